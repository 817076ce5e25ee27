"""The registered queries on a small fixture: against brute force where SQL can't express them, else against their SQL."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from movelytics.llm.queries import ORACLES, QUERIES

from ..compare import same
from .data import documents, texts, words
from .test_dedup import brute_components, brute_fingerprint, brute_substring
from .test_pieces import brute_likeness, brute_root


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All documents (repeated ids, null ids, clashing columns), and those of one row an id in `plain`."""
    import random

    rng, path = random.Random(5), tmp_path_factory.mktemp("tables")
    docs = documents(spark, extra=["line one\nshared line of many sites here\n" + words(rng, 30) for _ in range(12)])
    items = [(f"b{i}", t) for i, t in enumerate([words(rng, 12), " ".join((texts()[0]).split()[5:20]), "one", "", None])]
    pages = [(i, f"http://h{i % 3}.org/{i}", t) for i, t in enumerate(["x" * 1500] * 3 + ["short"] * 2 + [None, "", "é" * 600, "é" * 600])]
    for name in ("all", "plain"):
        (docs if name == "all" else docs.where("doc_id is not null").dropDuplicates(["doc_id"])).coalesce(1).write.parquet(f"{path}/{name}/documents.parquet")
        spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{path}/{name}/benchmark.parquet")
        spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{path}/{name}/pages.parquet")
    return path


def rows(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/all/documents.parquet").collect()]


def test_op1(spark, folder):
    known = [(d, brute_fingerprint(t)) for d, t in rows(spark, folder)]
    least = brute_components(known)
    got = QUERIES["op1_simhash"](spark, f"{folder}/all").collect()
    assert Counter((r["doc_id"], int(r["fingerprint"], 16)) for r in got) == Counter(known)
    assert all(len(r["fingerprint"]) == 16 and least[(r["doc_id"], int(r["fingerprint"], 16))] == r["component_id"] for r in got)


def test_op5(spark, folder):
    known = sorted(((d, t or "") for d, t in rows(spark, folder)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = Counter()
    for k, (d, a) in enumerate(known):
        b = known[(k + 1) % len(known)][1]
        q = len(a) // 4
        e = a[: len(a) - q] + b[:q]
        want[(d, len(a), hashlib.sha256(e.encode()).hexdigest(), brute_root(a), brute_root(e), round(brute_likeness(a, e), 12), round(brute_likeness(a, b), 12))] += 1
    got = QUERIES["op5_merkle"](spark, f"{folder}/all").collect()
    root = lambda fp: fp.partition("/")[0]
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], root(r["fingerprint"]), root(r["edited_fingerprint"]), round(r["near_edited"], 12), round(r["near_next"], 12)) for r in got) == want


def test_op6(spark, folder):
    got = QUERIES["op6_substring"](spark, f"{folder}/all").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_substring(rows(spark, folder)))


def test_op7(spark, folder):
    """Every piece holds the ids that the tokenizer gives its text, sequences are gapless and within 2048 tokens, and only long documents are cut."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/plain/documents.parquet").collect()}
    got = QUERIES["op7_packing"](spark, f"{folder}/plain").collect()
    sequences, total = {}, 0
    for d, t in known.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        assert len(mine) == -(-len(ids) // 2048) and all(r["length"] == 2048 for r in mine[1:])
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += len(ids)
    assert set(known) == {r["doc_id"] for r in got}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{folder}/plain/{t}.parquet/*.parquet')")
    got = QUERIES[name](spark, f"{folder}/plain").toPandas()
    if name == "op4_linededup":  # its SQL has no row for a null text, the operator has one without lines
        null = set(con.sql("select doc_id from documents where text is null").df().doc_id)
        bare = got[got.doc_id.isin(null)]
        assert len(bare) == len(null) > 0 and set(bare.kept_sha256) == {hashlib.sha256(b"").hexdigest()} and (bare.n_lines == 0).all() and (bare.n_removed == 0).all()
        got = got[~got.doc_id.isin(null)]
    same(got, con.sql(ORACLES[name]).df())
