"""SimHash near-duplicate detection with deletion-variant (one-wildcard segment) signatures.

Fingerprint: 64 bits over k-word shingles (XXH64, seed 42), a bit set when it is set in over half of the shingles.
Candidates: two fingerprints at Hamming distance <= 3 agree, in at least one of two 32-bit segments, up to one bit.
Each fingerprint is indexed under both segments and under their one-wildcard variants. A wildcard is written as a
cleared bit, so a segment whose bit is already 0 is its own variant and is stored once: about 2 + 32 index rows.
An equality join of index keys finds the candidates and each is verified on all 64 bits. Only a spanning forest
leaves a bucket, never all its pairs; a bucket above BLOCK members is cut into block pairs that run as separate tasks.

Nulls and empty texts: a null text has no words, like an empty one: fingerprint zero. A null id takes part, but is never a
component id unless nothing else is reachable. Rows that repeat an id keep their own fingerprints and are all returned.
Ties: of several smallest nodes there is one id. A very long text is hashed in pieces of 32,768 shingles. An empty table
gives an empty result. Other columns, whatever their names, are never read; one_per_group keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, scan_groups, stash, text_key
from .components import components
from .overlap import overlap_links

BLOCK = 4096
MAX_BITS = 3
_xx = xxhash.xxh64_intdigest


def fingerprint64(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text: A-Z lower-cased, words split at ASCII white space, shingles space-joined."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    buf = b" ".join(words)
    if n <= shingle:
        return _xx(buf, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    m = len(starts)
    h = np.fromiter((_xx(buf[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, m)
    counts = np.zeros(64, np.int64)
    for i in range(0, m, 32768):
        bits = np.unpackbits(h[i : i + 32768].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, tk, fp): one row per input row; tk tells apart texts under one id, fp holds the 64 bits as a signed bigint."""

    def run(batches):
        for b in batches:
            col, fps = b.column(2), np.empty(b.num_rows, np.uint64)
            for i in range(b.num_rows):
                fps[i] = fingerprint64(col[i].as_py(), shingle)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "tk", "fp"])

    src = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tk"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, tk bigint, fp bigint")


def _forest(t: pa.Table):
    """Spanning forest of the links within one bucket (or pair of blocks), breadth first: at most one row per member."""
    left = np.unique(t.column("fp").to_numpy()).view(np.uint64)
    a, b = [], []
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            hit = np.bitwise_count(left ^ at) <= MAX_BITS
            found = left[hit]
            if found.size:
                a.append(np.full(found.size, at))
                b.append(found)
                queue.extend(found)
                left = left[~hit]
    if a:
        yield pa.record_batch([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])


def variants(fps: DataFrame) -> DataFrame:
    """Index rows (seg, key, fp, own): both segments of each distinct fp, and each with one set bit cleared."""
    segs = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    cleared = "filter(transform(sequence(0, 31), j -> if(shiftright(v, j) & 1 = 1, v & ~shiftleft(1L, j), -1L)), k -> k >= 0)"
    return (
        fps.select("fp", F.posexplode(segs).alias("seg", "v"))
        .select("fp", F.col("seg").cast("tinyint").alias("seg"), "v", F.explode(F.expr(f"concat(array(v), {cleared})")).alias("key"))
        .select("seg", "key", "fp", (F.col("key") == F.col("v")).alias("own"))
    )


def links(fps: DataFrame) -> DataFrame:
    """(a, b): fingerprints within MAX_BITS bits; a spanning forest of each bucket, which joins all that all pairs would join."""
    every = stash(variants(fps), "variants")
    # A bucket counts only if a member stands in it with its whole segment: two cleared segments differ by up to two bits.
    full = stash(every.groupBy("seg", "key").agg(F.count("*").alias("n"), F.max("own").alias("whole")).where("n > 1 and whole").select("seg", "key", "n"), "buckets")
    index = every.join(full, ["seg", "key"]).select("seg", "key", "fp", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    paired = (
        index.withColumn("nb", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("seg", "key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "fp")
    )
    return scan_groups(paired, ["seg", "key", "p", "q"], [], _forest, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, tk, fp, component_id): component_id is the smallest id reachable over links of at most MAX_BITS bits."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = marked.groupBy("fp").agg(F.min("id").alias("first"))
    edges = cut(links(distinct.select("fp")))
    labels = components(edges).toDF("fp", "label")
    # Only linked fingerprints carry a label; the others are their own component.
    named = distinct.join(labels, "fp")
    least = named.groupBy("label").agg(F.min("first").alias("linked"))
    linked = named.join(least, "label").select("fp", "linked")
    # Written first: the last join then reads two plain exchanges, and Spark can split a fingerprint that many rows share.
    whole = stash(distinct.join(linked, "fp", "left").select("fp", F.coalesce("linked", "first").alias("component_id")), "classes")
    return marked.join(whole, "fp").select("id", "tk", "fp", "component_id")


def similar(docs: DataFrame, similarity: float, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, tk, component_id): components of the links between texts of at least this Jaccard similarity of their shingles.

    Candidates are the bands of the wide mode (see overlap) and, besides them, the texts that near_duplicates joins; its
    links of at most MAX_BITS bits are no links here before the exact similarity has decided.
    """
    found = cut(near_duplicates(docs, id_col, text_col, shingle))
    src = docs.select(text_key(text_col).alias("tk"), F.col(text_col).alias("text"))
    # Texts of one component hang on its smallest text.
    group = F.xxhash64(F.lit("class"), F.col("component_id").isNull(), "component_id", F.when(F.col("component_id").isNull(), F.col("fp")))
    named = found.select("tk", group.alias("g")).distinct()
    hubs = stash(named.groupBy("g").agg(F.min("tk").alias("hub")), "hubs")
    stars = named.join(hubs, "g").where("tk <> hub").select(F.col("tk").alias("a"), F.col("hub").alias("b"))
    labels = components(overlap_links(src, similarity, shingle, stars)).toDF("tk", "label")
    both = found.join(labels, "tk", "left").withColumn("label", F.coalesce("label", "tk"))
    least = stash(both.groupBy("label").agg(F.min("id").alias("component_id")), "least-ids")
    return both.drop("component_id").join(least, "label").select("id", "tk", "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """docs without near-duplicates: of each component the document with the smallest id stays, all columns kept.

    similarity: texts are linked by at least this Jaccard similarity of their shingles instead of by fingerprints. Rows that repeat the kept id
    within its group are that same document and stay together; if all ids of a group are null, all its rows stay.
    """
    if similarity is None:
        found = near_duplicates(docs, id_col, text_col, shingle)
    else:
        found = similar(docs, similarity, id_col, text_col, shingle)
    i, k = free_name(docs, "__dup_id"), free_name(docs, "__dup_tk")
    drop = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(i), F.col("tk").alias(k)).distinct()
    same = docs[id_col].eqNullSafe(drop[i]) & (text_key(text_col) == drop[k])
    return docs.join(drop, same, "left_anti")
