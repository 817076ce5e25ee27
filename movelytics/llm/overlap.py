"""Links between texts whose word-shingle sets have a Jaccard similarity of at least a threshold: the wide mode of simhash.

Texts that share four fifths of their five-word shingles differ in about ten of 64 SimHash bits; an index of one-wildcard
segments that reaches so far has keys of eight bits, which all texts share. So this mode finds candidates by banded
min-wise keys of the same shingles: with the numbers of rows and bands that banding() takes from the similarity, two texts
at the similarity itself share a key with a chance of 0.999 and more similar ones more surely. This is the only inexact
step. Texts that share a key are gathered to candidate clusters (by stars, never by pairs), together with candidates that
the caller knows of, and within a cluster a spanning forest is grown in which the exact Jaccard similarity decides every
link. Clusters above BLOCK texts are cut into block pairs. Texts without words have equal, empty sets: similarity 1.

Nulls: a null text has no words. Repeated rows and ties: rows of one text (one tk) count once. An empty table has no links.
A very long text is one set of 8 bytes a shingle. Other columns of src are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scan_groups, stash
from .components import components

BLOCK = 1024
#: Chance that two texts at the similarity itself share no band, and the most bands a text gets.
MISSED, MOST_BANDS = 1e-3, 30
_xx = xxhash.xxh3_64_intdigest


def banding(similarity: float) -> tuple[int, int]:
    """(rows, bands): the longest keys with which MOST_BANDS bands or fewer miss a pair at this similarity with a chance of MISSED at most."""
    if not 0.5 <= similarity <= 1:
        raise ValueError("bands are for a similarity from 0.5 to 1")
    need = lambda rows: 1 if similarity == 1 else math.ceil(math.log(MISSED) / math.log1p(-(similarity**rows)))
    rows = max(r for r in range(1, 13) if need(r) <= MOST_BANDS)
    return rows, need(rows)


def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n multipliers (odd) and offsets."""
    return np.random.default_rng(11).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.random.default_rng(12).integers(0, 2**63, n, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles (A-Z lower-cased); a short text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    return np.unique(np.fromiter(map(_xx, grams), np.uint64, len(grams)))


def minima(s: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    out = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(out, (s[i : i + 2048, None] * times + plus).min(axis=0), out=out)
    return out


def band_keys(m: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    n = len(m) // rows
    return np.fromiter((_xx(m[i * rows : (i + 1) * rows].tobytes(), i) for i in range(n)), np.uint64, n)


def _keys(src: DataFrame, similarity: float, shingle: int) -> DataFrame:
    rows, bands = banding(similarity)

    def run(batches):
        times, plus = _mixers(rows * bands)
        for b in batches:
            tk, keys = [], []
            for t, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tk.append(np.full(bands, t, np.int64))
                keys.append(band_keys(minima(shingle_set(x.as_py(), shingle), times, plus), rows).view(np.int64))
            if tk:
                yield pa.record_batch([pa.array(np.concatenate(tk)), pa.array(np.concatenate(keys))], names=["tk", "key"])

    return src.select("tk", "text").mapInArrow(run, "tk bigint, key bigint")


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning forest, as positions in sets, of all pairs at this Jaccard similarity or more; exact.

    The sets' elements are inverted once, so that one set's common elements with all others are counted by walking its own lists.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    at_code = np.argsort(code, kind="stable")
    holders = owner[at_code]
    first = np.concatenate(([0], np.cumsum(np.bincount(code)))) if len(code) else np.zeros(1, np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    left, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            at = queue.pop()
            mine = code[begin[at] : begin[at + 1]]
            lo, n = first[mine], first[mine + 1] - first[mine]
            walk = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(mine) else np.zeros(0, np.int64)
            both = np.bincount(holders[walk], minlength=len(sets))
            union = size + size[at] - both
            near = np.flatnonzero(left & ((both >= similarity * union) if size[at] else size == 0))
            left[near] = False
            out += [(at, i) for i in near.tolist()]
            queue += near.tolist()
    return out


def _forest(similarity: float, shingle: int):
    def grow(t: pa.Table):
        tk = t.column("tk").to_numpy()
        found = np.array(forest([shingle_set(x, shingle) for x in t.column("text").to_pylist()], similarity), np.int64).reshape(-1, 2)
        if len(found):
            yield pa.record_batch([pa.array(tk[found[:, 0]]), pa.array(tk[found[:, 1]])], names=["a", "b"])

    return grow


def _through_first(stars: DataFrame) -> DataFrame:
    """(a, b) text and hub -> fewer edges that join the same: a text hangs on its least hub, and that hub on the text's others.

    The texts of a large group have some thirty hubs each, and nearly all of them the same ones.
    """
    hubs = stars.groupBy("a").agg(F.min("b").alias("first"), F.collect_set("b").alias("hubs"))
    return hubs.select(F.explode(F.concat(F.array(F.struct(F.col("a"), F.col("first").alias("b"))), F.transform("hubs", lambda h: F.struct(F.col("first").alias("a"), h.alias("b"))))).alias("e")).select("e.*").where("a <> b").distinct()


def overlap_links(src: DataFrame, similarity: float, shingle: int, more: DataFrame | None = None) -> DataFrame:
    """src (tk, text) with tk the text's key -> (a, b): a spanning forest of the links between different texts.

    more: (a, b) further candidates, texts and hubs; like those of the bands they only say which texts are compared.
    """
    keys = stash(_keys(src, similarity, shingle).distinct(), "bands")
    shared = stash(keys.groupBy("key").agg(F.min("tk").alias("hub"), F.max("tk").alias("far")).where("hub < far").select("key", "hub"), "shared-bands")
    stars = keys.join(shared, "key").where("tk <> hub").select(F.col("tk").alias("a"), F.col("hub").alias("b"))
    clusters = components(_through_first(stars if more is None else stars.union(more))).toDF("tk", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    placed = stash(clusters.join(sizes, "cluster").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")), "clusters")
    # One row per text before the join, so that exact copies never meet with their texts.
    texts = src.dropDuplicates(["tk"]).join(placed, "tk")
    mine = F.pmod(F.xxhash64("tk"), F.col("nb")).cast("int")
    paired = (
        texts.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("cluster", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "tk", "text")
    )
    return cut(scan_groups(paired, ["cluster", "p", "q"], ["tk"], _forest(similarity, shingle), "a bigint, b bigint"))
