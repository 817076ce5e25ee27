"""Substring dedup: seed and extend on winnowed anchors.

Seeds: of every window of WINDOW words the k-word gram with the least hash (the leftmost of equals) is its anchor, so
two documents that share a window share its anchor at the same place in it. Consecutive windows with one anchor form a
run; runs of equal words are one run, however many documents hold it, and meet in map-side minima.
Extend: documents are joined on anchors with the anchor's first holder, the document with the smallest id. From the anchor
each match grows word by word both ways as far as the two documents agree; of the maximal repeat found the windows of
WINDOW words or more are repeats. That join has a row for each different run, never one for each pair.
Rest: what a run does not share with the first holder it may share with another one. Those windows are compared by their
hashes at equal offsets from the anchor, so nothing depends on which holder came first. Behind a run's first document the
whole run is a repeat. The union of repeated windows is what a document loses.

Words are runs of anything but ASCII white space, unchanged. Nulls and empty texts: a null text has no words, like an empty
one; rows with a null id neither lose words nor make others lose any. Ties and repeated rows: rows that repeat an id and
text are treated alike; of rows that repeat an id none is smaller, so they don't repeat each other. A very long text is
hashed in one task, in pieces. An empty table gives an empty result. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_key

WINDOW = 50
GRAM = 8
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_CHUNK = 1 << 16


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _prefix(h: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_B, len(h)), dtype=np.uint64)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(prefix: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int, inverse: np.ndarray) -> np.ndarray:
    """Hash of words [start, start + size), independent of where they stand."""
    return _mix((prefix[starts + sizes] - prefix[starts]) * inverse[starts] + np.uint64(1) * np.asarray(sizes, np.uint64))


def runs(words: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Of one text: anchor hash, hash of the run's words, start of the run's first window, number of its windows."""
    n = len(words) - window + 1
    if n <= 0:
        return None
    h = word_hashes(words)
    prefix, inverse = _prefix(h), _powers(_B_INV, len(words) + 1)
    grams = span_hashes(prefix, np.arange(len(words) - gram + 1), gram, inverse)
    width = window - gram + 1
    at = np.empty(n, np.int64)
    for i in range(0, n, _CHUNK):
        part = np.lib.stride_tricks.sliding_window_view(grams[i : min(n, i + _CHUNK) + width - 1], width)
        at[i : i + _CHUNK] = part.argmin(axis=1) + np.arange(i, i + len(part))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    return grams[at[first]], span_hashes(prefix, first, count + window - 1, inverse), first, count, at[first] - first


def _grouped(anchor: np.ndarray, run: np.ndarray, start: np.ndarray, n: np.ndarray, lead: np.ndarray):
    """One entry per different run of a text, with all its places: a text that repeats a few words has one run thousands of times.

    Equal runs have equal words, so equal n and lead.
    """
    order = np.lexsort((start, run, anchor))
    a, r = anchor[order], run[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (r[1:] != r[:-1]))))
    return a[first], r[first], n[order][first], lead[order][first], np.diff(np.concatenate((first, [len(a)]))), start[order]


def _anchors(src: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                got = runs(split_words(b.column(2)[i].as_py()), window, gram)
                if got is not None:
                    out.append((i, *_grouped(*got)))
            if out:
                rows = pa.array(np.concatenate([np.full(len(x[1]), x[0]) for x in out]))
                anchor, run_, n, lead, size, starts = (np.concatenate([x[k] for x in out]) for k in range(1, 7))
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                cols = [b.column(0).take(rows), b.column(1).take(rows), pa.array(anchor.view(np.int64)), pa.array(run_.view(np.int64)), pa.array(n.astype(np.int16)), pa.array(lead.astype(np.int16)), pa.ListArray.from_arrays(offsets, pa.array(starts.astype(np.int32)))]
                yield pa.record_batch(cols, names=["id", "tk", "anchor", "run", "n", "lead", "starts"])

    kind = src.schema["id"].dataType.simpleString()
    return src.where("id is not null").mapInArrow(run, f"id {kind}, tk bigint, anchor bigint, run bigint, n smallint, lead smallint, starts array<int>")


def _contexts(asked: DataFrame, window: int) -> DataFrame:
    """asked (id, text, asks: array of (anchor, run, start, n, lead)) -> a row per asked run with the hashes of its words."""

    def go(batches):
        for b in batches:
            at, cols, hashes = [], [[] for _ in range(4)], []
            for i in range(b.num_rows):
                h = word_hashes(split_words(b.column(1)[i].as_py())).view(np.int64)
                for x in b.column(2)[i].as_py():
                    at.append(i)
                    for c, v in zip(cols, (x["anchor"], x["run"], x["n"], x["lead"]), strict=True):
                        c.append(v)
                    hashes.append(h[x["start"] : x["start"] + x["n"] + window - 1])
            if at:
                ends = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in hashes]))).astype(np.int32))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.record_batch([b.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes)))], names=["id", "anchor", "run", "n", "lead", "words"])

    return asked.mapInArrow(go, f"id {asked.schema['id'].dataType.simpleString()}, anchor bigint, run bigint, n int, lead int, words array<bigint>")


def agreement(x: np.ndarray, x_at: int, y: np.ndarray, y_at: int) -> tuple[int, int]:
    """How many words before, and from, these places agree: a seed grown both ways."""
    k, m = min(x_at, y_at), min(len(x) - x_at, len(y) - y_at)
    differ = np.flatnonzero(x[x_at - k : x_at][::-1] != y[y_at - k : y_at][::-1])
    left = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(x[x_at : x_at + m] != y[y_at : y_at + m])
    return left, int(differ[0]) if len(differ) else m


def _extend(paired: DataFrame, window: int) -> DataFrame:
    """paired: runs with the first holder's (words0, lead0, owner0) -> (id, anchor, run, n, lead, words, lo, hi, owner0): windows lo..hi-1 lie in the maximal repeat."""

    def go(batches):
        for b in batches:
            lead, lead0 = b.column(4).to_numpy(), b.column(6).to_numpy()
            count = b.column(3).to_numpy()
            lo, hi = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            w, w0 = b.column(5), b.column(7)
            for i in range(b.num_rows):
                left, right = agreement(w[i].values.to_numpy(), int(lead[i]), w0[i].values.to_numpy(), int(lead0[i]))
                if left + right >= window:
                    lo[i], hi[i] = lead[i] - left, min(int(count[i]), lead[i] + right - window + 1)
            yield pa.record_batch([*(b.column(i) for i in range(6)), pa.array(lo), pa.array(hi), b.column(8)], names=[*b.schema.names[:6], "lo", "hi", "owner0"])

    kind = paired.schema["id"].dataType.simpleString()
    columns = f"id {kind}, anchor bigint, run bigint, n int, lead int, words array<bigint>, lo int, hi int, owner0 {kind}"
    return paired.select("id", "anchor", "run", "n", "lead", "words", "lead0", "words0", "owner0").mapInArrow(go, columns)


def _rest(grown: DataFrame, window: int) -> DataFrame:
    """(id, anchor, run, rel, off, win): hashes of the windows of runs that lie outside of lo..hi-1."""

    def go(batches):
        for b in batches:
            rows, rels, offs, wins = [], [], [], []
            for i in range(b.num_rows):
                n, lo, hi = b.column(3)[i].as_py(), b.column(6)[i].as_py(), b.column(7)[i].as_py()
                rel = np.concatenate((np.arange(lo), np.arange(hi, n)))
                h = b.column(5)[i].values.to_numpy().view(np.uint64)
                wins.append(span_hashes(_prefix(h), rel, window, _powers(_B_INV, len(h) + 1)).view(np.int64))
                rows.append(np.full(len(rel), i))
                rels.append(rel.astype(np.int32))
                offs.append((b.column(4)[i].as_py() - rel).astype(np.int32))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.record_batch([*(b.column(i).take(take) for i in range(3)), *(pa.array(np.concatenate(c)) for c in (rels, offs, wins))], names=["id", "anchor", "run", "rel", "off", "win"])

    kind = grown.schema["id"].dataType.simpleString()
    return grown.select("id", "anchor", "run", "n", "lead", "words", "lo", "hi").mapInArrow(go, f"id {kind}, anchor bigint, run bigint, rel int, off int, win bigint")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, spans): word ranges [start, end) of each document that a document with a smaller id holds too."""
    src = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tk"), F.col(text_col).alias("text"))
    every = stash(_anchors(src, window, gram), "anchors")
    # Most anchors stand in one document only: no window of theirs is repeated.
    # (Written first, so that the join below reads two plain exchanges and Spark can split a hot anchor.)
    shared = stash(every.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor"), "shared-anchors")
    found = stash(every.join(shared, "anchor"), "seeds")
    one = F.struct("id", "tk", F.col("starts")[0].alias("start"), F.col("n").cast("int").alias("n"), F.col("lead").cast("int").alias("lead"))
    by_run = found.groupBy("anchor", "run").agg(F.min(one).alias("first"), F.max("id").alias("last"))
    by_run = stash(by_run.select("anchor", "run", "first", "last", F.col("first.id").alias("owner")), "runs")
    # Anchors with several runs: what holds for a run's first document holds wherever the run stands.
    many = by_run.groupBy("anchor").agg(F.count("*").alias("k"), F.min(F.struct("owner", "run")).alias("holder"), F.max("owner").alias("hi")).where("k > 1 and holder.owner < hi")
    many = stash(many.select("anchor", F.col("holder.owner").alias("owner0"), F.col("holder.run").alias("run0")), "holders")
    asks = by_run.join(many.select("anchor"), "anchor").select("first.id", "first.tk", F.struct("anchor", "run", "first.start", "first.n", "first.lead").alias("ask"))
    asks = asks.groupBy("id", "tk").agg(F.collect_list("ask").alias("asks"))
    runs_of = stash(_contexts(src.join(asks, ["id", "tk"]).select("id", "text", "asks"), window), "contexts")
    holder = stash(runs_of.join(many.withColumnRenamed("run0", "run"), ["anchor", "run"]).select("anchor", F.col("run").alias("run0"), "owner0", F.col("lead").alias("lead0"), F.col("words").alias("words0")), "holder-contexts")
    paired = runs_of.join(holder, "anchor").where("run <> run0")
    grown = stash(_extend(paired, window), "grown")
    extended = grown.where("id > owner0 and hi > lo").select("anchor", "run", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("rel"))
    # A window outside of the maximal repeat is compared with the other runs'; the first holder's own windows were compared with all.
    wins = stash(_rest(grown.where("lo > 0 or hi < n"), window), "windows")
    least = wins.groupBy("anchor", "off", "win").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("last > owner").drop("last")
    single = wins.join(least, ["anchor", "off", "win"]).where(F.col("id") > F.col("owner"))
    parts = extended.union(single.select("anchor", "run", "rel")).groupBy("anchor", "run").agg(F.collect_set("rel").alias("rels"))
    held = by_run.join(parts, ["anchor", "run"], "left").where("last > owner or rels is not null").select("anchor", "run", "owner", "rels")
    # Behind the run's first document the whole run is a repeat; in that document only the windows found above.
    hits = found.join(held, ["anchor", "run"]).where("id > owner or rels is not null")
    whole = F.transform("starts", lambda x: F.struct(x.alias("start"), (x + F.col("n") + F.lit(window - 1)).alias("end")))
    single_windows = F.flatten(F.transform("starts", lambda x: F.transform("rels", lambda r: F.struct((x + r).alias("start"), (x + r + F.lit(window)).alias("end")))))
    spans = hits.select("id", "tk", F.when(F.col("id") > F.col("owner"), whole).otherwise(single_windows).alias("spans"))
    return spans.groupBy("id", "tk").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _covered(n: int, spans: list[dict]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(edge, [s["start"] for s in spans], 1)
        np.add.at(edge, [s["end"] for s in spans], -1)
    return np.cumsum(edge)[:n] > 0


def _kept(text: str | None, spans: list[dict] | None) -> tuple[int, int, bytes]:
    words = split_words(text)
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = _covered(len(words), spans)
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row."""

    def run(batches):
        for b in batches:
            rows = [_kept(b.column(1)[i].as_py(), b.column(2)[i].as_py()) for i in range(b.num_rows)]
            sums = [hashlib.sha256(r[2]).hexdigest() for r in rows]
            yield pa.record_batch([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(sums, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    joined = _with_spans(docs, window, gram, id_col, text_col)
    return joined.mapInArrow(run, f"id {joined.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string")


def _with_spans(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    spans = stash(repeats(docs, window, gram, id_col, text_col), "repeats").toDF("__id", "__tk", "__spans")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.join(spans, (src["id"] == F.col("__id")) & (text_key("text") == F.col("__tk")), "left").select("id", "text", "__spans")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the texts that are left, kept words joined by one space."""

    def run(batches):
        for b in batches:
            left = [_kept(b.column(1)[i].as_py(), b.column(2)[i].as_py())[2].decode("utf-8", "surrogatepass") for i in range(b.num_rows)]
            yield pa.record_batch([b.column(0), pa.array(left, pa.string())], names=["id", "text"])

    joined = _with_spans(docs, window, gram, id_col, text_col)
    return joined.mapInArrow(run, f"id {joined.schema['id'].dataType.simpleString()}, text string")
