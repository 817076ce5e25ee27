"""Product codes of embeddings by exact integer distances in the Walsh-Hadamard domain.

Each of 16 parts is padded with zeros to a power of two, P, and transformed by an unnormalised Walsh-Hadamard transform,
which is whole-numbered and multiplies every squared distance by P. The squared differences are summed up coefficient
by coefficient in sequency order; an entry whose partial sum already exceeds the full distance to the entry that leads
after the first coefficient can't be nearest and is dropped. Sums are exact, so ties fall to the lower index.

Nulls: rows whose vector is null, empty, or holds a null or non-finite entry go; null ids come last when codebooks start,
null labels are one label. Vectors whose length is no multiple of 16 are padded with zeros at the end. Of rows that share
an id, the least vector comes first; each row has its own code. Fewer than 64 rows give as many entries. An empty table
gives no rows. Vectors of different lengths are an error. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .vectors import matrix, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SALTS = 32
#: Totals by label up to this many rows are broadcast (a label and a sum each); beyond it the join is salted.
BROADCAST_ROWS = 10_000


def walsh(x: np.ndarray) -> np.ndarray:
    """Whole-numbered Walsh-Hadamard transform of the last axis (a power of two long), in sequency order."""
    p = x.shape[-1]
    step = 1
    while step < p:
        y = x.reshape(*x.shape[:-1], p // (2 * step), 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x[..., _sequency(p)]


def _sequency(p: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix in the order of their sign changes: bit-reversed Gray codes."""
    bits = p.bit_length() - 1
    return np.array([int(format(i ^ (i >> 1), f"0{bits}b")[::-1], 2) if bits else 0 for i in range(p)])


def _power(width: int) -> int:
    return 1 << max(0, width - 1).bit_length()


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    """x with zeros at the end of its last axis (numpy's pad mixes number types where x holds Python's)."""
    return np.concatenate([x, np.zeros((*x.shape[:-1], width - x.shape[-1]), x.dtype)], -1)


def split(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as (row, part, padded position)."""
    width = -(-x.shape[1] // parts)
    return _padded(_padded(x, parts * width).reshape(len(x), parts, width), _power(width))


def nearest(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of ties) and the squared distance, of transformed rows to transformed entries."""
    p = t.shape[1]
    first = (t[:, :1] - c[:, 0]) ** 2
    lead = first.argmin(1)
    bound = ((t - c[lead]) ** 2).sum(1)
    r, e = np.nonzero(first <= bound[:, None])
    acc = first[r, e]
    for j in range(1, p):
        acc = acc + (t[r, j] - c[e, j]) ** 2
        alive = acc <= bound[r]
        r, e, acc = r[alive], e[alive], acc[alive]
    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))  # the leader of each row is always left
    least = np.minimum.reduceat(acc, starts)
    hit = np.flatnonzero(acc == least[r])
    _, at = np.unique(r[hit], return_index=True)
    return e[hit[at]], least // p


def _exact(x: np.ndarray, books: np.ndarray) -> type:
    """64-bit integers where no sum can overflow, Python's beyond."""
    p = _power(books.shape[2])
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    return np.int64 if (2 * most * p) ** 2 * p < 1 << 62 else object


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) indexes and squared distances of whole-numbered rows to books (part, entry, position)."""
    kind = _exact(x, books)
    t = walsh(split(x.astype(kind), books.shape[0]))
    c = walsh(_padded(books.astype(kind), t.shape[2]))
    found = [nearest(t[:, m], c[m]) for m in range(books.shape[0])]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def first_books(src: DataFrame, parts: int, entries: int) -> tuple[np.ndarray, int] | None:
    """Codebooks of the rows with the smallest ids, and the dimension; None without rows. A top-k, `entries` rows large."""
    rows = src.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    if not rows:
        return None
    x = np.array([r["x"] for r in rows], np.int64)
    width = -(-x.shape[1] // parts)
    return np.moveaxis(split(x, parts)[:, :, :width], 0, 1).copy(), x.shape[1]


def improved(src: DataFrame, books: np.ndarray, d: int) -> np.ndarray:
    """One round: every part goes to its nearest entry; entries become the floor of their parts' mean, unused ones stay."""
    shared = src.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        b = shared.value
        parts, entries, width = b.shape
        sums, counts = np.zeros(b.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), d)
            index, _ = assign(x, b)
            cut = split(x, parts)[:, :, :width]
            for m in range(parts):
                np.add.at(sums[m], index[:, m], cut[:, m])
                counts[m] += np.bincount(index[:, m], minlength=entries)
        m, e = np.nonzero(counts)
        yield pa.record_batch([pa.array(m, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[m, e]), pa.array(list(sums[m, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    totals = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(books.shape[2])]
    out = books.copy()
    for r in src.mapInArrow(run, "part int, entry int, n bigint, s array<bigint>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # at most parts * entries rows
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books.shape[2])]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _with_label_error(coded: DataFrame) -> DataFrame:
    """coded with the sum of error over rows of equal label. A hot label is salted where totals are too many to broadcast."""
    totals = stash(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    if totals.count() <= BROADCAST_ROWS:
        named = F.broadcast(totals.withColumnRenamed("label", "of"))
        return coded.join(named, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    spread = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_of"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of"))).drop("of", "salt", "salt_of")


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of each kept row; code has two hex digits a part."""
    if entries > 256:
        raise ValueError("an index has two hex digits: at most 256 entries")
    src = whole(vectors, [F.col(id_col).alias("id"), F.col(label_col).alias("label")], vector_col)
    kinds = [src.schema[c].dataType.simpleString() for c in ("id", "label")]
    began = first_books(src, parts, entries)
    if began is None:
        return src.where("false").selectExpr("id", "label", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    books, d = began
    bare = src.select("id", "x")
    for _ in range(rounds):
        books = improved(bare, books, d)
    shared = src.sparkSession.sparkContext.broadcast(books)
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for b in batches:
            index, far = assign(matrix(b.column(2), d), shared.value)
            code = ["".join(row) for row in hexes[index.astype(int)]]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(far.sum(1).tolist(), pa.int64())], names=["id", "label", "code", "error"])

    coded = stash(src.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code string, error bigint"), "codes")
    return _with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books)))
