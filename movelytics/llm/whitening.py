"""Whitening of embeddings: QDWH spectral divide and conquer of their covariance.

The covariance of the distinct vectors is summed exactly in integers. It is split by its spectrum: the polar factor U of
the matrix less a shift (dynamically weighted Halley iteration, by QR while the weights are large, by Cholesky then) has
the eigenvalues +1 and -1, so (I + U) / 2 projects on the invariant subspace above the shift; an orthonormal basis of
that subspace and of its complement cuts the matrix in two, and each part is split again down to single components.
The components travel to the executors in a broadcast of d * k doubles.

Nulls: rows whose vector is null, empty, or holds a null or non-finite entry go; a null id is kept. Very long vectors
are bounded by the covariance alone (d * d doubles on the driver). Ties: equal vectors count once in the fit, each row
has its own result; equal eigenvalues may share any basis of their subspace. An eigenvalue of zero (all vectors equal
along it, a single vector among them) gives whitened 0 and takes no part in identity_error, which is 0 without any other
component. An empty table gives no rows. Vectors of different lengths are an error. Other columns, whatever their names,
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .vectors import matrix, whole

EPS = np.finfo(float).eps
SEED = 11


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH: its eigenvalues' signs on its eigenvectors."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 2) * 1.1)
    except np.linalg.LinAlgError:
        low = EPS
    low = float(min(max(low, EPS), 1.0))
    eye = np.eye(n)
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            y = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            w = np.linalg.cholesky(eye + wc * (x.T @ x))
            y = wb / wc * x + (wa - wb / wc) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        y = (y + y.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved, x = np.linalg.norm(y - x), y
        if moved < (5 * EPS) ** (1 / 3) and abs(1 - low) < 10 * EPS:
            break
    return x


def _bases(above: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector of rank k and of its complement."""
    q, _ = np.linalg.qr(above @ rng.standard_normal((len(above), k)), mode="complete")
    q, _ = np.linalg.qr(above @ q[:, :k], mode="complete")
    return q[:, :k], q[:, k:]


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, by spectral divide and conquer."""
    rng, norm = np.random.default_rng(SEED), np.linalg.norm(v)
    values, vectors, todo = [], [], [(v, np.eye(len(v)))]
    while todo:
        a, basis = todo.pop()
        n = len(a)
        flat = np.linalg.norm(a - np.eye(n) * (np.trace(a) / n))
        if n == 1 or flat <= n * EPS * norm:
            values.extend(np.diag(a))
            vectors.extend(basis.T)
            continue
        diagonal, best = np.sort(np.diag(a)), None
        spread = np.sqrt(flat * flat / n)
        # the mean of the eigenvalues always parts them; the others serve where it meets one of them or parts them badly
        for shift in (np.median(diagonal), diagonal.mean(), diagonal.mean() + spread / 7, diagonal.mean() - spread / 7, diagonal.mean() + spread / 29):
            above = (np.eye(n) + polar(a - shift * np.eye(n))) / 2
            k = round(float(np.trace(above)))
            if not 0 < k < n:
                continue
            upper, lower = _bases(above, k, rng)
            rest = np.linalg.norm(lower.T @ a @ upper)
            if best is None or rest < best[0]:
                best = rest, upper, lower
            if rest <= 10 * n * EPS * norm:
                break
        if best is None or best[0] > 1e-10 * norm:
            raise ArithmeticError("a part of the spectrum could not be split")
        for part in best[1:]:
            b = part.T @ a @ part
            todo.append(((b + b.T) / 2, basis @ part))
    order = np.argsort(values, kind="stable")[::-1]
    return np.array(values)[order], np.array(vectors).T[:, order]


@dataclass
class Whitener:
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray  # d x k
    trace: float
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows: centred exactly, as n * x - S, before the projection."""
        centred = (self.n * x - np.array(self.sums, x.dtype)).astype(float) / self.n
        return centred @ (self.components * np.array([1 / np.sqrt(e) if e > 0 else 0.0 for e in self.values]))


def _batches(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield matrix(b.column(0), d)


def _moments(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, sums, and sums of products, all exact: products of whole numbers below 2^53 are exact in doubles, too."""

    def run(batches):
        total = [[0] * (d + 1) for _ in range(d + 1)]
        for x in _batches(batches, d):
            m = int(np.abs(x).max())
            if m >= 1 << 31:
                raise OverflowError("entries beyond 2^31 / 256 have no exact covariance here")
            rows = np.hstack([np.ones((len(x), 1), np.int64), x])
            step = max(1, (1 << 53) // max(1, m * m))
            for at in range(0, len(rows), step):
                part = rows[at : at + step].astype(float)
                prod = (part.T @ part).astype(np.int64).tolist() if m < 1 << 26 else (rows[at : at + step].astype(object).T @ rows[at : at + step].astype(object)).tolist()
                total = [[s + p for s, p in zip(ts, ps, strict=True)] for ts, ps in zip(total, prod, strict=True)]
        i, j = np.triu_indices(d + 1)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([total[a][b] for a, b in zip(i, j, strict=True)], pa.int64())], names=["i", "j", "s"])

    found = fit.mapInArrow(run, "i int, j int, s bigint").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # (d + 1) * (d + 2) / 2 rows
    full = [[0] * (d + 1) for _ in range(d + 1)]
    for r in found:
        full[r["i"]][r["j"]] = full[r["j"]][r["i"]] = r["s"]
    return full[0][0], full[0][1:], [row[1:] for row in full[1:]]


def _identity_error(fit: DataFrame, d: int, model: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components of a positive eigenvalue."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return 0.0
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        k = len(live)
        total, products = np.zeros(k), np.zeros((k, k))
        for x in _batches(batches, d):
            w = shared.value.project(x)[:, live]  # centred already: their mean is a rounding error
            total, products = total + w.sum(0), products + w.T @ w
        both = np.vstack([total, products])
        i, j = np.indices(both.shape)
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(both.ravel(), pa.float64())], names=["i", "j", "s"])

    got = np.zeros((len(live) + 1, len(live)))
    for r in fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r["i"], r["j"]] = r["s"]
    mean = got[0] / model.n
    return float(np.abs(got[1:] / model.n - np.outer(mean, mean) - np.eye(len(live))).max())


def fit(vectors: DataFrame, k: int, vector_col: str = "embedding") -> Whitener | None:
    """The first k components of the distinct whole-number vectors; None without any."""
    distinct = stash(whole(vectors, [], vector_col).distinct(), "fit-list")
    first = distinct.first()
    if first is None:
        return None
    d = len(first["x"])
    n, sums, products = _moments(distinct, d)
    v = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])  # whole numbers until the division
    values, components = spectrum(v) if v.any() else (np.zeros(d), np.eye(d))
    trace = float(np.trace(v))
    values = np.where(values > d * EPS * trace, values, 0.0)[:k]
    model = Whitener(n, sums, values, components[:, :k], trace)
    model.error = _identity_error(distinct, d, model)
    return model


def whiten(vectors: DataFrame, model: Whitener | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of each kept row: whitened and explained are arrays over the components.

    deviation is the sum over dimensions of (n * x - S)^2, a decimal of 38 digits.
    """
    src = whole(vectors, [F.col(id_col).alias("id")], vector_col)
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, squares bigint, crossed bigint, whitened array<double>"
    if model is None:
        made = src.where("false").selectExpr("id", "0L as squares", "0L as crossed", "array(0d) as whitened")
        model = Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    else:
        shared = src.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            m = shared.value
            s = np.array(m.sums, np.int64)
            for b in batches:
                x = matrix(b.column(1), len(s))
                w = m.project(x)
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
                yield pa.record_batch([b.column(0), pa.array((x * x).sum(1)), pa.array(x @ s), lists], names=["id", "squares", "crossed", "whitened"])

        made = src.mapInArrow(run, schema)
    n, r = model.n, sum(s * s for s in model.sums)
    # sum (n x - S)^2 = n^2 sum x^2 - 2 n sum x S + sum S^2, each term whole
    deviation = F.expr(f"cast(cast({n * n} as decimal(38,0)) * squares - cast({2 * n} as decimal(38,0)) * crossed + cast('{r}' as decimal(38,0)) as decimal(38,0))")
    explained = F.array(*[F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.values])
    return made.select("id", F.lit(n).cast("long").alias("n"), deviation.alias("deviation"), "whitened", explained.alias("explained"), F.lit(model.error).alias("identity_error"))
