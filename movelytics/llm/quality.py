"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled good documents; unlabelled text is drawn from all documents. The class prior is the
smallest ratio, over score tails, of the unlabelled to the positive share (corrected for sample noise), and a small
network is fitted by minimising  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  with the logistic loss.

Nulls and empty texts: a null text scores like an empty one. Without a trusted positive or any document, an empty table
among them, the model is the constant prior. Very long texts are looked at whole. Ties and repeated rows: every row is
scored by its own text; of several labels of one id the largest counts. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share_of_hash, stash
from .toxicity import sample_labelled

SAMPLE = 10_000
HIDDEN, EPOCHS, BATCH, SEED = 24, 60, 500, 7
_SYMBOLS = re.compile(r"[#$%&*|<>{}\[\]\\^~=+_@]")
_BANG = re.compile(r"[!?]{2,}|!")
N_FEATURES = 22


def features(text: str | None) -> list[float]:
    """Shape of a text, from the whole text: lengths, character classes, repetition, compressibility."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = Counter(zip(words, words[1:], strict=False))
    upper = sum(map(str.isupper, words))
    edge = sum(1 for w in words if len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum())
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / m,
        max(map(len, words), default=0) ** 0.5,
        sum(c.isupper() for c in text if c.isalpha()) / n if not text.islower() else 0.0,
        upper / m,
        len(re.findall(r"\d", text)) / n,
        len(_SYMBOLS.findall(text)) / n,
        len(_BANG.findall(text)) / m,
        text.count("|") / m,
        (text.count(",") + text.count(".")) / m,
        edge / m,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        len(pairs) / max(1, len(words) - 1),
        max(pairs.values(), default=0) / m,
        np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        len(text) / max(1, len(lines)) / 100,
        len(zlib.compress(raw, 1)) / (len(raw) + 40),
        sum(1 for w in words if len(w) <= 3) / m,
        sum(1 for w in words if w[0].isupper()) / m,
    ]


@dataclass
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    net: tuple[np.ndarray, ...] | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        w1, b1, w2, b2 = self.net
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _train(p: np.ndarray, u: np.ndarray, prior: float, epochs: int) -> tuple[np.ndarray, ...]:
    """Minimise the non-negative risk by Adam; where the negative part turns below zero its gradient is reversed."""
    rng = np.random.default_rng(SEED)
    w = [rng.normal(0, 0.3, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m1, m2, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    steps = max(1, len(u) // BATCH)
    for epoch in range(epochs):
        rate = 5e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        ip, iu = rng.permutation(len(p)), rng.permutation(len(u))
        for s in range(steps):
            bp, bu = p[np.take(ip, np.arange(s * BATCH, s * BATCH + min(BATCH, len(p))), mode="wrap")], u[iu[s * BATCH : (s + 1) * BATCH]]
            x = np.vstack([bp, bu])
            h = np.tanh(x @ w[0] + w[1])
            g = h @ w[2] + w[3]
            sig = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            k, r = len(bp), len(bu)
            minus = np.logaddexp(0, g)  # loss of calling it negative
            negative = minus[k:].mean() - prior * minus[:k].mean()
            d = np.zeros(len(x))
            if negative >= 0:
                d[:k] = prior * (sig[:k] - 1) / k - prior * sig[:k] / k
                d[k:] = sig[k:] / r
            else:
                d[:k], d[k:] = prior * sig[:k] / k, -sig[k:] / r
            dh = np.outer(d, w[2]) * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            t += 1
            for i, gr in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * gr
                m2[i] = 0.999 * m2[i] + 0.001 * gr * gr
                w[i] = w[i] - rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in u: unlabelled = prior * positive + rest, so it is at most any tail's ratio of shares."""
    cuts = np.quantile(p, np.linspace(0.0, 0.85, 60))
    slack = np.sqrt(np.log(60) / len(u)) / 2 + np.sqrt(np.log(60) / len(p)) / 2
    ratios = [((u >= c).mean()) / max(1e-9, (p >= c).mean()) + slack * (1 - (p >= c).mean()) for c in cuts]
    return float(np.clip(min(ratios), 0.02, 0.98))


def _sampled(docs: DataFrame, labels: DataFrame, keep: Column, sample: int) -> tuple[np.ndarray, np.ndarray]:
    n = docs.count()
    loose = docs.where(share_of_hash(min(1.0, sample / max(1, n)), F.lit("unlabelled"), "doc_id", F.length("text"))).select("text", F.lit(0).alias("trusted"))
    good = sample_labelled(docs, labels.where("quality = 1"), "quality", keep, sample).select("text", F.lit(1).alias("trusted"))

    def run(batches):
        for b in batches:
            f = np.array([features(t.as_py()) for t in b.column(0)], float).reshape(-1, N_FEATURES)
            yield pa.record_batch([pa.array(list(f), pa.list_(pa.float64())), b.column(1)], names=["f", "trusted"])

    rows = stash(loose.union(good).mapInArrow(run, "f array<double>, trusted int"), "quality-sample").collect()
    x, t = np.array([r["f"] for r in rows], float).reshape(-1, N_FEATURES), np.array([r["trusted"] for r in rows], int)
    return x[t == 1], x[t == 0]


def fit(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most about `sample` trusted positives (labels that pass keep) and as many unlabelled documents."""
    p, u = _sampled(docs, labels, keep, sample)
    if not len(p) or not len(u):
        return Model(0.5, np.zeros(N_FEATURES), np.ones(N_FEATURES))
    order = np.lexsort(p.T)
    p, u = p[order], u[np.lexsort(u.T)]  # rows arrive in any order
    both = np.vstack([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    first = Model(0.5, mean, scale, _train(zp, zu, 0.5, EPOCHS // 3))
    prior = estimate_prior(first.logits(p), first.logits(u))
    return Model(prior, mean, scale, _train(zp, zu, prior, EPOCHS))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)], float).reshape(-1, N_FEATURES)
            yield pa.record_batch([b.column(0), pa.array(shared.value.score(x), pa.float64())], names=["id", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")
