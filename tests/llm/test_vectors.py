"""Whitening and product codes against numpy and brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from movelytics.llm import codes, whitening
from movelytics.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, x string, error string, part int"


def vectors(n=150, d=32, seed=4):
    """Common vectors, copies, a stretched direction, and rows that are dropped."""
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.1) * (4 if i == 3 else 1) for i in range(d)] for _ in range(n)]
    rows = [(i, v, i % 5 if i % 7 else None) for i, v in enumerate(base)]
    rows += [(i, base[0], 3) for i in range(n, n + 60)] + [rows[0], rows[0], (5, base[9], 1), (None, base[3], None), (n + 100, [-0.0] * d, 2)]
    gone = [(900, None, 1), (901, [float("nan"), *base[0][1:]], 1), (902, [float("inf"), *base[0][1:]], None), (903, [None, *base[0][1:]], 1), (904, [], 1)]
    return [(*r, "i", "x", "e", 1) for r in [*gone, *rows]]


def whole(rows):
    """(id, label, x) of the rows that stay."""
    out = []
    for r in rows:
        v = r[1]
        if v and all(e is not None and math.isfinite(e) for e in v):
            out.append((r[0], r[2], tuple(math.floor(256 * float(np.float32(e))) for e in v)))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame(vectors(), SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_op11(spark, folder):
    kept = whole(vectors())
    distinct = sorted({x for _, _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in distinct], float) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    got = QUERIES["op11_whitening"](spark, folder).collect()
    assert set(got[0].asDict()) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-12
    want = Counter((i, k, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, _, x in kept for k in (1, 2, 3, 4))
    assert Counter((r["vec_id"], r["component"], r["deviation"]) for r in got) == want
    signs = {}
    exact = {i: (np.array([n * a - s for a, s in zip(x, sums, strict=True)], float) / n) @ q[:, :4] / np.sqrt(e[:4]) for i, _, x in kept if i not in (5, None)}
    for r in got:
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-10
        if r["vec_id"] in exact:
            w = exact[r["vec_id"]][r["component"] - 1]
            if abs(w) > 1e-6:
                assert signs.setdefault(r["component"], np.sign(w * r["whitened"])) == np.sign(w * r["whitened"])
            assert abs(abs(w) - abs(r["whitened"])) < 1e-9


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_spectrum(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    for values in (rng.random(d), np.round(rng.random(d) * 3), 10.0 ** -np.arange(d), np.r_[1e6, np.ones(d - 1)], np.zeros(d)):
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        e, p = whitening.spectrum(v)
        scale = max(1e-300, np.abs(values).max())
        assert np.allclose(e, np.sort(values)[::-1], atol=1e-12 * scale) and np.abs(v @ p - p * e).max() <= 1e-12 * scale and np.abs(p.T @ p - np.eye(d)).max() < 1e-12


def test_polar_has_signs():
    a = np.diag([3.0, 1e-9, -1e-9, -2.0])
    assert np.allclose(whitening.polar(a), np.diag([1.0, 1, -1, -1]), atol=1e-6)


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert whitening.whiten(make([]), whitening.fit(make([]), 4)).count() == 0
    assert whitening.whiten(make([(1, None)]), whitening.fit(make([(1, None)]), 4)).columns == ["id", "n", "deviation", "whitened", "explained", "identity_error"]
    one = make([(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert {tuple(r["whitened"]) for r in whitening.whiten(one, whitening.fit(one, 4)).collect()} == {(0.0, 0.0)}
    flat = make([(i, [0.5, float(i)]) for i in range(5)])
    got = whitening.whiten(flat, whitening.fit(flat, 4)).orderBy("id").collect()
    assert [round(abs(r["whitened"][0]), 9) for r in got] == [1.414213562, 0.707106781, 0.0, 0.707106781, 1.414213562] and {r["whitened"][1] for r in got} == {0.0}
    assert got[0]["explained"] == [1.0, 0.0] and got[0]["identity_error"] < 1e-12
    ragged = make([(1, [1.0]), (2, [1.0, 2.0])])
    with pytest.raises(Exception, match="entries"):
        whitening.fit(ragged, 4)


def brute_codes(kept, parts=16, entries=64, rounds=2):
    d = len(kept[0][2])
    w = d // parts
    cut = {k: [k[2][m * w : (m + 1) * w] for m in range(parts)] for k in set(kept)}
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut[r][m] for r in order] for m in range(parts)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for m in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(near(cut[r][m], books[m])[1], []).append(cut[r][m])
            for i, g in groups.items():
                books[m][i] = tuple(sum(c) // len(g) for c in zip(*g, strict=True))
    found = [(r[0], r[1], [near(cut[r][m], books[m]) for m in range(parts)]) for r in kept]
    by_label = Counter()
    for _, label, f in found:
        by_label[label] += sum(x for x, _ in f)
    sha = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), sum(x for x, _ in f), by_label[label], sha) for i, label, f in found)


def test_op12(spark, folder, monkeypatch):
    want = brute_codes(whole(vectors()))
    for most in (codes.BROADCAST_ROWS, 0):  # totals by broadcast, and salted
        monkeypatch.setattr(codes, "BROADCAST_ROWS", most)
        assert Counter(tuple(r) for r in QUERIES["op12_codes"](spark, folder).collect()) == want


def test_codes_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert codes.codes(make([])).count() == 0
    got = codes.codes(make([(1, [1.0, 2.0, 3.0], None), (2, [1.0, 2.0, 3.0], None)])).collect()  # three entries, padded to sixteen parts
    assert [(r["code"], r["error"], r["label_error"]) for r in got] == [("00" * 16, 0, 0)] * 2


@pytest.mark.parametrize(("most", "d", "width"), [(150, 64, 4), (2, 64, 4), (1 << 40, 50, 4), (9, 16, 1), (9, 100, 7)])
def test_nearest_is_exact(most, d, width):
    rng = np.random.default_rng(most)
    x, books = rng.integers(-most, most, (80, d)), rng.integers(-most, most, (16, 9, width))
    books[3, 5] = books[3, 8]
    index, far = codes.assign(x, books)
    parts = np.pad(x, ((0, 0), (0, 16 * width - d))).reshape(80, 16, width).astype(object)
    direct = ((parts[:, :, None] - books[None].astype(object)) ** 2).sum(-1)
    assert (direct.argmin(2) == index).all() and (direct.min(2) == far).all()


def test_walsh_is_in_sequency_order():
    h = codes.walsh(np.eye(16, dtype=int)).T
    assert (h @ h.T == 16 * np.eye(16)).all() and [(np.diff(r) != 0).sum() for r in h] == list(range(16))
