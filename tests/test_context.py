"""Boundary rows and brute force for the context operators."""

import random

import pytest
from pyspark.sql import functions as F

from movelytics.operators.context import Win, band_join, context_agg, nearest, nearest_any, neighbours, occupancy, overtaking, unique_keys

S = 1_000_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(160):
        start = rng.randrange(0, 20_000) * S
        length = rng.choice([-2, 0, 0, 1, 3, 600, 7200, 7201])
        out.append((i, rng.choice(["A", "B", None]), start, start + length * S if i % 17 else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, k string, s bigint, f bigint")


@pytest.mark.parametrize("halo", [None, 3600 * S, 100_000 * S])
def test_windows(spark, rows, halo):
    df = frame(spark, rows)
    got = {r["id"]: r for r in context_agg(df, df, ["k"], "s", [Win("p", -900 * S, -1), Win("n", 0, 900 * S)], {"c": ("count", None), "m": ("avg", "id")}, halo=halo).collect()}
    for i, k, s, _ in rows:
        past = [j for j, kk, t, _ in rows if kk == k and s - 900 * S <= t < s]
        new = [j for j, kk, t, _ in rows if kk == k and s <= t <= s + 900 * S]
        if k is None:
            assert got[i]["p_c"] is None
            continue
        assert (got[i]["p_c"], got[i]["n_c"]) == (len(past), len(new))
        assert got[i]["p_m"] == (pytest.approx(sum(past) / len(past)) if past else None)


@pytest.mark.parametrize("si,ei", [(True, False), (False, False), (False, True)])
def test_occupancy(spark, rows, si, ei):
    df = frame(spark, rows)
    got = {r["id"]: r["n"] for r in occupancy(df, df, ["k"], "s", "s", "f", si, ei, "n", 1000 * S).collect()}
    for i, k, t, _ in rows:
        want = sum(1 for _, kk, s, f in rows if kk == k and f is not None and s < f and (s <= t if si else s < t) and (f >= t if ei else f > t))
        assert got[i] == (None if k is None else want)


def test_overtaking(spark, rows):
    iv = [r for r in rows if r[3] is not None and 0 < r[3] - r[2] <= 7200 * S and r[1]]
    got = {r["id"]: (r["overtakers"], r["left_behind"]) for r in overtaking(frame(spark, iv), "id", ["k"], "s", "f", 7200 * S).collect()}
    for i, k, s, f in iv:
        assert got[i] == (sum(1 for _, kk, a, b in iv if kk == k and a > s and b < f), sum(1 for _, kk, a, b in iv if kk == k and a < s and b > f))


def test_nearest(spark, rows):
    df = frame(spark, rows)
    any_ = {r["id"]: (r["prev_x"], r["next_even"]) for r in nearest_any(df, df, ["k"], "s", {"x": F.lit(True), "even": F.col("id") % 2 == 0}, 500 * S).collect()}
    near = {r["id"]: r["y_t"] for r in nearest(df, df, ["k"], "s", [], "future", 300 * S, prefix="y", tie="desc").collect()}
    for i, k, s, _ in rows:
        if k:
            assert any_[i][0] == max((t for _, kk, t, _ in rows if kk == k and t < s), default=None)
            assert any_[i][1] == min((t for j, kk, t, _ in rows if kk == k and t > s and j % 2 == 0), default=None)
            assert near[i] == min((t for _, kk, t, _ in rows if kk == k and s < t <= s + 300 * S), default=None)
        else:
            assert near[i] is None


def test_neighbours_and_band(spark, rows):
    df = frame(spark, rows)
    got = neighbours(df, df, ["k"], "s", "id", 1800 * S, 2, F.col("e_id") == F.col("id"), ["id"]).select("id", "side", "rank", "e_id").collect()
    seen = {(r["id"], r["side"], r["rank"]): r["e_id"] for r in got}
    for i, k, s, _ in rows:
        past = sorted(((s - t, j) for j, kk, t, _ in rows if k and kk == k and 0 < s - t <= 1800 * S))[:2]
        assert [seen.get((i, "past", n + 1)) for n in range(2)] == [j for _, j in past] + [None] * (2 - len(past))
    plan = band_join(df, df, ["k"], F.col("s"), F.col("s") + 10, "s", 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_partition_count_does_not_matter(spark, rows):
    df = frame(spark, rows)
    run = lambda d: sorted(map(tuple, context_agg(d, d, ["k"], "s", [Win("p", -900 * S, 0)], {"c": ("count", None)}).collect()), key=str)
    assert run(df.repartition(1)) == run(df.repartition(16))


def test_unique_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [r["k"] for r in unique_keys(df, ["k"]).collect()] == [2]


def test_overtaking_equals_pairs(spark):
    """Ties, hot buckets, intervals over bucket borders and null keys against all pairs."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "b", None]), s, s + rng.randrange(1, 101)) for i in range(400) for s in [rng.randrange(-150, 350)]]
    iv = spark.createDataFrame(rows, "id bigint, k string, s bigint, f bigint")
    got = {r["id"]: (r["overtakers"], r["left_behind"]) for r in overtaking(iv, "id", ["k"], "s", "f", 100).collect()}
    for i, k, s, f in rows:
        same = [r for r in rows if k and r[1] == k]
        assert got[i] == (sum(r[2] > s and r[3] < f for r in same), sum(r[2] < s and r[3] > f for r in same))
    assert overtaking(iv.limit(0), "id", ["k"], "s", "f", 100).count() == 0


def test_frames_grow(spark, capsys):
    """Dense keys: no frame slides or shrinks, and many events of one window give the same answers as brute force."""
    df = spark.range(3000).selectExpr("id", "'A' as k", "id div 2 * 1000 as t", "cast(id % 7 as double) / 10 as v", "id % 5 as n")
    past = context_agg(df, df, ["k"], "t", [Win("p", -900_000, -1)], {"c": ("count", None), "s": ("sum", "n"), "m": ("avg", "v"), "d": ("std", "v")})
    near = nearest(df, df, ["k"], "t", ["n"], "past", 5_000, prefix="a", tie="desc")
    near = nearest(near, df, ["k"], "t", [], "future", 5_000, prefix="b")
    near = nearest_any(near, df, ["k"], "t", {"x": F.col("id") % 100 == 0}, 10_000_000)
    for made in (past, near):
        made.explain(True)
    import re

    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]*),", capsys.readouterr().out)
    assert frames and all(f.startswith("unboundedpreceding") for f in frames)
    at = lambda i: i // 2 * 1000
    got = {r["id"]: r for r in past.collect()}
    found = {r["id"]: r for r in near.collect()}
    for i in (0, 1, 2, 999, 1800, 1801, 1802, 2999):
        mine = [j for j in range(3000) if at(i) - 900_000 <= at(j) < at(i)]
        mean = sum(j % 7 / 10 for j in mine) / len(mine) if mine else None
        assert (got[i]["p_c"], got[i]["p_s"]) == (len(mine), sum(j % 5 for j in mine) if mine else None)
        assert got[i]["p_m"] == (pytest.approx(mean) if mine else None)
        assert got[i]["p_d"] == (pytest.approx((sum((j % 7 / 10 - mean) ** 2 for j in mine) / len(mine)) ** 0.5) if mine else None)
        before, after, marked = [j for j in range(3000) if at(j) < at(i)], [j for j in range(3000) if at(j) > at(i)], [j for j in range(0, 3000, 100) if at(j) > at(i)]
        assert found[i]["a_t"] == (at(before[-1]) if before else None) and found[i]["b_t"] == (at(after[0]) if after else None)
        assert found[i]["a_n"] == (max(j % 5 for j in before[-2:]) if before else None) and found[i]["next_x"] == (at(marked[0]) if marked else None)
