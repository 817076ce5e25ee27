"""Bucketed ranks and neighbours equal whole-key windows."""

import random

from pyspark.sql import functions as F

from movelytics.operators.order import percentiles, row_numbers, running, with_neighbours


def test_ranks_and_neighbours(spark):
    rng = random.Random(2)
    rows = [(i * 7, rng.choice("ab"), rng.randrange(40), float(rng.randrange(5))) for i in range(500)] + [(9001, "c", None, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, k string, x int, v double")
    got = {r["id"]: r["r"] for r in row_numbers(df, ["k"], "x", ["id"], "r", parts=5).collect()}
    sums = {r["id"]: r["s"] for r in running(df.where("x is not null"), [], "x", ["id"], F.col("v"), "s", parts=7).collect()}
    near = {r["id"]: (r["prev"]["id"] if r["prev"] else None, r["next"]["id"] if r["next"] else None) for r in with_neighbours(df, ["k"], "id", ["id", "x"], 100).collect()}
    for k in "abc":
        order = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
        ids = sorted(r[0] for r in rows if r[1] == k)
        assert [near[i] for i in ids] == [(a, b) for a, b in zip([None, *ids[:-1]], [*ids[1:], None], strict=True)]
    total = 0.0
    for r in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        assert sums[r[0]] == total
        total += r[3]


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, k string, x int")
    assert row_numbers(df, ["k"], "x", ["id"], "r").count() == 0 and with_neighbours(df, ["k"], "id", ["x"], 10).count() == 0


def test_percentiles(spark):
    """Heavy ties, null values, a null key and a single value, against Spark's own exact percentiles."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 1.5, 1.5, rng.random() * 9])) for _ in range(300)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = [0.0, 0.05, 0.5, 0.95, 1.0]
    want = {r["k"]: r["q"] for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in points])).alias("q")).collect()}
    got = {r["k"]: r["q"] for r in percentiles(df, ["k"], "v", points, "q").collect()}
    assert set(got) == set(want) == {"a", "b", "c", None}
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
    assert percentiles(df.where("v > 99"), [], "v", points, "q").count() == 0


def test_one_set_of_cuts(spark, capsys):
    """Buckets are cut once: the rows and what lies before each bucket read the same written quantiles, joined without an exchange of the rows by group."""
    df = spark.range(2000).selectExpr("id", "'a' as k", "id * 7919 % 2003 as x")
    row_numbers(df, ["k"], "x", ["id"], "r", parts=5).explain()
    plan = capsys.readouterr().out
    assert "percentile" not in plan.lower() and "order-cuts" in plan
    assert "Broadcast" in plan and "SortMergeJoin" not in plan
