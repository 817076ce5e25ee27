"""Quotas, shares of the largest rows and stratified bootstraps against brute force, with ties and nulls."""

import pytest
from pyspark.sql import functions as F

from movelytics.operators.context import quota
from movelytics.operators.evaluate import day_bootstrap, top_shares
from movelytics.operators.order import so_far


def test_quota_with_ties(spark):
    uses = [(i, "a", (i // 3) * 10, 5 + i % 4, i % 6) for i in range(40)] + [(100, "b", 7, 1, 1), (101, None, 7, 1, 1), (102, "b", 7, 2, 2)]
    out = {r["id"]: r for r in quota(spark.createDataFrame(uses, "id long, k string, t long, bytes long, version long"), "k", "t", 60, 5, 120).collect()}
    assert len(out) == len(uses)
    for i, k, t, size, version in uses:
        old = [u for u in uses if u[1] == k and k is not None and u[2] < t]
        recent = sorted(u[2] for u in old if u[2] >= t - 60)
        want = (len(recent), max(5 - len(recent), 0), recent[-5] + 60 if len(recent) >= 5 else t, sum(u[3] for u in old) + size, version > max([u[4] for u in old], default=0))
        r = out[i]
        assert (r["used"], r["remaining"], r["next_slot_t"], r["projected"], r["version_is_new"]) == want
        assert r["allowed"] == (want[0] < 5 and want[3] <= 120 and want[4])


def test_so_far_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, t long, v long")
    assert so_far(empty, ["k"], "t", {"s": "v"}, {"m": "v"}).count() == 0


@pytest.mark.parametrize("values", [[1.0] * 7, [0.5, 3.0, 3.0, 3.0, 9.0, None], [0.0, 0.0], [float(i % 11) for i in range(230)]])
def test_top_shares(spark, values):
    got = {r["top"]: (r["rows"], r["share"]) for r in top_shares(spark.createDataFrame([(v,) for v in values], "v double"), "v", (1, 2, 10)).collect()}
    known = sorted((v for v in values if v is not None), reverse=True)
    for top, rows in (("1", 1), ("2", 2), ("10", 10), ("1%", max(1, -(-len(known) // 100)))):
        share = sum(known[:rows]) / sum(known) if sum(known) else None
        assert got[top][0] == rows and got[top][1] == (pytest.approx(share) if share is not None else None)


def test_days_are_drawn_within_their_stratum(spark):
    """A count per stratum is the same in every replicate: each month draws as many days as it has."""
    days = [(1 if d < 31 else 2, d, 1 if d < 31 else 0, 1 if d >= 31 else 0, d) for d in range(59)]
    sums = spark.createDataFrame(days, "month long, day long, first long, second long, v long")
    out = day_bootstrap(sums, ["first", "second", "v"], 50, "month")
    assert out.where((F.col("first") != 31) | (F.col("second") != 28)).count() == 0
    assert out.count() == 50 and out.select("v").distinct().count() > 10
