"""Nearest-event sequences and running counts against brute force; the movement-only allow-list."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from movelytics.operators.context import counts_until, nearest_events
from movelytics.operators.order import dense_codes
from movelytics.plans import features
from movelytics.sources.tables import refuse_labels

H = 3_600_000_000


def movements(spark, n=300, seed=1):
    """Ties in time, null flights, one flight with many events, a month border."""
    rng = random.Random(seed)
    start = 1_706_745_600_000_000 - 2 * H  # two hours before February 2024
    rows = []
    for i in range(n):
        t = start + rng.randrange(0, 5 * H, 60_000_000)
        rows.append((i, rng.choice(["A", "A", "A", "B"]), t - t % (600_000_000 if i % 4 == 0 else 1), rng.choice([None, i // 2, i // 2, 999]), rng.choice(["ARR", "DEP"]), rng.choice(["", "01"]), i % 7))
    return rows, spark.createDataFrame(rows, "id bigint, airport string, t bigint, flight bigint, phase string, runway string, aobt int")


@pytest.mark.parametrize("k,slack", [(16, 4), (3, 1)])
def test_nearest_events(spark, k, slack):
    rows, df = movements(spark)
    got = nearest_events(df.where("phase = 'DEP'"), df, "airport", "t", "id", "flight", ["phase", "runway", "aobt"], [], H, k, slack).collect()
    month = lambda t: str(np.datetime64(t, "us"))[:7]
    assert len(got) == sum(r[4] == "DEP" for r in rows)
    for q in got:
        other = [r for r in rows if r[1] == q["airport"] and r[2] != q["t"] and abs(r[2] - q["t"]) <= H and month(r[2]) == month(q["t"]) and (r[3] is None or r[3] != q["flight"])]
        for side, mine in (("past", lambda r: r[2] < q["t"]), ("future", lambda r: r[2] > q["t"])):
            want = sorted((r for r in other if mine(r)), key=lambda r: (abs(r[2] - q["t"]), r[4], r[5], r[6], r[0]))[:k]
            assert [x["id"] for x in q[side]] == [r[0] for r in want]


def test_event_arrays(spark):
    rows, df = movements(spark, 40)
    q = df.where("phase = 'DEP'").withColumnRenamed("runway", "rk").withColumnRenamed("id", "mvt_id").withColumnRenamed("t", "t_us")
    e = df.withColumnRenamed("id", "mvt_id").withColumnRenamed("t", "t_us").withColumn("aobt", F.when(F.col("aobt") > 3, F.col("t_us") - 600_000_000).otherwise(F.lit(-1)))
    found = features.event_arrays(nearest_events(q.drop("phase", "aobt"), e, "airport", "t_us", "mvt_id", "flight", ["phase", "runway", "aobt"], [], H, 16), 16).collect()
    for r in found:
        x, p = np.array(r["events"]), np.array(r["presence"])
        assert x.shape == (32, 6) and p.shape == (32,) and (x[p == 0] == 0).all()
        assert p[16 - len(r["past"]) : 16 + len(r["future"])].all() and p.sum() == len(r["past"]) + len(r["future"])
        assert (np.diff(x[p == 1][:, 0]) >= 0).all() and (x[:16, 0] <= 0).all() and (x[16:, 0] >= 0).all()
        valid = x[:, 4] == 1
        assert np.allclose(x[valid, 5], 1 / 6) and (x[~valid][:, [3, 5]] == 0).all()


def test_counts_until(spark):
    rows, df = movements(spark, 200, 3)
    for inclusive in (True, False):
        got = counts_until(df, df, ["airport"], "t", "t", {"arr": F.col("phase") == "ARR", "all": F.lit(True)}, inclusive, H, "_n").collect()
        for q in got:
            before = [r for r in rows if r[1] == q["airport"] and (r[2] <= q["t"] if inclusive else r[2] < q["t"])]
            assert q["all_n"] == len(before) and q["arr_n"] == sum(r[4] == "ARR" for r in before)


def test_dense_codes(spark, tmp_path):
    values = [f"v{i * 37 % 101}" for i in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["c"] for r in dense_codes(df, "v", "c", f"file://{tmp_path}/codes").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    assert dense_codes(df.limit(0), "v", "c", f"file://{tmp_path}/none").count() == 0


def test_allow_list(spark):
    assert len(features.ALLOWED) == len(set(features.ALLOWED)) == 77
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert refuse_labels(df, features.FORBIDDEN, ["a", "b"]).columns == ["a", "b"]
    for bad in (["b", "a"], ["a"]):
        with pytest.raises(ValueError):
            refuse_labels(df, features.FORBIDDEN, bad)
    with pytest.raises(ValueError):
        refuse_labels(df.withColumnRenamed("b", "callsign_prefix"), features.FORBIDDEN)


def test_wide_stack_is_whole():
    """The related-strip block has columns of its own, in the stack and in its SQL, as it had before."""
    assert features.STACK["rt"] == "w13_related_traffic" and len(features.STACK) == 16
    assert "'rt_" in features.wide_sql()
