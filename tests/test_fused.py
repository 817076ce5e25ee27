"""The fused passes and the segment join against brute force."""

import random
import statistics

import pytest

from movelytics.operators.fused import Inside, Mark, Near, Open, Over, context, fuse
from movelytics.operators.spatial import segment_pairs

S = 1_000_000
SPAN = 7200 * S


@pytest.fixture(scope="module")
def rows():
    """(id, key, start, end, value): ties, null keys and ends, long and reversed intervals."""
    rng = random.Random(8)
    out = []
    for i in range(220):
        t = rng.randrange(0, 40_000) * S
        t -= t % (600 * S) if i % 4 == 0 else 0
        length = rng.choice([-5, 0, 1, 60, 3000, 7200, 7201, 50_000])
        out.append((i, rng.choice(["A", "B", None]), t - length * S if i % 13 else None, t, rng.choice([None, 0.0, 1.5, 2.25, 900.125])))
    return out


ASKS = {
    "n": Over("all", -900 * S, 0), "later": Over("all", 1, 900 * S), "far": Over("all", -30_000 * S, -20_000 * S), "nv": Over("all", -3600 * S, -1, "count", "v"),
    "mean": Over("all", -3600 * S, 3600 * S, "avg", "v"), "std": Over("all", -3600 * S, 3600 * S, "std", "v"), "sum": Over("big", -3600 * S, -1, "sum", "v"),
    "prev": Near("all", "past", 1800 * S, ("v0",)), "next": Near("all", "future", 1800 * S, ("v0",)), "ever": Near("big", "past", None), "ahead": Near("big", "future", None),
    "open_in": Open("s", "t"), "open_ex": Open("s", "t", "true", None, False, True), "open_at": Open("s", "t", "true", "s"),
    "inside": Inside("all", "s", SPAN, f"t - s between 1 and {SPAN}"),
}
MARKS = {"all": Mark("t", "true", {"v": "v", "v0": "coalesce(v, -1e0)"}), "big": Mark("t", "v > 2", {"v": "v"})}


def brute(rows, q):
    i, key, s, t, _ = q
    es = [r for r in rows if r[1] == key]
    iv = [r for r in es if r[2] is not None]
    at = lambda lo, hi: [r for r in es if t + lo <= r[3] <= t + hi]
    vs = lambda rs: [r[4] for r in rs if r[4] is not None]
    big = [r for r in es if r[4] is not None and r[4] > 2]
    v = vs(at(-3600 * S, 3600 * S))
    total = vs([r for r in at(-3600 * S, -1) if r in big])
    prev = max(((r[3], -1.0 if r[4] is None else r[4]) for r in at(-1800 * S, -1)), default=(None, None))
    next_ = min(((r[3], -1.0 if r[4] is None else r[4]) for r in at(1, 1800 * S)), default=(None, None))
    valid = s is not None and 1 <= t - s <= SPAN
    return {
        "n": len(at(-900 * S, 0)), "later": len(at(1, 900 * S)), "far": len(at(-30_000 * S, -20_000 * S)), "nv": len(vs(at(-3600 * S, -1))),
        "mean": sum(v) / len(v) if v else None, "std": statistics.pstdev(v) if v else None, "sum": sum(total) if total else None,
        "prev_t": prev[0], "prev_v0": prev[1], "next_t": next_[0], "next_v0": next_[1],
        "ever_t": max((r[3] for r in big if r[3] < t), default=None), "ahead_t": min((r[3] for r in big if r[3] > t), default=None),
        "open_in": sum(r[2] <= t < r[3] for r in iv if r[2] < r[3]), "open_ex": sum(r[2] < t <= r[3] for r in iv if r[2] < r[3]),
        "open_at": None if s is None else sum(r[2] <= s < r[3] for r in iv if r[2] < r[3]), "inside": sum(s < r[3] < t for r in es) if valid else None,
    }


@pytest.mark.parametrize("width", [None, 3600 * S])
def test_one_pass_equals_brute_force(spark, rows, width):
    df = spark.createDataFrame(rows, "id long, key string, s long, t long, v double")
    got = {r["id"]: r.asDict() for r in fuse([context(df, df, ["key"], "t", MARKS, ASKS, "id", max(width, 30_000 * S) if width else None)], "id").collect()}
    assert set(got) == {r[0] for r in rows if r[1] is not None}
    for q in rows:
        if q[1] is not None:
            want = brute(rows, q)
            for c, w in want.items():
                g = got[q[0]][c]
                assert g == w or (isinstance(w, float) and abs(g - w) < 1e-6), (q, c, g, w)


def test_passes_over_several_keys_meet_once(spark, rows):
    df = spark.createDataFrame(rows, "id long, key string, s long, t long, v double").selectExpr("*", "id % 3 as k2")
    parts = [context(df, df, ["key"], "t", MARKS, {"a": Over("all", -900 * S, 0)}, "id"), context(df, df, ["key", "k2"], "t", MARKS, {"b": Over("all", -900 * S, 0)}, "id")]
    out = fuse(parts, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # one a key, one by id
    assert all(r["a"] >= r["b"] >= 1 for r in out.collect())
    with pytest.raises(ValueError, match="collide"):
        fuse([parts[0], parts[0]], "id")


def test_empty_events(spark, rows):
    df = spark.createDataFrame(rows, "id long, key string, s long, t long, v double")
    got = fuse([context(df, df.where("false"), ["key"], "t", MARKS, ASKS, "id")], "id").collect()
    assert {(r["n"], r["mean"], r["prev_t"], r["ever_t"], r["open_in"]) for r in got} == {(0, None, None, None, 0)}
    assert fuse([context(df.where("false"), df, ["key"], "t", MARKS, ASKS, "id")], "id").count() == 0


@pytest.mark.parametrize("cell", [50.0, 400.0, 5000.0])
def test_segment_pairs(spark, cell):
    rng = random.Random(3)
    segments = []
    for i in range(90):
        x, y = rng.uniform(-1500, 1500), rng.uniform(-1500, 1500)
        dx, dy = rng.uniform(-400, 400), rng.uniform(-400, 400) if i % 10 else 0.0
        segments.append((rng.choice(["A", "B"]) if i % 17 else None, i, x, y, x + dx, y + dy))
    s = spark.createDataFrame(segments, "airport string, sid int, le_x double, le_y double, he_x double, he_y double")
    reach = 120.0
    got = [(r["sid"], r["o_sid"]) for r in segment_pairs(s, ["airport"], "sid", reach, cell).collect()]
    assert len(got) == len(set(got))
    apart = lambda a, b, lo, hi: max(min(b[lo], b[hi]) - max(a[lo], a[hi]), min(a[lo], a[hi]) - max(b[lo], b[hi]))
    must = {(a[1], b[1]) for a in segments for b in segments if a[1] != b[1] and a[0] == b[0] is not None and apart(a, b, 2, 4) <= reach and apart(a, b, 3, 5) <= reach}
    assert must <= set(got) and all(a != b for a, b in got)


def test_partitions_follow_the_rows(spark, monkeypatch, capsys):
    """A pass over more events is dealt out to more partitions, by key and by id, with the same answers."""
    from movelytics import plans
    from movelytics.operators import fused

    sf, name = "/root/testdata/sf0.001", "f01_baseline_features"
    few = {tuple(r) for r in plans.queries()[name](spark, sf).collect()}
    monkeypatch.setattr(fused, "EVENTS", 100)
    more = plans.queries()[name](spark, sf)
    more.explain()
    assert ", 10), REPARTITION_BY_NUM" in capsys.readouterr().out
    assert {tuple(r) for r in more.collect()} == few
