from pyspark.sql import functions as F

from movelytics.functions import geo
from movelytics.sources.geometry import end_codes, strip_edges, strip_table, strips


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def points(*p):
    return [(F.lit(float(a)), F.lit(float(b))) for a, b in p]


def test_segments(spark):
    assert one(spark, geo.segments_cross(*points((0, 0), (2, 2), (0, 2), (2, 0))))
    assert one(spark, geo.segments_cross(*points((0, 0), (1, 0), (1, 0), (2, 5))))  # touching ends
    assert not one(spark, geo.segments_cross(*points((0, 0), (1, 0), (0, 1), (1, 1))))
    assert one(spark, geo.segments_cross(*points((0, 0), (4, 0), (1, 0), (2, 0))))  # overlap
    assert one(spark, geo.segments_m(*points((0, 0), (1, 0), (0, 3), (1, 3)))) == 3
    assert one(spark, geo.point_segment_m(*points((5, 4), (2, 0), (2, 0)))) == 5  # degenerate


def test_wind_and_bearing(spark):
    head, tail, cross = geo.wind(F.lit(90.0), F.lit(90.0), F.lit(10.0))
    assert [round(one(spark, c), 6) for c in (head, tail, cross)] == [10, 0, 0]
    assert round(one(spark, geo.wind(F.lit(270.0), F.lit(90.0), F.lit(10.0))[0]), 6) == -10
    assert one(spark, geo.wind(F.lit(90.0), F.lit(999.0), F.lit(10.0))[0]) is None
    assert one(spark, geo.bearing_gap(F.lit(350.0), F.lit(10.0))) == 20
    assert one(spark, geo.bearing_gap(F.lit(0.0), F.lit(180.0))) == 0


# Four strips of a test layout; strip 2 touches strip 1's end, strip 3 is too far from all but strip 2.
LAYOUT = [("A0", 0, "00", "27", 0.0, -0.01, 0.0, 0.01), ("A0", 1, "01", "36", -0.01, 0.0, 0.01, 0.0), ("A0", 2, "02", "27R", 0.01, -0.01, 0.01, 0.01), ("A0", 3, "09F", "27F", 0.03, -0.01, 0.03, 0.01)]
SHAPE = "airport string, sid int, le string, he string, le_lat double, le_lon double, he_lat double, he_lon double"


def test_strip_edges(spark):
    s = strip_table(spark.createDataFrame(LAYOUT, SHAPE))
    got = {(r["sid"], r["other"], r["relation"]) for r in strip_edges(s).collect()}
    assert (0, 1, "intersecting") in got and (0, 2, "near_parallel") in got and not any({a, b} == {0, 3} for a, b, _ in got)
    assert end_codes(s).count() == 8


def test_ambiguous_codes(spark):
    s = strip_table(spark.createDataFrame(LAYOUT, SHAPE).withColumn("he", F.lit("27")))
    assert end_codes(s).where("code = '27'").count() == 0


def test_edges_equal_all_pairs(spark):
    """Strips of a table of thousands: the cells lose no pair that the predicates alone would find."""
    s = strip_table(strips(spark, "/root/testdata/sf0.01")).cache()
    o = s.select(*[F.col(c).alias(f"o_{c}") for c in s.columns])
    p = [(F.col(f"{w}{e}_x"), F.col(f"{w}{e}_y")) for w in ("", "o_") for e in ("le", "he")]
    near = (geo.bearing_gap(F.col("le_heading"), F.col("o_le_heading")) <= geo.PARALLEL_DEG) & (geo.segments_m(*p) <= geo.PARALLEL_M)
    pairs = s.join(o, (F.col("airport") == F.col("o_airport")) & (F.col("sid") != F.col("o_sid"))).where(geo.segments_cross(*p) | near)
    want = {(r["airport"], r["sid"], r["o_sid"]) for r in pairs.collect()}
    got = [(r["airport"], r["sid"], r["other"]) for r in strip_edges(s, cell_m=1_500.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_only_strips_in_use_are_paired(spark, capsys):
    """Pairs are worked out for the strips whose codes movements use, the same ones as among all; rows are written before they are tested."""
    from movelytics.plans.joins import layout, valid_strips

    sf = "/root/testdata/sf0.001"
    whole = valid_strips(spark, sf)
    whole.explain()
    assert max(map(len, capsys.readouterr().out.splitlines())) < 4_000  # the rows' own expressions are not in the condition
    every = {tuple(r) for r in strip_edges(whole).collect()}
    for toward in (False, True):
        used, codes, near = layout(spark, sf, toward)
        mine = {(r["airport"], r["sid"]) for r in codes.collect()}
        assert mine == {(r["airport"], r["sid"]) for r in used.collect()} and 0 < len(mine) < whole.count()
        got = {tuple(r) for r in near.selectExpr("airport", "sid", "inline(near)").collect()}
        assert got == {e for e in every if (e[0], e[2 if toward else 1]) in mine}
