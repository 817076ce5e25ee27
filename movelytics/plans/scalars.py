"""Projections, predicates, scalar functions: P01-P16, C01-C15."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, geo
from ..functions.keys import EVENT_PLACEHOLDERS, RUNWAY_PLACEHOLDERS, agree, clipped, cut_right, grouped_key, identity, normal_key, seconds, strictly_above, text_identity, valid_proxy, within
from ..sources.tables import weather_observations
from .base import FL, deps, flights, moves, query, rounded

CLOCKS = ("aobt_us", "lobt_us", "iobt_us", "eobt_us", "sched_us", "planned_us", "flown_us")
GAPS = {
    **{f"takeoff_{c[:-3]}": ("t_us", c) for c in CLOCKS},
    **{f"{a}_{b}": (f"{a}_us", f"{b}_us") for a, b in (("aobt", "lobt"), ("aobt", "iobt"), ("aobt", "eobt"), ("lobt", "eobt"), ("sched", "lobt"))},
}
RAW_GAPS = {"gap": ("t_us", "sched_us"), "planned_duration": ("planned_us", "eobt_us"), "flown_duration": ("flown_us", "aobt_us"), "arrival_delay": ("flown_us", "planned_us"), "revision": ("eobt_us", "iobt_us")}


@query(
    "p01_clock_gaps",
    "{with}, " + FL + " select mvt_id, "
    + ", ".join(f"case when {a} - {b} is not null then greatest(least(({a} - {b}) / 1000000.0, 86400.0), -86400.0) end as {n}" for n, (a, b) in GAPS.items()) + " from fl",
)
def p01(spark, sf):
    """Take-off minus each of the seven clocks, and five pairs of clocks, clipped to a day."""
    return flights(spark, sf).select("mvt_id", *[clipped(seconds(F.col(a), F.col(b)), -86400.0, 86400.0).alias(n) for n, (a, b) in GAPS.items()])


@query(
    "p02_raw_gaps",
    "{with}, " + FL + " select mvt_id, cast(floor((t_us - sched_us) / 86400000000.0) as bigint) as days, " + ", ".join(f"({a} - {b}) / 1000000.0 as {n}" for n, (a, b) in RAW_GAPS.items()) + " from fl",
)
def p02(spark, sf):
    """Gap to the schedule and its days, planned and flown duration, arrival delay, revision; not clipped."""
    days = F.floor((F.col("t_us") - F.col("sched_us")) / 86_400_000_000.0)
    return flights(spark, sf).select("mvt_id", days.alias("days"), *[seconds(F.col(a), F.col(b)).alias(n) for n, (a, b) in RAW_GAPS.items()])


@query("p03_valid_proxy", "{with}, p as (select mvt_id, (t_us - aobt_us) / 1000000.0 as x from d) select mvt_id, coalesce(x between 0 and 7200, false) as closed, coalesce(x > 0 and x <= 7200, false) as half_open, coalesce(x between 0 and 3600, false) as arrival, coalesce(x > 0, false) as ordered from p")
def p03(spark, sf):
    x = seconds(F.col("t_us"), F.col("aobt_us"))
    return deps(spark, sf).select("mvt_id", *[F.coalesce(valid_proxy(x, k), F.lit(False)).alias(n) for k, n in (("closed", "closed"), ("open", "half_open"), ("arrival", "arrival"), ("ordered", "ordered"))])


@query("p04_label_ranges", "{with} select mvt_id, taxi_sec between 0 and 86400 as core, taxi_sec between 0 and 7200 as ordinary, taxi_sec > 0 as positive, taxi_sec is not null and not isnan(taxi_sec) as finite from d")
def p04(spark, sf):
    y = F.col("taxi_sec")
    return deps(spark, sf).select("mvt_id", y.between(0, 86400).alias("core"), y.between(0, 7200).alias("ordinary"), (y > 0).alias("positive"), (y.isNotNull() & ~F.isnan(y)).alias("finite"))


@query("p05_missing_clock_gate", "{with} select mvt_id, not coalesce((t_us - aobt_us) / 1000000.0 between 0 and 7200, false) and aobt_us is null and lobt_us is null and airport <> 'A0' as gate from d")
def p05(spark, sf):
    valid = F.coalesce(valid_proxy(seconds(F.col("t_us"), F.col("aobt_us"))), F.lit(False))
    return deps(spark, sf).select("mvt_id", (~valid & F.col("aobt_us").isNull() & F.col("lobt_us").isNull() & (F.col("airport") != "A0")).alias("gate"))


@query("p06_source_gate", "{with} select mvt_id, coalesce(airport in ('A1','A3') and abs(((t_us - sched_us) - (t_us - aobt_us)) / 1000000.0) > 600, false) as gate from d")
def p06(spark, sf):
    gap = seconds(F.col("aobt_us"), F.col("sched_us"))
    return deps(spark, sf).select("mvt_id", F.coalesce(F.col("airport").isin("A1", "A3") & (F.abs(gap) > 600), F.lit(False)).alias("gate"))


ALT = "p as (select mvt_id, (t_us - aobt_us) / 1000000.0 as proxy, (t_us - sched_us) / 1000000.0 as s, (t_us - lobt_us) / 1000000.0 as l, lobt_us, sched_us, taxi_sec from d)"


_OPTION = "coalesce((t_us - {c}) / 1000000.0 between 0 and 7200 and abs((aobt_us - {c}) / 1000000.0) > 600, false)"


@query(
    "p07_option_gate",
    "{with}, " + FL + ", o as (select mvt_id, lobt_us, iobt_us, coalesce((t_us - aobt_us) / 1000000.0 between 0 and 7200, false) as valid, "
    + ", ".join(f"{_OPTION.format(c=f'{n}_us')} as {n}" for n in ("lobt", "iobt", "sched"))
    + """ from fl), i as (select mvt_id, valid, lobt as lobt_option, iobt and (not lobt or abs((iobt_us - lobt_us) / 1000000.0) > 120) as iobt_option, sched as sched_option from o)
select mvt_id, lobt_option, iobt_option, sched_option, valid and (lobt_option or iobt_option or sched_option) as candidate from i""",
)
def p07(spark, sf):
    """Three alternates of a valid proxy: plausible and far from it; the initial time counts beside the last planned one only if they differ."""
    f, t = flights(spark, sf), F.col("t_us")
    proxy = seconds(t, F.col("aobt_us"))

    def option(c):
        apart = F.abs(seconds(F.col("aobt_us"), F.col(c)))  # whole microseconds, not a difference of doubles
        return F.coalesce(seconds(t, F.col(c)).between(0, 7200) & (apart > 600), F.lit(False))

    f = f.withColumns({"lobt_option": option("lobt_us"), "sched_option": option("sched_us"), "valid": F.coalesce(valid_proxy(proxy), F.lit(False))})
    f = f.withColumn("iobt_option", option("iobt_us") & (~F.col("lobt_option") | (F.abs(seconds(F.col("iobt_us"), F.col("lobt_us"))) > 120)))
    names = ["lobt_option", "iobt_option", "sched_option"]
    return f.select("mvt_id", *names, (F.col("valid") & (F.col(names[0]) | F.col(names[1]) | F.col(names[2]))).alias("candidate"))


def _alternates(spark, sf):
    t = F.col("t_us")
    return deps(spark, sf).select("mvt_id", seconds(t, F.col("aobt_us")).alias("proxy"), seconds(t, F.col("sched_us")).alias("s"), seconds(t, F.col("lobt_us")).alias("l"), "lobt_us", "sched_us", "taxi_sec")


@query("p08_long_schedule", "{with} select mvt_id, case when x > 7000 then 'very long' when x > 5000 then 'long' when x > 3600 then 'late' else 'ordinary' end as band from (select mvt_id, (t_us - sched_us) / 1000000.0 as x from d)")
def p08(spark, sf):
    x = seconds(F.col("t_us"), F.col("sched_us"))
    return deps(spark, sf).select("mvt_id", F.when(x > 7000, "very long").when(x > 5000, "long").when(x > 3600, "late").otherwise("ordinary").alias("band"))


@query("p09_consistent_arrival", "{with} select mvt_id, taxi_sec between 0 and 7200 and block_us >= t_us and abs((block_us - t_us) / 1000000.0 - taxi_sec) <= 1 as ok from a")
def p09(spark, sf):
    ok = F.col("taxi_sec").between(0, 7200) & (F.col("block_us") >= F.col("t_us")) & (F.abs(seconds(F.col("block_us"), F.col("t_us")) - F.col("taxi_sec")) <= 1)
    return moves(spark, sf).where("phase = 'ARR'").select("mvt_id", ok.alias("ok"))


# Physical ranges of observations.
RANGES = {"temperature": (-80, 60), "dew": (-90, 40), "rh": (0, 100), "wind_speed": (0, 100), "wind_dir": (0, 360), "gust": (0, 150), "precip": (0, 500), "snow_depth": (0, 10_000), "visibility": (0, 160_000), "ceiling": (0, 30_000)}


@query("p10_physical_ranges", "with {wx} select obs_id, " + ", ".join(f"round(case when {c} between {lo} and {hi} then {c} end, 6) as {c}" for c, (lo, hi) in RANGES.items()) + " from wx")
def p10(spark, sf):
    return rounded(weather_observations(spark, sf).select("obs_id", *[within(F.col(c), lo, hi).alias(c) for c, (lo, hi) in RANGES.items()]))


def _key_sql(missing) -> str:
    return f"case when upper(trim(runway)) in ({', '.join(repr(x) if chr(92) not in x else chr(39) + x + chr(39) for x in missing)}) then null else upper(trim(runway)) end"


@query("p11_key_modes", f"{{with}} select mvt_id, {_key_sql(RUNWAY_PLACEHOLDERS)} as runway_key, {_key_sql(EVENT_PLACEHOLDERS)} as event_key, nullif(upper(trim(runway)), '') as lenient, coalesce(runway, '__MISSING__') as grouped from m")
def p11(spark, sf):
    """A key normalised by either set of placeholders, by none, and with a group for missing ones."""
    r = F.col("runway")
    return moves(spark, sf).select("mvt_id", normal_key(r).alias("runway_key"), normal_key(r, EVENT_PLACEHOLDERS).alias("event_key"), normal_key(r, ("",)).alias("lenient"), grouped_key(r).alias("grouped"))


@query("p12_typed_identity", "{with} select mvt_id, case when taxi_sec = floor(taxi_sec) and abs(taxi_sec) < 9007199254740992 then concat('i:', cast(cast(taxi_sec as bigint) as varchar)) end as number, case when trim(flight) <> '' then concat('s:', trim(flight)) end as text from m")
def p12(spark, sf):
    return moves(spark, sf).select("mvt_id", identity(F.col("taxi_sec")).alias("number"), text_identity(F.col("flight")).alias("text"))


@query("p13_time_range", "{with}, b as (select min(t_us) + 86400000000 as lo, max(t_us) - 86400000000 as hi from m) select mvt_id, case when aobt_us between lo and hi then aobt_us end as aobt, case when t_us between lo and hi then t_us end as t from m, b")
def p13(spark, sf):
    """Times nulled outside of a range that keeps a day from both ends."""
    m = moves(spark, sf)
    b = m.agg((F.min("t_us") + clock.DAY).alias("lo"), (F.max("t_us") - clock.DAY).alias("hi"))
    return m.crossJoin(F.broadcast(b)).select("mvt_id", *[F.when(F.col(c).between(F.col("lo"), F.col("hi")), F.col(c)).alias(n) for c, n in (("aobt_us", "aobt"), ("t_us", "t"))])


@query("p14_flags", "{with} select mvt_id, cast(aobt_us is null as int) as no_aobt, cast(runway is null as int) as no_runway, coalesce(cast(airport = dest as int), 0) as same_place, coalesce(cast(runway = stand as int), 0) as same_key from d")
def p14(spark, sf):
    return deps(spark, sf).select("mvt_id", F.col("aobt_us").isNull().cast("int").alias("no_aobt"), F.col("runway").isNull().cast("int").alias("no_runway"), agree(F.col("airport"), F.col("dest")).alias("same_place"), agree(F.col("runway"), F.col("stand")).alias("same_key"))


@query("p15_source_class", "{with} select mvt_id, case when taxi_sec < 0 then 'negative' when aobt_us is null and lobt_us is null then 'none' when aobt_us is null then 'lobt only' when abs((t_us - aobt_us) / 1000000.0 - taxi_sec) <= 60 then 'close' else 'far' end as class from d")
def p15(spark, sf):
    gap = F.abs(seconds(F.col("t_us"), F.col("aobt_us")) - F.col("taxi_sec"))
    c = F.when(F.col("taxi_sec") < 0, "negative").when(F.col("aobt_us").isNull() & F.col("lobt_us").isNull(), "none").when(F.col("aobt_us").isNull(), "lobt only").when(gap <= 60, "close").otherwise("far")
    return deps(spark, sf).select("mvt_id", c.alias("class"))


@query("p16_nearest_alternate", "{with}, " + ALT + ", g as (select mvt_id, abs(proxy - taxi_sec) as a, abs(s - taxi_sec) as b, abs(l - taxi_sec) as c from p) select mvt_id, case when least(a, b, c) > 60 or least(a, b, c) is null then 0 when a = least(a, b, c) then 1 when b = least(a, b, c) then 2 else 3 end as source from g")
def p16(spark, sf):
    d = _alternates(spark, sf)
    gaps = [F.abs(F.col(c) - F.col("taxi_sec")) for c in ("proxy", "s", "l")]
    best = F.least(*gaps)
    return d.select("mvt_id", F.when(best.isNull() | (best > 60), 0).when(gaps[0] == best, 1).when(gaps[1] == best, 2).otherwise(3).alias("source"))


@query("c01_text_parts", "{with} select mvt_id, nullif(regexp_extract(flight, '^([A-Za-z]{1,3})', 1), '') as prefix, cast(nullif(regexp_extract(flight, '(\\d{1,4})', 1), '') as int) as number, cast(nullif(regexp_extract(runway, '^(\\d{2})', 1), '') as int) * 10 as heading from m")
def c01(spark, sf):
    part = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return moves(spark, sf).select("mvt_id", part("flight", r"^([A-Za-z]{1,3})").alias("prefix"), part("flight", r"(\d{1,4})").cast("int").alias("number"), (part("runway", r"^(\d{2})").cast("int") * 10).alias("heading"))


@query("c02_composite_keys", "{with} select mvt_id, concat(airport, '_', coalesce(runway, '?'), '_', coalesce(stand, '__MISSING__')) as k from m")
def c02(spark, sf):
    return moves(spark, sf).select("mvt_id", F.concat_ws("_", "airport", F.coalesce("runway", F.lit("?")), F.coalesce("stand", F.lit("__MISSING__"))).alias("k"))


@query("c03_stand_refs", "{with} select mvt_id, regexp_replace(regexp_replace(upper(concat('stand ', stand, ' / gate ', stand, 'b')), '[^A-Z0-9;/]', '', 'g'), '(STAND|GATE)', '', 'g') as ref, string_split(regexp_replace(regexp_replace(upper(concat('stand ', stand, ' / gate ', stand, 'b')), '[^A-Z0-9;/]', '', 'g'), '(STAND|GATE)', '', 'g'), '/')[2] as second from m")
def c03(spark, sf):
    text = F.upper(F.concat(F.lit("stand "), "stand", F.lit(" / gate "), "stand", F.lit("b")))
    ref = F.regexp_replace(F.regexp_replace(text, "[^A-Z0-9;/]", ""), "(STAND|GATE)", "")
    return moves(spark, sf).select("mvt_id", ref.alias("ref"), F.split(ref, "[;/]")[1].alias("second"))


@query("c04_runway_tokens", "{with} select mvt_id, array_to_string(regexp_extract_all(concat('RWY ', lpad(cast(mvt_id % 36 + 1 as varchar), 2, '0'), 'L/', lpad(cast((mvt_id + 18) % 36 + 1 as varchar), 2, '0'), 'R'), '\\d{2}[LRC]?'), ',') as tokens from m")
def c04(spark, sf):
    """Runway tokens of a label, not preceded or followed by another digit."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    label = F.concat(F.lit("RWY "), two(F.col("mvt_id") % 36 + 1), F.lit("L/"), two((F.col("mvt_id") + 18) % 36 + 1), F.lit("R"))
    return moves(spark, sf).select("mvt_id", F.array_join(F.regexp_extract_all(label, F.lit(r"(?<!\d)(\d{2}[LRC]?)(?!\d)"), F.lit(1)), ",").alias("tokens"))


TS = "make_timestamp(t_us)"


@query("c05_clock_parts", f"{{with}} select mvt_id, cast(hour({TS}) as int) as hour, cast(minute({TS}) as int) as minute, cast(isodow({TS}) - 1 as int) as weekday, cast(month({TS}) as int) as month, cast(dayofyear({TS}) as int) as doy, cast(isodow({TS}) >= 6 as int) as weekend from m")
def c05(spark, sf):
    t = F.col("t_us")
    return moves(spark, sf).select("mvt_id", clock.hour(t).alias("hour"), clock.minute(t).alias("minute"), clock.weekday(t).alias("weekday"), F.month(clock.stamp(t)).alias("month"), F.dayofyear(clock.stamp(t)).alias("doy"), (clock.weekday(t) >= 5).cast("int").alias("weekend"))


# Zones of the five test airports.
ZONES = {"A0": "Europe/Rome", "A1": "Europe/London", "A2": "Europe/Athens", "A3": "Europe/Istanbul", "A4": "Europe/Lisbon"}


@query("c06_local_hour", "{with} select mvt_id, cast(hour(make_timestamptz(t_us) at time zone (case airport " + " ".join(f"when '{a}' then '{z}'" for a, z in ZONES.items()) + " end)) as int) as local_hour from m")
def c06(spark, sf):
    """Local hour by the airport's zone."""
    zone = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])[F.col("airport")]
    return moves(spark, sf).select("mvt_id", clock.local_hour(F.col("t_us"), zone).alias("local_hour"))


@query("c07_cyclic", f"{{with}} select mvt_id, round(sin(hour({TS}) * 2 * pi() / 24), 6) + 0.0 as hour_sin, round(cos(hour({TS}) * 2 * pi() / 24), 6) + 0.0 as hour_cos, round(sin(dayofyear({TS}) * 2 * pi() / 365.25), 6) + 0.0 as year_sin from m")
def c07(spark, sf):
    hs, hc = clock.cyclic(clock.hour(F.col("t_us")), 24)
    ys, _ = clock.cyclic(F.dayofyear(clock.stamp(F.col("t_us"))), 365.25)
    return rounded(moves(spark, sf).select("mvt_id", hs.alias("hour_sin"), hc.alias("hour_cos"), ys.alias("year_sin")))


@query("c08_quarter_hours", "{with}, p as (select mvt_id, (sched_us // 1000000) % 900 as p from d) select mvt_id, p as phase, least(p, 900 - p) as distance, p = 0 as exact, (p % 300) = 0 as five from p")
def c08(spark, sf):
    p = clock.quarter_phase(F.col("sched_us"))
    return deps(spark, sf).select("mvt_id", p.alias("phase"), clock.quarter_distance(F.col("sched_us")).alias("distance"), (p == 0).alias("exact"), (F.pmod(p, F.lit(300)) == 0).alias("five"))


CODES = {"snow": "SN", "fog": "FG", "mist": "BR", "rain": "RA|DZ", "freezing": "FZ"}


@query("c09_weather_codes", "with {wx} select obs_id, " + ", ".join(f"coalesce(regexp_matches(upper(code), '{p}'), false) as {n}" for n, p in CODES.items()) + " from wx")
def c09(spark, sf):
    return weather_observations(spark, sf).select("obs_id", *[F.coalesce(F.col("code").rlike(f"(?i)({p})"), F.lit(False)).alias(n) for n, p in CODES.items()])


POINTS = "g as (select mvt_id, (mvt_id % 90) - 45.0 as lat1, (mvt_id % 170) - 85.0 as lon1, (mvt_id * 7 % 90) - 44.5 as lat2, (mvt_id * 13 % 170) - 84.25 as lon2 from m)"


@query("c10_spherical", "{with}, " + POINTS + " select mvt_id, round(2 * 6371000.0 * asin(sqrt(least(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2), 1.0))), 3) as metres, round(fmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360.0, 360.0), 4) as bearing from g")
def c10(spark, sf):
    m = moves(spark, sf).select("mvt_id", (F.col("mvt_id") % 90 - 45.0).alias("lat1"), (F.col("mvt_id") % 170 - 85.0).alias("lon1"), (F.col("mvt_id") * 7 % 90 - 44.5).alias("lat2"), (F.col("mvt_id") * 13 % 170 - 84.25).alias("lon2"))
    p = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    return m.select("mvt_id", F.round(geo.haversine_m(*p), 3).alias("metres"), F.round(geo.bearing_deg(*p), 4).alias("bearing"))


SEG = "s as (select mvt_id, cast(mvt_id % 7 as double) as ax, cast(mvt_id % 5 as double) as ay, cast(mvt_id % 11 as double) as bx, cast(mvt_id % 3 as double) as by_, cast(mvt_id % 13 as double) as cx, cast(mvt_id % 4 as double) as cy, cast(mvt_id % 6 as double) as dx, cast(mvt_id % 9 as double) as dy from m), o as (select *, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) as o1, (bx-ax)*(dy-ay)-(by_-ay)*(dx-ax) as o2, (dx-cx)*(ay-cy)-(dy-cy)*(ax-cx) as o3, (dx-cx)*(by_-cy)-(dy-cy)*(bx-cx) as o4 from s)"


def _box(p: str, a: str, b: str) -> str:
    y = {"a": "ay", "b": "by_", "c": "cy", "d": "dy"}
    return f"{p}x between least({a}x,{b}x) and greatest({a}x,{b}x) and {y[p]} between least({y[a]},{y[b]}) and greatest({y[a]},{y[b]})"


@query("c11_segments", "{with}, " + SEG + f" select mvt_id, (o1 * o2 < 0 and o3 * o4 < 0) or (o1 = 0 and {_box('c', 'a', 'b')}) or (o2 = 0 and {_box('d', 'a', 'b')}) or (o3 = 0 and {_box('a', 'c', 'd')}) or (o4 = 0 and {_box('b', 'c', 'd')}) as crosses from o")
def c11(spark, sf):
    """Closed segments that meet, with parallel and degenerate cases."""
    i = F.col("mvt_id")
    p = [(F.col("mvt_id") % k).cast("double") for k in (7, 5, 11, 3, 13, 4, 6, 9)]
    pairs = [(p[k], p[k + 1]) for k in (0, 2, 4, 6)]
    return moves(spark, sf).select(i, geo.segments_cross(*pairs).alias("crosses"))


@query("c12_bearing_gap", "{with} select mvt_id, abs(fmod(fmod((mvt_id * 37 % 360) - (mvt_id * 11 % 360) + 90.0, 180.0) + 180.0, 180.0) - 90.0) as gap from m")
def c12(spark, sf):
    i = F.col("mvt_id")
    return moves(spark, sf).select("mvt_id", geo.bearing_gap(i * 37 % 360, i * 11 % 360).alias("gap"))


@query("c13_wind", "with {wx}, h as (select obs_id, (obs_id * 29) % 360 as h, wind_dir as w, wind_speed as v from wx) select obs_id, round(case when w between 0 and 360 and v >= 0 then v * cos(radians(w - h)) end, 6) + 0.0 as head, round(case when w between 0 and 360 and v >= 0 then greatest(-v * cos(radians(w - h)), 0) end, 6) + 0.0 as tail, round(case when w between 0 and 360 and v >= 0 then abs(v * sin(radians(w - h))) end, 6) + 0.0 as cross_wind from h")
def c13(spark, sf):
    head, tail, cross = geo.wind(F.col("obs_id") * 29 % 360, F.col("wind_dir"), F.col("wind_speed"))
    return rounded(weather_observations(spark, sf).select("obs_id", head.alias("head"), tail.alias("tail"), cross.alias("cross_wind")))


@query("c14_round_clip", "{with} select mvt_id, greatest(taxi_sec, 0) as clipped, cast(floor(taxi_sec / 60) as bigint) as minutes from m")
def c14(spark, sf):
    return moves(spark, sf).select("mvt_id", F.greatest("taxi_sec", F.lit(0.0)).alias("clipped"), F.floor(F.col("taxi_sec") / 60).alias("minutes"))


@query("c15_padded_arrays", "{with}, l as (select flight, list(mvt_id order by t_us, mvt_id)[1:4] as ids from d group by flight) select flight, array_to_string(list_concat(ids, list_value(0, 0, 0, 0)[1 : 4 - len(ids)]), ',') as padded, array_to_string(list_transform(range(4), lambda i: case when i < len(ids) then 1 else 0 end), '') as mask from l")
def c15(spark, sf):
    """First four movements of a flight, zero-padded, with a presence mask."""
    rows = deps(spark, sf).groupBy("flight").agg(F.slice(F.array_sort(F.collect_list(F.struct("t_us", "mvt_id"))), 1, 4).alias("x"))
    ids = F.transform("x", lambda r: r["mvt_id"])
    pad = F.concat(ids, F.array_repeat(F.lit(0).cast("long"), F.lit(4) - F.size("x")))
    mask = F.concat(F.repeat(F.lit("1"), F.size("x")), F.repeat(F.lit("0"), F.lit(4) - F.size("x")))
    return rows.select("flight", F.array_join(pad, ",").alias("padded"), mask.alias("mask"))


@query("a20_bins", "{with}, x as (select mvt_id, (t_us - aobt_us) / 1000000.0 as p from d) select mvt_id, coalesce(cast(p > 300 as int) + cast(p > 600 as int) + cast(p > 1200 as int), -1) as above, case when p > 0 and p <= 300 then 0 when p > 300 and p <= 900 then 1 when p > 900 and p <= 7200 then 2 end as bin from x")
def a20(spark, sf):
    p = seconds(F.col("t_us"), F.col("aobt_us"))
    return deps(spark, sf).select("mvt_id", strictly_above(p, [300, 600, 1200]).alias("above"), cut_right(p, [0, 300, 900, 7200]).alias("bin"))

