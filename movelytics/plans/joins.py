"""Scans, equi joins, set operations, weather and geometry: S*, J01-J04, J11-J21, U*, G*, A06-A07, T*."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, geo
from ..operators.context import unique_keys
from ..operators.fused import Mark, Over, context, fuse
from ..operators.order import row_numbers
from ..operators.quality import coverage, differences, digest, exact_ids, ordered_digest, schema_fingerprint, vocabulary
from ..operators.weather import at_hour, weather_table
from ..sources.geometry import STRIPS_SQL, end_codes, strip_edges, strip_table, strips
from ..sources.tables import scan, weather_observations
from .audits import shared
from .base import MIN, S, arrs, deps, moves, query, rounded, table

NEEDED = ["event_id", "user_id", "event_type", "value", "ts"]


@query("s01_required_scan", "select event_type, count(*) as n, count(distinct user_id) as users from events group by event_type")
def s01(spark, sf):
    """Scan with a required-column check; only the asked columns are read."""
    return scan(spark, [f"{sf}/events.parquet"], NEEDED).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("s03_phase_projection", "{with} select mvt_id, airport, runway, t_us from a")
def s03(spark, sf):
    return arrs(spark, sf).select("mvt_id", "airport", "runway", "t_us")


@query("s06_subset_by_ids", "{with} select mvt_id, airport, t_us from m where mvt_id in (select o_orderkey from orders where o_orderkey % 3 = 0)")
def s06(spark, sf):
    ids = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("mvt_id"))
    return moves(spark, sf).join(ids, "mvt_id", "left_semi").select("mvt_id", "airport", "t_us")


@query("s12_readback_diff", "{with} select count(*) as n, 0 as missing, 0 as extra from m")
def s12(spark, sf):
    """Rows of a table written and read back, and its differences both ways to what was written; none expected."""
    m = moves(spark, sf).select("mvt_id", "phase", "airport", "runway", "t_us", "taxi_sec")
    path = shared(spark, "readback")
    m.write.mode("errorifexists").parquet(path)
    back = spark.read.parquet(path)
    n = lambda x, y, name: x.exceptAll(y).agg(F.count("*").cast("int").alias(name))
    return back.agg(F.count("*").alias("n")).crossJoin(n(m, back, "missing")).crossJoin(n(back, m, "extra"))


@query("s13_table_diff", "{with}, o as (select mvt_id, airport, case when mvt_id % 10 = 3 then null else stand end as stand, t_us + (mvt_id % 4 // 3) as t_us from m where mvt_id % 50 <> 1), j as (select m.mvt_id as x, o.mvt_id as y, m.airport is distinct from o.airport as c1, m.stand is distinct from o.stand as c2, m.t_us is distinct from o.t_us as c3 from m full join o on m.mvt_id = o.mvt_id) select unnest(['mvt_id', 'airport', 'stand', 't_us']) as \"column\", unnest([count(*) filter (x is null or y is null), count(*) filter (c1), count(*) filter (c2), count(*) filter (c3)]) as mismatches from j")
def s13(spark, sf):
    """Mismatches of each column between two builds of one table, by id."""
    m = moves(spark, sf).select("mvt_id", "airport", "stand", "t_us")
    changed = m.where("mvt_id % 50 <> 1").select("mvt_id", "airport", F.when(F.col("mvt_id") % 10 != 3, F.col("stand")).alias("stand"), (F.col("t_us") + F.expr("(mvt_id % 4) div 3")).alias("t_us"))
    return differences(m, changed, "mvt_id")


LINE = "sha256(concat_ws('|', cast(mvt_id as varchar), airport, coalesce(runway, '~'), cast(t_us as varchar)))"


LABEL_LINE = "sha256(concat_ws('|', cast(mvt_id as varchar), cast(cast(round(taxi_sec * 10) as bigint) as varchar)))"
_PARTS = "cast(sum(cast(concat('0x', substring({h}, 1, 7)) as bigint)) as bigint) as {a}, cast(sum(cast(concat('0x', substring({h}, 8, 7)) as bigint)) as bigint) as {b}"


@query(
    "s15_digests",
    "{with}, l as (select phase, " + LINE + " as h, " + LABEL_LINE + " as g, row_number() over (partition by phase order by mvt_id) - 1 as r from m), "
    + "c1 as (select phase, r // 4096 as r, sha256(string_agg(h, '' order by r)) as h from l group by phase, r // 4096), c2 as (select phase, r // 4096 as r, sha256(string_agg(h, '' order by r)) as h from c1 group by phase, r // 4096), "
    + "c3 as (select phase, sha256(string_agg(h, '' order by r)) as ordered from c2 group by phase) "
    + "select phase, count(*) as n, " + _PARTS.format(h="h", a="sum_a", b="sum_b") + ", " + _PARTS.format(h="g", a="label_a", b="label_b") + ", any_value(ordered) as ordered from l join c3 using (phase) group by phase",
)
def s15(spark, sf):
    """Digests of ids and keys and of labels, whatever the order, and one of the values in the order of ids."""
    m = moves(spark, sf).withColumn("label", F.round(F.col("taxi_sec") * 10).cast("long"))
    values = ["mvt_id", "airport", "runway", "t_us"]
    labels = digest(m, ["mvt_id", "label"], ["phase"]).select("phase", F.col("sum_a").alias("label_a"), F.col("sum_b").alias("label_b"))
    return digest(m, values, ["phase"]).join(labels, "phase").join(ordered_digest(m, values, "mvt_id", ["phase"]).drop("n"), "phase")


@query("s16_vocabularies", "{with}, v as (select distinct 'airport' as c, airport as v from m union select distinct 'runway', runway from m union select distinct 'ac_type', ac_type from m) select c as \"column\", count(*) as n_values, cast(sum(cast(concat('0x', substring(sha256(v), 1, 7)) as bigint)) as bigint) as digest from v where v is not null group by c")
def s16(spark, sf):
    return vocabulary(moves(spark, sf), ["airport", "runway", "ac_type"])


_CATEGORIES = ("phase", "airport", "runway", "ac_type")
_COLUMNS = ("mvt_id", "phase", "airport", "runway", "stand", "ac_type", "t_us", "aobt_us", "taxi_sec")


@query(
    "s16_schema",
    "{with}, ty as (select " + ", ".join(f"typeof({c}) as {c}" for c in _COLUMNS) + " from m limit 1), "
    + "cl as (select " + ", ".join(f"unnest([{v}]) as {n}" for v, n in ((", ".join(map(str, range(len(_COLUMNS)))), "position"), (", ".join(f"'{c}'" for c in _COLUMNS), '"column"'), (", ".join(_COLUMNS), "duck"))) + " from ty), "
    + "ct as (select position, \"column\", case duck when 'VARCHAR' then 'string' else lower(duck) end as type from cl), "
    + "v as (" + " union ".join(f"select distinct '{c}' as c, {c} as v from m" for c in _CATEGORIES) + "), "
    + "vo as (select c as \"column\", count(*) as n_values, cast(sum(cast(concat('0x', substring(sha256(v), 1, 7)) as bigint)) as bigint) as digest from v where v is not null group by c) "
    + "select position, \"column\", type, n_values, digest, (select sha256(string_agg(\"column\" || ':' || type, ',' order by position)) from ct) as schema from ct left join vo using (\"column\")",
)
def s16_schema(spark, sf):
    """Schema and vocabularies of a feature view."""
    return schema_fingerprint(moves(spark, sf).select(*_COLUMNS), list(_CATEGORIES))


@query("s17_report", "{with} select count(*) as n, round(min(taxi_sec), 6) as lo, round(max(taxi_sec), 6) as hi, round(avg(taxi_sec), 6) as mean, count(*) filter (taxi_sec > 86400) as over_day from d")
def s17(spark, sf):
    return rounded(deps(spark, sf).agg(F.count("*").alias("n"), F.min("taxi_sec").alias("lo"), F.max("taxi_sec").alias("hi"), F.avg("taxi_sec").alias("mean"), F.count_if(F.col("taxi_sec") > 86400).alias("over_day")))


@query("s18_coverage", "{with} select phase, unnest(['runway', 'aobt_us', 'block_us']) as \"column\", unnest([round(avg((runway is not null)::int), 6), round(avg((aobt_us is not null)::int), 6), round(avg((block_us is not null)::int), 6)]) as share from m group by phase")
def s18(spark, sf):
    return rounded(coverage(moves(spark, sf), ["runway", "aobt_us", "block_us"], ["phase"]))


@query("j01_exact_ids", "{with}, o as (select o_orderkey as k from orders) select (select count(*) from m where mvt_id not in (select k from o)) as only_a, (select count(*) from o where k not in (select mvt_id from m)) as only_b, 0 as null_ids, 0 as repeated")
def j01(spark, sf):
    out = exact_ids(moves(spark, sf).select("mvt_id"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("mvt_id")), "mvt_id")
    return out


@query("j02_group_lookup", "{with}, s as (select airport, runway, avg(taxi_sec) as v from d where mvt_id % 2 = 0 group by all), g as (select avg(taxi_sec) as v from d where mvt_id % 2 = 0) select d.mvt_id, round(coalesce(s.v, g.v), 6) as prior from d cross join g left join s on d.airport = s.airport and d.runway = s.runway where d.mvt_id % 2 = 1")
def j02(spark, sf):
    """Group statistics by key; unseen groups get the overall mean."""
    d = deps(spark, sf)
    train = d.where("mvt_id % 2 = 0")
    stats = train.groupBy("airport", "runway").agg(F.avg("taxi_sec").alias("v"))
    top = train.agg(F.avg("taxi_sec").alias("g"))
    out = d.where("mvt_id % 2 = 1").join(stats, ["airport", "runway"], "left").crossJoin(F.broadcast(top))
    return rounded(out.select("mvt_id", F.coalesce("v", "g").alias("prior")))


FLAGS = {"snow": "SN", "fog": "FG", "mist": "BR", "rain": "RA|DZ", "freezing": "FZ"}
WTAB = (
    "w0 as (select airport, (t_us // 3600000000) * 3600000000 as hour_us, count(*) as n_obs, median(temperature) as temperature, median(wind_speed) as wind_speed, max(precip) as precip, min(visibility) as visibility, "
    + ", ".join(f"coalesce(bool_or(regexp_matches(upper(code), '{p}')), false) as {n}" for n, p in FLAGS.items())
    + ", max_by(wind_dir, (t_us, wind_dir)) filter (wind_dir between 0 and 360) as wind_dir from wx group by all), g as (select airport, unnest(range((lo // 86400000000) * 86400000000, (hi // 86400000000) * 86400000000 + 86400000000, 3600000000)) as hour_us from (select distinct airport from wx), (select min(t_us) as lo, max(t_us) as hi from wx)), "
    + "wt as materialized (select g.airport, g.hour_us, coalesce(n_obs, 0) as n_obs, temperature, wind_speed, precip, visibility, coalesce(snow, false) as snow, coalesce(fog, false) or coalesce(visibility < 1000, false) as fog_hour, coalesce(temperature <= 0 and (snow or freezing or precip > 0), false) as deicing, wind_dir from g left join w0 on g.airport = w0.airport and g.hour_us = w0.hour_us)"
)
WCOLS = ["n_obs", "temperature", "wind_speed", "precip", "visibility", "snow", "fog_hour", "deicing", "wind_dir"]


@query("a06_hourly_weather", "with {wx}, " + WTAB + " select airport, hour_us, n_obs, round(temperature, 6) as temperature, round(wind_speed, 6) as wind_speed, round(precip, 6) as precip, round(visibility, 6) as visibility, snow, fog_hour, deicing, wind_dir from wt")
def a06(spark, sf):
    """Hourly roll-up on the complete grid, with fog and de-icing flags and the last valid direction (W23, A07, J21)."""
    return rounded(weather_table(weather_observations(spark, sf)).select("airport", "hour_us", *WCOLS))


@query("g09_grid_check", "with {wx}, " + WTAB + " select airport, count(*) as hours, count(distinct hour_us) as distinct_hours, count(*) filter (n_obs > 0) as with_data from wt group by airport")
def g09(spark, sf):
    w = weather_table(weather_observations(spark, sf))
    return w.groupBy("airport").agg(F.count("*").alias("hours"), F.countDistinct("hour_us").alias("distinct_hours"), F.count_if(F.col("n_obs") > 0).alias("with_data"))


@query("j03_weather_lookup", "with {m}, {wx}, " + WTAB + " select m.mvt_id, wt.n_obs, round(wt.temperature, 6) as temperature, wt.fog_hour from m left join wt on m.airport = wt.airport and wt.hour_us = (m.t_us // 3600000000) * 3600000000 where m.phase = 'DEP'")
def j03(spark, sf):
    return rounded(at_hour(deps(spark, sf).select("mvt_id", "airport", "t_us"), weather_table(weather_observations(spark, sf))).select("mvt_id", "n_obs", "temperature", "fog_hour"))


@query("j04_unique_key_join", "{with}, ud as (select * from d where flight_id in (select flight_id from d group by 1 having count(*) = 1)), ua as (select * from a where flight_id in (select flight_id from a group by 1 having count(*) = 1)) select ud.mvt_id, case when ua.t_us - ud.t_us between -64800000000 and 64800000000 then ua.mvt_id end as arrival from ud left join ua on ud.flight_id = ua.flight_id")
def j04(spark, sf):
    """Join on keys that occur once on each side; partners too far apart in time are nulled."""
    d, a = unique_keys(deps(spark, sf), ["flight_id"]), unique_keys(arrs(spark, sf), ["flight_id"])
    both = d.select("mvt_id", "flight_id", "t_us").join(a.select("flight_id", F.col("mvt_id").alias("aid"), F.col("t_us").alias("at_us")), "flight_id", "left")
    return both.select("mvt_id", F.when((F.col("at_us") - F.col("t_us")).between(-64_800 * S, 64_800 * S), F.col("aid")).alias("arrival"))


@query("j11_semi", "{with} select mvt_id from d where flight in (select flight from a)")
def j11(spark, sf):
    return deps(spark, sf).join(arrs(spark, sf).select("flight"), "flight", "left_semi").select("mvt_id")


@query("j12_anti", "{with} select mvt_id from d where taxi_sec is not null and not exists (select 1 from orders where o_orderkey = d.mvt_id)")
def j12(spark, sf):
    done = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mvt_id"))
    return deps(spark, sf).where("taxi_sec is not null").join(done, "mvt_id", "left_anti").select("mvt_id")


@query("j13_shared_flights", "{with} select count(*) as pairs, count(*) filter (d.airport = a.airport) as same_place, count(*) filter (a.t_us > d.t_us) as later from d join a on d.flight_id = a.flight_id")
def j13(spark, sf):
    a = arrs(spark, sf).select("flight_id", F.col("airport").alias("place"), F.col("t_us").alias("at_us"))
    return deps(spark, sf).join(a, "flight_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("airport") == F.col("place")).alias("same_place"), F.count_if(F.col("at_us") > F.col("t_us")).alias("later"))


@query("j14_recovery_audit", "{with} select count(distinct d.mvt_id) as missing, count(distinct case when a.mvt_id is not null then d.mvt_id end) as with_counterpart, count(distinct case when a.airport = d.dest then d.mvt_id end) as route_ok, count(distinct case when a.lobt_us is not null then d.mvt_id end) as recoverable from d left join a on d.flight_id = a.flight_id where d.aobt_us is null")
def j14(spark, sf):
    a = arrs(spark, sf).select("flight_id", F.col("mvt_id").alias("aid"), F.col("airport").alias("place"), F.col("lobt_us").alias("clock"))
    both = deps(spark, sf).where("aobt_us is null").join(a, "flight_id", "left")
    n = lambda c, name: F.countDistinct(F.when(c, F.col("mvt_id"))).alias(name)
    return both.agg(F.countDistinct("mvt_id").alias("missing"), n(F.col("aid").isNotNull(), "with_counterpart"), n(F.col("place") == F.col("dest"), "route_ok"), n(F.col("clock").isNotNull(), "recoverable"))


@query("j17_assembly", "{with}, e1 as (select mvt_id, taxi_sec + 10 as p1 from d where mvt_id % 5 <> 0), e2 as (select mvt_id, (t_us - aobt_us) / 1000000.0 as p2 from d), e3 as (select mvt_id, taxi_sec * 2 as p3 from d where mvt_id % 7 <> 0) select d.mvt_id, p1, p2, p3, p1 is not null and p2 is not null and p3 is not null as complete from d left join e1 using (mvt_id) left join e2 using (mvt_id) left join e3 using (mvt_id)")
def j17(spark, sf):
    """Several estimates joined on one id, with a coverage flag."""
    d = deps(spark, sf)
    experts = [d.where("mvt_id % 5 <> 0").select("mvt_id", (F.col("taxi_sec") + 10).alias("p1")), d.select("mvt_id", ((F.col("t_us") - F.col("aobt_us")) / 1_000_000.0).alias("p2")), d.where("mvt_id % 7 <> 0").select("mvt_id", (F.col("taxi_sec") * 2).alias("p3"))]
    out = reduce(lambda x, y: x.join(y, "mvt_id", "left"), experts, d.select("mvt_id"))
    return out.withColumn("complete", F.col("p1").isNotNull() & F.col("p2").isNotNull() & F.col("p3").isNotNull())


#: Fields on which two tables of the same movements must agree, and how the second one here departs from the first.
META = {"airport": "airport", "t_us": "t_us", "taxi_sec": "taxi_sec", "fold": "mvt_id % 5", "month": "month(TS)", "gate": "coalesce(t_us - aobt_us between 0 and 7200000000, false)"}
_OTHER = {"airport": "case when mvt_id % 9 <> 0 then airport end", "t_us": "t_us", "taxi_sec": "taxi_sec + case when mvt_id % 101 = 0 then 1 else 0 end", "fold": "mvt_id % 5", "month": "month(TS) + case when mvt_id % 1000 = 7 then 1 else 0 end", "gate": "coalesce(t_us - aobt_us between 0 and 7000000000, false)"}


def _meta(fields: dict[str, str], ts: str) -> str:
    return ", ".join(f"{e.replace('TS', ts)} as {n}" for n, e in fields.items())


@query("j18_metadata_agreement", "{with}, x as (select mvt_id, " + _meta(META, "make_timestamp(t_us)") + " from m), o as (select mvt_id, " + _meta(_OTHER, "make_timestamp(t_us)") + " from m) select " + ", ".join(f"count(*) filter (x.{n} is distinct from o.{n}) as {n}" for n in META) + " from x join o using (mvt_id)")
def j18(spark, sf):
    """On how many rows two tables of the same ids disagree, by field: place, time, target, fold, month, gate."""
    m = moves(spark, sf)
    x, o = (m.selectExpr("mvt_id", *[f"{e.replace('TS', 'timestamp_micros(t_us)')} as {p}{n}" for n, e in fields.items()]) for fields, p in ((META, ""), (_OTHER, "o_")))
    return x.join(o, "mvt_id").agg(*[F.count_if(~F.col(n).eqNullSafe(F.col(f"o_{n}"))).alias(n) for n in META])


@query("j19_matcher_agreement", "{with}, x as (select mvt_id, flight_id from d), u as (select flight_id, min(mvt_id) as m1, count(*) as n from a group by 1), y as (select d.mvt_id, min(a.mvt_id) as m2 from d left join a on a.flight = d.flight and a.airport = d.dest group by 1) select count(*) as n, count(*) filter (m1 is not null) as by_id, count(*) filter (m2 is not null) as by_name, count(*) filter (m1 = m2) as same from x left join u on x.flight_id = u.flight_id left join y on x.mvt_id = y.mvt_id")
def j19(spark, sf):
    d, a = deps(spark, sf), arrs(spark, sf)
    by_id = a.groupBy("flight_id").agg(F.min("mvt_id").alias("m1"))
    by_name = a.groupBy("flight", F.col("airport").alias("dest")).agg(F.min("mvt_id").alias("m2"))
    both = d.join(by_id, "flight_id", "left").join(by_name, ["flight", "dest"], "left")
    return both.agg(F.count("*").alias("n"), F.count("m1").alias("by_id"), F.count("m2").alias("by_name"), F.count_if(F.col("m1") == F.col("m2")).alias("same"))


@query("j20_template", "{with}, t as (select o_orderkey as mvt_id, (o_orderkey % 17) * 1000000000000 + o_orderkey as pos from orders) select t.pos, t.mvt_id, coalesce(d.taxi_sec, 0.0) as value from t left join d on t.mvt_id = d.mvt_id")
def j20(spark, sf):
    """Every id of a template in its own order, with the value or 0."""
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mvt_id")).withColumn("pos", F.col("mvt_id") % 17 * 1_000_000_000_000 + F.col("mvt_id"))
    return t.join(deps(spark, sf).select("mvt_id", "taxi_sec"), "mvt_id", "left").select("pos", "mvt_id", F.coalesce("taxi_sec", F.lit(0.0)).alias("value"))


@query("u01_union_peers", "{with} select phase, mvt_id, t_us, aobt_us as start_us, null as block_us from d union all select phase, mvt_id, t_us, null, block_us from a")
def u01(spark, sf):
    d = deps(spark, sf).select("phase", "mvt_id", "t_us", F.col("aobt_us").alias("start_us"))
    return d.unionByName(arrs(spark, sf).select("phase", "mvt_id", "t_us", "block_us"), allowMissingColumns=True)


@query("u02_union_folds", "{with}, f as (select mvt_id, (t_us // 86400000000) % 4 as fold from m) select fold, count(*) as n, count(distinct mvt_id) as ids from f group by fold")
def u02(spark, sf):
    m = moves(spark, sf).select("mvt_id", F.pmod(clock.day_number(F.col("t_us")), F.lit(4)).alias("fold"))
    whole = reduce(lambda x, y: x.unionByName(y), [m.where(F.col("fold") == k) for k in range(4)])
    return whole.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("mvt_id").alias("ids"))


@query("u03_id_sets", "{with} select (select count(*) from (select mvt_id from d where mvt_id % 2 = 0 except select mvt_id from d where mvt_id % 3 = 0)) as left_only, (select count(*) from (select mvt_id from d where mvt_id % 3 = 0 except select mvt_id from d where mvt_id % 2 = 0)) as right_only")
def u03(spark, sf):
    x, y = (deps(spark, sf).where(f"mvt_id % {k} = 0").select("mvt_id") for k in (2, 3))
    return x.exceptAll(y).agg(F.count("*").alias("left_only")).crossJoin(y.exceptAll(x).agg(F.count("*").alias("right_only")))


@query("u04_disjoint", "{with} select count(*) as shared from (select mvt_id from d where (t_us // 86400000000) % 4 = 0 intersect select mvt_id from d where (t_us // 86400000000) % 4 = 1)")
def u04(spark, sf):
    d = deps(spark, sf).withColumn("f", F.pmod(clock.day_number(F.col("t_us")), F.lit(4)))
    return d.where("f = 0").select("mvt_id").intersect(d.where("f = 1").select("mvt_id")).agg(F.count("*").alias("shared"))


@query("u05_vocabulary_union", "{with} select distinct flight from (select flight from d union select flight from a)")
def u05(spark, sf):
    return deps(spark, sf).select("flight").union(arrs(spark, sf).select("flight")).distinct()


@query("u06_difference", "{with} select mvt_id from d except select mvt_id from d where taxi_sec > 100")
def u06(spark, sf):
    d = deps(spark, sf)
    return d.select("mvt_id").subtract(d.where("taxi_sec > 100").select("mvt_id"))


@query("u07_keep_none", "{with} select mvt_id from a where flight in (select flight from a group by flight having count(*) = 1)")
def u07(spark, sf):
    return unique_keys(arrs(spark, sf), ["flight"]).select("mvt_id")


def _metres(a: str, b: str) -> str:
    return f"2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians({b}_lat - {a}_lat) / 2), 2) + cos(radians({a}_lat)) * cos(radians({b}_lat)) * pow(sin(radians({b}_lon - {a}_lon) / 2), 2))))"


def _bearing(a: str, b: str) -> str:
    d = f"radians({b}_lon - {a}_lon)"
    return f"fmod(degrees(atan2(sin({d}) * cos(radians({b}_lat)), cos(radians({a}_lat)) * sin(radians({b}_lat)) - sin(radians({a}_lat)) * cos(radians({b}_lat)) * cos({d}))) + 360, 360)"


def _turn(a: str, b: str, c: str) -> str:
    return f"(({b}_x - {a}_x) * ({c}_y - {a}_y) - ({b}_y - {a}_y) * ({c}_x - {a}_x))"


def _on(a: str, b: str, c: str) -> str:
    return f"({_turn(a, b, c)} = 0 and {c}_x between least({a}_x, {b}_x) and greatest({a}_x, {b}_x) and {c}_y between least({a}_y, {b}_y) and greatest({a}_y, {b}_y))"


def _far(c: str, a: str, b: str) -> str:
    dx, dy = f"({b}_x - {a}_x)", f"({b}_y - {a}_y)"
    k = f"greatest(0, least(1, (({c}_x - {a}_x) * {dx} + ({c}_y - {a}_y) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow({c}_x - {a}_x - {k} * {dx}, 2) + pow({c}_y - {a}_y - {k} * {dy}, 2))"


_A, _B, _C, _D = "s.le", "s.he", "o.le", "o.he"
_CROSS = f"((sign({_turn(_A, _B, _C)}) * sign({_turn(_A, _B, _D)}) < 0 and sign({_turn(_C, _D, _A)}) * sign({_turn(_C, _D, _B)}) < 0) or {_on(_A, _B, _C)} or {_on(_A, _B, _D)} or {_on(_C, _D, _A)} or {_on(_C, _D, _B)})"
_GAP = "abs(fmod(fmod(s.le_heading - o.le_heading + 90, 180) + 180, 180) - 90)"
#: Strips with length, headings and planar ends, their ends' codes, and every pair of an airport by the predicates themselves.
GEO = (
    "strips as (" + STRIPS_SQL.replace("{customer}", "customer") + "), "
    + f"sl as (select *, {_metres('le', 'he')} as length_m, {_bearing('le', 'he')} as le_heading, {_bearing('he', 'le')} as he_heading from strips where le_lat between -90 and 90 and he_lat between -90 and 90 and le_lon between -180 and 180 and he_lon between -180 and 180), "
    + "so as (select airport, avg((le_lat + he_lat) / 2) as lat0, avg((le_lon + he_lon) / 2) as lon0 from sl group by airport), "
    + "sg as materialized (select sl.*, " + ", ".join(f"({e}_lon - lon0) * 6371000.0 * radians(1) * cos(radians(lat0)) as {e}_x, ({e}_lat - lat0) * 6371000.0 * radians(1) as {e}_y" for e in ("le", "he")) + " from sl join so using (airport) where length_m >= 1), "
    + "ends as (select airport, sid, le as code, le_heading as heading from sg union all select airport, sid, he, he_heading from sg), "
    + "ec as materialized (select airport, code, min(sid) as sid, min(heading) as heading from ends group by airport, code having count(distinct sid) = 1), "
    + f"edge as materialized (select * from (select s.airport, s.sid, o.sid as other, case when {_CROSS} then 'intersecting' when {_GAP} <= 15 and least({_far(_A, _C, _D)}, {_far(_B, _C, _D)}, {_far(_C, _A, _B)}, {_far(_D, _A, _B)}) <= 2000 then 'near_parallel' end as relation from sg s join sg o on s.airport = o.airport and s.sid <> o.sid) where relation is not null)"
)
RELATIONS = ("intersecting", "near_parallel")
RELATED = [(f"{rel}_{ph.lower()}{w}", rel, ph, w) for rel in RELATIONS for ph in ("ARR", "DEP") for w in (15, 60)]
#: Movements with their strip, and events fanned out to the strips that they bear on.
TRAFFIC_SQL = "c as materialized (select m.*, ec.sid, ec.heading from m left join ec on m.airport = ec.airport and m.runway = ec.code), fan as materialized (select c.airport, edge.sid, edge.relation, c.phase, c.t_us from c join edge on c.airport = edge.airport and c.sid = edge.other)"
RELATED_SQL = ", ".join(f"case when q.sid is null then null else (select count(*) from fan e where e.airport = q.airport and e.sid = q.sid and e.relation = '{rel}' and e.phase = '{ph}' and e.t_us between q.t_us - {w * 60_000_000} and q.t_us - 1) end as {n}" for n, rel, ph, w in RELATED)


@query("g02_strip_table", "with " + GEO + " select airport, sid, round(length_m, 3) as length_m, round(le_heading, 4) as le_heading, round(he_heading, 4) as he_heading from sg")
def g02(spark, sf):
    """Valid strips with length and headings."""
    return valid_strips(spark, sf).select("airport", "sid", F.round("length_m", 3).alias("length_m"), F.round("le_heading", 4).alias("le_heading"), F.round("he_heading", 4).alias("he_heading"))


def codes_of(s) -> DataFrame:
    return end_codes(s).select("airport", F.col("code").alias("runway"), "sid", "heading")


def written(spark, name: str, df: DataFrame) -> DataFrame:
    """A table of the shared folder that holds df."""
    path = shared(spark, f"layout-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def valid_strips(spark, sf) -> DataFrame:
    """The strip table, over rows that are written first: else Spark moves the tests of length and range below the rows' own expressions, into one condition of many thousand characters that is worked out row by row in one task."""
    return strip_table(written(spark, "rows", strips(spark, sf).repartition("airport", "sid")))


def layout(spark, sf, toward: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(strips, codes, near) of the codes that movements use, from tables in the shared folder: near has the list of related ones, of all strips, for each strip with such a code; with `toward`, for every strip those that have such a code.

    Pairs of strips that no movement uses are not worked out, and joins of movements with the few codes in use don't exchange the movements.
    Built once, so that views over it don't plan the geometry again.
    """

    kept = partial(written, spark)
    whole = kept("strips", valid_strips(spark, sf))
    codes = kept("codes", codes_of(whole).join(moves(spark, sf).select("airport", "runway").distinct(), ["airport", "runway"], "left_semi"))
    used = kept("used", whole.join(codes.select("airport", "sid").distinct(), ["airport", "sid"], "left_semi"))
    edges = strip_edges(whole, used) if toward else strip_edges(used, whole)
    return used, codes, kept("near", edges.groupBy("airport", "sid").agg(F.collect_list(F.struct("other", "relation")).alias("near")))


@query("g03_end_codes", "{with}, " + GEO + " select m.mvt_id, ec.sid from m left join ec on m.airport = ec.airport and m.runway = ec.code")
def g03(spark, sf):
    """Runway codes mapped to strips; a code of several strips maps to none."""
    return moves(spark, sf).join(codes_of(valid_strips(spark, sf)), ["airport", "runway"], "left").select("mvt_id", "sid")


@query("g04_strip_edges", "with " + GEO + " select airport, sid, other, relation from edge")
def g04(spark, sf):
    """Crossing and near-parallel strips of every airport, by cells and exact predicates."""
    return strip_edges(valid_strips(spark, sf))


def strip_traffic(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(departures with sid and heading, strips, the pass over related strips' events)."""
    s, codes, near = layout(spark, sf)
    m = moves(spark, sf).join(codes, ["airport", "runway"], "left")
    edges = near.select("airport", F.col("sid").alias("of"), F.inline("near")).withColumnRenamed("other", "sid")
    fan = m.where("sid is not null").join(edges, ["airport", "sid"]).select("airport", F.col("of").alias("sid"), "relation", "phase", "t_us")
    q = m.where("phase = 'DEP'").select("mvt_id", "airport", "sid", "heading", "t_us")
    marks = {f"{rel}_{ph}": Mark("t_us", f"relation = '{rel}' and phase = '{ph}'") for rel in RELATIONS for ph in ("ARR", "DEP")}
    asks = {n: Over(f"{rel}_{ph}", -w * MIN, -1) for n, rel, ph, w in RELATED}
    sizes = near.select("airport", "sid", *[F.expr(f"size(filter(near, x -> x.relation = '{r}'))").cast("long").alias(f"{r}_strips") for r in RELATIONS])
    shape = s.select("airport", "sid", "length_m").join(sizes, ["airport", "sid"], "left")
    return q, shape, fuse([context(q.select("mvt_id", "airport", "sid", "t_us"), fan, ["airport", "sid"], "t_us", marks, asks, "mvt_id")], "mvt_id")


@query("w13_related_traffic", "{with}, " + GEO + ", " + TRAFFIC_SQL + " select q.mvt_id, " + RELATED_SQL + " from c q where q.phase = 'DEP'")
def w13(spark, sf):
    """Arrivals and departures on crossing and near-parallel strips in [t - w, t) (J15, J16)."""
    q, _, related = strip_traffic(spark, sf)
    return q.select("mvt_id").join(related, "mvt_id", "left").select("mvt_id", *[n for n, *_ in RELATED])


_WIND = "case when q.heading is not null and wt.wind_dir between 0 and 360 and wt.wind_speed >= 0 then {} end"
_G05 = {
    "heading_sin": "round(sin(radians(q.heading)), 5) + 0.0", "heading_cos": "round(cos(radians(q.heading)), 5) + 0.0", "length_m": "round(sg.length_m, 5) + 0.0",
    "head": "round(" + _WIND.format("wt.wind_speed * cos(radians(wt.wind_dir - q.heading))") + ", 5) + 0.0",
    "tail": "round(" + _WIND.format("greatest(-wt.wind_speed * cos(radians(wt.wind_dir - q.heading)), 0)") + ", 5) + 0.0",
    "crosswind": "round(" + _WIND.format("abs(wt.wind_speed * sin(radians(wt.wind_dir - q.heading)))") + ", 5) + 0.0",
    **{f"{r}_strips": f"case when q.sid is not null then (select count(*) from edge where edge.airport = q.airport and edge.sid = q.sid and relation = '{r}') end" for r in RELATIONS},
}


@query("g05_geometry_wind", "{with}, {wx}, " + WTAB + ", " + GEO + ", " + TRAFFIC_SQL + " select q.mvt_id, " + ", ".join(f"{e} as {n}" for n, e in _G05.items()) + ", " + RELATED_SQL + " from c q left join sg on q.airport = sg.airport and q.sid = sg.sid left join wt on q.airport = wt.airport and wt.hour_us = (q.t_us // 3600000000) * 3600000000 where q.phase = 'DEP'")
def g05(spark, sf):
    """The geometry view: heading, length, wind along and across, related strips and their traffic. Unmapped runways give nulls throughout, no time the static columns alone, a bad wind three nulls."""
    q, shape, related = strip_traffic(spark, sf)
    w = at_hour(q.join(shape, ["airport", "sid"], "left"), weather_table(weather_observations(spark, sf)).select("airport", "hour_us", "wind_dir", "wind_speed"))
    head, tail, cross = geo.wind(F.col("heading"), F.col("wind_dir"), F.col("wind_speed"))
    turned = {"heading_sin": F.sin(F.radians("heading")), "heading_cos": F.cos(F.radians("heading")), "head": head, "tail": tail, "crosswind": cross}
    counted = [F.when(F.col("sid").isNotNull(), F.coalesce(f"{r}_strips", F.lit(0).cast("long"))).alias(f"{r}_strips") for r in RELATIONS]
    out = w.join(related, "mvt_id", "left").select("mvt_id", *[c.alias(n) for n, c in turned.items()], "length_m", *counted, *[n for n, *_ in RELATED])
    return rounded(out, 5)


@query("t01_largest_errors", "{with} select mvt_id, abs(taxi_sec - (t_us - aobt_us) / 1000000.0) as err from d where aobt_us is not null order by err desc, mvt_id limit 20")
def t01(spark, sf):
    """A top-20 report."""
    err = F.abs(F.col("taxi_sec") - (F.col("t_us") - F.col("aobt_us")) / 1_000_000.0)
    return deps(spark, sf).where("aobt_us is not null").select("mvt_id", err.alias("err")).orderBy(F.desc("err"), "mvt_id").limit(20)


@query("t02_canonical_order", "{with} select mvt_id, row_number() over (partition by airport order by t_us, phase, coalesce(runway, ''), mvt_id) as pos from m")
def t02(spark, sf):
    return row_numbers(moves(spark, sf), ["airport"], "t_us", ["phase", F.coalesce("runway", F.lit("")), "mvt_id"], "pos").select("mvt_id", "pos")


def _dice(c: str, n: int = 1) -> str:
    """A number below 1,000,003 from an id, in integer arithmetic that any engine repeats."""
    return f"((({c} % 1000003) * {7919 * n} + {31 * n}) % 1000003)"


RARE = "taxi_sec > 900 or taxi_sec < 0"


@query("t03_rare_sample", "{with}, r as (select mvt_id, taxi_sec from d where not (" + RARE + ") order by " + _dice("mvt_id") + ", mvt_id limit 200) select mvt_id, taxi_sec from d where " + RARE + " union all select * from r")
def t03(spark, sf):
    """All rare rows, and of the rest a hash sample up to a cap (a sampling operator)."""
    d = deps(spark, sf).select("mvt_id", "taxi_sec")
    rest = d.where(f"not ({RARE})").orderBy(F.expr(_dice("mvt_id")), "mvt_id").limit(200)
    return d.where(RARE).union(rest)


_EARLY = "case when " + _dice("mvt_id", 3) + " % 10 = 0 then 1 else 0 end"


@query("t04_class_sample", "{with}, c as (select mvt_id, case when taxi_sec > 600 then 1 else 0 end as class from d), k as (select * from c where class = 1 or " + _dice("mvt_id", 2) + " % 10 = 0), n as (select class, count(*) as n from c group by 1), s as (select class, count(*) as k from k group by 1) select mvt_id, class, n / cast(k as double) as weight, " + _EARLY + " as early from k join n using (class) join s using (class)")
def t04(spark, sf):
    """The rare class whole, a tenth of the other by hash, inverse weights, a tenth of each set apart (a sampling operator)."""
    d = deps(spark, sf).select("mvt_id", F.when(F.col("taxi_sec") > 600, 1).otherwise(0).alias("class"))
    kept = d.where((F.col("class") == 1) | F.expr(_dice("mvt_id", 2) + " % 10 = 0"))
    sizes = d.groupBy("class").agg(F.count("*").alias("n")).join(kept.groupBy("class").agg(F.count("*").alias("k")), "class")
    return kept.join(sizes, "class").select("mvt_id", "class", (F.col("n") / F.col("k")).alias("weight"), F.expr(_EARLY).alias("early"))


@query("t05_stratified_first", "{with}, r as (select mvt_id, airport, phase, runway is null as norw, row_number() over (partition by airport, phase, runway is null order by t_us, mvt_id) as k from m) select mvt_id, airport, phase, norw, k from r where k <= 3")
def t05(spark, sf):
    """The first three rows of every stratum."""
    w = Window.partitionBy("airport", "phase", "norw").orderBy("t_us", "mvt_id")
    return moves(spark, sf).withColumn("norw", F.col("runway").isNull()).withColumn("k", F.row_number().over(w).cast("long")).where("k <= 3").select("mvt_id", "airport", "phase", "norw", "k")


@query("t06_folds", "{with} select mvt_id, case (t_us // 86400000000) % 4 when 0 then 'seasonal' when 1 then 'forward' else 'fit' end as fold from d")
def t06(spark, sf):
    f = F.pmod(clock.day_number(F.col("t_us")), F.lit(4))
    return deps(spark, sf).select("mvt_id", F.when(f == 0, "seasonal").when(f == 1, "forward").otherwise("fit").alias("fold"))


@query("t07_day_modulo", "{with} select mvt_id from d where (t_us // 86400000000) % 11 = 0")
def t07(spark, sf):
    """A split by calendar day (the split is the feature)."""
    return deps(spark, sf).where(F.pmod(clock.day_number(F.col("t_us")), F.lit(11)) == 0).select("mvt_id")


_SHARE = "greatest(6e-2, least(1e0, 2e2 / n))"


@query("t08_fraction_split", "{with}, c as (select cast(count(*) as double) as n from d) select mvt_id, " + _dice("mvt_id", 5) + " < 1000003e0 * " + _SHARE + " as early from d, c")
def t08(spark, sf):
    """Early-stopping split: six percent by hash, or 200 rows if that is more (a sampling operator)."""
    d = deps(spark, sf).select("mvt_id")
    n = d.agg(F.count("*").cast("double").alias("n"))
    return d.crossJoin(n).select("mvt_id", F.expr(_dice("mvt_id", 5) + " < 1000003e0 * " + _SHARE).alias("early"))


@query("t09_split_receipt", "{with} select fold, count(*) as n, cast(sum(cast(concat('0x', substring(h, 1, 7)) as bigint)) as bigint) as sum_a, cast(sum(cast(concat('0x', substring(h, 8, 7)) as bigint)) as bigint) as sum_b from (select (t_us // 86400000000) % 4 as fold, sha256(concat_ws('|', cast(mvt_id as varchar))) as h from d) group by fold")
def t09(spark, sf):
    return digest(deps(spark, sf).withColumn("fold", F.pmod(clock.day_number(F.col("t_us")), F.lit(4))), ["mvt_id"], ["fold"])

