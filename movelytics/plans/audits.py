"""Sources, sinks and map jobs over data that Spark derives from the tables: S02, S04, S05, S10, S11, S14, S19, G01, G06-G08, W23."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import row_numbers
from ..sources.maps import crosswalk, map_elements, match_audit, runway_thresholds, stand_centroids
from ..sources.tables import cached, fingerprints, publish, refuse_labels, shared
from .base import arrs, deps, moves, query, rounded, table

#: Map elements made from movements: a node per movement's stand (one stand's positions lie far apart), a way per movement on a runway, every other one drawn from its far end.
_LAT = "(mvt_id % 8) * 0.001e0 + (mvt_id % 3) * 0.0001e0 + case when mvt_id % 24 = 23 then 0.0015e0 else 0e0 end"
NODES = f"n as (select mvt_id, airport, concat('Stand ', stand) as ref, {_LAT} as lat, (mvt_id % 8) * 0.002e0 as lon from m)"


def _metres(a: str, b: str) -> str:
    return f"2 * 6371000.0 * asin(sqrt(least(1, pow(sin(radians({b}_lat - {a}_lat) / 2), 2) + cos(radians({a}_lat)) * cos(radians({b}_lat)) * pow(sin(radians({b}_lon - {a}_lon) / 2), 2))))"


_D = "radians(l_lon - f_lon)"
_BEARING = f"fmod(degrees(atan2(sin({_D}) * cos(radians(l_lat)), cos(radians(f_lat)) * sin(radians(l_lat)) - sin(radians(f_lat)) * cos(radians(l_lat)) * cos({_D}))) + 360, 360)"
#: What the map says, in SQL: cen(metres) of stands, and thr, the threshold of each runway code.
MAP_SQL = (
    NODES
    + ", ns as materialized (select airport, regexp_replace(upper(ref), '(STAND|GATE|[^A-Z0-9])', '', 'g') as stand, lat as s_lat, lon as s_lon from n)"
    + ", no as (select airport, stand, s_lat as o_lat, s_lon as o_lon from (select *, row_number() over (partition by airport, stand order by s_lat, s_lon) as r from ns) where r = 1)"
    + f", cen as materialized (select airport, stand, avg(s_lat) as c_lat, avg(s_lon) as c_lon, max({_metres('s', 'o')}) as spread from ns join no using (airport, stand) group by all)"
    + ", we as (select mvt_id, airport, unnest([runway, '1' || substring(runway, 2, 1)]) as runway, case when mvt_id % 2 = 0 then 0e0 else (mvt_id % 5 + 1) * 0.004e0 end as f_lon, case when mvt_id % 2 = 0 then (mvt_id % 5 + 1) * 0.004e0 else 0e0 end as l_lon, 0e0 as f_lat, 0e0 as l_lat from m where runway in ('00', '01', '02'))"
    + f", wl as (select *, {_metres('f', 'l')} as length_m, {_BEARING} as bearing from we)"
    + ", wb as (select *, row_number() over (partition by airport, runway order by length_m desc, f_lat desc, f_lon desc, l_lat desc, l_lon desc) as r from wl where length_m >= 400)"
    + ", wt as (select *, abs(fmod(cast(substring(runway, 1, 2) as int) * 10 - bearing + 180 + 720, 360) - 180) as turn from wb where r = 1)"
    + ", thr as materialized (select airport, runway, case when turn <= 90 then f_lat else l_lat end as t_lat, case when turn <= 90 then f_lon else l_lon end as t_lon, length_m from wt)"
)


def _map(spark, sf, spread_m: float) -> tuple[DataFrame, DataFrame]:
    """(stands, runway thresholds) of the map."""
    e = map_elements(elements(spark, sf))
    return stand_centroids(e, spread_m), runway_thresholds(e, 400.0)


def elements(spark, sf) -> DataFrame:
    """Nested map elements with tags and geometry."""
    m = moves(spark, sf)
    lat = F.expr(_LAT)
    lon = (F.col("mvt_id") % 8) * 0.002
    nodes = m.select("airport", F.lit("node").alias("type"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.create_map(F.lit("aeroway"), F.lit("parking_position"), F.lit("ref"), F.concat(F.lit("Stand "), "stand")).alias("tags"), F.array().cast("array<struct<lat:double,lon:double>>").alias("geometry"))
    point = lambda a, b: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lon"))
    none = F.lit(None).cast("double")
    ends = [point(F.lit(0.0), F.lit(0.0)), point(F.lit(0.0), (F.col("mvt_id") % 5 + 1) * 0.004)]
    drawn = F.when(F.col("mvt_id") % 2 == 0, F.array(*ends)).otherwise(F.array(*ends[::-1]))
    tags = F.create_map(F.lit("aeroway"), F.lit("runway"), F.lit("ref"), F.concat(F.col("runway"), F.lit("/1"), F.substring("runway", 2, 1)))
    ways = m.where("runway in ('00', '01', '02')").select("airport", F.lit("way").alias("type"), none.alias("lat"), none.alias("lon"), tags.alias("tags"), drawn.alias("geometry"))
    return nodes.unionByName(ways)


@query("s10_map_elements", "{with}, " + NODES + " select airport, regexp_replace(upper(ref), '(STAND|GATE|[^A-Z0-9])', '', 'g') as ref, count(*) as n, round(min(lat), 6) as lat from n group by all")
def s10(spark, sf):
    """Stands of the map by canonical reference: elements exploded, tags looked up, references split."""
    s = map_elements(elements(spark, sf)).where("kind = 'stand'")
    return rounded(s.groupBy("airport", "ref").agg(F.count("*").alias("n"), F.min("lat").alias("lat")))


@query("g06_stand_centroids", "{with}, " + MAP_SQL + " select airport, stand, round(c_lat, 6) + 0e0 as lat, round(c_lon, 6) + 0e0 as lon from cen where spread <= 100")
def g06(spark, sf):
    """Mean position of each stand; those spread over more than the limit are ambiguous and go."""
    return rounded(stand_centroids(map_elements(elements(spark, sf)), 100.0))


@query("g07_runway_thresholds", "{with}, " + MAP_SQL + " select airport, runway, round(t_lat, 6) + 0e0 as lat, round(t_lon, 6) + 0e0 as lon, round(length_m, 6) + 0e0 as length_m from thr")
def g07(spark, sf):
    """Of each runway code the longest way's nearer-heading end."""
    return rounded(runway_thresholds(map_elements(elements(spark, sf)), 400.0))


@query("g08_crosswalk", "{with}, " + MAP_SQL + ", u as (select airport, regexp_replace(upper(stand), '(STAND|GATE|[^A-Z0-9])', '', 'g') as stand, runway, count(*) as n from m where runway is not null group by all) select u.airport, u.stand, u.runway, n, round(" + _metres("c", "t") + ", 3) + 0e0 as metres from u join cen using (airport, stand) join thr using (airport, runway) where spread <= 1000")
def g08(spark, sf):
    """Distance from stands to thresholds, with the movements that used both."""
    e = map_elements(elements(spark, sf))
    return rounded(crosswalk(moves(spark, sf), stand_centroids(e, 1000.0), runway_thresholds(e, 400.0)), 3)


@query("a41_match_audit", "{with}, " + MAP_SQL + ", j as (select m.airport, (cen.stand is not null)::int as s, (thr.runway is not null)::int as r from m left join cen on m.airport = cen.airport and regexp_replace(upper(m.stand), '(STAND|GATE|[^A-Z0-9])', '', 'g') = cen.stand and cen.spread <= 100 left join thr on m.airport = thr.airport and m.runway = thr.runway) select airport, count(*) as n, round(avg(s), 6) as stand_share, round(avg(r), 6) as runway_share, round(avg(s * r), 6) as both_share from j group by airport")
def a41(spark, sf):
    """Share of movements whose stand and runway are on the map, by the map's own tables; an ambiguous stand is not."""
    return rounded(match_audit(moves(spark, sf), *_map(spark, sf, 100.0)))


@query("g01_code_map", "{with}, c as (select concat('ID', flight) as ident, airport as gps, flight from m), u as (select gps, min(ident) as ident from c group by gps having count(distinct ident) = 1) select m.mvt_id, u.ident from m left join u on m.airport = u.gps")
def g01(spark, sf):
    """Codes mapped to identifiers where the mapping is unique."""
    c = moves(spark, sf).select(F.concat(F.lit("ID"), "flight").alias("ident"), F.col("airport").alias("gps"))
    unique = c.groupBy("gps").agg(F.countDistinct("ident").alias("k"), F.min("ident").alias("ident")).where("k = 1").drop("k")
    return moves(spark, sf).join(unique, F.col("airport") == F.col("gps"), "left").select("mvt_id", "ident")


@query("s04_leak_guard", "{with} select mvt_id, airport, t_us from d")
def s04(spark, sf):
    """A feature view that passes the label guard and its ordered allow-list."""
    names = ["mvt_id", "airport", "t_us"]
    return refuse_labels(deps(spark, sf).select(*names), ("taxi", "block", "target"), names)


@query("s05_feature_cache", "{with} select mvt_id, airport, t_us, aobt_us from d")
def s05(spark, sf):
    """Features written to the shared folder and reloaded with checks by id."""
    return cached(deps(spark, sf).select("mvt_id", "airport", "t_us", "aobt_us"), shared(spark, "features"), "mvt_id")


@query("s11_exclusive_publish", "{with} select mvt_id, taxi_sec, true as refused from a")
def s11(spark, sf):
    """A checked publish in the template's order, and a second one to the same place that is refused and leaves the first as it was."""
    path = shared(spark, "published")
    df = arrs(spark, sf).select("mvt_id", "taxi_sec")
    template = df.select("mvt_id", F.col("mvt_id").alias("pos"))
    publish(df, template, "mvt_id", "taxi_sec", path)
    try:
        publish(df.withColumn("taxi_sec", F.lit(0.0)), template, "mvt_id", "taxi_sec", path)
        refused = False
    except AnalysisException as e:
        refused = "EXISTS" in str(e.getCondition())
    return spark.read.schema(df.schema).parquet(path).withColumn("refused", F.lit(refused))


@query("s14_file_fingerprints")
def s14(spark, sf):
    """Size and digest of every input file before and after they are read, and whether both agree."""
    paths = [f"{sf}/{t}.parquet" for t in ("events", "orders", "lineitem", "customer")]
    before = cached(fingerprints(spark, paths), shared(spark, "fingerprints"), "file")
    spark.read.parquet(paths[0]).agg(F.max("event_id")).first()
    after = fingerprints(spark, paths).toDF("file", "bytes_after", "sha256_after")
    return before.join(after, "file", "full").select("file", "bytes", "sha256", (F.col("bytes").eqNullSafe(F.col("bytes_after")) & F.col("sha256").eqNullSafe(F.col("sha256_after"))).alias("unchanged"))


@query("s19_pruned_peers", "{with} select mvt_id, t_us from m where airport = 'A1' and t_us // 86400000000 = (select min(t_us // 86400000000) + 1 from m)")
def s19(spark, sf):
    """Peers of one airport and day from a table partitioned by both: only their files are read."""
    path = shared(spark, "by-day")
    m = moves(spark, sf).withColumn("day", F.floor(F.col("t_us") / 86_400_000_000).cast("long"))
    m.select("mvt_id", "t_us", "airport", "day").repartition("airport", "day").write.partitionBy("airport", "day").parquet(path)
    day = m.agg(F.min("day")).first()[0]
    return spark.read.parquet(path).where((F.col("airport") == "A1") & (F.col("day") == (day or 0) + 1)).select("mvt_id", "t_us")


@query("s07_ordered_scan", "select o_orderkey, o_custkey, o_totalprice > 100000 as large from orders")
def s07(spark, sf):
    """A scan and derivation without batches of its own: Spark's partitions bound the memory."""
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 100000).alias("large"))



#: Rows of a batch: small enough that the given tables have several.
BATCH = 4096
_DERIVED = ["mvt_id", "t_us", "t_us - aobt_us as gap_us", "t_us - sched_us as wait_us", "mod(t_us div 3600000000, 24) as hour", "aobt_us is null as no_clock"]


@query(
    "s07_bounded_batches",
    "with {m}, f as (select mvt_id, t_us - aobt_us as gap_us, t_us - sched_us as wait_us, (t_us // 3600000000) % 24 as hour, aobt_us is null as no_clock, (row_number() over (order by mvt_id, t_us) - 1) // "
    + f"{BATCH} as batch from m) "
    + "select batch, count(*) as n, min(mvt_id) as first_id, max(mvt_id) as last_id, cast(sum(gap_us) as bigint) as gap_us, cast(sum(wait_us) as bigint) as wait_us, cast(sum(hour) as bigint) as hours, "
    + "count(*) filter (no_clock) as no_clock, true as same from f group by batch",
)
def s07_batches(spark, sf):
    """A table of derived columns, written in files of a batch's rows at most, and its receipts: batches of BATCH rows in id order
    of what was written are held against the same batches derived from the source again.

    Rows are numbered within ranges of ids, and a batch is a group of that number: no task holds more than a range, and only
    one row a batch is joined. Null clocks give null gaps, which sums skip; rows that repeat an id follow their times.
    """
    path = shared(spark, "derived-movements")
    derived = moves(spark, sf).selectExpr(*_DERIVED)
    derived.write.option("maxRecordsPerFile", BATCH).parquet(path)
    sums = {"n": F.count("*"), "first_id": F.min("mvt_id"), "last_id": F.max("mvt_id"), "gap_us": F.sum("gap_us"), "wait_us": F.sum("wait_us"), "hours": F.sum("hour").cast("long"), "no_clock": F.count_if("no_clock")}

    def receipts(df: DataFrame) -> DataFrame:
        numbered = row_numbers(df, [], "mvt_id", ["t_us"], "r").withColumn("batch", F.floor((F.col("r") - 1) / BATCH).cast("long"))
        digest = F.sum(F.shiftright(F.xxhash64("mvt_id", "t_us", "gap_us", "wait_us", "hour", "no_clock"), 20)).alias("digest")
        return numbered.groupBy("batch").agg(*[v.alias(k) for k, v in sums.items()], digest)

    written = receipts(spark.read.schema(derived.schema).parquet(path))
    again = receipts(derived).select(F.col("batch").alias("b"), F.col("digest").alias("d"))
    both = written.join(again, F.col("batch") == F.col("b"), "full")
    return both.select(F.coalesce("batch", "b").alias("batch"), *sums, F.coalesce(F.col("digest").eqNullSafe(F.col("d")), F.lit(False)).alias("same"))
