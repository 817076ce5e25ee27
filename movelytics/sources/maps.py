"""Airport map jobs: stands and runways from nested elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

# Prefixes that references carry.
PREFIXES = "(STAND|GATE|[^A-Z0-9])"
SCHEMA = "elements array<struct<type:string,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Elements of nested map JSON files, one row each."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.inline("elements"))


def canonical(ref: Column) -> Column:
    return F.regexp_replace(F.upper(ref), PREFIXES, "")


def map_elements(elements: DataFrame) -> DataFrame:
    """(airport, kind, ref, lat, lon, first, last): a row per stand reference and per runway code of each way."""
    tag = lambda k: F.element_at("tags", F.lit(k))
    geom = F.col("geometry")
    first, last = F.when(F.size(geom) > 0, F.element_at(geom, 1)), F.when(F.size(geom) > 0, F.element_at(geom, -1))
    e = elements.withColumns({"kind": F.when(tag("aeroway").isin("parking_position", "gate", "stand"), "stand").when(tag("aeroway") == "runway", "runway"), "ref0": tag("ref"), "first": first, "last": last}).where("kind is not null and ref0 is not null")
    stands = e.where("kind = 'stand'").select("airport", "kind", F.explode(F.split("ref0", "[;/]")).alias("r"), F.coalesce("lat", F.col("first.lat")).alias("lat"), F.coalesce("lon", F.col("first.lon")).alias("lon"), "first", "last").withColumn("ref", canonical(F.col("r")))
    ways = e.where("kind = 'runway'").select("airport", "kind", F.explode(F.regexp_extract_all("ref0", F.lit(r"(?<!\d)(\d{2}[LRC]?)(?!\d)"), F.lit(1))).alias("r"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "first", "last").withColumn("ref", F.col("r"))
    return stands.unionByName(ways).drop("r").where("ref <> ''")


def stand_centroids(e: DataFrame, spread_m: float = 100.0) -> DataFrame:
    """(airport, stand, lat, lon); stands with a position farther than spread_m from their least one are left out."""
    s = e.where("kind = 'stand' and lat is not null").select("airport", F.col("ref").alias("stand"), "lat", "lon")
    origin = s.groupBy("airport", "stand").agg(F.min(F.struct("lat", "lon")).alias("o"))
    far = s.join(origin, ["airport", "stand"]).withColumn("m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("o.lat"), F.col("o.lon")))
    return far.groupBy("airport", "stand").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max("m").alias("spread")).where(F.col("spread") <= spread_m).drop("spread")


def runway_thresholds(e: DataFrame, shortest_m: float = 400.0) -> DataFrame:
    """(airport, runway, lat, lon, length_m): of the longest way with a code, the end from which the code's heading runs."""
    w = e.where("kind = 'runway' and first is not null").select("airport", F.col("ref").alias("runway"), "first", "last")
    ends = [F.col("first.lat"), F.col("first.lon"), F.col("last.lat"), F.col("last.lon")]
    w = w.withColumns({"length_m": geo.haversine_m(*ends), "bearing": geo.bearing_deg(*ends)}).where(F.col("length_m") >= shortest_m)
    best = w.groupBy("airport", "runway").agg(F.max(F.struct("length_m", "first", "last", "bearing")).alias("w"))
    heading = F.substring("runway", 1, 2).cast("double") * 10
    turn = F.abs(F.pmod(heading - F.col("w.bearing") + 180.0, F.lit(360.0)) - 180.0)
    end = F.when(turn <= 90, F.col("w.first")).otherwise(F.col("w.last"))
    return best.select("airport", "runway", end["lat"].alias("lat"), end["lon"].alias("lon"), F.col("w.length_m").alias("length_m"))


def crosswalk(moves: DataFrame, stands: DataFrame, runways: DataFrame) -> DataFrame:
    """(airport, stand, runway, n, metres) for the pairs that movements used."""
    used = moves.where("runway is not null").groupBy("airport", canonical(F.col("stand")).alias("stand"), "runway").agg(F.count("*").alias("n"))
    r = runways.select("airport", "runway", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    both = used.join(stands, ["airport", "stand"]).join(r, ["airport", "runway"])
    return both.select("airport", "stand", "runway", "n", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")).alias("metres"))


def match_audit(moves: DataFrame, stands: DataFrame, runways: DataFrame) -> DataFrame:
    """(airport, n, stand_share, runway_share, both_share): how many movements' stands and runways the map has.

    Movements are counted per (airport, stand, runway) before the joins, so that the joins carry one row a combination.
    """
    used = moves.groupBy("airport", canonical(F.col("stand")).alias("stand"), "runway").agg(F.count("*").alias("n"))
    known = used.join(stands.select("airport", "stand", F.lit(1).alias("s")), ["airport", "stand"], "left").join(runways.select("airport", "runway", F.lit(1).alias("r")), ["airport", "runway"], "left")
    s, r = F.coalesce("s", F.lit(0)), F.coalesce("r", F.lit(0))
    share = lambda c: F.sum(c * F.col("n")) / F.sum("n")
    return known.groupBy("airport").agg(F.sum("n").alias("n"), share(s).alias("stand_share"), share(r).alias("runway_share"), share(s * r).alias("both_share"))
