"""Runway strips: rows that are derived from a table, their ends' codes, and how they lie to each other.

STRIPS_SQL is the one text of the rows for both engines: the first three strips of an airport bear the codes that movements
use and cross or run beside one another, the others are laid out over the field with codes of their own; some share an end's
code, some are out of range or without length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.spatial import segment_pairs
from .tables import table

STRIPS_SQL = """
select airport, k as sid,
 case when k < 3 then concat('0', cast(k as varchar(9))) else concat('L', cast(k as varchar(9))) end as le,
 case when k in (3, 4) then '27' else concat('H', cast(k as varchar(9))) end as he,
 le_lat, le_lon,
 case when k % 50 = 49 then 95e0 when k % 50 = 48 then le_lat when k = 0 then 0e0 when k = 1 then 0.01e0 when k = 2 then 0.009e0
      else le_lat + case k % 4 when 0 then 0.031e0 when 1 then 0.022e0 when 2 then 0.002e0 else -0.021e0 end end as he_lat,
 case when k % 50 = 48 then le_lon when k = 0 then 0.01e0 when k = 1 then 0.0003e0 when k = 2 then 0.01e0
      else le_lon + case k % 4 when 0 then 0.001e0 when 1 then 0.019e0 when 2 then 0.03e0 else 0.023e0 end end as he_lon
from (select airport, k,
   case k when 0 then 0e0 when 1 then -0.01e0 when 2 then 0.009e0 else 0.03e0 + ((k - k % 40) / 40) * 0.02e0 + ((k * 7919) % 1000) * 1e-5 end as le_lat,
   case k when 0 then -0.01e0 when 1 then 0e0 when 2 then -0.01e0 else (k % 40) * 0.02e0 + ((k * 6101) % 997) * 1e-5 end as le_lon
 from (select concat('A', cast(c_custkey % 5 as varchar(9))) as airport, (c_custkey - c_custkey % 5) / 5 as k0 from {customer}) a,
      lateral (select cast(k0 as bigint) as k) b) c
"""


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STRIPS_SQL, customer=table(spark, sf_dir, "customer"))


def strip_table(s: DataFrame, shortest_m: float = 1.0) -> DataFrame:
    """Valid strips with length, both headings and planar ends; coordinates out of range or too short strips go."""
    ends = [F.col(c) for c in ("le_lat", "le_lon", "he_lat", "he_lon")]
    ok = F.col("le_lat").between(-90, 90) & F.col("he_lat").between(-90, 90) & F.col("le_lon").between(-180, 180) & F.col("he_lon").between(-180, 180)
    out = s.where(ok).withColumns({"length_m": geo.haversine_m(*ends), "le_heading": geo.bearing_deg(*ends), "he_heading": geo.bearing_deg(ends[2], ends[3], ends[0], ends[1])})
    lat0 = out.groupBy("airport").agg(F.avg((F.col("le_lat") + F.col("he_lat")) / 2).alias("lat0"), F.avg((F.col("le_lon") + F.col("he_lon")) / 2).alias("lon0"))
    out = out.join(lat0, "airport").where(F.col("length_m") >= shortest_m)
    for end in ("le", "he"):
        x, y = geo.project_m(F.col(f"{end}_lat"), F.col(f"{end}_lon"), F.col("lat0"), F.col("lon0"))
        out = out.withColumns({f"{end}_x": x, f"{end}_y": y})
    return out.drop("lat0", "lon0")


def end_codes(s: DataFrame) -> DataFrame:
    """(airport, code, sid, heading): an end code that names several strips is dropped."""
    ends = s.select("airport", "sid", F.inline(F.array(F.struct(F.col("le").alias("code"), F.col("le_heading").alias("heading")), F.struct(F.col("he").alias("code"), F.col("he_heading").alias("heading")))))
    return ends.groupBy("airport", "code").agg(F.countDistinct("sid").alias("n"), F.min("sid").alias("sid"), F.min("heading").alias("heading")).where("n = 1").drop("n")


def strip_edges(s: DataFrame, others: DataFrame | None = None, bearing: float = geo.PARALLEL_DEG, metres: float = geo.PARALLEL_M, cell_m: float = 4_000.0) -> DataFrame:
    """(airport, sid, other, relation): strips of an airport that cross, or run nearly parallel within a distance; `others` of others where they are given."""
    pairs = segment_pairs(s, ["airport"], "sid", metres, cell_m, others)
    p = [(F.col(f"{w}{e}_x"), F.col(f"{w}{e}_y")) for w in ("", "o_") for e in ("le", "he")]
    crossing = geo.segments_cross(*p)
    near = (geo.bearing_gap(F.col("le_heading"), F.col("o_le_heading")) <= bearing) & (geo.segments_m(*p) <= metres)
    relation = F.when(crossing, "intersecting").when(near, "near_parallel")
    told = pairs.select("airport", "sid", F.col("o_sid").alias("other"), F.array(relation).alias("relation"))
    return told.select("airport", "sid", "other", F.explode("relation").alias("relation")).where("relation is not null")  # explode: the predicate is worked out once
