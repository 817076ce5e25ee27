"""Registry of queries, and the shared text of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import MOVEMENTS_SQL, WEATHER_SQL, movements, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: `m`: the movements view, for oracles.
M = "m as materialized (" + MOVEMENTS_SQL.replace("{US}", "epoch_us(ts)").replace("{events}", "events") + ")"
DEP = "d as materialized (select * from m where phase = 'DEP'), a as materialized (select * from m where phase = 'ARR')"
WX = "wx as materialized (" + WEATHER_SQL.replace("{US}", "epoch_us(ts)").replace("{events}", "events") + ")"
WITH = f"with {M}, {DEP}"
#: Flights have clocks (planned and flown arrival among them) and attributes that the movements view lacks; they are derived from it.
FLIGHTS_SQL = """select *,
 case when mvt_id % 13 = 0 then null else lobt_us + ((mvt_id % 5) - 2) * 120000000 end as iobt_us,
 case when mvt_id % 17 = 0 then null else sched_us + ((mvt_id % 7) - 3) * 60000000 end as eobt_us,
 case when mvt_id % 25 = 0 then null else sched_us + (3600 + (mvt_id % 4) * 1800) * 1000000 end as planned_us,
 case when mvt_id % 27 = 0 then null else t_us + (3300 + (mvt_id % 5) * 1700) * 1000000 end as flown_us,
 case when mvt_id % 19 = 0 then null else concat(flight, 'X') end as callsign,
 case when mvt_id % 23 = 0 then dest else airport end as adep_flt,
 case when mvt_id % 29 = 0 then null else ac_type end as type_flt,
 case when mvt_id % 31 = 0 then airport else dest end as ades_flt,
 case when mvt_id % 3 = 0 then 'V' else 'I' end as rule,
 case when mvt_id % 33 = 0 then null when mvt_id % 35 = 0 then airport else dest end as filed_dest,
 case when mvt_id % 37 = 0 then null else substr(flight, 1, 4) end as operator,
 case when mvt_id % 21 = 0 then null else concat('M', cast(mvt_id % 6 as varchar(9))) end as segment,
 case when mvt_id % 39 = 0 then null when mvt_id % 4 = 0 then 'H' else 'L' end as wake,
 case when mvt_id % 41 = 0 then null when mvt_id % 3 = 0 then 'V' else 'I' end as rule_flt,
 case when mvt_id % 43 = 0 then null else concat('S', cast(mvt_id % 2 as varchar(9))) end as kind
from {d}"""
FL = "fl as materialized (" + FLIGHTS_SQL.replace("{d}", "d") + ")"
S = 1_000_000
MIN = 60 * S


def query(name: str, oracle: str | None = None):
    """Register a query of (spark, sf_dir); `oracle` may start with {with} for the views m, d and a."""

    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle.replace("{with}", WITH).replace("{m}", M).replace("{wx}", WX)
        return f

    return put


def moves(spark: SparkSession, sf: str) -> DataFrame:
    return movements(spark, sf)


def deps(spark: SparkSession, sf: str) -> DataFrame:
    return movements(spark, sf).where("phase = 'DEP'")


def arrs(spark: SparkSession, sf: str) -> DataFrame:
    return movements(spark, sf).where("phase = 'ARR'")


def flights(spark, sf) -> DataFrame:
    return spark.sql(FLIGHTS_SQL, d=deps(spark, sf))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that engines that add in another order agree; -0 becomes 0."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


__all__ = ["FL", "MIN", "ORACLES", "QUERIES", "S", "arrs", "deps", "flights", "moves", "query", "rounded", "table"]
