"""Parts of larger operators as queries of their own: S02, S08, S09, A07, J15, J16, J21, W23."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.weather import hour_grid, hourly, weather_table
from ..sources.tables import OBSERVATION, period_files, read_strings, station_years, weather_observations, write_periods, write_station_years
from .audits import shared
from .base import moves, query, rounded, table
from .joins import GEO, WTAB, layout


@query("s02_day_files", "{with} select mvt_id, t_us, strftime(make_timestamp(t_us), '%Y-%m-%d') as period from m where t_us is not null")
def s02(spark, sf):
    """Every period of the table in folders of its own, written at once and read back by name; a copy of the first one beside them is ignored."""
    path = shared(spark, "periods")
    m = moves(spark, sf).where("t_us is not null").select("mvt_id", "t_us", F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd").alias("period"))
    size = m.agg(F.min("period").alias("first"), F.countDistinct("period").alias("n")).first()
    copy = m.where(F.col("period") == size["first"]).withColumn("period", F.concat("period", F.lit(" (1)")))
    write_periods(m.union(copy), path, "period")
    return period_files(spark, path, "mvt_id bigint, t_us bigint", "period", size["n"])


@query("s08_string_dimension", "select cast(c_custkey as varchar) as c_custkey, cast(c_nationkey as varchar) as c_nationkey from customer")
def s08(spark, sf):
    """A CSV dimension written from a table and read back with every column a string."""
    path = shared(spark, "dimension")
    table(spark, sf, "customer").select("c_custkey", "c_nationkey").write.csv(path, header=True)
    return read_strings(spark, path, ["c_custkey", "c_nationkey"])


@query("s09_station_scan", "with {wx}, st as (select airport, concat('ST', airport) as station from (select distinct airport from wx)) select station, count(*) as n, round(avg(temperature), 6) as temperature from wx join st using (airport) group by station")
def s09(spark, sf):
    """Observations joined to the station dimension."""
    obs = weather_observations(spark, sf)
    stations = obs.select("airport").distinct().withColumn("station", F.concat(F.lit("ST"), "airport"))
    return rounded(obs.join(stations, "airport").groupBy("station").agg(F.count("*").alias("n"), F.avg("temperature").alias("temperature")))


_NUMBERS = OBSERVATION[1:11]
#: Measures that are only valid within bounds; others become null.
BOUNDS = {"temperature": (-15.0, 45.0), "rh": (0.0, 100.0), "wind_dir": (0.0, 360.0)}


@query(
    "s09_station_years",
    "with {wx} select concat('ST', airport) as station, airport, year(make_timestamp(t_us)) as year, t_us, "
    + ", ".join(f"case when {c} between {BOUNDS[c][0]} and {BOUNDS[c][1]} then cast({c} as double) end as {c}" if c in BOUNDS else f"cast({c} as double) as {c}" for c in _NUMBERS)
    + ", code as mw, case when obs_id % 2 = 0 then code end as au, upper(code) as aw from wx",
)
def s09_years(spark, sf):
    """Every observation of station-year files, all 14 columns, written a folder each and read back with pruning; stations joined to their airports."""
    obs = weather_observations(spark, sf)
    stations = obs.select("airport").distinct().withColumn("station", F.concat(F.lit("ST"), "airport"))
    codes = [F.col("code").alias("mw"), F.when(F.col("obs_id") % 2 == 0, F.col("code")).alias("au"), F.upper("code").alias("aw")]
    path = shared(spark, "stations")
    write_station_years(obs.select(F.concat(F.lit("ST"), "airport").alias("station"), "t_us", *[F.col(c).cast("double").alias(c) for c in _NUMBERS], *codes), path)
    return station_years(spark, path, bounds=BOUNDS).join(stations, "station")


@query("a07_weather_flags", "with {wx}, " + WTAB + " select airport, count(*) filter (fog_hour) as fog_hours, count(*) filter (deicing) as deicing_hours, count(*) filter (n_obs = 0) as empty_hours from wt group by airport")
def a07(spark, sf):
    w = weather_table(weather_observations(spark, sf))
    return w.groupBy("airport").agg(F.count_if("fog_hour").alias("fog_hours"), F.count_if("deicing").alias("deicing_hours"), F.count_if(F.col("n_obs") == 0).alias("empty_hours"))


@query("j15_strip_pairs", "{with}, " + GEO + " select m.mvt_id, edge.other, edge.relation from m join ec on m.airport = ec.airport and m.runway = ec.code join edge on edge.airport = m.airport and edge.sid = ec.sid")
def j15(spark, sf):
    """Movements with the strips related to their own."""
    _, codes, near = layout(spark, sf)
    related = codes.join(near, ["airport", "sid"]).select("airport", "runway", F.inline("near"))
    return moves(spark, sf).join(related, ["airport", "runway"]).select("mvt_id", "other", "relation")


@query("j16_strip_events", "{with}, " + GEO + " select m.airport, edge.sid, edge.relation, m.phase, count(*) as n from m join ec on m.airport = ec.airport and m.runway = ec.code join edge on edge.airport = m.airport and edge.other = ec.sid group by all")
def j16(spark, sf):
    """Events fanned out to the strips that they bear on: counted per strip before the fan-out."""
    _, codes, near = layout(spark, sf, toward=True)
    at = moves(spark, sf).groupBy("airport", "runway", "phase").agg(F.count("*").alias("n")).join(codes.withColumnRenamed("sid", "other"), ["airport", "runway"])
    return at.join(near.select("airport", "sid", F.inline("near")), ["airport", "other"]).groupBy("airport", "sid", "relation", "phase").agg(F.sum("n").alias("n"))


@query("j21_calendar", "with {wx}, " + WTAB + " select airport, hour_us from g")
def j21(spark, sf):
    return hour_grid(weather_observations(spark, sf))


@query("w23_last_direction", "with {wx} select airport, (t_us // 3600000000) * 3600000000 as hour_us, max_by(wind_dir, (t_us, wind_dir)) filter (wind_dir between 0 and 360) as wind_dir from wx group by all")
def w23(spark, sf):
    """The hour's latest valid direction; of equals in time the larger."""
    return hourly(weather_observations(spark, sf)).select("airport", "hour_us", "wind_dir")

