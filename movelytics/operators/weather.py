"""Hourly weather roll-up on a complete hour grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
MEDIANS, MAXIMA, MINIMA = ("temperature", "dew", "rh", "wind_speed"), ("gust", "precip", "snow_depth"), ("visibility", "ceiling")
# Patterns of present-weather codes.
CODES = {"snow": "SN", "fog": "FG", "mist": "BR", "rain": "RA|DZ", "freezing": "FZ"}


def hourly(obs: DataFrame) -> DataFrame:
    """(airport, hour_us, medians, maxima, minima, flags, last valid direction, number of observations)."""
    flags = [F.coalesce(F.bool_or(F.col("code").rlike(f"(?i)({p})")), F.lit(False)).alias(n) for n, p in CODES.items()]
    valid = F.col("wind_dir").between(0, 360)
    last = F.max(F.when(valid, F.struct("t_us", "wind_dir")))["wind_dir"].alias("wind_dir")
    by = obs.groupBy("airport", (F.floor(F.col("t_us") / HOUR).cast("long") * HOUR).alias("hour_us"))
    return by.agg(F.count("*").alias("n_obs"), *[F.percentile(c, 0.5).alias(c) for c in MEDIANS], *[F.max(c).alias(c) for c in MAXIMA], *[F.min(c).alias(c) for c in MINIMA], *flags, last)


def hour_grid(obs: DataFrame) -> DataFrame:
    """Every hour from the first to the last day, for every airport that has observations."""
    day = 24 * HOUR
    lim = obs.agg((F.floor(F.min("t_us") / day).cast("long") * day).alias("lo"), (F.floor(F.max("t_us") / day).cast("long") * day + day - HOUR).alias("hi"))
    return obs.select("airport").distinct().crossJoin(F.broadcast(lim)).select("airport", F.explode(F.sequence("lo", "hi", F.lit(HOUR))).alias("hour_us"))


def weather_table(obs: DataFrame) -> DataFrame:
    """The grid with the roll-up: hours without observations have n_obs 0, false flags and nulls."""
    w = hour_grid(obs).join(hourly(obs), ["airport", "hour_us"], "left")
    out = w.withColumns({"n_obs": F.coalesce("n_obs", F.lit(0)), **{n: F.coalesce(n, F.lit(False)) for n in CODES}})
    fog = F.col("fog") | F.coalesce(F.col("visibility") < 1000, F.lit(False))
    icing = F.coalesce((F.col("temperature") <= 0) & (F.col("snow") | F.col("freezing") | (F.col("precip") > 0)), F.lit(False))
    return out.withColumns({"fog_hour": fog, "deicing": icing})


def at_hour(rows: DataFrame, weather: DataFrame, t: str = "t_us") -> DataFrame:
    """rows joined to the weather of their airport and hour; a missing hour gives nulls, a repeated key is an error of the join itself."""
    values = [c for c in weather.columns if c not in ("airport", "hour_us")]
    once = weather.groupBy("airport", "hour_us").agg(F.count("*").alias("__n"), *[F.any_value(c).alias(c) for c in values])
    sound = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("weather has repeated hours")).cast("boolean"))
    return rows.withColumn("hour_us", F.floor(F.col(t) / HOUR).cast("long") * HOUR).join(once.where(sound).drop("__n"), ["airport", "hour_us"], "left")
