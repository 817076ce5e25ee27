"""Scoring of estimates: error tables, paired day bootstrap, weight grids, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running


def scores(df: DataFrame, target: str, estimate: str, by: list[str] = ()) -> DataFrame:
    """n, rmse, mae, bias (estimate - target), overall or per group; rows without both values don't count."""
    e = F.col(estimate) - F.col(target)
    known = df.where(F.col(target).isNotNull() & F.col(estimate).isNotNull())
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def day_sums(df: DataFrame, target: str, old: str, new: str, day: Column, strata: list[str] = ()) -> DataFrame:
    return df.groupBy(*strata, day.alias("day")).agg(F.count("*").alias("n"), F.sum(F.pow(F.col(old) - F.col(target), 2)).alias("sse_old"), F.sum(F.pow(F.col(new) - F.col(target), 2)).alias("sse_new"))


def paired_bootstrap(df: DataFrame, target: str, old: str, new: str, day: Column, replicates: int = 1000, stratum: str | None = None) -> DataFrame:
    """(replicate, gain): RMSE of old minus new over days drawn with replacement, within each value of an integer stratum if there is one.

    The draw is integer arithmetic on (replicate, slot), so that any engine makes the same one. The table of days is
    small whatever the number of rows: replicates x days rows are drawn.
    """
    got = day_bootstrap(day_sums(df, target, old, new, day, [stratum] if stratum else []), ["n", "sse_old", "sse_new"], replicates, stratum)
    return got.select(F.col("r").alias("replicate"), (F.sqrt(F.col("sse_old") / F.col("n")) - F.sqrt(F.col("sse_new") / F.col("n"))).alias("gain"))


def day_bootstrap(sums: DataFrame, columns: list[str], replicates: int = 1000, stratum: str | None = None) -> DataFrame:
    """(r, columns): sums of the columns of a table of days over as many days drawn with replacement, for each replicate; each stratum draws its own days."""
    spark, key = sums.sparkSession, [stratum] if stratum else []
    days = sums.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("day")) - 1)
    total = days.groupBy(*key).agg(F.count("*").alias("days"))
    grid = spark.range(replicates).toDF("r").join(F.broadcast(total)).select("r", "days", *key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("days") - 1)).alias("s"))
    shift = F.col(stratum) * 611953 if stratum else F.lit(0)
    draw = grid.select("r", *key, (F.expr("(r*7919 + s*104729 + r*s*31 + 12345)") + shift).alias("x"), "days").select("r", *key, F.expr("x % 1000003 % days").cast("int").alias("i"))
    return draw.join(days, [*key, "i"]).groupBy("r").agg(*[F.sum(c).alias(c) for c in columns])


def interval(gains: DataFrame) -> DataFrame:
    p = F.percentile("gain", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return gains.agg(p.alias("p"), F.avg((F.col("gain") > 0).cast("double")).alias("positive"), F.count("*").alias("replicates")).select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("mid"), F.col("p")[2].alias("hi"), "positive", "replicates")


def weight_grid(df: DataFrame, target: str, base: str, other: str, weights: list[float], by: list[str] = ()) -> DataFrame:
    """(by, weight, rmse) of max(base + w (other - base), 0) for each weight, in one pass."""
    w = F.explode(F.array(*[F.lit(float(x)) for x in weights])).alias("weight")
    long = df.select(*by, target, base, other, w)
    est = F.greatest(F.col(base) + F.col("weight") * (F.col(other) - F.col(base)), F.lit(0.0))
    return long.groupBy(*by, "weight").agg(F.sqrt(F.avg(F.pow(est - F.col(target), 2))).alias("rmse"))


def best_weight(grid: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weight with the least rmse; the smaller weight of equals."""
    return grid.groupBy(*by).agg(F.min(F.struct("rmse", "weight")).alias("m")).select(*by, F.col("m.weight").alias("weight"), F.col("m.rmse").alias("rmse"))


def error_shares(df: DataFrame, target: str, estimate: str, by: list[str]) -> DataFrame:
    """Squared-error share of each cell."""
    sq = F.pow(F.col(estimate) - F.col(target), 2)
    cells = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(sq).alias("sse"))
    return cells.crossJoin(F.broadcast(cells.agg(F.sum("sse").alias("total")))).select(*by, "n", (F.col("sse") / F.col("total")).alias("share"))


def top_shares(df: DataFrame, value: str, tops: tuple[int, ...], part: float = 0.01) -> DataFrame:
    """(top, rows, share): the share of the sum in the largest rows, for numbers of rows and for a part of them (one row at least).

    Counts per distinct value and their running sums tell how many of a value's rows are among the largest; nulls don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("v")).alias("sum"))
    placed = running(counts, [], "v", [], F.col("n"), "before").crossJoin(F.broadcast(whole))  # one row
    above = F.col("total") - F.col("before") - F.col("n")
    rows = {str(k): F.lit(k).cast("long") for k in tops} | {f"{part:.0%}": F.greatest(F.ceil(F.col("total") * part), F.lit(1)).cast("long")}
    taken = [F.sum(F.greatest(F.least(r - above, F.col("n")), F.lit(0)) * F.col("v")).alias(f"t{i}") for i, r in enumerate(rows.values())]
    one = placed.groupBy("total", "sum").agg(*taken)
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("top"), r.alias("rows"), (F.col(f"t{i}") / F.nullif(F.col("sum"), F.lit(0.0))).alias("share")) for i, (name, r) in enumerate(rows.items())])))


def centred_slope(df: DataFrame, x: str, y: str, strata: list[str], least: int = 20) -> DataFrame:
    """Slope of y on x after centring both by the mean of their stratum, over strata of at least `least` rows."""
    means = df.groupBy(*strata).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.count("*").alias("__n")).where(F.col("__n") >= least)
    both = df.join(means, strata).select((F.col(x) - F.col("__mx")).alias("dx"), (F.col(y) - F.col("__my")).alias("dy"))
    return both.agg((F.sum(F.col("dx") * F.col("dy")) / F.nullif(F.sum(F.col("dx") * F.col("dx")), F.lit(0.0))).alias("slope"), F.count("*").alias("n"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve by the rank sum; equal scores share their mean rank. Ranks come from counts per distinct score."""
    per = df.groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    ranked = running(per, [], score, [], F.col("n"), "before")
    s = ranked.agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))
