"""Estimator fits M01-M09. Rows only: tree fits can't be told in SQL."""

from __future__ import annotations

from functools import reduce
from statistics import median

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..ml.fits import chance, classifier, out_of_fold, regressor
from ..ml.grouped import Expert, cross_fit, fit_groups, learn_bins, predicted, score_held
from ..operators.context import Win, context_agg
from .audits import shared
from .base import MIN, arrs, deps, query, rounded
from .estimates import CUTS, EXPERTS, baseline_features

NUM = ["p", "s", "l", "p_ok", "no_aobt", "hour", "weekday", "dep15", "dep60", "arr60", "arr60_taxi"]
CAT = ["airport", "ac_type"]


def folds():
    return [("seasonal", F.col("fold") == 0), ("forward", F.col("fold") == 1)]


def keeper(spark, name: str):
    """Writes a table to the shared folder and reads it back."""

    def keep(df):
        path = shared(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def kept_features(spark, sf):
    """(features of the rows with a target in range, and of the others), of one written table: a fit looks at its rows many times."""
    f = baseline_features(spark, sf)
    f = f.select(*[F.col(c).cast("double").alias(c) if c in NUM else F.col(c) for c in f.columns]).withColumns({"resid": F.col("y") - F.coalesce("p", F.lit(200.0)), "early": F.pmod(F.xxhash64("mvt_id"), F.lit(10)) == 0})
    f = keeper(spark, "model-features")(f)
    known = "coalesce(y between 0 and 86400, false)"
    return f.where(known), f.where(f"not {known}")


def features(spark, sf, labelled: bool = True):
    """Features of the rows with a target in range, or of the others."""
    return kept_features(spark, sf)[0 if labelled else 1]


@query("m01_residual_fit")
def m01(spark, sf):
    """Out-of-fold estimates: proxy plus a fitted residual, stopped early on a hash split.

    Rows without a target in range are scored by a final model, fitted on all others with the median number of rounds of the hold-outs.
    """
    (df, unknown), rounds = kept_features(spark, sf), []

    def fit(t):
        m = regressor(t, "resid", NUM, CAT, early="early")
        rounds.append(m.stages[-1].getNumTrees)
        return m

    out = out_of_fold(df, folds(), fit, ["mvt_id", "p"])
    final = regressor(df, "resid", NUM, CAT, rounds=int(median(rounds))).transform(unknown)
    out = out.unionByName(final.select("mvt_id", "p", "fitted", F.lit("final").alias("holdout")))
    return rounded(out.select("mvt_id", "holdout", F.greatest(F.coalesce("p", F.lit(200.0)) + F.col("fitted"), F.lit(0.0)).alias("estimate")))


@query("m02_airport_models")
def m02(spark, sf):
    """One regressor per airport, all grown in the same passes; those with under 20 rows, or without a code, take one that is fitted on all rows."""
    df, keep = features(spark, sf), keeper(spark, "airport-models")
    df = keep(df.select("mvt_id", "airport", "y", learn_bins(df, NUM, ["ac_type"]).column().alias("bins")))
    own = df.groupBy("airport").agg(F.count("*").alias("n")).where("n >= 20 and airport is not null").select(F.col("airport").alias("a"), F.concat(F.lit("own "), "airport").alias("own"))
    rows = df.join(own, F.col("airport") == F.col("a"), "left").drop("a")
    models = fit_groups(rows.withColumn("model", F.array("own", F.lit("all"))), "model", "y", "bins", keep)
    scored = rows.withColumn("model", F.coalesce("own", F.lit("all"))).join(models, "model", "left")
    return rounded(scored.select("mvt_id", "airport", predicted(F.col("base"), F.col("trees"), F.col("bins"), 3, 0.4).alias("fitted")))


@query("m03_match_classifier")
def m03(spark, sf):
    """Chance that the schedule lies within ten minutes of the target."""
    df = features(spark, sf).withColumn("match", (F.abs(F.col("s") - F.col("y")) <= 600).cast("int"))
    m = classifier(df.where("fold >= 2"), "match", NUM, CAT, rounds=5)
    return rounded(m.transform(df.where("fold < 2")).select("mvt_id", "match", chance("chance").alias("chance")))


@query("m04_source_classifier")
def m04(spark, sf):
    """Four source classes with inverse-frequency weights."""
    gaps = [F.abs(F.col(c) - F.col("y")) for c in ("p", "s", "l")]
    best = F.least(*gaps)
    df = features(spark, sf).withColumn("source", F.when(best.isNull() | (best > 300), 0).when(gaps[0] == best, 1).when(gaps[1] == best, 2).otherwise(3))
    train = df.where("fold >= 2")
    share = train.groupBy("source").agg((1.0 / F.count("*")).alias("w"))
    m = classifier(train.join(F.broadcast(share), "source"), "source", NUM, CAT, rounds=10, classes=4, weight="w")
    return rounded(m.transform(df.where("fold < 2")).select("mvt_id", "source", *[F.coalesce(F.get(_array("chance"), F.lit(k)), F.lit(0.0)).alias(f"p{k}") for k in range(4)]))


def _array(c: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(c)


@query("m05_ratio_fit")
def m05(spark, sf):
    """Ratio of target to schedule, weighted by the schedule squared."""
    df = features(spark, sf).where("s > 600").withColumns({"ratio": F.least(F.col("y") / F.col("s"), F.lit(4.0)), "w": F.pow(F.col("s") / 1000.0, 2)})
    m = regressor(df.where("fold >= 2"), "ratio", NUM, CAT, rounds=5, weight="w")
    return rounded(m.transform(df.where("fold < 2")).select("mvt_id", (F.col("s") * F.greatest(F.least("fitted", F.lit(4.0)), F.lit(0.0))).alias("estimate")))


@query("m06_tail_mixture")
def m06(spark, sf):
    """Robust fit of ordinary rows, tail chance, and their mixture with a fitted ratio of the tail to the schedule (ten minutes at least)."""
    df = features(spark, sf).withColumn("tail", (F.col("y") > 600).cast("int"))
    train = df.where("fold >= 2")
    plain = regressor(train.where("tail = 0"), "y", NUM, CAT, robust=True)
    tail = classifier(train, "tail", NUM, CAT, rounds=5)
    base = F.greatest("s", F.lit(600.0))  # a missing schedule is ten minutes
    of_base = train.where("tail = 1").withColumns({"ratio": F.least(F.col("y") / base, F.lit(4.0)), "w": F.pow(base / 1000.0, 2)})
    ratio = regressor(of_base, "ratio", NUM, CAT, rounds=5, weight="w", out="tail_ratio")
    drop = [c for c in ("features", *[f"{c}_f" for c in NUM], *[f"{c}_i" for c in CAT])]
    both = df.where("fold < 2")
    for model in (plain, tail, ratio):
        both = model.transform(both).drop(*drop)
    p, high = chance("chance"), base * F.greatest(F.least("tail_ratio", F.lit(4.0)), F.lit(0.0))
    return rounded(both.select("mvt_id", F.greatest((1 - p) * F.col("fitted") + p * high, F.lit(0.0)).alias("estimate")), 4)


@query("m07_movement_fit")
def m07(spark, sf):
    """Direct fit on movement columns alone, split by calendar day."""
    df = features(spark, sf)
    out = out_of_fold(df, [("held", F.pmod("day", F.lit(11)) == 0)], lambda t: regressor(t, "y", ["s", "hour", "weekday", "dep15", "arr60"], CAT, rounds=5), ["mvt_id"])
    return rounded(out)


@query("m08_stacked_correction")
def m08(spark, sf):
    """A correction of out-of-fold residuals on a small view, fold by fold."""
    df = features(spark, sf)
    first = out_of_fold(df, folds(), lambda t: regressor(t, "y", NUM, CAT, rounds=3), ["mvt_id", "y", "fold", "arr60", "arr60_taxi", "hour"]).withColumnRenamed("fitted", "first").withColumn("resid", F.col("y") - F.col("first"))
    out = out_of_fold(first.drop("holdout"), folds(), lambda t: regressor(t, "resid", ["arr60", "arr60_taxi", "hour", "first"], [], rounds=3), ["mvt_id", "first"])
    return rounded(out.select("mvt_id", F.greatest(F.col("first") + F.col("fitted"), F.lit(0.0)).alias("estimate")))


@query("m09_saved_model")
def m09(spark, sf):
    """A model saved to the shared folder, loaded again and applied to a gate."""
    df = features(spark, sf)
    path = shared(spark, "model")
    regressor(df.where("fold >= 2"), "y", NUM, CAT, rounds=3).write().save(path)
    return rounded(PipelineModel.load(path).transform(df.where("fold < 2 and p_ok = 1")).select("mvt_id", "fitted"))


#: The fitted experts behind the candidates for rows with a missing clock: label, rows to learn from, weight.
FITTED = [
    Expert("missing_direct", "y", "y between 0 and 86400"),
    Expert("late", "y - old", "y between 0 and 86400"),
    Expert("ratio_of_schedule", "least(y / s, 4)", "s > 600 and y >= 0", "power(s / 1000, 2)"),
    Expert("match", "cast(abs(s - y) <= 600 as int)", "s > 3600 and y is not null"),
]


@query("o08_fitted_experts")
def o08_fitted(spark, sf):
    """The fourteen experts with fitted models behind them: each row is scored by the models that held its fold out.

    The models (direct, residual to the proxy, ratio to the schedule, chance that the schedule is right) are a table of named
    fits per held fold, written to the shared folder and read back. The grouped candidate is the mean of the row's route over
    the other folds; the schedule is picked where its fitted chance is a half or more.
    """
    keep = keeper(spark, "expert-registry")
    raw = reduce(DataFrame.unionByName, kept_features(spark, sf))
    rows = keep(raw.withColumn("bins", learn_bins(raw, NUM, CAT).column()))
    registry = keep(cross_fit(rows, "fold", [0, 1, 2, 3], FITTED, "bins", keep))
    x = score_held(rows, "fold", registry, [e.name for e in FITTED], "bins")
    known = "y between 0 and 86400"
    route = rows.where(known).groupBy("airport", "dest", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("sum"))
    total = route.groupBy("airport", "dest").agg(F.sum("n").alias("n_all"), F.sum("sum").alias("sum_all"))
    x = x.join(total, ["airport", "dest"], "left").join(route, ["airport", "dest", "fold"], "left")
    n_like = F.coalesce("n_all", F.lit(0)) - F.coalesce("n", F.lit(0))
    x = x.withColumns({"n_like": n_like, "grp": F.try_divide(F.col("sum_all") - F.coalesce("sum", F.lit(0.0)), n_like), "new": F.greatest(F.coalesce("missing_direct", "old"), F.lit(0.0))})
    x = x.withColumns({"old": F.greatest(F.col("old") + F.coalesce("late", F.lit(0.0)), F.lit(0.0)), "picked": F.when(F.col("match") >= 0.5, F.col("s")), "ratio": F.greatest("s", F.lit(1.0)) * F.least(F.greatest(F.coalesce("ratio_of_schedule", F.lit(1.0)), F.lit(0.0)), F.lit(4.0))})
    at = [F.when(F.col("s") > c, F.col("s")).otherwise(F.col("old")).alias(f"at_{int(c)}") for c in CUTS]
    return rounded(x.select("mvt_id", "fold", *at, *[F.expr(v).cast("double").alias(n) for n, v in EXPERTS.items()]), 4)
