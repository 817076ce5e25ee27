"""Group estimates with shrinkage, blends, gated policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shrink_ladder(train: DataFrame, rows: DataFrame, levels: list[list[str]], strengths: list[float], value: str, name: str) -> DataFrame:
    """rows with a hierarchical estimate: from the global mean down the levels, (sum + k * parent) / (n + k).

    train is aggregated once per level, and once for the mean; a group unseen in training keeps its parent's estimate.
    The levels' tables are joined by their keys; Spark broadcasts the ones that are small.
    """
    out = rows
    top = train.agg(F.avg(value).alias("__p"))
    out = out.crossJoin(F.broadcast(top))  # one row
    for keys, k in zip(levels, strengths, strict=True):
        stats = train.groupBy(*keys).agg(F.count(value).alias("__n"), F.sum(value).alias("__s"))
        out = out.join(stats, keys, "left").withColumn("__p", F.when(F.col("__n").isNull(), F.col("__p")).otherwise((F.col("__s") + k * F.col("__p")) / (F.col("__n") + k))).drop("__n", "__s")
    return out.withColumn(name, F.greatest(F.col("__p"), F.lit(0.0))).drop("__p")


@dataclass(frozen=True)
class Policy:
    """gate: rows it applies to; value: the new estimate there (over the current one, column `estimate`)."""

    gate: Column
    value: Column


def compose(df: DataFrame, policies: list[Policy], estimate: str = "estimate") -> DataFrame:
    """Apply policies in order; rows outside a gate keep their value, and the final value is at least 0."""
    for p in policies:
        df = df.withColumn(estimate, F.when(F.coalesce(p.gate, F.lit(False)), p.value).otherwise(F.col(estimate)))
    return df.withColumn(estimate, F.greatest(F.col(estimate), F.lit(0.0)))


def blend_weight(df: DataFrame, target: str, base: str, other: str, by: list[str] = ()) -> DataFrame:
    """clip(sum(d r) / sum(d^2), 0, 1) with d = other - base and r = target - base, overall or per group."""
    d, r = F.col(other) - F.col(base), F.col(target) - F.col(base)
    raw = F.sum(d * r) / F.nullif(F.sum(d * d), F.lit(0.0))
    return df.groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.0)))).alias("weight"), F.count("*").alias("n"))


def moments(df: DataFrame, experts: list[str], target: str, by: list[str] = ()) -> DataFrame:
    """Gram entries g_i_j and cross moments b_i of a few experts, one row (or one per group)."""
    aggs = [F.avg(F.col(x) * F.col(y)).alias(f"g_{i}_{j}") for i, x in enumerate(experts) for j, y in enumerate(experts) if i <= j]
    aggs += [F.avg(F.col(x) * F.col(target)).alias(f"b_{i}") for i, x in enumerate(experts)]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def error_products(df: DataFrame, experts: list[str], target: str, by: list[str] = ()) -> DataFrame:
    """(by, n, g): sums of the products of the experts' errors, g an array of rows; rows that lack the target or an expert are left out."""
    k = len(experts)
    err = df.dropna(subset=[target, *experts]).select(*by, *[(F.col(x) - F.col(target)).alias(f"__e{i}") for i, x in enumerate(experts)])
    sums = [F.sum(F.col(f"__e{i}") * F.col(f"__e{j}")).alias(f"__g{i}{j}") for i in range(k) for j in range(i, k)]
    out = err.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    return out.select(*by, "n", square([[F.col(f"__g{min(i, j)}{max(i, j)}") for j in range(k)] for i in range(k)]).alias("g"))


def square(rows: list[list[Column]]) -> Column:
    return F.array(*[F.array(*r) for r in rows])


def simplex_weights(g: str, k: int) -> Column:
    """Weights at least 0 that sum to 1 and minimise w'Gw, where column g holds the products of k experts' errors (at most about five).

    All faces of the simplex are tried, in one expression without a shuffle: on the face of a set of experts the weights are in
    proportion to the solution of Gx = 1, found by Gauss-Jordan elimination over arrays. The same number added to every entry of G
    changes no weight and keeps a faultless expert's row from being zero. Faces whose pivots vanish and weights below 0 drop
    out; of equals the face with the lowest number wins. Null where G is null.
    """
    nan = "double('NaN')"
    lift = f"(1D + aggregate(transform({g}, (r, i) -> r[i]), 0D, (s, x) -> s + x))"
    start = (
        f"transform({g}, (r, i) -> if(getbit(face, i) = 1, concat(transform(r, (x, j) -> if(getbit(face, j) = 1, x / {lift} + 1D, 0D)), array(1D)), "
        f"transform(sequence(0, {k}), j -> if(j = i, 1D, 0D))))"
    )
    solved = (
        f"aggregate(sequence(0, {k - 1}), {start}, (m, p) -> transform(m, (r, i) -> if(not m[p][p] > 1e-12D, transform(r, x -> {nan}), "
        "if(i = p, transform(r, x -> x / m[p][p]), zip_with(r, m[p], (x, y) -> x - y * r[p] / m[p][p])))), m -> transform(m, r -> r[size(r) - 1]))"
    )
    dot = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    scaled = f"transform(transform(sequence(1, {(1 << k) - 1}), face -> {solved}), x -> transform(x, v -> if(isnan(v) or v < -1e-12D, {nan}, v) / aggregate(x, 0D, (s, v) -> s + if(v > 0, v, 0D))))"
    valid = f"filter({scaled}, w -> not exists(w, v -> isnan(v)))"
    cost = dot.format(a="w", b=f"transform({g}, r -> {dot.format(a='w', b='r')})")
    return F.expr(f"array_min(transform({valid}, (w, face) -> struct({cost} as cost, face, w))).w")


def simplex(df: DataFrame, experts: list[str], target: str, by: str, strength: float) -> DataFrame:
    """(group, n, w_0..): weights of each group, drawn to those of all rows by n / (n + strength); all from one aggregation of df."""
    k = len(experts)
    each = error_products(df, experts, target, [by])
    total = square([[F.sum(F.col("g")[i][j]) for j in range(k)] for i in range(k)])
    top = each.agg(total.alias("g")).select(simplex_weights("g", k).alias("top"))
    share = F.col("n") / (F.col("n") + strength)
    own = each.select(by, "n", simplex_weights("g", k).alias("own")).crossJoin(F.broadcast(top))  # one row
    return own.select(by, "n", *[(share * F.col("own")[i] + (1 - share) * F.col("top")[i]).alias(f"w_{i}") for i in range(k)])


def best_expert(df: DataFrame, experts: list[str], target: str, by: str, strength: float) -> DataFrame:
    """(group, expert): least mean squared error after shrinking each group's risk to the overall one; ties by order of experts."""
    long = df.select(by, target, F.posexplode(F.create_map(*[x for e in experts for x in (F.lit(e), F.col(e))])).alias("rank", "expert", "p"))
    sq = F.pow(F.col("p") - F.col(target), 2)
    top = long.groupBy("expert").agg(F.avg(sq).alias("top"))
    risk = long.groupBy(by, "expert", "rank").agg(F.sum(sq).alias("s"), F.count("*").alias("n")).join(F.broadcast(top), "expert")
    return risk.groupBy(by).agg(F.min_by("expert", F.struct(((F.col("s") + strength * F.col("top")) / (F.col("n") + strength)).alias("risk"), "rank")).alias("expert"))
