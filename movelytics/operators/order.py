"""Ranks and neighbours in an order, without one task per key.

A window over a whole key (or over no key) is one task for a hot key. Here rows fall into buckets of the ordering column,
a window works inside each bucket, and a table of one row per bucket carries what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared


def bucketed(df: DataFrame, by: list[str], order: str, parts: int | None = None) -> DataFrame:
    """df with __b: the bucket of a numeric column within its group, by approximate quantiles; null order values come first.

    There are as many buckets as shuffle partitions, 32 at least, unless parts says otherwise; rows of one value share a bucket.
    The quantiles are written to the shared folder and read back: over many rows they depend on the order in which tasks end, and
    a bucket's rows and what lies before it are worked out apart, so both must see the same ones.
    """
    parts = parts or max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.groupBy(*by).agg(F.approx_percentile(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(32 * parts)).alias("__cuts"))
    path = shared(df.sparkSession, "order-cuts")
    cuts.write.parquet(path)
    cuts = df.sparkSession.read.schema(cuts.schema).parquet(path)
    both = df.join(cuts, by) if by else df.crossJoin(F.broadcast(cuts))
    inside = F.size(F.filter("__cuts", lambda c: c < F.col(order)))
    return both.withColumn("__b", F.when(F.col(order).isNull() | F.col("__cuts").isNull(), F.lit(-1)).otherwise(inside)).drop("__cuts")


def running(df: DataFrame, by: list[str], order: str, ties: list[str | Column], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """df with the sum of value over the rows before each row, in the order (order, ties) of its group (keys not null)."""
    b = bucketed(df.withColumn("__v", value), by, order, parts)
    sums = b.groupBy(*by, "__b").agg(F.sum("__v").alias("__s"))
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(w), F.lit(0))).drop("__s")  # one row per bucket
    inner = Window.partitionBy(*by, "__b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumn("__in", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
    return local.join(before, [*by, "__b"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__v", "__in", "__before", "__b")


def row_numbers(df: DataFrame, by: list[str], order: str, ties: list[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """df with the row number (from 1) in its group."""
    return running(df, by, order, ties, F.lit(1).cast("long"), name, parts).withColumn(name, F.col(name) + 1)


def so_far(df: DataFrame, by: list[str], order: str, sums: dict[str, str], maxima: dict[str, str]) -> DataFrame:
    """df with sums and maxima (name -> column) of the rows before each row of its group; `order` is unique in a group, sums start at 0, maxima at null."""
    b = bucketed(df, by, order)
    made = {n: (F.sum, c) for n, c in sums.items()} | {n: (F.max, c) for n, c in maxima.items()}
    join = lambda n, a, c: F.coalesce(a, F.lit(0)) + F.coalesce(c, F.lit(0)) if n in sums else F.greatest(a, c)
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = b.groupBy(*by, "__b").agg(*[f(c).alias(f"__e_{n}") for n, (f, c) in made.items()])
    ends = ends.select(*by, "__b", *[f(f"__e_{n}").over(w).alias(f"__p_{n}") for n, (f, _) in made.items()])  # one row per bucket
    inner = Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumns({f"__i_{n}": f(c).over(inner) for n, (f, c) in made.items()}).join(ends, [*by, "__b"])
    return local.select(*df.columns, *[join(n, F.col(f"__p_{n}"), F.col(f"__i_{n}")).alias(n) for n in made])


def percentiles(df: DataFrame, by: list[str], value: str, points: list[float], name: str) -> DataFrame:
    """(by, name): an array of the exact percentiles of the non-null values, interpolated between neighbours.

    Counts per distinct value and their running sums find the values around each place, so that neither a hot value nor the values of a
    whole group are gathered. Groups without a value have no row; null keys are a group like any other.
    """
    group = F.struct(*by) if by else F.lit(True)
    counts = df.where(F.col(value).isNotNull()).groupBy(group.alias("__g"), F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__c"))
    sizes = counts.groupBy("__g").agg(F.sum("__c").alias("__n"))
    placed = running(counts, ["__g"], "__x", [], F.col("__c"), "__lo").join(sizes, "__g")
    last = F.col("__lo") + F.col("__c")

    def at(place):
        return F.max(F.when((F.col("__lo") <= place) & (place < last), F.col("__x")))

    sides = []
    for i, p in enumerate(points):
        place = (F.col("__n") - 1) * p
        sides += [at(F.floor(place)).alias(f"__a{i}"), at(F.ceil(place)).alias(f"__b{i}")]
    found = placed.groupBy("__g").agg(F.max("__n").alias("__n"), *sides)
    part = [(F.col("__n") - 1) * p - F.floor((F.col("__n") - 1) * p) for p in points]
    values = [F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * f for i, f in enumerate(part)]
    return found.select(*[F.col(f"__g.{c}").alias(c) for c in by], F.array(*values).alias(name))


def with_neighbours(df: DataFrame, by: list[str], order: str, columns: list[str], width: int) -> DataFrame:
    """df with structs prev and next: the given columns of the neighbouring rows in the order of a unique integer column.

    Buckets are ranges of `width` of that column. The first and last row of a bucket find theirs in the nearest bucket
    that has rows, from a table of one row per bucket.
    """
    b = df.withColumn("__b", F.floor(F.col(order) / width).cast("long")).withColumn("__x", F.struct(order, *[c for c in columns if c != order]))
    inner = Window.partitionBy(*by, "__b").orderBy(order)
    ends = b.groupBy(*by, "__b").agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    across = Window.partitionBy(*by).orderBy("__b")
    ends = ends.select(*by, "__b", F.lag("__hi").over(across).alias("__p"), F.lead("__lo").over(across).alias("__n"))
    local = b.withColumns({"__l": F.lag("__x").over(inner), "__r": F.lead("__x").over(inner)}).join(ends, [*by, "__b"])
    return local.withColumns({"prev": F.coalesce("__l", "__p"), "next": F.coalesce("__r", "__n")}).drop("__b", "__x", "__l", "__r", "__p", "__n")


def dense_codes(distinct: DataFrame, column: str, name: str, path: str) -> DataFrame:
    """A table of distinct values with their places in order, from 0: ranges of values are written to path and numbered apart, a row per range carries the counts."""
    spark = distinct.sparkSession
    distinct.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), column).select(column, F.spark_partition_id().alias("__p")).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__p").orderBy(column)) - 1
    return ranged.withColumn("__i", inner).join(before, "__p").select(column, (F.col("__before") + F.col("__i")).cast("long").alias(name))
