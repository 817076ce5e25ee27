"""Audits: profiles, drift, exact id sets, table differences, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import percentiles, row_numbers


def exact_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids only in a, only in b, null and repeated ids on either side; all zero for equal id sets."""
    side = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    both = side(a, "na").join(side(b, "nb").withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k")), "full_outer")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return both.agg(
        F.count_if((na > 0) & (nb == 0)).alias("only_a"),
        F.count_if((na == 0) & (nb > 0)).alias("only_b"),
        F.count_if(F.col(key).isNull() & F.col("__k").isNull()).alias("null_ids"),
        F.count_if((na > 1) | (nb > 1)).alias("repeated"),
    )


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(column, mismatches) over a full outer join of two builds by id; nulls equal nulls."""
    cols = [c for c in a.columns if c != key]
    right = b.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in cols])
    both = a.join(right, F.col(key) == F.col("__k"), "full_outer")
    out = both.agg(F.count_if(F.col(key).isNull() | F.col("__k").isNull()).alias(key), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in cols])
    return out.unpivot([], [key, *cols], "column", "mismatches")


def digest(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Order-free digest: rows, and the sums of two 31-bit parts of every row's SHA-256."""
    line = _line(columns)
    part = lambda k: F.conv(F.substring(line, k, 7), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(part(1)).alias("sum_a"), F.sum(part(8)).alias("sum_b"))


def _line(columns: list[str]):
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)


def ordered_digest(df: DataFrame, columns: list[str], order: str, by: list[str] = (), chunk: int = 4096, levels: int = 3) -> DataFrame:
    """(by, n, ordered): SHA-256 over the rows' digests in the order of `order`, as a tree: `chunk` digests a node, `levels` levels above the rows.

    Two rows that change places change it. Every node is a group of at most `chunk` rows, but for the root, which takes what
    chunk ** (levels - 1) rows a node leave: 3 levels of 4096 serve 7e10 rows a group. Ranks come from range buckets; `order` is unique.
    """
    by = list(by)
    group = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("")
    keyed = df.select(*by, group.alias("__g"), order, _line(columns).alias("h"))  # null keys are groups of their own
    lines = row_numbers(keyed.select("__g", order, "h"), ["__g"], order, [], "r").select("__g", (F.col("r") - 1).alias("r"), "h")
    for level in range(levels):
        node = F.floor(F.col("r") / chunk).cast("long") if level < levels - 1 else F.lit(0).cast("long")
        inner = F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"])
        lines = lines.groupBy("__g", node.alias("node")).agg(F.sha2(F.array_join(inner, ""), 256).alias("h")).select("__g", F.col("node").alias("r"), "h")
    counts = keyed.groupBy("__g", *by).agg(F.count("*").alias("n"))
    return counts.join(lines.select("__g", F.col("h").alias("ordered")), "__g").drop("__g")


def vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_values, digest) of the distinct non-null values."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null").distinct()
    part = F.conv(F.substring(F.sha2("value", 256), 1, 7), 16, 10).cast("long")
    return long.groupBy("column").agg(F.count("*").alias("n_values"), F.sum(part).alias("digest"))


def schema_fingerprint(df: DataFrame, categories: list[str]) -> DataFrame:
    """(position, column, type, n_values, digest, schema): one row a column; vocabularies of the categories, null for others.

    schema is the SHA-256 of all "name:type" in order, the same in each row: another order, name or type changes it. A category
    without values has n_values and digest 0.
    """
    names = [f"{c}:{t}" for c, t in df.dtypes]
    rows = [(i, c, t, c in categories) for i, (c, t) in enumerate(df.dtypes)]
    columns = df.sparkSession.createDataFrame(rows, "position int, column string, type string, is_category boolean")
    zero = lambda c: F.when(F.col("is_category"), F.coalesce(c, F.lit(0))).alias(c)
    both = columns.join(vocabulary(df, categories), "column", "left")
    return both.select("position", "column", "type", zero("n_values"), zero("digest"), F.sha2(F.lit(",".join(names)), 256).alias("schema"))


def coverage(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by, column, share of non-null values)."""
    wide = df.groupBy(*by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot(list(by), columns, "column", "share")


def quantiles(df: DataFrame, value: str, points: list[float], by: list[str] = ()) -> DataFrame:
    """(by, n, coverage, mean, min, max, q_i) with exact percentiles; q_i are null where a group has no value."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return with_percentiles(out, df, value, points, by).select(*by, "n", "coverage", "mean", "min", "max", *[F.col("__q")[i].alias(f"q{i}") for i in range(len(points))])


def with_percentiles(groups: DataFrame, df: DataFrame, value: str, points: list[float], by: list[str], name: str = "__q") -> DataFrame:
    """groups (one row per by) with the percentiles of df's values in each."""
    if not by:
        return groups.join(percentiles(df, [], value, points, name), F.lit(True), "left")  # one row a side
    found = percentiles(df, list(by), value, points, name).withColumnsRenamed({c: f"__q_{c}" for c in by})
    on = [groups[c].eqNullSafe(found[f"__q_{c}"]) for c in by]
    return groups.join(found, on, "left").drop(*[f"__q_{c}" for c in by])


def drift(old: DataFrame, new: DataFrame, by: str, numeric: list[str], categories: list[str]) -> DataFrame:
    """(by, column, coverage_delta, median_delta, novel_rate): how columns of new differ from the same group of old."""
    rows = None
    if numeric:
        marked = [df.where(F.col(by).isNotNull()).select(by, F.lit(s).alias("__side"), *[F.col(c).cast("double").alias(c) for c in numeric]) for df, s in ((new, 1), (old, 0))]
        long = marked[0].union(marked[1]).unpivot([by, "__side"], numeric, "column", "__v")
        each = [by, "__side", "column"]
        stats = with_percentiles(long.groupBy(*each).agg(F.avg(F.col("__v").isNotNull().cast("double")).alias("cov")), long, "__v", [0.5], each, "__m")
        gap = lambda c: F.max(F.when(F.col("__side") == 1, c)) - F.max(F.when(F.col("__side") == 0, c))
        both = stats.groupBy(by, "column").agg(gap(F.col("cov")).alias("coverage_delta"), gap(F.col("__m")[0]).alias("median_delta"), F.count("*").alias("sides"))
        rows = both.where("sides = 2").select(by, "column", "coverage_delta", "median_delta", F.lit(None).cast("double").alias("novel_rate"))
    for c in categories:
        seen = old.where(F.col(c).isNotNull()).select(by, c).distinct().withColumn("__seen", F.lit(1))
        one = new.join(seen, [by, c], "left").groupBy(by).agg(F.avg(F.when(F.col(c).isNotNull(), F.col("__seen").isNull().cast("double"))).alias("novel_rate"), F.avg(F.col(c).isNotNull().cast("double")).alias("cov_n"))
        cov = old.groupBy(by).agg(F.avg(F.col(c).isNotNull().cast("double")).alias("cov_o"))
        one = one.join(cov, by).select(by, F.lit(c).alias("column"), (F.col("cov_n") - F.col("cov_o")).alias("coverage_delta"), F.lit(None).cast("double").alias("median_delta"), "novel_rate")
        rows = one if rows is None else rows.union(one)
    return rows
