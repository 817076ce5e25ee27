"""Boosted regression trees for many groups at once, and a registry of cross-fitted experts built on them.

The trees of all groups grow together, level by level: one pass sums weights and residuals per (group, node, column, bin),
a window over the bins finds each node's best split, and the splits go into the model table, a row per group. Passes are
rounds x depth, whatever the number of groups; what is shuffled are the sums, combined before the exchange, whose number
follows groups x nodes x columns x bins and not the rows. Rows are binned once and written once, as blocks of up to BLOCK rows
that teach the same groups: a row of a table then joins the models by group, and numpy walks and sums a block at a time.
A row that teaches several groups stands in one block that joins several models.

Nulls: a null number, or a category beyond the most frequent, is a bin of its own below the others; rows whose label or
group is null are left out of a fit, and rows of a group without a model are scored null. A group of equal labels is its
mean. Ties: the first column, then the lowest bin. An empty table gives an empty model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A tree maps a node's number (1 is the root, 2n and 2n + 1 are the sides of n) to its split and the sides' values.
SPLIT = "struct<feature:int,cut:int,low:double,high:double>"
TREE = f"map<int,{SPLIT}>"
#: Rows of a block at most (about 30 bytes a row and 13 columns), and groups whose sums a task holds before it hands them on.
BLOCK, HELD = 1 << 13, 256


@dataclass(frozen=True)
class Bins:
    """How columns become bins: ascending cuts of a number, or the most frequent values of a category."""

    numeric: dict[str, list[float]]
    categorical: dict[str, list[str]]

    def column(self) -> Column:
        """Array of bins: 0 for null or unknown, else one more than the number of cuts below the value, or the category's rank."""
        below = lambda c, cuts: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0).otherwise(1 + F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(c)))) if cuts else F.when(F.col(c).isNull(), 0).otherwise(1)
        rank = lambda c, values: F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(c)).cast("int"), F.lit(0)) if values else F.lit(0)
        return F.array(*[below(c, v).cast("int") for c, v in self.numeric.items()], *[rank(c, v) for c, v in self.categorical.items()])


def learn_bins(df: DataFrame, numeric: list[str], categorical: list[str], bins: int = 24) -> Bins:
    """Approximate quantiles of the numbers and the most frequent categories; at most `bins` values a column come to the driver."""
    asked = [k / bins for k in range(1, bins)]
    cuts: dict[str, list[float]] = {c: [] for c in numeric}
    if numeric:
        row = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in numeric]).agg(*[F.percentile_approx(c, asked, 1000).alias(c) for c in numeric]).first()
        cuts = {c: sorted(set(row[c] or [])) for c in numeric}
    top = {}
    for c in categorical:
        found = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(bins)
        top[c] = [r[c] for r in found.collect()]
    return Bins(cuts, top)


def _flat(tree: Column, depth: int) -> Column:
    """A tree as arrays: column (-1 without a split) and cut of the nodes 1 to 2 ** depth - 1, values of the 2 ** depth places below them."""
    at = lambda n, c: F.try_element_at(tree, F.lit(n))[c]
    nodes = range(1, 1 << depth)
    # a place's value is that of the last split on the way to it
    ends = [F.coalesce(*[at((1 << depth | place) >> up + 1, "high" if place >> up & 1 else "low") for up in range(depth)], F.lit(0.0)) for place in range(1 << depth)]
    return F.struct(F.array(*[F.coalesce(at(n, "feature"), F.lit(-1)) for n in nodes]).alias("feature"), F.array(*[F.coalesce(at(n, "cut"), F.lit(0)) for n in nodes]).alias("cut"), F.array(*ends).alias("value"))


def predicted(base: Column, trees: Column, bins: Column, depth: int, rate: float) -> Column:
    """The base and the trees' values, shrunk by the rate; null without a model."""

    def value(t: Column) -> Column:
        high = lambda n: F.coalesce(F.get(bins, F.get(t["feature"], n - 1)) > F.get(t["cut"], n - 1), F.lit(False))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), lambda n, _: n + n + high(n).cast("int"))
        return F.get(t["value"], end - (1 << depth))

    return F.aggregate(trees, base, lambda acc, t: acc + F.lit(rate) * value(t))


def _blocks(batches):
    """Runs of rows that teach the same groups (the rows come sorted by them) as blocks: labels, weights and bins, a column after another, in bytes."""
    held, count = [], 0

    def block(rows: pa.Table) -> pa.RecordBatch:
        bins = rows.column("bins").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).T
        raw = [np.ascontiguousarray(x, t).tobytes() for x, t in ((rows.column("y").to_numpy(), "<f8"), (rows.column("w").to_numpy(), "<f8"), (bins, "<i2"))]
        return pa.record_batch([rows.column("teaches").combine_chunks().slice(0, 1), *[pa.array([x], pa.binary()) for x in raw]], names=["teaches", "y", "w", "bins"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column("teaches").to_pylist()
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1][0] != keys[lo]:
                yield block(pa.Table.from_batches([x for _, x in held]))
                held, count = [], 0
            while lo < hi:
                some = min(hi - lo, BLOCK - count)
                held.append((keys[lo], batch.slice(lo, some)))
                lo, count = lo + some, count + some
                if count == BLOCK:
                    yield block(pa.Table.from_batches([x for _, x in held]))
                    held, count = [], 0
    if held:
        yield block(pa.Table.from_batches([x for _, x in held]))


def _totals(batches):
    """Rows, weighted labels and weights of each block."""
    for b in batches:
        ys, ws = ([np.frombuffer(x.as_buffer(), "<f8") for x in b.column(c)] for c in ("y", "w"))
        cols = [b.column("teaches"), pa.array([len(y) for y in ys], pa.int64()), pa.array([float(y @ w) for y, w in zip(ys, ws, strict=True)], pa.float64()), pa.array([float(w.sum()) for w in ws], pa.float64())]
        yield pa.record_batch(cols, names=["teaches", "n", "wy", "w"])


def _places(tree: dict[int, dict], bins: np.ndarray, depth: int) -> np.ndarray:
    """For each row the place, of 2 ** depth, that a tree sends it to; a node without a split sends all low."""
    place = np.zeros(bins.shape[1], np.min_scalar_type((1 << depth) - 1))
    for level in range(depth):
        high = np.zeros(len(place), bool)
        for node in range(1 << level, 2 << level):
            if s := tree.get(node):
                high |= (bins[s["feature"]] > s["cut"]) & (place == node - (1 << level))
        place = 2 * place + high
    return place


def _ends(tree: dict[int, dict], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, value) at which a row of each place ends."""
    nodes, values = np.ones(1 << depth, np.int64), np.zeros(1 << depth)
    for place in range(1 << depth):
        for level in range(depth):
            if not (s := tree.get(int(nodes[place]))):
                break
            high = place >> (depth - 1 - level) & 1
            nodes[place], values[place] = 2 * nodes[place] + high, s["high" if high else "low"]
    return nodes, values


def _summed(kind: pa.DataType, level: int, depth: int, rate: float):
    """Blocks with the models that they teach become sums of (g, node, feature, bin): rows, weights, weighted residuals."""

    def told(held: dict):
        for g, x in held.items():
            node, feature, bin_ = np.nonzero(x[0])
            cols = [pa.array([g] * len(node), kind), *[pa.array(c.astype(np.int32)) for c in (node + (1 << level), feature, bin_)], pa.array(x[0][node, feature, bin_].astype(np.int64)), *[pa.array(x[k][node, feature, bin_]) for k in (1, 2)]]
            yield pa.record_batch(cols, names=["g", "node", "feature", "bin", "n", "w", "s"])

    def run(batches):
        held: dict = {}
        for b in batches:
            for raw_y, raw_w, raw_bins, models in zip(*(b.column(c) for c in ("y", "w", "bins", "models")), strict=True):
                y, w = (np.frombuffer(x.as_buffer(), "<f8") for x in (raw_y, raw_w))
                bins = np.frombuffer(raw_bins.as_buffer(), "<i2").reshape(-1, len(y))
                top = int(bins.max(initial=0)) + 1
                for m in models.as_py():
                    r = y - m["base"]
                    for tree in map(dict, m["trees"]):
                        r -= rate * _ends(tree, depth)[1][_places(tree, bins, depth)]
                    open_ = dict(m["open"])
                    place, live = _places(open_, bins, level), _ends(open_, level)[0] >= 1 << level
                    here, wr, weight = bins, w * r, w
                    if not live.all():
                        kept = live[place]
                        place, here, wr, weight = place[kept], bins[:, kept], wr[kept], w[kept]
                    at = place.astype(np.intp) * top
                    size = top << level
                    sums = np.zeros((3, 1 << level, len(bins), top))
                    for f, x in enumerate(here):
                        to = at + x
                        for k, of in enumerate((None, weight, wr)):
                            sums[k, :, f] = np.bincount(to, of, size).reshape(1 << level, top)
                    old = held.get(m["g"])
                    if old is not None and old.shape != sums.shape:  # a block may lack the highest bins
                        old, sums = (np.pad(x, [(0, 0), (0, 0), (0, 0), (0, max(old.shape[3], top) - x.shape[3])]) for x in (old, sums))
                    held[m["g"]] = sums if old is None else old + sums
                    if len(held) >= HELD:
                        yield from told(held)
                        held = {}
        yield from told(held)

    return run


def fit_groups(train: DataFrame, group: str, label: str, bins: str, keep: Callable[[DataFrame], DataFrame], weight: str | None = None, rounds: int = 6, depth: int = 3, rate: float = 0.4, least: int = 5, ridge: float = 1.0) -> DataFrame:
    """(group, n, base, trees): a model of squared error per group of train; `bins` is a column that Bins.column made.

    `group` is a column of groups, or of arrays of the groups that a row teaches. `keep` cuts the lineage of a small table
    (one row per group) after each level, by a table or a reliable checkpoint; it is also called once on the binned rows.
    """
    several = train.schema[group].dataType.typeName() == "array"
    kind = train.schema[group].dataType.elementType if several else train.schema[group].dataType
    teaches = F.filter(F.col(group), lambda g: g.isNotNull()) if several else F.array_compact(F.array(group))
    rows = train.select(teaches.alias("teaches"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.col(bins).alias("bins")).where(F.col("y").isNotNull() & F.col("w").isNotNull() & (F.size("teaches") > 0))
    listed = f"array<{kind.simpleString()}>"
    blocks = keep(rows.sortWithinPartitions("teaches").mapInArrow(_blocks, f"teaches {listed}, y binary, w binary, bins binary"))
    totals = blocks.mapInArrow(_totals, f"teaches {listed}, n bigint, wy double, w double").select(F.explode("teaches").alias("g"), "n", "wy", "w")
    means = totals.groupBy("g").agg(F.sum("n").alias("n"), F.try_divide(F.sum("wy"), F.sum("w")).alias("base"))
    model = keep(means.where("base is not null").withColumns({"trees": F.array().cast(f"array<{TREE}>"), "open": F.map_from_arrays(F.array().cast("array<int>"), F.array().cast(f"array<{SPLIT}>"))}))
    by_bin = Window.partitionBy("g", "node", "feature")
    for _ in range(rounds):
        for level in range(depth):
            taught = blocks.select("teaches").distinct().select("teaches", F.explode("teaches").alias("g")).join(model, "g").groupBy("teaches").agg(F.collect_list(F.struct("g", "base", "trees", "open")).alias("models"))
            at = blocks.join(taught, "teaches").select("y", "w", "bins", "models").mapInArrow(_summed(to_arrow_type(kind), level, depth, rate), f"g {kind.simpleString()}, node int, feature int, bin int, n bigint, w double, s double")
            sums = at.groupBy("g", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "nws"])
            upto = by_bin.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            cuts = sums.select("g", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}1") for c in "nws"], *[F.sum(c).over(by_bin).alias(f"{c}t") for c in "nws"])
            part = lambda s, w: F.col(s) * F.col(s) / (F.col(w) + ridge)
            cuts = cuts.where((F.col("n1") >= least) & (F.col("nt") - F.col("n1") >= least)).withColumns({"s2": F.col("st") - F.col("s1"), "w2": F.col("wt") - F.col("w1")})
            cuts = cuts.withColumn("gain", part("s1", "w1") + part("s2", "w2") - part("st", "wt")).where("gain > 1e-9")
            best = cuts.groupBy("g", "node").agg(F.max_by(F.struct("feature", F.col("bin").alias("cut"), (F.col("s1") / (F.col("w1") + ridge)).alias("low"), (F.col("s2") / (F.col("w2") + ridge)).alias("high")), F.struct(F.round("gain", 6), -F.col("feature"), -F.col("bin"))).alias("split"))
            found = best.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("node", "split"))).alias("found"))
            model = model.join(found, "g", "left").withColumn("open", F.when(F.col("found").isNull(), F.col("open")).otherwise(F.map_concat("open", "found"))).drop("found")
            if level == depth - 1:
                model = model.withColumns({"trees": F.concat("trees", F.array("open")), "open": F.map_filter("open", lambda k, _: k < 0)})
            model = keep(model)
    return model.select(F.col("g").alias(group), "n", "base", F.transform("trees", lambda t: _flat(t, depth)).alias("trees"))


@dataclass(frozen=True)
class Expert:
    """A named fit: SQL expressions of its label, of the rows that it may learn from, and of their weights."""

    name: str
    label: str
    learns_from: str = "true"
    weight: str = "1"


def cross_fit(df: DataFrame, fold: str, folds: list[int], experts: list[Expert], bins: str, keep: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """Registry (held, experts: map of name -> (n, base, trees), learned): one model per expert and held fold, fitted together.

    A model of the held fold k learns from the rows of all other folds that its expert admits; rows without a fold teach none.
    `learned` lists the folds that its models have seen. A fold is one of `folds`; scoring holds it against the list again.
    """
    offers = F.array(*[F.when(F.expr(e.learns_from), F.struct(F.lit(e.name).alias("expert"), F.expr(e.label).cast("double").alias("label"), F.expr(e.weight).cast("double").alias("weight"))) for e in experts])
    rows = df.where(F.col(fold).isin(folds)).select(F.col(fold).alias("seen"), F.col(bins).alias("bins"), F.explode(F.filter(offers, lambda o: o.isNotNull() & o["label"].isNotNull())).alias("o"))
    others = F.filter(F.array(*map(F.lit, folds)), lambda k: k != F.col("seen"))
    rows = rows.select("bins", "o.*", F.transform(others, lambda k: F.concat_ws("@", F.col("o.expert"), k.cast("string"))).alias("model"))
    models = fit_groups(rows, "model", "label", "bins", keep, weight="weight", **options)
    named = models.select(F.split_part("model", F.lit("@"), F.lit(2)).cast("int").alias("held"), F.split_part("model", F.lit("@"), F.lit(1)).alias("name"), F.struct("n", "base", "trees").alias("fitted"))
    per_fold = named.groupBy("held").agg(F.map_from_entries(F.collect_list(F.struct("name", "fitted"))).alias("experts"))
    return per_fold.withColumn("learned", F.filter(F.array(*map(F.lit, folds)), lambda k: k != F.col("held")))


def score_held(df: DataFrame, fold: str, registry: DataFrame, names: list[str], bins: str, depth: int = 3, rate: float = 0.4) -> DataFrame:
    """df with a column per expert: the prediction of the models that held the row's fold out.

    A model that has seen the row's fold is an error; a fold or an expert without a model gives null.
    """
    held = registry.select(F.col("held").alias("__held"), F.col("experts").alias("__experts"), F.col("learned").alias("__learned"))
    both = df.join(held, F.col(fold) == F.col("__held"), "left")

    def value(name: str) -> Column:
        m = F.col("__experts")[name]
        seen = F.array_contains("__learned", F.col(fold))
        return F.when(seen, F.raise_error(F.lit(f"{name} has seen the fold that it scores")).cast("double")).otherwise(predicted(m["base"], m["trees"], F.col(bins), depth, rate))

    return both.withColumns({n: value(n) for n in names}).drop("__held", "__experts", "__learned")
