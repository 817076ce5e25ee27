"""Temporal context around query rows: range windows, occupancy, nearest events, band joins, nearest-k sequences.

Spark has no range join, so windows over other rows run on one sorted union of queries and events. Bounded windows are
partitioned by (key, time bucket) and not by key alone, so that a hot key is spread over its time span; a query stands
in one bucket and an event in each bucket whose queries can see it. All times are BIGINT microseconds, bounds inclusive:
strictly past is (-w, -1), strictly future (1, w).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fused import dealt
from .order import so_far

MILLION = 1_000_000


@dataclass(frozen=True)
class Win:
    name: str
    lo: int
    hi: int


def _renamed(e: DataFrame, key: list[str], t: str, values: list[str]) -> DataFrame:
    return e.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col(t).alias("__t"), *[F.col(v).alias(f"__v_{v}") for v in values])


def _queries(q: DataFrame, key: list[str], t: str, width: int) -> DataFrame:
    return q.select("*", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col(t).alias("__t"), F.floor(F.col(t) / width).cast("long").alias("__b"), F.lit(0).alias("__tag"))


def context_agg(q: DataFrame, e: DataFrame, key: list[str], t: str, windows: list[Win], aggs: dict[str, tuple[str, str | None]], event_t: str | None = None, halo: int | None = None, null_safe: bool = False) -> DataFrame:
    """q with one column `{window}_{agg}` per window and aggregate over the events of the same key in [t+lo, t+hi].

    aggs: name -> (count | sum | avg | std, value column or None). Counts are 0 and the others null where there are no
    events. Rows with a null key or time get nulls; with null_safe, null keys form a group of their own.

    No frame slides: a query row becomes a row for each bound after the exchange, and an answer is what a running aggregate
    gained between two bounds, so the cost is by row and not by the events in a window. Times are doubled, so that a bound
    lies between two moments. Doubles are summed in whole millionths, so that differences are exact.
    Partitions follow the number of events, which is counted first.
    """
    event_t = event_t or t
    width = halo or max(max(abs(w.lo), abs(w.hi)) for w in windows)
    values = sorted({v for _, v in aggs.values() if v})
    lo, hi = min(w.lo for w in windows), max(w.hi for w in windows)
    near = F.sequence(F.floor((F.col("__t") - hi) / width).cast("long"), F.floor((F.col("__t") - lo) / width).cast("long"))
    keys = [f"__k{i}" for i in range(len(key))]
    events = _renamed(e, key, event_t, values).where("__t is not null").withColumn("__b", F.explode(near)).withColumn("__tag", F.lit(1))
    # rows without a time belong to no bucket; they are spread by what they hold
    loose = F.pmod(F.xxhash64(*[c for c, kind in q.dtypes if "map<" not in kind]), F.lit(4096))
    queries = _queries(q, key, t, width).withColumn("__b", F.coalesce("__b", loose))
    known = F.col("__t").isNotNull() if null_safe else F.col("__t").isNotNull() & ~sum(((F.col(k).isNull()).cast("int") for k in keys), F.lit(0)).cast("boolean")
    bounds: dict[int, int] = {}  # offset to the doubled time -> number
    spans = {w: (bounds.setdefault(2 * w.lo - 1, len(bounds)), bounds.setdefault(2 * w.hi, len(bounds))) for w in windows}
    stand = lambda at, o: F.struct(F.lit(at).cast("int").alias("__at"), o.alias("__o"))
    asked = F.array(*[stand(n, F.col("__t") * 2 + d) for d, n in bounds.items()])
    both = queries.unionByName(events, allowMissingColumns=True).repartition(dealt(e), *keys, "__b").withColumn("__row", F.monotonically_increasing_id())
    rows = both.select("*", F.inline(F.when(F.col("__tag") == 1, F.array(stand(None, F.col("__t") * 2))).otherwise(asked)))
    upto = Window.partitionBy(*keys, "__b").orderBy("__o").rangeBetween(Window.unboundedPreceding, 0)
    hit, kinds = F.col("__tag") == 1, dict(e.dtypes)
    exact = lambda v: kinds[v] not in ("double", "float")
    run: dict[str, Column] = {}  # running aggregates, each kept once

    def running(how: str, v: str | None) -> str:
        whole = F.when(hit, F.lit(1) if v is None else F.col(f"__v_{v}") if exact(v) else F.round(F.col(f"__v_{v}").cast("double") * MILLION).cast("bigint"))
        wide = whole.cast("decimal(19,0)") if v is None or not exact(v) or "decimal" not in kinds[v] else whole
        made = {"n": lambda: F.count(whole).over(upto), "s": lambda: F.coalesce(F.sum(whole).over(upto), F.lit(0)), "x": lambda: F.coalesce(F.sum(wide * wide).over(upto), F.lit(0))}[how]
        name = f"__{how}_{v}"
        run.setdefault(name, made())
        return name

    sums: dict[str, Column] = {}  # what a bound's row adds to its query's sums

    def gained(of: str, w: Win) -> Column:
        first, last = spans[w]
        name = f"{of}_{first}_{last}"
        sums.setdefault(name, F.when(F.col("__at") == last, F.col(of)).when(F.col("__at") == first, -F.col(of)))
        return F.col(name)

    out: dict[str, Column] = {}
    for w in windows:
        for name, (how, v) in aggs.items():
            n = gained(running("n", v), w)
            unit = F.lit(1) if v is None or exact(v) else F.lit(float(MILLION))
            if how == "count":
                made = n
            elif how == "std":
                # n * sum x^2 - (sum x)^2 is exact in whole numbers
                total, squares = gained(running("s", v), w).cast("decimal(19,0)"), gained(running("x", v), w).cast("decimal(38,0)")
                made = F.when(n > 0, F.sqrt((n.cast("decimal(19,0)") * squares - total * total).cast("double")) / n / unit)
            else:
                total = gained(running("s", v), w)
                made = F.when(n > 0, (total if exact(v) else total / unit) / (n if how == "avg" else F.lit(1)) if how == "avg" or not exact(v) else total)
            out[f"{w.name}_{name}"] = F.when(known, made)
    # a query's rows are in one partition already, so this needs no exchange
    one = rows.withColumns(run).where("__tag = 0").groupBy(*keys, "__b", "__row", "__t", *q.columns).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return one.select(*q.columns, *[c.alias(n) for n, c in out.items()])


def occupancy(q: DataFrame, e: DataFrame, key: list[str], at: str, start: str, end: str, start_inclusive: bool, end_inclusive: bool, name: str, width: int, minus_self: Column | None = None) -> DataFrame:
    """q with the number of intervals of its key that are open at q.at.

    start_inclusive: an interval that starts at `at` counts; end_inclusive: one that ends at `at` still counts.
    A +1/-1 stream is summed within (key, bucket); an interval that enters a later bucket leaves a carry row there.
    """
    keys = [f"__k{i}" for i in range(len(key))]
    kcols = [F.col(k).alias(n) for k, n in zip(key, keys, strict=True)]
    iv = e.where(F.col(start).isNotNull() & F.col(end).isNotNull()).where((F.col(start) <= F.col(end)) if start_inclusive and end_inclusive else F.col(start) < F.col(end))
    # Doubled times leave room for order among equals: starts, queries, ends.
    s, f = F.col(start) * 2 + (0 if start_inclusive else 1), F.col(end) * 2 + (1 if end_inclusive else 0)
    bucket = lambda c: F.floor(c / (2 * width)).cast("long")
    carry = F.transform(F.when(bucket(f) > bucket(s), F.sequence(bucket(s) + 1, bucket(f))).otherwise(F.array().cast("array<bigint>")), lambda b: F.struct(b.alias("__b"), (b * (2 * width)).alias("__o"), F.lit(1).alias("__d")))
    steps = F.concat(F.array(F.struct(bucket(s).alias("__b"), s.alias("__o"), F.lit(1).alias("__d")), F.struct(bucket(f).alias("__b"), f.alias("__o"), F.lit(-1).alias("__d"))), carry)
    stream = iv.select(*kcols, F.inline(steps)).withColumn("__tag", F.lit(1))
    queries = q.select("*", *kcols, (F.col(at) * 2).alias("__o"), bucket(F.col(at) * 2).alias("__b"), F.lit(0).alias("__tag"), F.lit(0).alias("__d"))
    run = F.sum("__d").over(Window.partitionBy(*keys, "__b").orderBy("__o").rangeBetween(Window.unboundedPreceding, 0))
    open_ = (run - (minus_self if minus_self is not None else F.lit(0))).cast("long")
    known = F.col("__o").isNotNull() & ~sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)).cast("boolean")
    both = queries.unionByName(stream, allowMissingColumns=True)
    return both.withColumn(name, F.when(known, open_)).where("__tag = 0").select(*q.columns, name)


def nearest(q: DataFrame, e: DataFrame, key: list[str], t: str, payload: list[str], side: str, tolerance: int, inclusive: bool = False, event_t: str | None = None, prefix: str = "near", tie: str = "asc") -> DataFrame:
    """q with the nearest event of its key before ("past") or after ("future"), at most `tolerance` away: `{prefix}_t` and its payload.

    Among events at one time, payloads decide: the smallest with tie asc, the largest with desc.
    """
    event_t = event_t or t
    keys = [f"__k{i}" for i in range(len(key))]
    gap = 0 if inclusive else 1
    lo, hi = (-tolerance, -gap) if side == "past" else (gap, tolerance)
    near = F.sequence(F.floor((F.col("__t") - hi) / tolerance).cast("long"), F.floor((F.col("__t") - lo) / tolerance).cast("long"))
    events = _renamed(e, key, event_t, payload).where("__t is not null").withColumn("__b", F.explode(near)).withColumn("__tag", F.lit(1))
    both = _queries(q, key, t, tolerance).unionByName(events, allowMissingColumns=True)
    # the nearest event of all on that side decides: a growing frame, from the far end for the future, and then the tolerance
    order = F.col("__t") if side == "past" else -F.col("__t")
    frame = Window.partitionBy(*keys, "__b").orderBy(order).rangeBetween(Window.unboundedPreceding, -gap)
    sign = -1 if side == "past" and tie != "desc" else 1
    found = F.when(F.col("__tag") == 1, F.struct("__t", *[(F.col(f"__v_{p}") * sign if sign < 0 else F.col(f"__v_{p}")).alias(f"__v_{p}") for p in payload]))
    best = (F.max if side == "past" else F.min)(found).over(frame)
    known = F.col("__t").isNotNull() & ~sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)).cast("boolean")
    rows = both.withColumn("__best", F.when(known, best)).where("__tag = 0").withColumn("__best", F.when(F.abs(F.col("__best.__t") - F.col("__t")) <= tolerance, F.col("__best")))
    return rows.select(*q.columns, F.col("__best.__t").alias(f"{prefix}_t"), *[(F.col(f"__best.__v_{p}") * sign if sign < 0 else F.col(f"__best.__v_{p}")).alias(f"{prefix}_{p}") for p in payload])


def nearest_any(q: DataFrame, e: DataFrame, key: list[str], t: str, kinds: dict[str, Column], width: int, event_t: str | None = None) -> DataFrame:
    """q with `prev_{kind}` and `next_{kind}`: times of the nearest events of its key strictly before and after, however far.

    kinds: name -> condition over e. All of them come from one sorted union. Within a bucket running extremes find them;
    where the bucket has none, the extreme of the nearest bucket with events is carried in, from a table of one row per
    (key, bucket).
    """
    event_t = event_t or t
    keys = [f"__k{i}" for i in range(len(key))]
    marks = e.select(*key, F.col(event_t).alias("__et"), *[F.when(c, F.col(event_t)).alias(f"__n_{k}") for k, c in kinds.items()])
    events = _renamed(marks, key, "__et", [f"__n_{k}" for k in kinds]).where("__t is not null").withColumn("__b", F.floor(F.col("__t") / width).cast("long"))
    queries = _queries(q, key, t, width)
    at = {k: f"__v___n_{k}" for k in kinds}
    ends = [f(c).alias(f"{n}_{k}") for k, c in at.items() for n, f in (("__hi", F.max), ("__lo", F.min))]
    buckets = events.unionByName(queries.select(*keys, "__b").distinct(), allowMissingColumns=True).groupBy(*keys, "__b").agg(*ends)
    order = Window.partitionBy(*keys).orderBy("__b")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carry = buckets.select(*keys, "__b", *[F.max(f"__hi_{k}").over(before).alias(f"__p_{k}") for k in kinds], *[F.min(f"__lo_{k}").over(after).alias(f"__f_{k}") for k in kinds])
    both = queries.unionByName(events.withColumn("__tag", F.lit(1)), allowMissingColumns=True)
    inner = Window.partitionBy(*keys, "__b")  # both frames grow: one that shrinks is worked out anew for each row
    past, future = inner.orderBy("__t").rangeBetween(Window.unboundedPreceding, -1), inner.orderBy(-F.col("__t")).rangeBetween(Window.unboundedPreceding, -1)
    local = both.withColumns({f"__i_{k}": F.max(c).over(past) for k, c in at.items()} | {f"__o_{k}": F.min(c).over(future) for k, c in at.items()}).where("__tag = 0")
    found = [c for k in kinds for c in (F.coalesce(f"__i_{k}", f"__p_{k}").alias(f"prev_{k}"), F.coalesce(f"__o_{k}", f"__f_{k}").alias(f"next_{k}"))]
    return local.join(carry, [*keys, "__b"], "left").select(*q.columns, *found)


def band_join(q: DataFrame, e: DataFrame, key: list[str], q_lo: Column, q_hi: Column, e_t: str, span: int) -> DataFrame:
    """Inner join of q with the events of its key in [q_lo, q_hi], hi - lo at most about `span`; events' columns get the prefix e_.

    A query is sent to each bucket its band touches, an event to its own, so no pair comes twice.
    """
    ev = e.select(*[F.col(c).alias(f"e_{c}") for c in e.columns]).withColumn("__b", F.floor(F.col(f"e_{e_t}") / span).cast("long"))
    asked = q.withColumns({"__lo": q_lo, "__hi": q_hi}).where("__lo <= __hi").withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / span).cast("long"), F.floor(F.col("__hi") / span).cast("long"))))
    on = (asked["__b"] == ev["__b"]) & F.col(f"e_{e_t}").between(F.col("__lo"), F.col("__hi"))
    for k in key:
        on = on & (asked[k] == ev[f"e_{k}"])
    return asked.join(ev, on).drop("__b", "__lo", "__hi")


def dominated(iv: DataFrame, id_col: str, key: list[str], x: str, y: str, width: int, name: str) -> DataFrame:
    """(id, name): rows of the same key with a larger x and a smaller y, where that implies an x less than width away.

    No pairs: rows are ranked by x in buckets of width. The ranks above a row are the upper halves of those power-of-two blocks
    that hold the row in their lower half, one a level, and the whole next bucket; each row stands in one block a level. A running count in the
    order of y serves every block, so m rows of a bucket make about m log2 m rows. Rows with a null in x, y or key count nowhere and are not in the result.
    """
    base = iv.select(F.col(id_col).alias("__id"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col(x).alias("__x"), F.col(y).alias("__y"))
    keys = [f"__k{i}" for i in range(len(key))]
    b = base.dropna(subset=["__x", "__y", *keys]).withColumn("__b", F.floor(F.col("__x") / width).cast("long"))
    whole = Window.partitionBy(*keys, "__b")
    upto = whole.orderBy("__x")
    ranked = b.withColumns({"__i": F.row_number().over(upto) - 1, "__top": F.count("*").over(upto.rangeBetween(Window.unboundedPreceding, 0)) - 1, "__n": F.count("*").over(whole)})
    levels = "sequence(0, length(bin(__n)) - 1)"
    stands = f"concat(transform({levels}, k -> struct(__b as b, k as level, shiftright(__i, k) as node, false as asks)), array(struct(__b as b, -1 as level, 0 as node, false as asks)))"
    asks = f"concat(transform(filter({levels}, k -> shiftright(__top, k) & 1 = 0), k -> struct(__b as b, k as level, cast(shiftright(__top, k) + 1 as int) as node, true as asks)), array(struct(__b + 1 as b, -1 as level, 0 as node, true as asks)))"
    rows = ranked.select("__id", *keys, "__y", F.inline(F.expr(f"concat({stands}, {asks})")))
    below = Window.partitionBy(*keys, "b", "level", "node").orderBy("__y").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__c", F.count_if(~F.col("asks")).over(below)).where("asks").groupBy(F.col("__id").alias(id_col)).agg(F.sum("__c").alias(name))


def overtaking(iv: DataFrame, id_col: str, key: list[str], start: str, end: str, span: int) -> DataFrame:
    """(id, overtakers, left_behind) of intervals of more than 0 and at most span: others that start later and end earlier, and the reverse."""
    turned = iv.withColumns({start: -F.col(start), end: -F.col(end)})
    over = dominated(iv, id_col, key, start, end, span, "overtakers")
    left = dominated(turned, id_col, key, start, end, span, "left_behind")
    both = iv.select(id_col).join(over, id_col, "left").join(left, id_col, "left")
    return both.select(id_col, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("overtakers", "left_behind")])


def neighbours(q: DataFrame, e: DataFrame, key: list[str], t: str, id_col: str, horizon: int, k: int, exclude: Column, tie: list[str]) -> DataFrame:
    """(q columns, e_ columns, side, rank): up to k events of the same key before and after, nearest first, within the horizon.

    exclude is a condition over a pair that bars it; events at the query's own time never count.
    """
    pairs = band_join(q, e, key, F.col(t) - horizon, F.col(t) + horizon, t, horizon).where((F.col(f"e_{t}") != F.col(t)) & ~F.coalesce(exclude, F.lit(False)))
    side = F.when(F.col(f"e_{t}") < F.col(t), "past").otherwise("future")
    gap = F.abs(F.col(f"e_{t}") - F.col(t))
    rank = F.row_number().over(Window.partitionBy(id_col, "side").orderBy(gap, *[f"e_{c}" for c in tie]))
    return pairs.withColumn("side", side).withColumn("rank", rank).where(F.col("rank") <= k)


def unique_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs once; every row of a repeated key goes."""
    once = df.groupBy(*key).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return df.join(once, key, "left_semi")


def counts_until(q: DataFrame, e: DataFrame, key: list[str], at: str, event_t: str, kinds: dict[str, Column], inclusive: bool, width: int, suffix: str) -> DataFrame:
    """q with `{kind}{suffix}`: the number of events of its key and kind before q.at (or at it, if inclusive), however far back.

    kinds: name -> condition over e. A running count within (key, bucket); what lies in earlier buckets is carried in from
    a table of one row per (key, bucket). Rows with a null key or time get nulls.
    """
    keys = [f"__k{i}" for i in range(len(key))]
    kcols = [F.col(k).alias(n) for k, n in zip(key, keys, strict=True)]
    flags = {k: F.when(c, 1).otherwise(0).alias(f"__n_{k}") for k, c in kinds.items()}
    bucket = lambda c: F.floor(F.col(c) / width).cast("long").alias("__b")
    events = e.where(F.col(event_t).isNotNull()).select(*kcols, bucket(event_t), (F.col(event_t) * 2).alias("__o"), F.lit(1).alias("__tag"), *flags.values())
    queries = q.select("*", *kcols, bucket(at), (F.col(at) * 2 + (1 if inclusive else -1)).alias("__o"), F.lit(0).alias("__tag"))
    totals = events.unionByName(queries.select(*keys, "__b").distinct(), allowMissingColumns=True).groupBy(*keys, "__b").agg(*[F.sum(f"__n_{k}").alias(f"__s_{k}") for k in kinds])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "__b", *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__c_{k}") for k in kinds])
    inner = Window.partitionBy(*keys, "__b").orderBy("__o").rangeBetween(Window.unboundedPreceding, 0)
    both = queries.unionByName(events, allowMissingColumns=True)
    local = both.withColumns({f"__i_{k}": F.coalesce(F.sum(f"__n_{k}").over(inner), F.lit(0)) for k in kinds}).where("__tag = 0")
    return local.join(carry, [*keys, "__b"], "left").select(*q.columns, *[(F.col(f"__c_{k}") + F.col(f"__i_{k}")).alias(f"{k}{suffix}") for k in kinds])


def nearest_events(q: DataFrame, e: DataFrame, key: str, t: str, id_col: str, flight: str, order: list[str], payload: list[str], horizon: int, k: int, slack: int = 4) -> DataFrame:
    """q with arrays past and future: up to k events of its key on each side within the horizon, nearest time first, in `order` within a time.

    Events at the query's own time never count, nor those of its own flight, nor those of another UTC month. No pairs are
    made: events are gathered per (key, time), k + slack of them at most, and a frame of k + slack distinct times on either
    side of each time, within buckets with a halo of the horizon, gives every query of that time its candidates. slack
    covers a flight's own events; queries of flights with more events than that go by way of `neighbours`.
    """
    most = k + slack
    columns = list(dict.fromkeys([*order, id_col, flight, *payload]))
    month = lambda c: F.date_format(F.timestamp_micros(c), "yyyyMM")
    rank = F.row_number().over(Window.partitionBy(key, t).orderBy(*order, id_col))
    one = F.struct(*[F.col(c) for c in dict.fromkeys([*order, id_col, *columns, t])])
    times = e.where(F.col(key).isNotNull() & F.col(t).isNotNull()).withColumn("__r", rank).where(F.col("__r") <= most).groupBy(key, t).agg(F.array_sort(F.collect_list(one)).alias("__ev"))
    width = 4 * horizon
    own = F.floor(F.col(t) / width).cast("long")
    near = F.sequence(F.floor((F.col(t) - horizon) / width).cast("long"), F.floor((F.col(t) + horizon) / width).cast("long"))
    placed = times.withColumn("__own", own).withColumn("__b", F.explode(near))
    w = Window.partitionBy(key, "__b").orderBy(t)
    within = lambda lists: F.slice(F.filter(F.flatten(lists), lambda x: (F.abs(x[t] - F.col(t)) <= horizon) & (month(x[t]) == month(F.col(t)))), 1, most)
    found = placed.withColumns({"__p": F.collect_list("__ev").over(w.rowsBetween(-most, -1)), "__f": F.collect_list("__ev").over(w.rowsBetween(1, most))}).where("__b = __own")
    found = found.select(key, t, within(F.reverse("__p")).alias("__p"), within(F.col("__f")).alias("__f"))
    busy = e.where(F.col(flight).isNotNull()).groupBy(key, flight).agg(F.count("*").alias("__n")).where(F.col("__n") > slack).select(key, flight)
    some = q.join(busy, [key, flight], "left_semi")
    rest = q.join(busy, [key, flight], "left_anti").join(found, [key, t], "left")
    other = lambda c: F.slice(F.filter(F.coalesce(c, F.array()), lambda x: ~F.coalesce(x[flight] == F.col(flight), F.lit(False))), 1, k)
    quick = rest.select(*q.columns, other(F.col("__p")).alias("past"), other(F.col("__f")).alias("future"))
    same = (F.col(f"e_{id_col}") == F.col(id_col)) | (F.col(f"e_{flight}") == F.col(flight)) | (month(F.col(f"e_{t}")) != month(F.col(t)))
    pairs = neighbours(some, e, [key], t, id_col, horizon, k, F.coalesce(same, F.lit(False)), [*order, id_col])
    back = F.struct(F.col("rank"), F.struct(*[F.col(f"e_{c}").alias(c) for c in dict.fromkeys([*order, id_col, *columns, t])]).alias("x"))
    sides = [F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, back))), lambda y: y["x"]).alias(s) for s in ("past", "future")]
    slow = some.join(pairs.groupBy(id_col).agg(*sides), id_col, "left")
    kind = quick.schema["past"].dataType
    return quick.unionByName(slow.select(*q.columns, *[F.coalesce(F.col(s), F.array()).cast(kind).alias(s) for s in ("past", "future")]))


def quota(e: DataFrame, key: str, t: str, span: int, slots: int, budget: int) -> DataFrame:
    """e (uses of a key with bytes and version) with what a rolling quota says of each, by the uses of its key at strictly earlier times.

    used and volume within the span, remaining slots, next_slot (t, or the time of the last-but-(slots-1) use plus span if all slots are
    taken), projected bytes with all that is held, version_is_new, and allowed: all three hold. Null keys or times have no earlier uses.
    """
    windowed = context_agg(e, e, [key], t, [Win("w", -span, -1)], {"n": ("count", None), "v": ("sum", "bytes")})
    moments = e.where(F.col(key).isNotNull() & F.col(t).isNotNull()).groupBy(key, t).agg(F.count("*").alias("__n"), F.sum("bytes").alias("__bytes"), F.max("version").alias("__version"))
    past = so_far(moments, [key], t, {"__uses": "__n", "__held": "__bytes"}, {"__latest": "__version"}).drop("__bytes", "__version")
    numbered = past.select(key, F.col(t).alias("__at"), F.explode(F.sequence(F.col("__uses") + 1, F.col("__uses") + F.col("__n"))).alias("__no"))
    f = windowed.join(past, [key, t], "left").withColumn("used", F.coalesce("w_n", F.lit(0)))
    f = f.withColumn("__no", F.when(F.col("used") >= slots, F.col("__uses") - (slots - 1))).join(numbered, [key, "__no"], "left")
    projected = F.coalesce("__held", F.lit(0)) + F.col("bytes")
    new = F.col("version") > F.coalesce("__latest", F.lit(0))
    return f.select(
        *e.columns, "used", F.greatest(F.lit(slots) - F.col("used"), F.lit(0)).alias("remaining"), F.coalesce("w_v", F.lit(0)).alias("volume"),
        F.when(F.col("used") >= slots, F.col("__at") + span).otherwise(F.col(t)).alias(f"next_slot_{t}"), projected.alias("projected"), new.alias("version_is_new"),
        ((F.col("used") < slots) & (projected <= budget) & new).alias("allowed"),
    )
