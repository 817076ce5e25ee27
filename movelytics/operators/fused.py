"""Temporal context of several kinds in one pass over each key.

`context` takes range aggregates, intervals open at a time, events inside a query's own interval and nearest events
for the same key, and plans them over one union of queries and events, one exchange by (key, time bucket) and one sort.
`fuse` brings the passes over several keys together with one exchange by id. Times are BIGINT microseconds; in the
stream they are doubled, so that starts, queries and ends of one moment have an order.

No frame slides: every answer is a difference of running aggregates, which one growing frame keeps for all requests.
After the exchange each query row becomes one row for each bound that it asks for ([t + lo, t + hi] is what has come up
to t + hi less what had come before t + lo), so the cost is by row and not by the length of a window. Sums are kept in
whole millionths, so that differences are exact and no order of rows matters.

An event stands in each bucket whose queries can see it, an interval in the buckets of its start and end, with a carry
row at the beginning of each bucket that it enters. Buckets are four times as wide as the farthest look by default,
so that few events stand in two of them, and a hot key is still spread over its time span.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MILLION = 1_000_000


@dataclass(frozen=True)
class Mark:
    """A kind of event: rows of the event table that pass `when`, at the time `at`, with named values (SQL expressions, taken as doubles)."""

    at: str
    when: str = "true"
    values: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Over:
    """count, sum, avg or std (of the population) over a mark's events in [t + lo, t + hi]. Counts are 0 and the others null without events.

    With a value, events without it don't count. Values are rounded to millionths.
    """

    mark: str
    lo: int
    hi: int
    how: str = "count"
    value: str | None = None


@dataclass(frozen=True)
class Near:
    """Time (`{name}_t`) and values (`{name}_{value}`) of a mark's nearest event strictly before ("past") or after ("future").

    At most reach away, or with reach None however far, and then without values. Of events at one time the largest values count before, the smallest after.
    """

    mark: str
    side: str
    reach: int | None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Open:
    """Intervals of the events (start to end, columns; rows that pass `when`) that are open at the query's column `at` (None: t).

    start_inclusive: one that starts at that time counts; end_inclusive: one that ends at it still counts.
    """

    start: str
    end: str
    when: str = "true"
    at: str | None = None
    start_inclusive: bool = True
    end_inclusive: bool = False


@dataclass(frozen=True)
class Inside:
    """A mark's events strictly between the query's column `since` and t, for queries that pass `valid`, which must bound t - since by span."""

    mark: str
    since: str
    span: int
    valid: str = "true"


@dataclass(frozen=True)
class Part:
    """Rows of one pass, at most one an id with each of the structs of answers."""

    rows: DataFrame
    structs: dict[str, list[str]]


def _known(keys: list[Column], *more: Column) -> Column:
    out = F.lit(True)
    for c in (*keys, *more):
        out = out & c.isNotNull()
    return out


def _reach(marks: dict[str, Mark], asks: dict[str, object]) -> dict[str, tuple[int, int]]:
    """For each mark that is asked for, how far before and after a query its events count."""
    out: dict[str, tuple[int, int]] = {}
    for a in asks.values():
        if isinstance(a, Open):
            continue
        lo, hi = 0, 0
        if isinstance(a, Over):
            lo, hi = a.lo, a.hi
        elif isinstance(a, Near) and a.reach is not None:
            lo, hi = (-a.reach, 0) if a.side == "past" else (0, a.reach)
        elif isinstance(a, Inside):
            lo = -a.span
        known = out.get(a.mark, (0, 0))
        out[a.mark] = min(known[0], lo), max(known[1], hi)
    return out


@dataclass(frozen=True)
class Layout:
    """Where the stream keeps what: a bit of __m for each mark, a number in __s for each Open (its negative ends it), a double column for each value of a mark."""

    bits: dict[str, int]
    opens: dict[str, int]
    values: dict[tuple[str, str], str]

    @staticmethod
    def of(marks: dict[str, Mark], asks: dict[str, object]) -> Layout:
        names = sorted({a.mark for a in asks.values() if not isinstance(a, Open)})
        values: dict[tuple[str, str], str] = {}
        used: dict[str, int] = {}  # marks of one time share rows, so their values have columns of their own
        for m in names:
            for v in sorted({v for a in asks.values() if getattr(a, "mark", None) == m for v in ((a.value,) if isinstance(a, Over) and a.value else getattr(a, "values", ()))}):
                values[m, v] = f"__v{used.setdefault(marks[m].at, 0)}"
                used[marks[m].at] += 1
        return Layout({m: 1 << i for i, m in enumerate(names)}, {n: i + 1 for i, n in enumerate(n for n, a in asks.items() if isinstance(a, Open))}, values)

    def hit(self, mark: str) -> Column:
        return F.col("__m").bitwiseAND(F.lit(self.bits[mark])) != 0

    def value(self, mark: str, value: str | None) -> Column:
        """The value of a row of the mark in millionths (1 without one), null on other rows."""
        return F.when(self.hit(mark), F.round(F.col(self.values[mark, value]) * MILLION).cast("bigint") if value else F.lit(1))

    def step(self, name: str) -> Column:
        return F.when(F.col("__s") == self.opens[name], 1).when(F.col("__s") == -self.opens[name], -1)


def _stream(e: DataFrame, keys: dict[str, Column], marks: dict[str, Mark], asks: dict[str, object], reach: dict[str, tuple[int, int]], layout: Layout, width: int) -> DataFrame:
    """Events as rows of (keys, __b, __o, __m, __s, values), from one scan of e."""
    slots = sorted(set(layout.values.values()))

    def row(b, o, m, s, values):
        return F.struct(b.alias("__b"), o.alias("__o"), m.cast("bigint").alias("__m"), s.cast("int").alias("__s"), *[values.get(v, F.lit(None)).cast("double").alias(v) for v in slots])

    def placed(o, m, s, values):
        """A row in a bucket, at o or at the bucket's beginning."""
        return lambda b: row(b, b * (2 * width) if o is None else o, m, s, values)

    empty = F.array().cast(f"array<struct<__b:bigint,__o:bigint,__m:bigint,__s:int{''.join(f',{v}:double' for v in slots)}>>")
    made = []
    by_time: dict[str, list[str]] = {}
    for m in reach:
        by_time.setdefault(marks[m].at, []).append(m)
    for at, group in by_time.items():
        lo, hi = min(reach[m][0] for m in group), max(reach[m][1] for m in group)
        mask = F.expr(" + ".join(f"if({marks[m].when}, {layout.bits[m]}L, 0L)" for m in group))
        values = {slot: F.expr(marks[m].values[v]) for (m, v), slot in layout.values.items() if m in group}
        near = F.sequence(F.floor((F.col(at) - hi) / width).cast("long"), F.floor((F.col(at) - lo) / width).cast("long"))
        made.append(F.when((mask > 0) & F.col(at).isNotNull(), F.transform(near, placed(F.col(at) * 2, mask, F.lit(None), values))).otherwise(empty))
    bucket = lambda c: F.floor(c / (2 * width)).cast("long")
    for n, a in asks.items():
        if not isinstance(a, Open):
            continue
        s, f, no = F.col(a.start) * 2 + (0 if a.start_inclusive else 1), F.col(a.end) * 2 + (1 if a.end_inclusive else 0), layout.opens[n]
        sound = F.expr(a.when) & ((F.col(a.start) <= F.col(a.end)) if a.start_inclusive and a.end_inclusive else (F.col(a.start) < F.col(a.end)))
        carry = F.transform(F.when(bucket(f) > bucket(s), F.sequence(bucket(s) + 1, bucket(f))).otherwise(F.array().cast("array<bigint>")), placed(None, F.lit(0), F.lit(no), {}))
        ends = F.array(row(bucket(s), s, F.lit(0), F.lit(no), {}), row(bucket(f), f, F.lit(0), F.lit(-no), {}))
        made.append(F.when(sound, F.concat(ends, carry)).otherwise(empty))
    return e.where(_known(list(keys.values()))).select(*[c.alias(k) for k, c in keys.items()], F.inline(F.concat(*made)))


@dataclass
class Places:
    """Rows that a query needs: one for each bound (offset to doubled t, in t's bucket), and one for each other time it asks about."""

    t: str
    width: int
    offsets: dict[int, int] = field(default_factory=dict)
    others: dict[tuple[str, str | None], int] = field(default_factory=dict)

    def bound(self, offset: int) -> int:
        return self.offsets.setdefault(offset, len(self.offsets) + len(self.others))

    def other(self, column: str, valid: str | None) -> int:
        """At a column's time: in its own bucket, or, where `valid` bounds its distance, in t's bucket."""
        return self.others.setdefault((column, valid), len(self.offsets) + len(self.others))

    def buckets(self) -> Column:
        """The buckets (with the tags to be answered there) that a query row goes to before the exchange."""
        bucket = lambda c: F.floor(F.col(c) / self.width).cast("long")
        own = [F.struct(bucket(self.t).alias("__b"), F.lit(-1).alias("__at"))]
        far = [F.struct(bucket(c).alias("__b"), F.lit(tag).alias("__at")) for (c, valid), tag in self.others.items() if valid is None]
        return F.filter(F.array(*own, *far), lambda x: x["__b"].isNotNull())

    def rows(self) -> Column:
        """(__tag, __o) of a query row that has arrived (__at), or of an event itself (tag null)."""
        row = lambda tag, o: F.struct(F.lit(tag).cast("int").alias("__tag"), o.alias("__o"))
        near = [row(tag, F.col("__t") * 2 + d) for d, tag in self.offsets.items()]
        near += [row(tag, F.when(F.col(f"__q{tag}"), F.col(f"__c{tag}")) * 2) for (_, valid), tag in self.others.items() if valid is not None]
        out = F.when(F.col("__at").isNull(), F.array(row(None, F.col("__o"))))
        for (_, valid), tag in self.others.items():
            if valid is None:
                out = out.when(F.col("__at") == tag, F.array(row(tag, F.col(f"__c{tag}") * 2)))
        return out.otherwise(F.filter(F.array(*near).cast("array<struct<__tag:int,__o:bigint>>"), lambda x: x["__o"].isNotNull()))


def _queries(q: DataFrame, keys: dict[str, Column], id_col: str, places: Places) -> DataFrame:
    times = [F.col(c).alias(f"__c{tag}") for (c, _), tag in places.others.items()]
    sound = [F.coalesce(F.expr(valid), F.lit(False)).alias(f"__q{tag}") for (_, valid), tag in places.others.items() if valid is not None]
    return q.where(_known(list(keys.values()), F.col(places.t))).select(F.col(id_col).alias("__id"), F.col(places.t).alias("__t"), *[c.alias(k) for k, c in keys.items()], *times, *sound, F.inline(places.buckets()))


def _carried(stream: DataFrame, queries: DataFrame, keys: list[str], far: dict[str, Near], layout: Layout, width: int) -> DataFrame:
    """(keys, __b, __c_{name}): the extreme of the nearest earlier or later bucket with events of its own; a row per (key, bucket)."""
    own = F.floor(F.col("__o") / (2 * width)) == F.col("__b")
    ends = {n: (F.max if a.side == "past" else F.min)(F.when(layout.hit(a.mark) & own, F.col("__o"))) for n, a in far.items()}
    all_ = stream.unionByName(queries.select(*keys, "__b"), allowMissingColumns=True).groupBy(*keys, "__b").agg(*[c.alias(f"__e_{n}") for n, c in ends.items()])
    order = Window.partitionBy(*keys).orderBy("__b")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    return all_.select(*keys, "__b", *[(F.max if a.side == "past" else F.min)(f"__e_{n}").over(before if a.side == "past" else after).alias(f"__c_{n}") for n, a in far.items()])


def context(q: DataFrame, e: DataFrame, key: list[str], t: str, marks: dict[str, Mark], asks: dict[str, Over | Near | Open | Inside], id_col: str, width: int | None = None, parts: int | None = None) -> Part:
    """What asks says of each query row of q, by the events of e with the same key: one exchange, one sort (two with a look at the future).

    Rows of q with a null key or time have no row. Columns of the result are the asks' names (Near: see there).
    parts: how many partitions the stream is dealt out to (see `dealt`); without it, as many as Spark is set to.
    """
    reach = _reach(marks, asks)
    width = width or max([3_600_000_000, *[4 * max(-lo, hi) for lo, hi in reach.values()]])
    keys = {f"__k{i}": F.col(k) for i, k in enumerate(key)}
    layout, places = Layout.of(marks, asks), Places(t, width)
    stream = _stream(e, keys, marks, asks, reach, layout, width)
    run: dict[str, Column] = {}  # running aggregates, each kept once
    sums: dict[str, Column] = {}  # what a row adds to an id's sums
    picks: dict[str, Column] = {}
    answers: dict[str, Column] = {}
    elsewhere: dict[str, int] = {}  # answers at other times than t
    far = {n: a for n, a in asks.items() if isinstance(a, Near) and a.reach is None}
    by = Window.partitionBy(*keys, "__b")
    upto = by.orderBy("__o").rangeBetween(Window.unboundedPreceding, 0)
    back = by.orderBy(F.col("__o").desc()).rangeBetween(Window.unboundedPreceding, 0)
    tag, zero = F.col("__tag"), F.lit(0)

    def running(name: str, what: Column, frame=upto, blank: Column | None = None) -> str:
        made = what.over(frame)
        run.setdefault(name, made if blank is None else F.coalesce(made, blank))
        return name

    def between(name: str, of: str, lo: int, hi: int) -> str:
        """A sum column for what `of` gained between two tags."""
        sums.setdefault(name, F.when(tag == hi, F.col(of)).when(tag == lo, -F.col(of)))
        return name

    for n, a in asks.items():
        if isinstance(a, Over):
            lo, hi = places.bound(2 * a.lo - 1), places.bound(2 * a.hi)
            stem, span = f"{a.mark}_{a.value}", f"{lo}_{hi}"
            v = layout.value(a.mark, a.value)
            count = F.col(between(f"__n_{stem}_{span}", running(f"__rn_{stem}", F.count(v)), lo, hi))
            if a.how == "count":
                answers[n] = count
                continue
            total = F.col(between(f"__s_{stem}_{span}", running(f"__rs_{stem}", F.sum(v), blank=zero), lo, hi))
            if a.how == "std":
                wide = v.cast("decimal(19,0)")
                squares = F.col(between(f"__x_{stem}_{span}", running(f"__rx_{stem}", F.sum(wide * wide), blank=zero), lo, hi))
                # n * sum x^2 - (sum x)^2 is exact in whole numbers
                spread = count.cast("decimal(19,0)") * squares.cast("decimal(38,0)") - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")
                answers[n] = F.when(count > 0, F.sqrt(spread.cast("double")) / count / MILLION)
            else:
                answers[n] = F.when(count > 0, total / MILLION / (count if a.how == "avg" else F.lit(1.0)))
        elif isinstance(a, Near):
            past = a.side == "past"
            at = places.bound(-1 if past else 1)
            pick = (F.max if past else F.min)(F.when(layout.hit(a.mark), F.struct("__o", *[F.col(layout.values[a.mark, v]).alias(v) for v in a.values])))
            best = running(f"__near_{n}", pick, upto if past else back)
            o = F.col(f"{best}.__o")
            inside = F.lit(True) if a.reach is None else F.abs(o - 2 * F.col("__t")) <= 2 * a.reach
            o = F.coalesce(o, F.col(f"__c_{n}")) if a.reach is None else o
            picks[f"{n}_t"] = F.when((tag == at) & inside, F.shiftright(o, 1))
            for v in a.values:
                picks[f"{n}_{v}"] = F.when((tag == at) & inside, F.col(f"{best}.{v}"))
            answers |= {f"{n}_{v}": F.col(f"{n}_{v}") for v in ("t", *a.values)}
        elif isinstance(a, Open):
            at = places.bound(0) if a.at in (None, t) else places.other(a.at, None)
            open_ = running(f"__open_{n}", F.sum(layout.step(n)), blank=zero)
            picks[n] = F.when(tag == at, F.col(open_))
            answers[n] = F.col(n)
            elsewhere[n] = -1 if a.at in (None, t) else at
        else:
            since, until = places.other(a.since, a.valid), places.bound(-1)
            of = running(f"__rn_{a.mark}_None", F.count(layout.value(a.mark, None)))
            sums[n] = F.when(F.col(f"__q{since}") & (tag == until), F.col(of)).when(tag == since, -F.col(of))
            answers[n] = F.col(n)
    queries = _queries(q, keys, id_col, places)
    both = queries.unionByName(stream, allowMissingColumns=True).repartition(*([parts] if parts else []), *keys, "__b")
    rows = both.select(*[c for c in both.columns if c != "__o"], F.inline(places.rows())).withColumns(run).where(tag.isNotNull())
    if far:
        rows = rows.join(_carried(stream, queries, list(keys), far, layout, width), [*keys, "__b"], "left")
    # the rows of an id in a bucket are in one partition already; at other times an id has a row in a bucket of its own
    rows = rows.select(*keys, "__b", "__at", "__id", *[c.alias(n) for n, c in {**sums, **picks}.items()])
    one = rows.groupBy(*keys, "__b", "__at", "__id").agg(*[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in picks])
    structs, made = {}, []
    for at in (-1, *[tag_ for (_, valid), tag_ in places.others.items() if valid is None]):
        mine = [n for n in answers if elsewhere.get(n, -1) == at]
        if mine:
            name = f"{'_'.join(key)}_{len(structs)}"
            structs[name] = mine
            made.append(F.when(F.col("__at") == at, F.struct(*[answers[n].alias(n) for n in mine])).alias(name))
    return Part(one.select(F.col("__id").alias(id_col), *made), structs)


#: Events that a partition of a pass takes, about: with all bounds of its queries some tens of MB to sort.
EVENTS = 50_000


def dealt(events: DataFrame) -> int:
    """Partitions that hold about EVENTS of the events each, so that a task's memory doesn't grow with the table; at least as many as Spark is set to."""
    return max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // EVENTS))


def fuse(parts: list[Part], id_col: str, into: int | None = None) -> DataFrame:
    """One row an id with the answers of all parts: one exchange by id over the union of their rows, to `into` partitions if given."""
    names = [n for p in parts for ns in p.structs.values() for n in ns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns collide: {twice}")
    rows = parts[0].rows
    for p in parts[1:]:
        rows = rows.unionByName(p.rows, allowMissingColumns=True)
    if into:
        rows = rows.repartition(into, id_col)
    structs = {s: ns for p in parts for s, ns in p.structs.items()}
    one = rows.groupBy(id_col).agg(*[F.first(s, ignorenulls=True).alias(s) for s in structs])
    return one.select(id_col, *[F.col(f"{s}.{n}").alias(n) for s, ns in structs.items() for n in ns])
