"""Aggregations and audits: A01-A19, A21-A25, A36-A43, L01-L02."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.keys import seconds
from ..operators.evaluate import auc, centred_slope, error_shares, scores, top_shares
from ..operators.order import percentiles, running
from ..operators.quality import drift, quantiles, with_percentiles
from ..operators.context import quota
from ..operators.order import dense_codes
from .audits import shared
from .base import FLIGHTS_SQL, S, arrs, deps, moves, query, rounded, table

PX = "x as (select *, (t_us - aobt_us) / 1000000.0 as p, (t_us // 86400000000) % 4 as fold, t_us // 86400000000 as day from d)"


def _x(spark, sf):
    t = F.col("t_us")
    return deps(spark, sf).withColumns({"p": seconds(t, F.col("aobt_us")), "fold": F.pmod(clock.day_number(t), F.lit(4)), "day": clock.day_number(t)})


@query("a01_group_stats", "select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as double)) as double) as total from lineitem group by all")
def a01(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("total"))


@query("a02_coarsened", "{with} select airport, runway, ac_type, grouping(airport) * 4 + grouping(runway) * 2 + grouping(ac_type) as level, count(*) as n, round(avg(taxi_sec), 6) as mean from d group by rollup (airport, runway, ac_type)")
def a02(spark, sf):
    return rounded(deps(spark, sf).rollup("airport", "runway", "ac_type").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("taxi_sec").alias("mean")))


@query("a08_scores", "{with}, " + PX + " select airport, count(*) as n, round(sqrt(avg((p - taxi_sec) * (p - taxi_sec))), 4) as rmse, round(avg(abs(p - taxi_sec)), 4) as mae, round(avg(p - taxi_sec), 4) as bias from x where p is not null and taxi_sec is not null group by airport")
def a08(spark, sf):
    return rounded(scores(_x(spark, sf), "taxi_sec", "p", ["airport"]), 4)


@query("a09_grouping_sets", "{with}, " + PX + ", k as (select *, month(make_timestamp(t_us)) as month from x) select fold, airport, day, month, count(*) as n, round(avg((p - taxi_sec) * (p - taxi_sec)), 3) as mse from k where p is not null group by grouping sets ((fold), (fold, airport), (fold, day), (fold, airport, day), (fold, month))")
def a09(spark, sf):
    """Scores by several key sets in one pass."""
    f = F.col
    x = _x(spark, sf).where("p is not null").withColumn("month", F.month(F.date_from_unix_date(f("day").cast("int"))).cast("long"))
    sets = [[f("fold")], [f("fold"), f("airport")], [f("fold"), f("day")], [f("fold"), f("airport"), f("day")], [f("fold"), f("month")]]
    return x.groupingSets(sets, f("fold"), f("airport"), f("day"), f("month")).agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("taxi_sec"), 2)), 3).alias("mse"))


QS = [0.01, 0.05, 0.5, 0.95, 0.99, 0.999]


@query("a10_quantiles", "{with}, " + PX + " select airport, count(*) as n, round(avg((p is not null)::int), 6) as coverage, round(avg(p), 6) as mean, round(min(p), 6) as min, round(max(p), 6) as max, " + ", ".join(f"round(quantile_cont(p, {q}), 6) as q{i}" for i, q in enumerate(QS)) + " from x group by airport")
def a10(spark, sf):
    return rounded(quantiles(_x(spark, sf), "p", QS, ["airport"]))


_CLOCKS = ("aobt_us", "lobt_us", "iobt_us", "eobt_us", "sched_us", "planned_us", "flown_us")
_CODES = ("runway", "stand", "dest", "ac_type", "flight")
#: Ids as they arrive: numbers that may be null, broken or too large to be told apart as doubles.
_RAW_ID = "(case when mvt_id % 40 = 0 then null when mvt_id % 40 = 1 then mvt_id + 0.5e0 when mvt_id % 40 = 2 then 9007199254740994e0 + mvt_id else cast(mvt_id as double) end)"


@query(
    "a11_null_counts",
    "with {m}, fm as (" + FLIGHTS_SQL.replace("{d}", "m") + ") select phase, count(*) as n, "
    + ", ".join([*[f"count(*) filter ({c} is null) as no_{c.removesuffix('_us')}" for c in _CLOCKS], *[f"count(*) filter ({c} is null) as no_{c}" for c in _CODES]])
    + f", count(*) filter (flight_id is null) as no_flight_id, count(flight_id) - count(distinct flight_id) as repeated_flights, count(*) filter ({_RAW_ID} is null) as null_ids, count(*) filter ({_RAW_ID} <> floor({_RAW_ID})) as fractional_ids, count(*) filter (abs({_RAW_ID}) > 9007199254740992e0) as inexact_ids from fm group by phase",
)
def a11(spark, sf):
    """Missing clocks, categories and ids of each phase; ids that are null, fractional or beyond 2^53."""
    f = spark.sql(FLIGHTS_SQL, d=moves(spark, sf)).withColumn("raw", F.expr(_RAW_ID))
    raw = F.col("raw")
    return f.groupBy("phase").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c.removesuffix('_us')}") for c in (*_CLOCKS, *_CODES)],
        F.count_if(F.col("flight_id").isNull()).alias("no_flight_id"), (F.count("flight_id") - F.countDistinct("flight_id")).alias("repeated_flights"),
        F.count_if(raw.isNull()).alias("null_ids"), F.count_if(raw != F.floor(raw)).alias("fractional_ids"), F.count_if(F.abs(raw) > F.lit(float(1 << 53))).alias("inexact_ids"),
    )


@query("a12_profile", "{with}, " + PX + " select airport, fold, count(*) as n, count(p) as with_proxy, count(*) filter (p < 0) as negative, count(*) filter (p > 7200) as over, round(avg(p - taxi_sec), 4) as bias, count(*) filter (abs(p - taxi_sec) > 60) as off60, count(*) filter (abs(p - taxi_sec) > 300) as off300, count(*) filter (abs(p - taxi_sec) > 900) as off900 from x group by all")
def a12(spark, sf):
    gap = F.abs(F.col("p") - F.col("taxi_sec"))
    out = _x(spark, sf).groupBy("airport", "fold").agg(F.count("*").alias("n"), F.count("p").alias("with_proxy"), F.count_if(F.col("p") < 0).alias("negative"), F.count_if(F.col("p") > 7200).alias("over"), F.avg(F.col("p") - F.col("taxi_sec")).alias("bias"), *[F.count_if(gap > k).alias(f"off{k}") for k in (60, 300, 900)])
    return rounded(out, 4)


@query("a13_label_identity", "{with} select airport, count(*) as n, count(*) filter (abs((block_us - t_us) / 1000000.0 - taxi_sec) > 1) as off from a group by airport")
def a13(spark, sf):
    return arrs(spark, sf).groupBy("airport").agg(F.count("*").alias("n"), F.count_if(F.abs(seconds(F.col("block_us"), F.col("t_us")) - F.col("taxi_sec")) > 1).alias("off"))


@query(
    "a14_drift",
    "{with}, " + PX + """, o as (select * from x where fold >= 2), n as (select * from x where fold = 0),
 num as (select 'p' as c, airport, p as v, fold from x union all select 'taxi_sec', airport, taxi_sec, fold from x),
 nu as (select c, airport, avg((v is not null)::int) filter (fold = 0) - avg((v is not null)::int) filter (fold >= 2) as cd, median(v) filter (fold = 0) - median(v) filter (fold >= 2) as md, count(*) filter (fold = 0) as a, count(*) filter (fold >= 2) as b from num group by all),
 cat as (select n.airport, avg((n.flight not in (select flight from o where o.airport = n.airport))::int) as novel from n group by 1)
select airport, c as "column", round(cd, 6) + 0.0 as coverage_delta, round(md, 6) + 0.0 as median_delta, null::double as novel_rate from nu where a > 0 and b > 0
union all select cat.airport, 'flight', 0.0, null, round(novel, 6) from cat where airport in (select airport from o)""",
)
def a14(spark, sf):
    """Coverage and median changes, and the share of values never seen before in the airport."""
    x = _x(spark, sf)
    return rounded(drift(x.where("fold >= 2"), x.where("fold = 0"), "airport", ["p", "taxi_sec"], ["flight"]))


@query("a15_pooled", "{with}, " + PX + ", g as (select airport, count(*) as n, avg((p - taxi_sec) * (p - taxi_sec)) as mse from x where p is not null group by 1) select round(sqrt(sum(n * mse) / sum(n)), 4) as rmse, cast(sum(n) as bigint) as n from g")
def a15(spark, sf):
    g = scores(_x(spark, sf), "taxi_sec", "p", ["airport"])
    return rounded(g.agg(F.sqrt(F.sum(F.col("n") * F.pow("rmse", 2)) / F.sum("n")).alias("rmse"), F.sum("n").alias("n")), 4)


CLASSES = {"long": "taxi_sec > 900", "negative": "taxi_sec < 0", "proxy present": "aobt_us is not null", "proxy missing": "aobt_us is null", "proxy negative": "t_us < aobt_us"}


@query("a16_anomalies", "{with}, e as (" + " union all ".join(f"select '{n}' as class, airport, taxi_sec from d where {c}" for n, c in CLASSES.items()) + ") select class, airport, count(*) as n, min(taxi_sec) as lo, max(taxi_sec) as hi from e group by all")
def a16(spark, sf):
    flags = F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in CLASSES.items()]), lambda x: x.isNotNull())
    return deps(spark, sf).select("airport", "taxi_sec", F.explode(flags).alias("class")).groupBy("class", "airport").agg(F.count("*").alias("n"), F.min("taxi_sec").alias("lo"), F.max("taxi_sec").alias("hi"))


@query("a17_source_errors", "{with}, " + PX + ", l as (select 'aobt' as source, p as v, taxi_sec from x union all select 'lobt', (t_us - lobt_us) / 1000000.0, taxi_sec from x union all select 'sched', (t_us - sched_us) / 1000000.0, taxi_sec from x) select source, count(v) as available, round(median(abs(v - taxi_sec)), 4) as median_error, round(sqrt(avg((v - taxi_sec) * (v - taxi_sec))), 4) as rmse, count(*) filter (abs(v - taxi_sec) <= 60) as within60, count(*) filter (abs(v - taxi_sec) <= 300) as within300 from l group by source")
def a17(spark, sf):
    """Each clock as a source: availability and error."""
    t = F.col("t_us")
    wide = deps(spark, sf).select("taxi_sec", *[seconds(t, F.col(f"{c}_us")).alias(c) for c in ("aobt", "lobt", "sched")])
    e = F.abs(F.col("v") - F.col("taxi_sec"))
    long = wide.unpivot(["taxi_sec"], ["aobt", "lobt", "sched"], "source", "v").withColumn("error", e)
    out = long.groupBy("source").agg(F.count("v").alias("available"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count_if(e <= 60).alias("within60"), F.count_if(e <= 300).alias("within300"))
    return rounded(with_percentiles(out, long, "error", [0.5], ["source"]).withColumn("median_error", F.col("__q")[0]).drop("__q"), 4)


BANDS = [(-1e9, 0.0), (0.0, 1800.0), (1800.0, 3600.0), (3600.0, 7200.0), (7200.0, 1e9)]


@query("a18_bands", "{with}, s as (select (t_us - sched_us) / 1000000.0 as v, taxi_sec from d), b as (select * from (values " + ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(BANDS)) + ") t(band, lo, hi)) select band, count(*) as n, round(avg(taxi_sec), 6) as mean from s join b on v >= lo and v < hi group by band")
def a18(spark, sf):
    """Half-open bands."""
    v = seconds(F.col("t_us"), F.col("sched_us"))
    band = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(BANDS):
        band = F.when((v >= lo) & (v < hi), i).otherwise(band)
    return rounded(deps(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("taxi_sec").alias("mean")))


@query("a19_disagreement", "{with} select airport, count(*) filter (airport <> dest) as differs, count(*) filter (airport = dest) as same from m group by airport")
def a19(spark, sf):
    return moves(spark, sf).groupBy("airport").agg(F.count_if(F.col("airport") != F.col("dest")).alias("differs"), F.count_if(F.col("airport") == F.col("dest")).alias("same"))


@query("a21_crosstab", "{with} select airport, count(*) filter (ac_type = 'T0') as T0, count(*) filter (ac_type = 'T1') as T1, count(*) filter (ac_type = 'T2') as T2, count(*) filter (ac_type = 'T3') as T3 from d group by airport")
def a21(spark, sf):
    return deps(spark, sf).groupBy("airport").pivot("ac_type", ["T0", "T1", "T2", "T3"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a22_error_shares", "{with}, " + PX + ", c as (select airport, fold, count(*) as n, sum((p - taxi_sec) * (p - taxi_sec)) as s from x where p is not null group by all) select airport, fold, n, round(s / sum(s) over (), 6) as share from c")
def a22(spark, sf):
    return rounded(error_shares(_x(spark, sf).where("p is not null"), "taxi_sec", "p", ["airport", "fold"]))


TOPS = (1, 2, 10, 100, 1000)


@query(
    "a22_top_shares",
    "{with}, " + PX + ", r as (select (p - taxi_sec) * (p - taxi_sec) as s, row_number() over (order by abs(p - taxi_sec) desc, mvt_id) as k from x where p is not null), "
    + f"g as (select unnest({list(TOPS)}) as rows, unnest({[str(k) for k in TOPS]}) as top union all select greatest(1, (count(*) + 99) // 100), '1%' from r)"
    + " select top, rows, round(sum(s) filter (k <= rows) / sum(s), 6) as share from r, g group by all",
)
def a22_top(spark, sf):
    """Share of the squared error in the largest 1, 2, 10, 100, 1000 rows and in the largest hundredth."""
    x = _x(spark, sf).where("p is not null").select(F.pow(F.col("p") - F.col("taxi_sec"), 2).alias("s"))
    return rounded(top_shares(x, "s", TOPS))


@query("a23_correlations", "{with}, " + PX + " select fold, count(*) as n, round(corr(p, taxi_sec), 6) as r, round(quantile_cont(abs(p - taxi_sec), 0.5), 4) as median, round(quantile_cont(abs(p - taxi_sec), 0.95), 4) as p95, round(avg(p * taxi_sec), 3) as product from x where p is not null group by fold")
def a23(spark, sf):
    x = _x(spark, sf).where("p is not null").withColumn("error", F.abs(F.col("p") - F.col("taxi_sec")))
    out = x.groupBy("fold").agg(F.count("*").alias("n"), F.corr("p", "taxi_sec").alias("r"), F.round(F.avg(F.col("p") * F.col("taxi_sec")), 3).alias("product"))
    return rounded(with_percentiles(out, x, "error", [0.5, 0.95], ["fold"]).withColumns({"median": F.round(F.col("__q")[0], 4), "p95": F.round(F.col("__q")[1], 4)}).drop("__q"))


@query("a23_binned_residuals", "{with}, " + PX + ", b as (select *, cast(floor(p / 300) as bigint) as bin, taxi_sec - p as r from x where p is not null) select bin, count(*) as n, round(avg(r), 4) as mean, round(quantile_cont(r, 0.5), 4) as median, round(sqrt(avg(r * r)), 4) as rmse from b group by bin")
def a23b(spark, sf):
    """What the proxy leaves, by bins of five minutes of the proxy."""
    x = _x(spark, sf).where("p is not null").select(F.floor(F.col("p") / 300).alias("bin"), (F.col("taxi_sec") - F.col("p")).alias("r"))
    out = x.groupBy("bin").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"))
    return rounded(with_percentiles(out, x, "r", [0.5], ["bin"]).withColumn("median", F.col("__q")[0]).drop("__q"), 4)


@query("a24_centred_slope", "{with}, " + PX + ", s as (select *, avg(p) over w as mp, avg(taxi_sec) over w as mt, count(*) over w as n from x where p is not null window w as (partition by airport, ac_type)) select round(sum((p - mp) * (taxi_sec - mt)) / sum((p - mp) * (p - mp)), 6) as slope, count(*) as n from s where n >= 20")
def a24(spark, sf):
    return rounded(centred_slope(_x(spark, sf).where("p is not null"), "p", "taxi_sec", ["airport", "ac_type"]))


@query("a36_robust_scale", "{with}, " + PX + ", f as (select quantile_cont(p, 0.25) as a, quantile_cont(p, 0.5) as b, quantile_cont(p, 0.75) as c from x where fold >= 2) select mvt_id, case when p is null then -11.0 else round(greatest(least((p - b) / greatest(c - a, 1.0), 10.0), -10.0), 6) + 0.0 end as z from x, f")
def a36(spark, sf):
    """Median and quartile scaling learned on the fit folds; clipped, and a code for missing values."""
    x = _x(spark, sf)
    f = percentiles(x.where("fold >= 2"), [], "p", [0.25, 0.5, 0.75], "q")
    z = (F.col("p") - F.col("q")[1]) / F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1.0))
    return rounded(x.join(F.broadcast(f), F.lit(True), "left").select("mvt_id", F.when(F.col("p").isNull(), F.lit(-11.0)).otherwise(F.greatest(F.least(z, F.lit(10.0)), F.lit(-10.0))).alias("z")))


@query("a37_vocabulary_codes", "{with}, v as (select flight, row_number() over (order by count(*) desc, flight) as k from d where mvt_id % 2 = 0 group by flight) select mvt_id, cast(case when d.flight is null then 0 when v.flight is null or k > 20 then 1 else k + 1 end as int) as code from d left join v using (flight)")
def a37(spark, sf):
    """Codes by descending frequency in the fit rows: 0 missing, 1 unseen, then ranks; the top 20 are the vocabulary."""
    d = deps(spark, sf)
    top = d.where("mvt_id % 2 = 0").groupBy("flight").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flight").limit(20)
    codes = top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "flight"))).select("flight", "k")
    return d.join(F.broadcast(codes), "flight", "left").select("mvt_id", F.when(F.col("flight").isNull(), 0).when(F.col("k").isNull(), 1).otherwise(F.col("k") + 1).alias("code"))


@query("a38_classifier_scores", "{with}, " + PX + ", s as (select case when taxi_sec > 300 then 1 else 0 end as y, least(greatest(p / 1000.0, 0.001), 0.999) as q from x where p is not null), r as (select *, rank() over (order by q) + (count(*) over (partition by q) - 1) / 2.0 as k from s) select round(avg(y), 6) as exact_rate, round(avg((q - y) * (q - y)), 6) as brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as log_loss, round((sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) as auc from r")
def a38(spark, sf):
    q = F.least(F.greatest(F.col("p") / 1000.0, F.lit(0.001)), F.lit(0.999))
    s = _x(spark, sf).where("p is not null").select((F.col("taxi_sec") > 300).cast("int").alias("y"), q.alias("q"))
    y = F.col("y")
    loss = s.agg(F.avg(y).alias("exact_rate"), F.avg(F.pow(F.col("q") - y, 2)).alias("brier"), F.avg(-(y * F.ln("q") + (1 - y) * F.ln(1 - F.col("q")))).alias("log_loss"))
    return rounded(loss.crossJoin(auc(s, "y", "q")))


@query("a40_duplicates", "{with} select count(*) as n, count(distinct mvt_id) as ids, count(*) - count(distinct (airport, t_us)) as repeated_times from m")
def a40(spark, sf):
    return moves(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("mvt_id").alias("ids"), (F.count("*") - F.countDistinct("airport", "t_us")).alias("repeated_times"))


@query("a42_cells", "{with}, c as (select cast(floor((t_us - lobt_us) / 600000000.0) as bigint) as cell, taxi_sec, (t_us - aobt_us) / 1000000.0 as p from d where (t_us - sched_us) / 1000000.0 between 0 and 3600) select cell, count(*) as n, round(avg(taxi_sec), 4) as mean, round(avg(p - taxi_sec), 4) as error, round(avg((taxi_sec > 600)::int), 6) as long_rate from c where cell is not null group by cell having count(*) >= 10")
def a42(spark, sf):
    """Cells of one gap within a band of another, those with ten rows or more."""
    t = F.col("t_us")
    d = deps(spark, sf).where(seconds(t, F.col("sched_us")).between(0, 3600) & F.col("lobt_us").isNotNull())
    c = d.select(F.floor((t - F.col("lobt_us")) / 600_000_000.0).alias("cell"), "taxi_sec", seconds(t, F.col("aobt_us")).alias("p"))
    out = c.groupBy("cell").agg(F.count("*").alias("n"), F.round(F.avg("taxi_sec"), 4).alias("mean"), F.round(F.avg(F.col("p") - F.col("taxi_sec")), 4).alias("error"), F.avg((F.col("taxi_sec") > 600).cast("int")).alias("long_rate"))
    return rounded(out.where("n >= 10"))


@query("a43_group_codes", "{with}, v as (select flight, dense_rank() over (order by flight) - 1 as code from (select distinct flight from d where mvt_id % 2 = 0)) select mvt_id, coalesce(code, -1) as code from d left join v using (flight)")
def a43(spark, sf):
    """Dense codes of the groups of one table, applied to another; unseen groups are -1."""
    d = deps(spark, sf)
    groups = dense_codes(d.where("mvt_id % 2 = 0").select("flight").distinct(), "flight", "code", shared(spark, "codes"))
    return d.join(groups, "flight", "left").select("mvt_id", F.coalesce("code", F.lit(-1)).alias("code"))


QUOTA, BUDGET = 5, 40_000_000
L01 = f"""with q as materialized (select event_id, user_id, epoch_us(ts) as us, cast(round(value * 1000) as bigint) as bytes, event_id % 40 + 1 as version from events),
r as (select q.event_id, q.us, q.bytes, q.version, count(e.us) filter (e.us >= q.us - 86400000000) as used, coalesce(sum(e.bytes) filter (e.us >= q.us - 86400000000), 0) as volume, coalesce(sum(e.bytes), 0) as held, coalesce(max(e.version), 0) as latest,
  list(e.us order by e.us desc) filter (e.us is not null) as times from q left join q e on e.user_id = q.user_id and e.us < q.us group by all)
select event_id, used, greatest({QUOTA} - used, 0) as remaining, cast(volume as bigint) as volume, case when used >= {QUOTA} then times[{QUOTA}] + 86400000000 else us end as next_slot_us, cast(held + bytes as bigint) as projected, version > latest as version_is_new,
  used < {QUOTA} and held + bytes <= {BUDGET} and version > latest as allowed from r"""


@query("l01_rolling_quota", L01)
def l01(spark, sf):
    """Uses of a key in the last 24 hours, what is left of a quota, when the next slot is free, the size with all held before, and whether the version is new.

    The derived sizes and versions of a use come from its value and id. The fifth-latest use is found by its number in the key's order.
    """
    e = table(spark, sf, "events").select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), F.round(F.col("value") * 1000).cast("long").alias("bytes"), (F.col("event_id") % 40 + 1).alias("version"))
    return quota(e, "user_id", "us", 86_400 * S, QUOTA, BUDGET).select("event_id", "used", "remaining", "volume", "next_slot_us", "projected", "version_is_new", "allowed")


@query("l02_leader_position", "with b as (select user_id, min(value) as best from events group by user_id) select user_id, best, 1 + (select count(*) from b o where o.best < b.best) as position from b")
def l02(spark, sf):
    """Position by best score: one more than the keys with a lower one."""
    b = table(spark, sf, "events").groupBy("user_id").agg(F.min("value").alias("best"))
    ranks = running(b.groupBy("best").agg(F.count("*").alias("n")), [], "best", [], F.col("n"), "before").withColumn("position", F.col("before") + 1)
    return b.join(ranks, "best").select("user_id", "best", "position")
