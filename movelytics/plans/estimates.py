"""Group estimates, blends, bootstrap, gates and policies: A03-A05, A25-A35, A39, O01-O12, F01-F07."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..functions.keys import clipped, seconds, valid_proxy
from ..operators.context import Win, context_agg
from ..operators.estimates import Policy, best_expert, blend_weight, compose, error_products, moments, shrink_ladder, simplex, simplex_weights, square
from ..operators.evaluate import best_weight, day_bootstrap, interval, paired_bootstrap, scores, weight_grid
from ..operators.quality import with_percentiles
from .base import MIN, S, arrs, deps, query, rounded

#: Departures with a proxy, two estimates and a fold: `e`.
E = """e as materialized (select mvt_id, airport, runway, dest, ac_type, t_us, aobt_us, lobt_us, sched_us, taxi_sec as y, (t_us - aobt_us) / 1000000.0 as p, (t_us - sched_us) / 1000000.0 as s, (t_us - lobt_us) / 1000000.0 as l,
 coalesce((t_us - aobt_us) / 1000000.0, 200.0) as old, coalesce((t_us - aobt_us) / 1000000.0, 200.0) * 0.9 + 10.0 as new, (t_us // 86400000000) as day, (t_us // 86400000000) % 4 as fold from d)"""


def est(spark, sf):
    t = F.col("t_us")
    d = deps(spark, sf).withColumns({"y": F.col("taxi_sec"), "p": seconds(t, F.col("aobt_us")), "s": seconds(t, F.col("sched_us")), "l": seconds(t, F.col("lobt_us")), "day": clock.day_number(t)})
    old = F.coalesce("p", F.lit(200.0))
    return d.withColumns({"old": old, "new": old * 0.9 + 10.0, "fold": F.pmod("day", F.lit(4))})


LADDER = """tr as (select * from e where fold >= 2 and y between 0 and 7200), g0 as (select avg(y) as v from tr), s1 as (select airport, count(y) as n, sum(y) as s from tr group by 1), s2 as (select airport, runway, count(y) as n, sum(y) as s from tr group by 1, 2), s3 as (select airport, runway, ac_type, count(y) as n, sum(y) as s from tr group by 1, 2, 3),
sh as (select e.*, case when c.n is null then v2 else (c.s + 30 * v2) / (c.n + 30) end as v3 from (select e.*, case when b.n is null then v1 else (b.s + 20 * v1) / (b.n + 20) end as v2 from (select e.*, case when a1.n is null then g0.v else (a1.s + 100 * g0.v) / (a1.n + 100) end as v1 from e cross join g0 left join s1 a1 on e.airport = a1.airport) e left join s2 b on e.airport = b.airport and e.runway = b.runway) e left join s3 c on e.airport = c.airport and e.runway = c.runway and e.ac_type = c.ac_type)"""


def _shrunk(spark, sf):
    e = est(spark, sf)
    train = e.where("fold >= 2 and y between 0 and 7200")
    return shrink_ladder(train, e, [["airport"], ["airport", "runway"], ["airport", "runway", "ac_type"]], [100.0, 20.0, 30.0], "y", "estimate")


@query("a03_shrinkage", "{with}, " + E + ", " + LADDER + " select mvt_id, round(greatest(v3, 0), 6) as estimate from sh")
def a03(spark, sf):
    """Hierarchical estimate, airport to runway to type, learned on the fit folds."""
    return rounded(_shrunk(spark, sf).select("mvt_id", "estimate"))


@query("a03_scored", "{with}, " + E + ", " + LADDER + " select fold, count(*) as n, round(sqrt(avg((greatest(v3, 0) - y) * (greatest(v3, 0) - y))), 4) as rmse, round(avg(abs(greatest(v3, 0) - y)), 4) as mae, round(avg(greatest(v3, 0) - y), 4) as bias from sh where fold < 2 group by fold")
def a03_scored(spark, sf):
    return rounded(scores(_shrunk(spark, sf).where("fold < 2"), "y", "estimate", ["fold"]), 4)


@query("a04_route_evidence", "{with}, " + E + " select airport, dest, count(*) as n, round(avg((abs(s - y) <= 60)::int), 6) as match_rate, round(median(y - s), 4) as median_residual from e where fold >= 2 and s > 3600 group by all")
def a04(spark, sf):
    e = est(spark, sf).where("fold >= 2 and s > 3600")
    e = e.withColumn("residual", F.col("y") - F.col("s"))
    out = e.groupBy("airport", "dest").agg(F.count("*").alias("n"), F.avg((F.abs(F.col("s") - F.col("y")) <= 60).cast("int")).alias("match_rate"))
    return rounded(with_percentiles(out, e, "residual", [0.5], ["airport", "dest"]).withColumn("median_residual", F.round(F.col("__q")[0], 4)).drop("__q"))


@query("a05_analogs", "{with}, " + E + " select airport, ac_type, count(*) as n, round(avg(y), 6) as target, round(avg(y - old), 6) as residual, round(avg(s), 6) as schedule, round(avg((y > 600)::int), 6) as long_rate from e where fold not in (0, 1) group by all")
def a05(spark, sf):
    e = est(spark, sf).where("fold not in (0, 1)")
    return rounded(e.groupBy("airport", "ac_type").agg(F.count("*").alias("n"), F.avg("y").alias("target"), F.avg(F.col("y") - F.col("old")).alias("residual"), F.avg("s").alias("schedule"), F.avg((F.col("y") > 600).cast("int")).alias("long_rate")))


REPLICATES = 1000
BOOT = """ds as (select day, count(*) as n, sum((old - y) * (old - y)) as so, sum((new - y) * (new - y)) as sn, row_number() over (order by day) - 1 as i from e group by day), nd as (select count(*) as days from ds),
dr as (select r, ((r*7919 + s*104729 + r*s*31 + 12345) % 1000003) % days as i from nd, range({REPLICATES}) a(r), range(days) b(s)), gn as (select r, sqrt(sum(so) / sum(n)) - sqrt(sum(sn) / sum(n)) as gain from dr join ds using (i) group by r)""".replace("{REPLICATES}", str(REPLICATES))


@query("a26_bootstrap", "{with}, " + E + ", " + BOOT + " select round(quantile_cont(gain, 0.025), 5) as lo, round(quantile_cont(gain, 0.5), 5) as mid, round(quantile_cont(gain, 0.975), 5) as hi, round(avg((gain > 0)::int), 5) as positive, count(*) as replicates from gn")
def a26(spark, sf):
    """Paired day bootstrap of the RMSE gain of one estimate over another."""
    return rounded(interval(paired_bootstrap(est(spark, sf), "y", "old", "new", F.col("day"), REPLICATES)), 5)


MONTHS = """ds as (select month(make_timestamp(day * 86400000000)) as m, day, count(*) as n, sum((old - y) * (old - y)) as so, sum((new - y) * (new - y)) as sn, row_number() over (partition by month(make_timestamp(day * 86400000000)) order by day) - 1 as i from e group by day), nd as (select m, count(*) as days from ds group by m),
dr as (select r, m, ((r*7919 + s*104729 + r*s*31 + 12345 + m*611953) % 1000003) % days as i from nd, range({REPLICATES}) a(r), range(days) b(s)), gn as (select r, sqrt(sum(so) / sum(n)) - sqrt(sum(sn) / sum(n)) as gain from dr join ds using (m, i) group by r)""".replace("{REPLICATES}", str(REPLICATES))


@query("a26_month_bootstrap", "{with}, " + E + ", " + MONTHS + " select round(quantile_cont(gain, 0.025), 5) as lo, round(quantile_cont(gain, 0.5), 5) as mid, round(quantile_cont(gain, 0.975), 5) as hi, round(avg((gain > 0)::int), 5) as positive, count(*) as replicates from gn")
def a26_month(spark, sf):
    """The paired day bootstrap with days drawn within each calendar month."""
    e = est(spark, sf).withColumn("month", F.month(F.date_from_unix_date(F.col("day").cast("int"))).cast("long"))
    return rounded(interval(paired_bootstrap(e, "y", "old", "new", F.col("day"), REPLICATES, "month")), 5)


@query("a27_blend_weights", "{with}, " + E + " select airport, count(*) as n, round(greatest(0, least(1, coalesce(sum((s - old) * (y - old)) / nullif(sum((s - old) * (s - old)), 0), 0))), 6) as weight from e where fold >= 2 group by airport")
def a27(spark, sf):
    return rounded(blend_weight(est(spark, sf).where("fold >= 2"), "y", "old", "s", ["airport"]))


@query("a28_moments", "{with}, " + E + " select airport, count(*) as n, round(avg(old * old), 2) as g_0_0, round(avg(old * s), 2) as g_0_1, round(avg(s * s), 2) as g_1_1, round(avg(old * y), 2) as b_0, round(avg(s * y), 2) as b_1 from e group by airport")
def a28(spark, sf):
    """Gram and cross moments, from which simplex weights are solved."""
    return rounded(moments(est(spark, sf), ["old", "s"], "y", ["airport"]), 2)


def simplex_sql(src: str, keys: str) -> str:
    """w0, w1, w2 of three experts from sums g00..g22 of products of errors: the inner solution if it is one, else the best of the edges."""
    edge = lambda i, j: f"greatest(0, least(1, coalesce((g{j}{j} - g{i}{j}) / nullif(g{i}{i} + g{j}{j} - 2 * g{i}{j}, 0), 1)))"
    cost = "{a} * {a} * g{i}{i} + 2 * {a} * (1 - {a}) * g{i}{j} + (1 - {a}) * (1 - {a}) * g{j}{j}"
    at = {(0, 1): "[a01, 1 - a01, 0]", (0, 2): "[a02, 0, 1 - a02]", (1, 2): "[0, a12, 1 - a12]"}
    x0 = "(g11 * g22 - g12 * g12) - (g01 * g22 - g12 * g02) + (g01 * g12 - g11 * g02)"
    x1 = "(g00 * g22 - g02 * g02) - (g01 * g22 - g02 * g12) - (g00 * g12 - g01 * g02)"
    x2 = "(g01 * g12 - g02 * g11) - (g00 * g12 - g01 * g02) + (g00 * g11 - g01 * g01)"
    inner = f"select *, {x0} as x0, {x1} as x1, {x2} as x2, {', '.join(f'{edge(i, j)} as a{i}{j}' for i, j in at)} from {src}"
    edges = ", ".join(f"struct_pack(cost := {cost.format(a=f'a{i}{j}', i=i, j=j)}, w := {w})" for (i, j), w in at.items())
    best = f"select *, case when least(x0, x1, x2) >= 0 and x0 + x1 + x2 > 0 then [x0 / (x0 + x1 + x2), x1 / (x0 + x1 + x2), x2 / (x0 + x1 + x2)] else list_sort([{edges}])[1].w end as w from ({inner})"
    return f"select {keys}, w[1] as w0, w[2] as w1, w[3] as w2 from ({best})"


_ERR = "(select *, old - y as e0, new - y as e1, s - y as e2 from e where old is not null and new is not null and s is not null and y is not null)"
_PAIRS = ("00", "01", "02", "11", "12", "22")
_G = ", ".join(f"sum(e{i} * e{j}) as g{i}{j}" for i, j in _PAIRS)
CONVEX = "ga as (select airport, count(*) as n, " + _G + " from " + _ERR + " group by airport), ws as (" + simplex_sql("ga", "airport, n") + ")"


@query("a28_simplex_weights", "{with}, " + E + ", " + CONVEX + " select airport, n, round(w0, 5) + 0e0 as w_0, round(w1, 5) + 0e0 as w_1, round(w2, 5) + 0e0 as w_2 from ws")
def a28_weights(spark, sf):
    """Convex weights of three experts for each airport, solved within the aggregation's own rows."""
    g = error_products(est(spark, sf), ["old", "new", "s"], "y", ["airport"]).select("airport", "n", simplex_weights("g", 3).alias("w"))
    return rounded(g.select("airport", "n", *[F.col("w")[i].alias(f"w_{i}") for i in range(3)]), 5)


@query(
    "a29_airport_simplex",
    "{with}, " + E + ", " + CONVEX + ", gt as (select " + _G + " from " + _ERR + "), wt as (" + simplex_sql("gt", "0 as k") + ") select ws.airport, n, "
    + ", ".join(f"round((n * ws.w{i} + 500 * wt.w{i}) / (n + 500), 7) + 0e0 as w_{i}" for i in range(3)) + " from ws, wt",
)
def a29(spark, sf):
    """Simplex weights per airport, shrunk to the overall ones."""
    return rounded(simplex(est(spark, sf), ["old", "new", "s"], "y", "airport", 500.0), 7)


@query("a30_best_expert", "{with}, " + E + ", l as (select airport, y, unnest(['old', 'new', 's']) as expert, unnest([0, 1, 2]) as k, unnest([old, new, s]) as v from e), t as (select expert, avg((v - y) * (v - y)) as top from l group by 1), r as (select airport, expert, k, (sum((v - y) * (v - y)) + 50 * any_value(top)) / (count(*) + 50) as risk from l join t using (expert) group by all) select airport, arg_min(expert, (risk, k)) as expert from r group by airport")
def a30(spark, sf):
    return best_expert(est(spark, sf), ["old", "new", "s"], "y", "airport", 50.0)


GRID = [0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0]


@query("a31_weight_grid", "{with}, " + E + ", g as (select unnest(" + str(GRID) + ") as weight) select fold, weight, round(sqrt(avg(pow(greatest(old + weight * (s - old), 0) - y, 2))), 4) as rmse from e, g group by all")
def a31(spark, sf):
    """Score of every blend weight in one pass."""
    return rounded(weight_grid(est(spark, sf), "y", "old", "s", GRID, ["fold"]), 4)


@query("a31_best_weight", "{with}, " + E + ", g as (select unnest(" + str(GRID) + ") as weight), r as (select fold, weight, sqrt(avg(pow(greatest(old + weight * (s - old), 0) - y, 2))) as rmse from e, g group by all) select fold, arg_min(weight, (rmse, weight)) as weight, round(min(rmse), 4) as rmse from r group by fold")
def a31_best(spark, sf):
    return rounded(best_weight(weight_grid(est(spark, sf), "y", "old", "s", GRID, ["fold"]), ["fold"]), 4)


A32 = """, gap as (select case when fold = 1 then -1 else mvt_id % 5 end as part, (mvt_id // 5) % 3 as inner_fold, airport, s - old as d, y - old as r, old - y as e0, new - y as e1, s - y as e2 from e where s is not null and old is not null and y is not null and airport is not null),
cells as (select part, inner_fold, airport, count(*) as n, sum(d * r) as dr, sum(d * d) as dd, sum(r * r) as rr, {G} from gap group by all),
splits as (select unnest([-1, 0, 1, 2, 3, 4]) as outer_fold), holds as (select unnest([-1, 0, 1, 2]) as hold),
tr as (select outer_fold, hold, airport, sum(n) as n, sum(dr) as dr, sum(dd) as dd, {S} from splits, holds, cells where part >= 0 and part <> outer_fold and inner_fold <> hold group by all),
gl as (select outer_fold, hold, greatest(least(coalesce(sum(dr) / nullif(sum(dd), 0), 0), 1), 0) as wg from tr group by all),
te as (select outer_fold, hold, airport, n, dr, dd, rr, {N} from splits, holds, cells where case when hold < 0 then part = outer_fold else part >= 0 and part <> outer_fold and inner_fold = hold end),
ct as (select outer_fold, hold, {S} from tr group by all), cw as ({CW}),
cand as (select unnest(['base', 'global', 'airport_0', 'airport_20', 'airport_50']) as candidate, unnest([0, 1, 2, 3, 4]) as k, unnest([null, null, 0.0::double, 20.0::double, 50.0::double]) as strength),
w as (select te.outer_fold, te.hold, candidate, k, te.n, te.dr, te.dd, te.rr, case when k = 0 then 0 when k = 1 or tr.n is null then wg else (tr.n * greatest(least(coalesce(tr.dr / nullif(tr.dd, 0), 0), 1), 0) + strength * wg) / (tr.n + strength) end as v from te join gl using (outer_fold, hold) left join tr on tr.outer_fold = te.outer_fold and tr.hold = te.hold and tr.airport = te.airport cross join cand),
sc as (select outer_fold, hold < 0 as held, candidate, k, sum(n) as n, sqrt(greatest(sum(rr - 2 * v * dr + v * v * dd), 0) / sum(n)) as rmse from w group by all
 union all select te.outer_fold, te.hold < 0, 'convex', 5, sum(te.n), sqrt(greatest(sum(w0 * w0 * g00 + w1 * w1 * g11 + w2 * w2 * g22 + 2 * (w0 * w1 * g01 + w0 * w2 * g02 + w1 * w2 * g12)), 0) / sum(te.n)) from te join cw using (outer_fold, hold) group by all),
best as (select outer_fold, arg_min(struct_pack(candidate := candidate, k := k), (round(rmse, 6), k)) as c, min(round(rmse, 6)) as inner_rmse from sc where not held group by 1)
select outer_fold, c.candidate as chosen, round(inner_rmse, 4) as inner_rmse, round(sc.rmse, 4) as held_rmse, cast(sc.n as bigint) as n_held from best join sc using (outer_fold) where held and sc.k = c.k"""
A32 = A32.replace("{G}", _G).replace("{S}", ", ".join(f"sum(g{p}) as g{p}" for p in _PAIRS)).replace("{N}", ", ".join(f"g{p}" for p in _PAIRS)).replace("{CW}", simplex_sql("ct", "outer_fold, hold"))


@query("a32_nested_cv", "{with}, " + E + A32)
def a32(spark, sf):
    """Nested folds by id over blend weights: none, one for all, one for an airport drawn to that for all by three strengths, and the convex mix of three experts.

    For each outer fold the candidate with the least pooled error over three inner folds, each fitted on the other two, is fitted anew on all
    that is not held out and scored on the outer fold; outer_fold -1 is the transfer of the choice on all folds to the forward fold. Fits
    and errors are sums of one table of cells. An airport that a fit has not seen takes the weight for all.
    """
    e = est(spark, sf).dropna(subset=["s", "old", "y", "airport"])
    err = [F.col(x) - F.col("y") for x in ("old", "new", "s")]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    g = [f"g{i}{j}" for i, j in pairs]
    d, r = F.col("s") - F.col("old"), F.col("y") - F.col("old")
    part = F.when(F.col("fold") == 1, F.lit(-1).cast("long")).otherwise(F.col("mvt_id") % 5)
    cells = e.groupBy(part.alias("part"), F.expr("mvt_id div 5 % 3").alias("inner_fold"), "airport").agg(F.count("*").alias("n"), F.sum(d * r).alias("dr"), F.sum(d * d).alias("dd"), F.sum(r * r).alias("rr"), *[F.sum(err[i] * err[j]).alias(f"g{i}{j}") for i, j in pairs])
    cells = cells.select("*", F.explode(F.array(*[F.lit(x) for x in range(-1, 5)])).alias("outer_fold")).select("*", F.explode(F.array(*[F.lit(x) for x in range(-1, 3)])).alias("hold"))
    at = ["outer_fold", "hold"]
    fitted = (F.col("part") >= 0) & (F.col("part") != F.col("outer_fold"))
    held = F.when(F.col("hold") < 0, F.col("part") == F.col("outer_fold")).otherwise(fitted & (F.col("inner_fold") == F.col("hold")))
    weight = lambda dr, dd: clipped(F.coalesce(dr / F.nullif(dd, F.lit(0.0)), F.lit(0.0)), 0.0, 1.0)
    train = cells.where(fitted & (F.col("inner_fold") != F.col("hold"))).groupBy(*at, "airport").agg(F.sum("n").alias("n_fit"), F.sum("dr").alias("dr_fit"), F.sum("dd").alias("dd_fit"), *[F.sum(c).alias(f"{c}_fit") for c in g])
    overall = train.groupBy(*at).agg(weight(F.sum("dr_fit"), F.sum("dd_fit")).alias("wg"), square([[F.sum(f"g{min(i, j)}{max(i, j)}_fit") for j in range(3)] for i in range(3)]).alias("gram")).select(*at, "wg", simplex_weights("gram", 3).alias("w"))
    test = cells.where(held).select(*at, "airport", "n", "dr", "dd", "rr", *g).join(overall, at).join(train, [*at, "airport"], "left")
    own = weight(F.col("dr_fit"), F.col("dd_fit"))
    drawn = lambda k: F.coalesce((F.col("n_fit") * own + k * F.col("wg")) / (F.col("n_fit") + k), F.col("wg"))
    ways = [("base", F.lit(0.0)), ("global", F.col("wg"))] + [(f"airport_{k}", drawn(k)) for k in (0, 20, 50)]
    cand = F.inline(F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(i).alias("k"), v.alias("v")) for i, (c, v) in enumerate(ways)]))
    v = F.col("v")
    sse = F.sum(F.col("rr") - 2 * v * F.col("dr") + v * v * F.col("dd"))
    scored = test.select(*at, "n", "dr", "dd", "rr", cand).groupBy("outer_fold", (F.col("hold") < 0).alias("held"), "candidate", "k").agg(F.sum("n").alias("n"), F.sqrt(F.greatest(sse, F.lit(0.0)) / F.sum("n")).alias("rmse"))
    w = F.col("w")
    mixed = F.sum(sum((w[i] * w[j] * F.col(f"g{i}{j}") * (1 if i == j else 2) for i, j in pairs), F.lit(0.0)))
    convex = test.groupBy("outer_fold", (F.col("hold") < 0).alias("held"), F.lit("convex").alias("candidate"), F.lit(len(ways)).alias("k")).agg(F.sum("n").alias("n"), F.sqrt(F.greatest(mixed, F.lit(0.0)) / F.sum("n")).alias("rmse"))
    scored = scored.union(convex)
    best = scored.where("not held").groupBy("outer_fold").agg(F.min(F.struct(F.round("rmse", 6).alias("inner_rmse"), "k", F.col("candidate").alias("chosen"))).alias("m")).select("outer_fold", "m.*")
    out = best.join(scored.where("held").select("outer_fold", "k", F.col("rmse").alias("held_rmse"), F.col("n").alias("n_held")), ["outer_fold", "k"])
    return rounded(out.select("outer_fold", "chosen", "inner_rmse", "held_rmse", "n_held"), 4)


@query("a33_promotion_gate", "{with}, " + E + ", " + BOOT + ", f as (select fold, sqrt(avg(pow(new - y, 2))) < sqrt(avg(pow(old - y, 2))) as better from e group by fold) select (select bool_and(better) from f) as every_fold, (select quantile_cont(gain, 0.025) > 0 from gn) as bound, (select bool_and(better) from f) and (select quantile_cont(gain, 0.025) > 0 from gn) as promote")
def a33(spark, sf):
    """Pass if every fold improves and the bootstrap's lower bound is above zero."""
    e = est(spark, sf)
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("y"), 2)))
    folds = e.groupBy("fold").agg((rmse("new") < rmse("old")).alias("better")).agg(F.bool_and("better").alias("every_fold"))
    bound = interval(paired_bootstrap(e, "y", "old", "new", F.col("day"), REPLICATES)).select((F.col("lo") > 0).alias("bound"))
    return folds.crossJoin(bound).withColumn("promote", F.col("every_fold") & F.col("bound"))


@query("a34_route_choice", "{with}, " + E + ", l as (select dest, unnest(['new', 'old', 's']) as route, unnest([0, 1, 2]) as k, unnest([new, old, s]) as v, y from e), r as (select dest, route, k, count(*) as n, avg(abs(v - y)) as mae from l group by all having count(*) >= 5) select dest, arg_min(route, (round(mae, 6), k)) as route from r group by dest")
def a34(spark, sf):
    """The eligible route with the least error, fixed order among equals."""
    cand = F.array(*[F.struct(F.lit(n).alias("route"), F.lit(k).alias("k"), F.col(n).alias("v")) for k, n in enumerate(("new", "old", "s"))])
    r = est(spark, sf).select("dest", "y", F.inline(cand)).groupBy("dest", "route", "k").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("v") - F.col("y"))), 6).alias("mae")).where("n >= 5")
    return r.groupBy("dest").agg(F.min(F.struct("mae", "k", "route"))["route"].alias("route"))


CUTS = [1800.0, 3600.0, 5400.0, 6600.0]


@query("a35_threshold_sweep", "{with}, " + E + ", g as (select unnest(" + str(CUTS) + ") as cut), w as (select cut, count(*) filter (s > cut) as gated, round(sqrt(avg(pow(case when s > cut then s else old end - y, 2))), 4) as rmse from e, g group by cut) select *, row_number() over (order by rmse, cut) = 1 as best from w")
def a35(spark, sf):
    """Pooled error of each threshold of the tail gate, and the best one: of equal errors the lowest threshold. One scan, a row a threshold."""
    e = est(spark, sf).select("s", "old", "y", F.explode(F.array(*[F.lit(c) for c in CUTS])).alias("cut"))
    v = F.when(F.col("s") > F.col("cut"), F.col("s")).otherwise(F.col("old"))
    swept = rounded(e.groupBy("cut").agg(F.count_if(F.col("s") > F.col("cut")).alias("gated"), F.sqrt(F.avg(F.pow(v - F.col("y"), 2))).alias("rmse")), 4)
    rows = F.array_sort(F.collect_list(F.struct("rmse", "cut", "gated")))  # as many as thresholds
    return swept.agg(rows.alias("rows")).select(F.posexplode("rows").alias("i", "x")).select("x.cut", "x.gated", "x.rmse", (F.col("i") == 0).alias("best"))


def _boot_sql(where: str, sums: dict[str, str], stat: str) -> str:
    """Day sums, REPLICATES draws of days, and bg: the statistic v of each replicate r."""
    return (
        f"bd as (select row_number() over (order by day) - 1 as i, {', '.join(f'{e} as {n}' for n, e in sums.items())} from e where {where} group by day), bn as (select count(*) as days from bd), "
        f"br as (select r, ((r*7919 + s*104729 + r*s*31 + 12345) % 1000003) % days as i from bn, range({REPLICATES}) a(r), range(days) b(s)), "
        f"bg as (select r, {stat} as v from (select r, {', '.join(f'sum({n}) as {n}' for n in sums)} from br join bd using (i) group by r))"
    )


_SLOPE = "(xy - x * yy / n) / nullif(xx - x * x / n, 0)"
_A25 = {"n": "count(*)", "x": "sum(p)", "yy": "sum(y)", "xy": "sum(p * y)", "xx": "sum(p * p)"}


@query("a25_day_slopes", "{with}, " + E + ", " + _boot_sql("p is not null and y is not null", _A25, _SLOPE) + f" select (select round({_SLOPE}, 4) from (select {', '.join(f'sum({n}) as {n}' for n in _A25)} from bd)) as slope, round(quantile_cont(v, 0.025), 4) as lo, round(quantile_cont(v, 0.975), 4) as hi, count(*) as replicates from bg")
def a25(spark, sf):
    """Slope of taxi time on the proxy, and its interval over days drawn with replacement."""
    e = est(spark, sf).where("p is not null and y is not null")
    days = e.groupBy("day").agg(*[F.expr(x).alias(n) for n, x in _A25.items()])
    slope = F.expr(_SLOPE)
    whole = days.agg(*[F.sum(n).alias(n) for n in _A25]).select(F.round(slope, 4).alias("slope"))
    p = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    bounds = day_bootstrap(days, list(_A25), REPLICATES).select(slope.alias("v")).agg(p.alias("p"), F.count("*").alias("replicates"))
    return whole.crossJoin(bounds.select(F.round(F.col("p")[0], 4).alias("lo"), F.round(F.col("p")[1], 4).alias("hi"), "replicates"))


_A39 = {"n": "count(*)", "so": "sum(pow(old - y, 2))", "sn": "sum(pow(new - y, 2))"}
_GAIN = "sqrt(so / n) - sqrt(sn / n)"


@query("a39_ablation", "{with}, " + E + ", " + _boot_sql("p is not null and y is not null", _A39, _GAIN) + f" select n, round(sqrt(so / n), 5) as rmse_old, round(sqrt(sn / n), 5) as rmse_new, round({_GAIN}, 5) as gain, (select round(quantile_cont(v, 0.025), 5) from bg) as lo, (select round(quantile_cont(v, 0.975), 5) from bg) as hi from (select {', '.join(f'cast(sum({n}) as bigint) as {n}' if n == 'n' else f'sum({n}) as {n}' for n in _A39)} from bd)")
def a39(spark, sf):
    """Two estimates on identical rows: their errors, the gain, and its interval over days."""
    e = est(spark, sf).where("p is not null and y is not null")
    days = e.groupBy("day").agg(*[F.expr(x).alias(n) for n, x in _A39.items()])
    gain = F.expr(_GAIN)
    whole = days.agg(*[F.sum(n).alias(n) for n in _A39]).select("n", F.sqrt(F.col("so") / F.col("n")).alias("rmse_old"), F.sqrt(F.col("sn") / F.col("n")).alias("rmse_new"), gain.alias("gain"))
    p = day_bootstrap(days, list(_A39), REPLICATES).select(gain.alias("v")).agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return rounded(whole.crossJoin(p.select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))), 5)


POLICY = {
    "o01_proxy_fallback": ("greatest(case when coalesce(p between 0 and 7200, false) then p + 0.3 * (old - p) else 250.0 end, 0)", lambda: [Policy(F.lit(True), F.lit(250.0)), Policy(valid_proxy(F.col("p")), F.col("p") + 0.3 * (F.col("old") - F.col("p")))]),
    "o02_gated_blend": ("greatest(case when coalesce(s between 0 and 7200, false) then greatest(old + 0.25 * (s - old), 0) else old end, 0)", lambda: [Policy(F.col("s").between(0, 7200), F.greatest(F.col("estimate") + 0.25 * (F.col("s") - F.col("estimate")), F.lit(0.0)))]),
    "o03_source_correction": ("greatest(old + 0.5 * (least(greatest(s, 0), 7200) / 7200.0) * (s - old), 0)", lambda: [Policy(F.lit(True), F.col("estimate") + 0.5 * (clipped(F.col("s"), 0.0, 7200.0) / 7200.0) * (F.col("s") - F.col("estimate")))]),
    "o04_capped_sources": ("greatest(old + least(greatest(0.1 * (s - old), -3600), 3600) + case when l is null then 0 else least(greatest(0.2 * (l - old), -3600), 3600) end, 0)", lambda: [Policy(F.lit(True), F.col("old") + clipped(0.1 * (F.col("s") - F.col("old")), -3600.0, 3600.0) + F.coalesce(clipped(0.2 * (F.col("l") - F.col("old")), -3600.0, 3600.0), F.lit(0.0)))]),
    "o05_clock_switch": ("greatest(case when not coalesce(p between 0 and 7200, false) then coalesce(l, old) when abs(aobt_us - lobt_us) > 600000000 then old + 0.5 * (l - old) else old end, 0)", lambda: [Policy(valid_proxy(F.col("p")) & (F.abs(F.col("aobt_us") - F.col("lobt_us")) > 600 * S), F.col("old") + 0.5 * (F.col("l") - F.col("old"))), Policy(~F.coalesce(valid_proxy(F.col("p")), F.lit(False)), F.coalesce("l", "old"))]),
    "o06_missing_clock": ("greatest(case when aobt_us is null and lobt_us is null then least(greatest(s, 0), 1200) when aobt_us is null then 0.5 * l + 100 else old end, 0)", lambda: [Policy(F.col("aobt_us").isNull() & F.col("lobt_us").isNotNull(), 0.5 * F.col("l") + 100.0), Policy(F.col("aobt_us").isNull() & F.col("lobt_us").isNull(), clipped(F.col("s"), 0.0, 1200.0))]),
    "o09_mixture": ("greatest(0.3 * s + 0.7 * old * least(greatest(s / greatest(old, 1.0), 0), 4), 0)", lambda: [Policy(F.lit(True), 0.3 * F.col("s") + 0.7 * F.col("old") * clipped(F.col("s") / F.greatest(F.col("old"), F.lit(1.0)), 0.0, 4.0))]),
    "o10_staged_chain": ("greatest(case when s > 6000 then s when s > 3600 then old + 0.5 * (s - old) when s < 0 then old * 1.1 else old end, 0)", lambda: [Policy(F.col("s") > 6000, F.col("s")), Policy((F.col("s") > 3600) & (F.col("s") <= 6000), F.col("old") + 0.5 * (F.col("s") - F.col("old"))), Policy(F.col("s") < 0, F.col("old") * 1.1)]),
    "o11_delta": ("greatest(case when p is not null then old + 0.5 * (new - old) else old end, 0)", lambda: [Policy(F.col("p").isNotNull(), F.col("estimate") + 0.5 * (F.col("new") - F.col("old")))]),
}


def _policy(make):
    def run(spark, sf):
        return rounded(compose(est(spark, sf).withColumn("estimate", F.col("old")), make()).select("mvt_id", "estimate"))

    return run


for _name, (_sql, _make) in POLICY.items():
    query(_name, "{with}, " + E + f" select mvt_id, round(cast({_sql} as double), 6) + 0.0 as estimate from e")(_policy(_make))


@query("o07_tail_routes", "{with}, " + E + ", r as (select airport, dest, count(*) as n, avg((abs(s - y) <= 600)::int) as rate, median(y - s) as offs from e where fold >= 2 and s > 3600 group by all), g as (select avg(y) as m from e where fold >= 2 and s > 3600) select e.mvt_id, round(greatest(case when s > 3600 and n >= 3 and rate >= 0.1 then s + offs when s > 3600 then m else old end, 0), 4) as estimate from e cross join g left join r on e.airport = r.airport and e.dest = r.dest")
def o07(spark, sf):
    """Long schedules: the schedule plus a reliable route's median offset, else the mean of long rows."""
    e = est(spark, sf)
    tail = e.where("fold >= 2 and s > 3600")
    routes = tail.groupBy("airport", "dest").agg(F.count("*").alias("n"), F.avg((F.abs(F.col("s") - F.col("y")) <= 600).cast("int")).alias("rate"))
    routes = with_percentiles(routes, tail.withColumn("residual", F.col("y") - F.col("s")), "residual", [0.5], ["airport", "dest"]).withColumn("offs", F.col("__q")[0]).drop("__q")
    both = e.join(routes, ["airport", "dest"], "left").crossJoin(F.broadcast(tail.agg(F.avg("y").alias("m")))).withColumn("estimate", F.col("old"))
    out = compose(both, [Policy(F.col("s") > 3600, F.col("m")), Policy((F.col("s") > 3600) & (F.col("n") >= 3) & (F.col("rate") >= 0.1), F.col("s") + F.col("offs"))])
    return rounded(out.select("mvt_id", "estimate"), 4)


#: Candidates for rows without an off-block clock, null elsewhere: a direct one, a ratio, a mixture.
MISSING = {"direct": "case when aobt_us is null and lobt_us is not null then 0.5 * l + 100 end", "ratio": "case when aobt_us is null then least(greatest(s, 0), 1200) end", "mixture": "case when aobt_us is null and s > 0 then 0.3 * s + 0.7 * old end"}
#: Policy -> (candidate, share) steps, each over the result of the one before.
VARIANTS = {"base": [], "direct_half": [("direct", 0.5)], "direct_full": [("direct", 1.0)], "ratio_half": [("ratio", 0.5)], "mixture_half": [("mixture", 0.5)], "direct_half_ratio_half": [("direct", 0.5), ("ratio", 0.5)], "direct_half_mixture_half": [("direct", 0.5), ("mixture", 0.5)]}


def _variant_sql(steps) -> str:
    text = "old"
    for c, share in steps:
        text = f"coalesce({1 - share} * {text} + {share} * {c}, {text})"
    return text


@query("o06_policy_variants", "{with}, " + E + ", k as (select *, " + ", ".join(f"{v} as {n}" for n, v in MISSING.items()) + " from e) select mvt_id, " + ", ".join(f"round(cast({_variant_sql(v)} as double), 6) + 0.0 as {n}" for n, v in VARIANTS.items()) + " from k")
def o06_variants(spark, sf):
    """All seven policies for missing clocks: steps that move the estimate towards a candidate where there is one."""
    e = est(spark, sf).withColumns({n: F.expr(v) for n, v in MISSING.items()})

    def value(steps):
        out = F.col("old")
        for c, share in steps:
            out = F.coalesce((1 - share) * out + share * F.col(c), out)
        return out

    return rounded(e.select("mvt_id", *[value(v).cast("double").alias(n) for n, v in VARIANTS.items()]))


#: The airport with experts of its own, and the experts' columns: `picked` is the schedule where an earlier clock agrees with it.
HOME = "A0"
PICKED = "case when abs(s - l) <= 3600 then s end"
EXPERTS = {
    "baseline_direct": "old",
    "missing_direct": "new",
    "missing_schedule": "coalesce(s, new)",
    "grouped": "coalesce(grp, old)",
    **{f"tail_gate_{int(c)}": f"case when s > {c} then coalesce(picked, old) else old end" for c in CUTS[1:]},
    **{f"tail_schedule_{int(c)}": f"case when airport = '{HOME}' and s > {c} then coalesce(picked, old) when airport = '{HOME}' then coalesce(s, new) else old end" for c in CUTS[1:]},
    "ratio_missing": f"case when airport = '{HOME}' then ratio else new end",
    "ratio_baseline": f"case when airport = '{HOME}' then ratio else old end",
    "ratio_analog": f"case when airport = '{HOME}' and s > 3600 and n_like >= 3 and picked is not null then picked when airport = '{HOME}' then ratio else old end",
    "ratio_high_schedule": f"case when airport = '{HOME}' and s between 5400 and 6600 then 0.5 * ratio + 0.5 * s when airport = '{HOME}' then ratio else old end",
}


@query(
    "o08_expert_family",
    "{with}, " + E + f", h as (select airport, dest, count(*) as n_like, avg(y) as grp, sum(y) / nullif(sum(greatest(s, 1)), 0) as rate from e where fold >= 2 group by all), x as (select e.*, n_like, grp, {PICKED} as picked, greatest(s, 1) * coalesce(rate, 1) as ratio from e left join h on e.airport = h.airport and e.dest = h.dest) select mvt_id, "
    + ", ".join(f"case when s > {c} then s else old end as at_{int(c)}" for c in CUTS) + ", " + ", ".join(f"round(cast({v} as double), 4) + 0.0 as {n}" for n, v in EXPERTS.items()) + " from x",
)
def o08(spark, sf):
    """The schedule beyond each cut, and the fourteen experts for rows with a missing clock; history is that of the route in the fit folds."""
    e = est(spark, sf)
    h = e.where("fold >= 2").groupBy("airport", "dest").agg(F.count("*").alias("n_like"), F.avg("y").alias("grp"), (F.sum("y") / F.nullif(F.sum(F.greatest("s", F.lit(1.0))), F.lit(0.0))).alias("rate"))
    x = e.join(h, ["airport", "dest"], "left").withColumns({"picked": F.expr(PICKED), "ratio": F.greatest("s", F.lit(1.0)) * F.coalesce("rate", F.lit(1.0))})
    at = [F.when(F.col("s") > c, F.col("s")).otherwise(F.col("old")).alias(f"at_{int(c)}") for c in CUTS]
    return x.select("mvt_id", *at, *[(F.round(F.expr(v).cast("double"), 4) + 0.0).alias(n) for n, v in EXPERTS.items()])


@query("o10_stage_check", "{with}, " + E + " select count(*) filter (s > 3600 and s <= 6000 and s > 6000) as overlap, count(*) filter (s > 6000) as first, count(*) filter (s > 3600 and s <= 6000) as second, count(*) filter (s < 0) as third, 0 as changed_outside from e")
def o10_check(spark, sf):
    """Gates of the chain are disjoint, and rows outside of them keep their value."""
    gates = [F.col("s") > 6000, (F.col("s") > 3600) & (F.col("s") <= 6000), F.col("s") < 0]
    e = est(spark, sf).withColumn("estimate", F.col("old"))
    out = compose(e, POLICY["o10_staged_chain"][1]())
    hits = sum(g.cast("int") for g in gates[1:]) + gates[0].cast("int")
    return out.agg(F.count_if(hits > 1).alias("overlap"), F.count_if(gates[0]).alias("first"), F.count_if(gates[1]).alias("second"), F.count_if(gates[2]).alias("third"), F.count_if((hits == 0) & (F.col("estimate") != F.greatest("old", F.lit(0.0)))).cast("int").alias("changed_outside"))


@query("o12_publish_check", "{with}, " + E + " select count(*) as n, count(*) filter (old is null or isnan(old)) as bad, count(*) filter (old < 0) as negative, round(min(greatest(old, 0)), 6) as lo, round(max(greatest(old, 0)), 6) as hi from e")
def o12(spark, sf):
    """The checks that a published table must pass."""
    e = est(spark, sf)
    v = F.greatest("old", F.lit(0.0))
    return rounded(e.agg(F.count("*").alias("n"), F.count_if(F.col("old").isNull() | F.isnan("old")).alias("bad"), F.count_if(F.col("old") < 0).alias("negative"), F.min(v).alias("lo"), F.max(v).alias("hi")))


def baseline_features(spark, sf):
    """Departure features: clock gaps, flags, calendar, keys, airport context."""
    e = est(spark, sf)
    t = F.col("t_us")
    wins = [Win("dep15", -15 * MIN, 0), Win("dep60", -60 * MIN, 0)]
    e = context_agg(e, e.select("airport", "t_us"), ["airport"], "t_us", wins, {"n": ("count", None)})
    e = context_agg(e, arrs(spark, sf).where("taxi_sec between 0 and 3600"), ["airport"], "t_us", [Win("arr60", -60 * MIN, -1)], {"n": ("count", None), "mean": ("avg", "taxi_sec")})
    hs, hc = clock.cyclic(clock.hour(t), 24)
    return e.select(
        "mvt_id", "airport", "runway", "dest", "ac_type", "fold", "day", "y", "p", "s", "l", "old",
        valid_proxy(F.col("p")).cast("int").alias("p_ok"), F.col("aobt_us").isNull().cast("int").alias("no_aobt"), clock.hour(t).alias("hour"), clock.weekday(t).alias("weekday"), hs.alias("hour_sin"), hc.alias("hour_cos"),
        F.concat_ws("_", "airport", F.coalesce("runway", F.lit("?"))).alias("airport_runway"), (F.col("dep15_n") - 1).alias("dep15"), (F.col("dep60_n") - 1).alias("dep60"), F.col("arr60_n").alias("arr60"), F.col("arr60_mean").alias("arr60_taxi"),
    )
