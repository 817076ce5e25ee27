"""Windows and interval context: W01-W24, and the time joins J05-J10."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.keys import normal_key
from ..operators.context import Win, band_join, context_agg, counts_until, nearest, nearest_any, occupancy, overtaking
from ..operators.order import row_numbers, running, with_neighbours
from .base import MIN, S, arrs, deps, moves, query, rounded


def _count_sql(events: str, key: str, lo: int, hi: int, what: str = "count(*)", extra: str = "", t: str = "t_us") -> str:
    return f"(select {what} from {events} e where {' and '.join(f'e.{k} = q.{k}' for k in key.split(','))} and e.{t} between q.t_us + ({lo}) and q.t_us + ({hi}){extra})"


W01 = {"dep_prev5": ("d", -5, 0), "dep_prev15": ("d", -15, 0), "dep_prev30": ("d", -30, 0), "dep_next15": ("d", 0, 15), "arr_prev15": ("a", -15, 0), "arr_prev30": ("a", -30, 0), "arr_next15": ("a", 0, 15)}


@query("w01_airport_counts", "{with} select mvt_id, " + ", ".join(f"greatest({_count_sql(s, 'airport', lo * MIN, hi * MIN)} - {1 if s == 'd' else 0}, 0) as {n}" for n, (s, lo, hi) in W01.items()) + " from d q")
def w01(spark, sf):
    """Departures and arrivals at the airport around each departure, both ends inclusive, own row not counted."""
    m = moves(spark, sf).select("mvt_id", "airport", "t_us", *[F.when(F.col("phase") == p, F.lit(1)).alias(n) for p, n in (("DEP", "d"), ("ARR", "a"))])
    spans = sorted({(lo, hi) for _, lo, hi in W01.values()})
    wins = [Win(f"w{i}", lo * MIN, hi * MIN) for i, (lo, hi) in enumerate(spans)]
    out = context_agg(m.where("d = 1").select("mvt_id", "airport", "t_us"), m, ["airport"], "t_us", wins, {"d": ("count", "d"), "a": ("count", "a")})
    at = lambda s, lo, hi: F.col(f"w{spans.index((lo, hi))}_{s}")
    return out.select("mvt_id", *[F.greatest(at(s, lo, hi) - (1 if s == "d" else 0), F.lit(0)).alias(n) for n, (s, lo, hi) in W01.items()])


@query("w02_runway_counts", "{with}, r as (select mvt_id, t_us, airport, coalesce(runway, '__MISSING__') as rk from d) select mvt_id, greatest(" + _count_sql("r", "airport,rk", -15 * MIN, 0) + " - 1, 0) as n from r q")
def w02(spark, sf):
    """Departures on the same runway in the last 15 minutes; missing runways share a group."""
    d = deps(spark, sf).select("mvt_id", "airport", "t_us", F.coalesce("runway", F.lit("__MISSING__")).alias("rk"))
    out = context_agg(d, d, ["airport", "rk"], "t_us", [Win("w", -15 * MIN, 0)], {"n": ("count", None)})
    return out.select("mvt_id", F.greatest(F.col("w_n") - 1, F.lit(0)).alias("n"))


@query("w03_taxi_backlog", "{with}, i as (select * from d where aobt_us < t_us) select mvt_id, (select count(*) from i e where e.airport = q.airport and e.aobt_us <= q.aobt_us and e.t_us > q.aobt_us) - 1 as airport_backlog, case when q.runway is null then null else (select count(*) from i e where e.airport = q.airport and e.runway = q.runway and e.aobt_us <= q.aobt_us and e.t_us > q.aobt_us) - 1 end as runway_backlog from i q")
def w03(spark, sf):
    """Departures already taxiing at each departure's off-block time, at the airport and on the runway."""
    i = deps(spark, sf).where("aobt_us < t_us").select("mvt_id", "airport", "runway", "aobt_us", "t_us")
    for key, name in ((["airport"], "airport_backlog"), (["airport", "runway"], "runway_backlog")):
        i = occupancy(i, i.select("airport", "runway", "aobt_us", "t_us"), key, "aobt_us", "aobt_us", "t_us", True, False, name, 7200 * S, F.lit(1))
    return i.select("mvt_id", "airport_backlog", "runway_backlog")


W04 = [("ap", "airport"), ("rw", "airport,rk")]
W04_SPANS = (("past", 15, -15 * MIN, -1), ("past", 60, -60 * MIN, -1), ("future", 15, 1, 15 * MIN), ("future", 60, 1, 60 * MIN))


@query(
    "w04_neighbour_proxies",
    "{with}, r as (select mvt_id, airport, coalesce(runway, '?') as rk, t_us, (t_us - aobt_us) // 1000000 as p from d), e0 as (select * from r where p between 0 and 7200) select mvt_id, "
    + ", ".join(
        f"{_count_sql('e0', key, lo, hi)} as {s}_{side}{w}_n, round({_count_sql('e0', key, lo, hi, 'avg(p)')}, 6) as {s}_{side}{w}_mean, round({_count_sql('e0', key, lo, hi, 'stddev_pop(p)')}, 6) as {s}_{side}{w}_std"
        for s, key in W04
        for side, w, lo, hi in W04_SPANS
    )
    + " from r q",
)
def w04(spark, sf):
    """Count, mean and spread of valid taxi proxies around each departure, strictly before and after."""
    r = deps(spark, sf).select("mvt_id", "airport", F.coalesce("runway", F.lit("?")).alias("rk"), "t_us", F.expr("(t_us - aobt_us) div 1000000").alias("p"))
    events = r.where("p between 0 and 7200")
    wins = [Win(f"{side}{w}", lo, hi) for side, w, lo, hi in W04_SPANS]
    out = r
    for s, key in W04:
        named = [Win(f"{s}_{w.name}", w.lo, w.hi) for w in wins]
        out = context_agg(out, events, key.split(","), "t_us", named, {"n": ("count", "p"), "mean": ("avg", "p"), "std": ("std", "p")})
    return rounded(out.drop("airport", "rk", "t_us", "p"))


@query(
    "w05_arrival_taxi",
    "{with}, e0 as (select *, case when taxi_sec >= 1200 then 1.0 else 0.0 end as slow from a where taxi_sec between 0 and 3600) select mvt_id, "
    + ", ".join(f"{_count_sql('e0', 'airport', -w * MIN, -1)} as w{w}_n, round({_count_sql('e0', 'airport', -w * MIN, -1, 'avg(taxi_sec)')}, 6) as w{w}_mean, round({_count_sql('e0', 'airport', -w * MIN, -1, 'avg(slow)')}, 6) as w{w}_slow" for w in (15, 60, 180))
    + " from d q",
)
def w05(spark, sf):
    """Taxi-in of recent arrivals by landing time in [t - w, t): count, mean, share of 20 minutes or more."""
    e = arrs(spark, sf).where("taxi_sec between 0 and 3600").withColumn("slow", (F.col("taxi_sec") >= 1200).cast("double"))
    q = deps(spark, sf).select("mvt_id", "airport", "t_us")
    wins = [Win(f"w{w}", -w * MIN, -1) for w in (15, 60, 180)]
    return rounded(context_agg(q, e, ["airport"], "t_us", wins, {"n": ("count", None), "mean": ("avg", "taxi_sec"), "slow": ("avg", "slow")}).drop("airport", "t_us"))


@query("w06_inblocks", "{with}, e0 as (select * from a where block_us between t_us and t_us + 7200000000) select mvt_id, " + _count_sql("e0", "airport", -60 * MIN, -1, t="block_us") + " as n from d q")
def w06(spark, sf):
    """Arrivals that reached their stand in the last hour."""
    e = arrs(spark, sf).where("block_us between t_us and t_us + 7200000000")
    q = deps(spark, sf).select("mvt_id", "airport", "t_us")
    return context_agg(q, e, ["airport"], "t_us", [Win("w", -60 * MIN, -1)], {"n": ("count", None)}, event_t="block_us").select("mvt_id", F.col("w_n").alias("n"))


@query("w07_arrivals_taxiing", "{with} select mvt_id, (select count(*) from a e where e.airport = q.airport and e.t_us < q.t_us and e.block_us > q.t_us) as n from d q")
def w07(spark, sf):
    """Arrivals that have landed but not reached their stand: landings before t less in-blocks up to t."""
    q = deps(spark, sf).select("mvt_id", "airport", "t_us")
    return occupancy(q, arrs(spark, sf).select("airport", F.col("t_us").alias("s"), F.col("block_us").alias("f")), ["airport"], "t_us", "s", "f", False, False, "n", 7200 * S).select("mvt_id", "n")


@query(
    "w08_same_stand",
    "{with} select q.mvt_id, (q.t_us - max(e.block_us)) / 1000000.0 as gap_s, round(max_by(e.taxi_sec, (e.block_us, e.taxi_sec)), 6) as last_taxi, count(e.mvt_id) filter (e.block_us >= q.t_us - 14400000000) as n4h from d q left join a e on e.airport = q.airport and e.stand = q.stand and e.block_us between q.t_us - 86400000000 and q.t_us - 1 group by q.mvt_id, q.t_us",
)
def w08(spark, sf):
    """The last arrival on the same stand within a day before, and the number within four hours."""
    q = deps(spark, sf).select("mvt_id", "airport", "stand", "t_us")
    e = arrs(spark, sf)
    q = nearest(q, e, ["airport", "stand"], "t_us", ["taxi_sec"], "past", 86_400 * S, event_t="block_us", prefix="last", tie="desc")
    q = context_agg(q, e, ["airport", "stand"], "t_us", [Win("w", -14_400 * S, -1)], {"n": ("count", None)}, event_t="block_us")
    return rounded(q.select("mvt_id", ((F.col("t_us") - F.col("last_t")) / 1_000_000.0).alias("gap_s"), F.col("last_taxi_sec").alias("last_taxi"), F.col("w_n").alias("n4h")))


RW = "r as materialized (select *, nullif(upper(trim(runway)), '?') as rk from m), rd as (select * from r where phase = 'DEP'), ra as (select * from r where phase = 'ARR' and rk is not null)"


@query("w09_runway_arrivals", "{with}, " + RW + " select mvt_id, " + ", ".join(f"case when rk is null then null else {_count_sql('ra', 'airport,rk', lo, hi)} end as {n}" for n, lo, hi in (("past15", -15 * MIN, -1), ("past60", -60 * MIN, -1), ("future15", 1, 15 * MIN), ("future60", 1, 60 * MIN))) + " from rd q")
def w09(spark, sf):
    """Arrivals on the same runway before and after; placeholder runways get nulls."""
    r = moves(spark, sf).withColumn("rk", normal_key(F.col("runway"), ("?",)))
    wins = [Win("past15", -15 * MIN, -1), Win("past60", -60 * MIN, -1), Win("future15", 1, 15 * MIN), Win("future60", 1, 60 * MIN)]
    out = context_agg(r.where("phase = 'DEP'").select("mvt_id", "airport", "rk", "t_us"), r.where("phase = 'ARR' and rk is not null"), ["airport", "rk"], "t_us", wins, {"x": ("count", None)})
    return out.select("mvt_id", *[F.col(f"{w.name}_x").alias(w.name) for w in wins])


def _headway(op: str, events: str, pick: str) -> str:
    return f"(select {pick}(e.t_us) from {events} e where e.airport = q.airport and e.rk = q.rk and e.t_us {op} q.t_us)"


@query("w10_runway_headway", "{with}, " + RW + ", rq as (select * from rd where rk is not null) select mvt_id, " + ", ".join([f"(q.t_us - {_headway('<', e, 'max')}) / 1000000.0 as prev_{n}, ({_headway('>', e, 'min')} - q.t_us) / 1000000.0 as next_{n}" for n, e in (("arr", "ra"), ("dep", "rq"))]) + " from rd q")
def w10(spark, sf):
    """Seconds to the runway's previous and next arrival and departure, however far."""
    r = moves(spark, sf).withColumn("rk", normal_key(F.col("runway"), ("?",)))
    q = r.where("phase = 'DEP'").select("mvt_id", "airport", "rk", "t_us")
    q = nearest_any(q, r.where("rk is not null"), ["airport", "rk"], "t_us", {"arr": F.col("phase") == "ARR", "dep": F.col("phase") == "DEP"}, 6 * 3600 * S)
    return q.select("mvt_id", *[c for n in ("arr", "dep") for c in (((F.col("t_us") - F.col(f"prev_{n}")) / 1_000_000.0).alias(f"prev_{n}"), ((F.col(f"next_{n}") - F.col("t_us")) / 1_000_000.0).alias(f"next_{n}"))])


SOUND = "taxi_sec between 0 and 7200 and block_us >= t_us and abs((block_us - t_us) / 1000000.0 - taxi_sec) <= 1"


@query(
    "w11_completed_taxi",
    f"{{with}}, e0 as (select *, nullif(runway, '?') as rk from a where {SOUND}), q0 as (select *, nullif(runway, '?') as rk from d) select mvt_id, "
    + ", ".join(f"case when rk is null then null else {_count_sql('e0', 'airport,rk', -w * MIN, -1, t='block_us')} end as w{w}_n, round({_count_sql('e0', 'airport,rk', -w * MIN, -1, 'avg(taxi_sec)', t='block_us')}, 6) as w{w}_mean, round({_count_sql('e0', 'airport,rk', -w * MIN, -1, 'stddev_pop(taxi_sec)', t='block_us')}, 6) as w{w}_std" for w in (15, 60, 180))
    + " from q0 q",
)
def w11(spark, sf):
    """Completed taxi-in on the runway, anchored on in-block time in [t - w, t)."""
    e = arrs(spark, sf).where(SOUND).withColumn("rk", normal_key(F.col("runway")))
    q = deps(spark, sf).select("mvt_id", "airport", normal_key(F.col("runway")).alias("rk"), "t_us")
    wins = [Win(f"w{w}", -w * MIN, -1) for w in (15, 60, 180)]
    return rounded(context_agg(q, e, ["airport", "rk"], "t_us", wins, {"n": ("count", None), "mean": ("avg", "taxi_sec"), "std": ("std", "taxi_sec")}, event_t="block_us").drop("airport", "rk", "t_us"))


@query("w12_active_arrivals", f"{{with}}, e0 as (select *, nullif(runway, '?') as rk from a where {SOUND}), q0 as (select *, nullif(runway, '?') as rk from d) select mvt_id, case when rk is null then null else (select count(*) from e0 e where e.airport = q.airport and e.rk = q.rk and e.t_us < q.t_us and e.block_us > q.t_us) end as n from q0 q")
def w12(spark, sf):
    """Arrivals of the runway between landing and stand at take-off."""
    e = arrs(spark, sf).where(SOUND).select("airport", normal_key(F.col("runway")).alias("rk"), F.col("t_us").alias("s"), F.col("block_us").alias("f")).where("rk is not null")
    q = deps(spark, sf).select("mvt_id", "airport", normal_key(F.col("runway")).alias("rk"), "t_us")
    return occupancy(q, e, ["airport", "rk"], "t_us", "s", "f", False, False, "n", 7200 * S).select("mvt_id", "n")


@query(
    "w14_inside_own_interval",
    "{with}, i as (select * from d where t_us - aobt_us between 1 and 7200000000) select mvt_id, "
    + ", ".join(f"{'case when q.runway is null then null else ' if s == 'runway' else ''}(select count(*) from {e} e where e.airport = q.airport{' and e.runway = q.runway' if s == 'runway' else ''} and e.{t} > q.aobt_us and e.{t} < q.t_us){' end' if s == 'runway' else ''} as {s}_{n}" for s in ("airport", "runway") for n, e, t in (("takeoffs", "d", "t_us"), ("starts", "i", "aobt_us")))
    + " from i q",
)
def w14(spark, sf):
    """Take-offs and taxi starts strictly inside each departure's own interval, at the airport and on the runway: two running counts each."""
    d = deps(spark, sf).select("mvt_id", "airport", "runway", "t_us", "aobt_us")
    i = d.where("t_us - aobt_us between 1 and 7200000000")
    events = d.select("airport", "runway", F.col("t_us").alias("at"), F.lit("takeoffs").alias("kind")).union(i.select("airport", "runway", F.col("aobt_us").alias("at"), F.lit("starts").alias("kind")))
    kinds = ("takeoffs", "starts")
    out = i
    for scope, key in (("airport", ["airport"]), ("runway", ["airport", "runway"])):
        named = {f"{scope}_{k}": F.col("kind") == k for k in kinds}
        out = counts_until(out, events, key, "t_us", "at", named, False, 7200 * S, "_hi")
        out = counts_until(out, events, key, "aobt_us", "at", named, True, 7200 * S, "_lo")
    return out.select("mvt_id", *[(F.col(f"{s}_{k}_hi") - F.col(f"{s}_{k}_lo")).alias(f"{s}_{k}") for s in ("airport", "runway") for k in kinds])


@query("w15_active_at_takeoff", "{with}, i as (select * from d where t_us - aobt_us between 1 and 7200000000) select mvt_id, (select count(*) from i e where e.airport = q.airport and e.mvt_id <> q.mvt_id and e.aobt_us <= q.t_us and e.t_us > q.t_us) as n from i q")
def w15(spark, sf):
    """Departures still taxiing at each take-off, start <= t < end."""
    i = deps(spark, sf).where("t_us - aobt_us between 1 and 7200000000").select("mvt_id", "airport", "t_us", "aobt_us")
    return occupancy(i, i, ["airport"], "t_us", "aobt_us", "t_us", True, False, "n", 7200 * S).select("mvt_id", "n")


@query("w16_overtakers", "{with}, i as (select * from d where t_us - aobt_us between 1 and 7200000000) select mvt_id, (select count(*) from i e where e.airport = q.airport and e.aobt_us > q.aobt_us and e.t_us < q.t_us) as overtakers, (select count(*) from i e where e.airport = q.airport and e.aobt_us < q.aobt_us and e.t_us > q.t_us) as left_behind from i q")
def w16(spark, sf):
    """Departures that started later and took off earlier, and those that started earlier and took off later."""
    i = deps(spark, sf).where("t_us - aobt_us between 1 and 7200000000").select("mvt_id", "airport", "aobt_us", "t_us")
    return overtaking(i, "mvt_id", ["airport"], "aobt_us", "t_us", 7200 * S)


def _step_sql(scope: str, side: str) -> str:
    f, w = ("lag" if side == "prev" else "lead"), f"w_{scope}"
    sign = "" if side == "prev" else "-"
    same = "".join(f", coalesce(cast({c} = {f}({c}) over {w} as int), 0) as {scope}_{side}_{n}" for n, c in SAME.items())
    return f"abs(mvt_id - {f}(mvt_id) over {w}) as {scope}_{side}_id_gap, {sign}(t_us - {f}(t_us) over {w}) / 1000000.0 as {scope}_{side}_step_s{same}"


SAME = {"same_airport": "airport", "same_phase": "phase", "same_type": "ac_type", "same_flight": "flight"}
SIDES = [(scope, side) for scope in ("airport", "global") for side in ("prev", "next")]


@query("w18_id_neighbours", "{with} select mvt_id, " + ", ".join(_step_sql(a, b) for a, b in SIDES) + " from m window w_airport as (partition by airport order by mvt_id), w_global as (order by mvt_id)")
def w18(spark, sf):
    """Differences to the neighbours in id order on both sides, at the airport and over all rows."""
    m = moves(spark, sf).select("mvt_id", "t_us", *SAME.values())
    for scope, by in (("airport", ["airport"]), ("global", [])):
        m = with_neighbours(m, by, "mvt_id", ["mvt_id", "t_us", *SAME.values()], 4096).withColumnsRenamed({"prev": f"{scope}_prev", "next": f"{scope}_next"})
    out = []
    for scope, side in SIDES:
        at = f"{scope}_{side}"
        step = (F.col("t_us") - F.col(f"{at}.t_us")) / 1_000_000.0
        out += [F.abs(F.col("mvt_id") - F.col(f"{at}.mvt_id")).alias(f"{at}_id_gap"), (step if side == "prev" else -step).alias(f"{at}_step_s")]
        out += [F.coalesce((F.col(c) == F.col(f"{at}.{c}")).cast("int"), F.lit(0)).alias(f"{at}_{n}") for n, c in SAME.items()]
    return m.select("mvt_id", *out)


@query("w19_flight_nearby", "{with}, n as (select *, row_number() over (partition by airport order by mvt_id) as i from m) select q.mvt_id, exists (select 1 from n e where e.airport = q.airport and e.flight = q.flight and e.i <> q.i and abs(e.i - q.i) <= 5 and abs(e.mvt_id - q.mvt_id) <= 50) as nearby from n q")
def w19(spark, sf):
    """The same flight within five rows and an id distance, in id order: buckets of ids with a halo of the distance that counts."""
    width, reach = 4096, 50
    m = moves(spark, sf).select("mvt_id", "airport", "flight", F.explode(F.sequence(F.expr(f"(mvt_id - {reach}) div {width}"), F.expr(f"(mvt_id + {reach}) div {width}"))).alias("b"))
    near = F.collect_list(F.struct("mvt_id", "flight")).over(Window.partitionBy("airport", "b").orderBy("mvt_id").rowsBetween(-5, 5))
    own = m.withColumn("near", near).where(F.expr(f"b = mvt_id div {width}"))
    return own.select("mvt_id", F.exists("near", lambda x: (x["flight"] == F.col("flight")) & (x["mvt_id"] != F.col("mvt_id")) & (F.abs(x["mvt_id"] - F.col("mvt_id")) <= reach)).alias("nearby"))


@query("w20_next_same_key", "{with} select mvt_id, lead(t_us) over (partition by flight, airport, dest order by t_us, mvt_id) as next_us from a")
def w20(spark, sf):
    return arrs(spark, sf).select("mvt_id", F.lead("t_us").over(Window.partitionBy("flight", "airport", "dest").orderBy("t_us", "mvt_id")).alias("next_us"))


@query(
    "w21_tertiles",
    "{with}, r as (select mvt_id, airport, row_number() over (partition by airport order by taxi_sec, mvt_id) as r, count(*) over (partition by airport) as n, rank() over (partition by airport order by taxi_sec) as k, count(*) over (partition by airport, taxi_sec) as ties from d) select mvt_id, case when r <= 1 + (n - 1) / 3.0 then 0 when r <= 1 + 2 * (n - 1) / 3.0 then 1 else 2 end as tertile, least(cast(floor(3.0 * (k + (ties - 1) / 2.0) / n) as int), 2) as thirds from r",
)
def w21(spark, sf):
    """Equal-count tertiles by explicit cuts, and thirds by average percent rank."""
    d = deps(spark, sf).select("mvt_id", "airport", "taxi_sec")
    sizes = d.groupBy("airport").agg(F.count("*").alias("n"))  # one row per airport
    equal = d.groupBy("airport", "taxi_sec").agg(F.count("*").alias("ties"))
    below = running(equal, ["airport"], "taxi_sec", [], F.col("ties"), "below").withColumn("k", F.col("below") + 1)
    r = row_numbers(d, ["airport"], "taxi_sec", ["mvt_id"], "r").join(below, ["airport", "taxi_sec"]).join(F.broadcast(sizes), "airport")
    cut = lambda k: 1 + k * (F.col("n") - 1) / 3.0
    return r.select("mvt_id", F.when(F.col("r") <= cut(1), 0).when(F.col("r") <= cut(2), 1).otherwise(2).alias("tertile"), F.least(F.floor(3.0 * (F.col("k") + (F.col("ties") - 1) / 2.0) / F.col("n")).cast("int"), F.lit(2)).alias("thirds"))


@query("w22_centred", "{with} select mvt_id, round(taxi_sec - avg(taxi_sec) over w, 6) as centred, count(*) over w as n from d window w as (partition by airport, ac_type)")
def w22(spark, sf):
    """Centring by the mean of a stratum: sums per stratum, joined back."""
    d = deps(spark, sf)
    means = d.groupBy("airport", "ac_type").agg(F.avg("taxi_sec").alias("mean"), F.count("*").alias("n"))
    return rounded(d.join(means, ["airport", "ac_type"]).select("mvt_id", (F.col("taxi_sec") - F.col("mean")).alias("centred"), "n"))


@query("w24_step_masks", "{with}, s as (select taxi_sec, (t_us - aobt_us) / 1000000.0 as p, (t_us - lag(t_us) over (partition by airport order by mvt_id)) / 1000000.0 as step from m), g as (select unnest([0, -3600, -21600, -86400]) as cut) select cut, coalesce(step < cut, false) as flagged, count(*) as n, round(sqrt(avg((p - taxi_sec) * (p - taxi_sec))), 4) as rmse from s, g where p is not null group by all")
def w24(spark, sf):
    """Error of the proxy on rows whose time runs backwards in id order, against the others."""
    m = with_neighbours(moves(spark, sf), ["airport"], "mvt_id", ["mvt_id", "t_us"], 4096)
    s = m.select("taxi_sec", ((F.col("t_us") - F.col("aobt_us")) / 1_000_000.0).alias("p"), ((F.col("t_us") - F.col("prev.t_us")) / 1_000_000.0).alias("step")).where("p is not null")
    long = s.withColumn("cut", F.explode(F.array(*[F.lit(x) for x in (0, -3600, -21600, -86400)])))
    e = F.col("p") - F.col("taxi_sec")
    return rounded(long.groupBy("cut", F.coalesce(F.col("step") < F.col("cut"), F.lit(False)).alias("flagged")).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")), 4)


@query(
    "j05_forward_asof",
    """{with}, c as (select q.mvt_id, q.t_us, q.ac_type, e.mvt_id as aid, e.t_us as at_us, e.ac_type as atype, row_number() over (partition by q.mvt_id order by e.t_us, e.mvt_id) as rk, count(*) over (partition by q.mvt_id) as n
  from d q left join a e on e.flight = q.flight and e.airport = q.dest and e.t_us between q.t_us and q.t_us + 64800000000)
select mvt_id, case when aid is not null and at_us - t_us >= 900000000 and atype = ac_type and n = 1 then aid end as arrival from c where rk = 1""",
)
def j05(spark, sf):
    """Forward as-of to the flight's arrival within 18 hours; rejected under 900 s, for another type, or if a second one follows."""
    d = deps(spark, sf).select("mvt_id", "flight", F.col("dest").alias("place"), "t_us", "ac_type")
    a = arrs(spark, sf).select("flight", F.col("airport").alias("place"), "t_us", F.col("mvt_id").alias("id"), F.regexp_extract("ac_type", r"(\d+)", 1).cast("long").alias("kind"))
    q = nearest(d, a, ["flight", "place"], "t_us", ["id", "kind"], "future", 64_800 * S, inclusive=True, prefix="a")
    q = context_agg(q, a, ["flight", "place"], "t_us", [Win("w", 0, 64_800 * S)], {"n": ("count", None)})
    ok = (F.col("a_t") - F.col("t_us") >= 900 * S) & (F.concat(F.lit("T"), F.col("a_kind").cast("string")) == F.col("ac_type")) & (F.col("w_n") == 1)
    return q.select("mvt_id", F.when(ok, F.col("a_id")).alias("arrival"))


@query("j06_backward_asof", "{with} select q.mvt_id, max(e.block_us) as last_us, count(e.mvt_id) > 0 as found from d q left join a e on e.airport = q.airport and e.stand = q.stand and e.block_us between q.t_us - 86400000000 and q.t_us - 1 group by q.mvt_id")
def j06(spark, sf):
    """Last in-block on the same stand strictly before, at most a day ago."""
    q = deps(spark, sf).select("mvt_id", "airport", "stand", "t_us")
    return nearest(q, arrs(spark, sf), ["airport", "stand"], "t_us", [], "past", 86_400 * S, event_t="block_us", prefix="last", tie="desc").select("mvt_id", F.col("last_t").alias("last_us"), F.col("last_t").isNotNull().alias("found"))


@query("j07_nearest_both", "{with} select q.mvt_id, max(e.t_us) filter (e.t_us < q.t_us) as prev_us, min(e.t_us) filter (e.t_us > q.t_us) as next_us from d q left join a e on e.airport = q.airport group by q.mvt_id")
def j07(spark, sf):
    """Previous and next arrival at the airport, strict and unbounded."""
    q = deps(spark, sf).select("mvt_id", "airport", "t_us")
    e = arrs(spark, sf).select("airport", "t_us")
    out = nearest_any(q, e, ["airport"], "t_us", {"us": F.lit(True)}, 6 * 3600 * S)
    return out.select("mvt_id", "prev_us", "next_us")


@query("j08_band_aggregate", "{with} select mvt_id, " + _count_sql("a", "airport", -30 * MIN, -1) + " as n, round(" + _count_sql("a", "airport", -30 * MIN, -1, "sum(taxi_sec)") + ", 4) as total from d q")
def j08(spark, sf):
    """Band join with an aggregate, as a range frame without a join."""
    q = deps(spark, sf).select("mvt_id", "airport", "t_us")
    out = context_agg(q, arrs(spark, sf), ["airport"], "t_us", [Win("w", -30 * MIN, -1)], {"n": ("count", None), "total": ("sum", "taxi_sec")})
    return rounded(out.select("mvt_id", F.col("w_n").alias("n"), F.col("w_total").alias("total")), 4)


@query("j09_dominance_pairs", "{with}, i as (select * from d where t_us - aobt_us between 1 and 7200000000) select q.mvt_id, e.mvt_id as other from i q join i e on e.airport = q.airport and e.aobt_us > q.aobt_us and e.t_us < q.t_us")
def j09(spark, sf):
    """Pairs at an airport in which the other started later and took off earlier."""
    i = deps(spark, sf).where("t_us - aobt_us between 1 and 7200000000").select("mvt_id", "airport", "runway", "aobt_us", "t_us")
    return band_join(i, i, ["airport"], F.col("aobt_us") + 1, F.col("t_us"), "aobt_us", 7200 * S).where("e_t_us < t_us").select("mvt_id", F.col("e_mvt_id").alias("other"))


