"""Context of departures in few passes: the windows W01-W16 as requests to the fused operator, and their columns.

Each block names what it asks of a key's pass and how its columns follow from the answers and the departure's own row.
A stack asks for all of its blocks at once, so that each key is dealt out once, whatever the number of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import normal_key
from ..operators.context import dominated
from ..operators.fused import Inside, Mark, Near, Open, Over, Part, context, dealt, fuse
from .base import MIN, S, moves
from .windows import SOUND, W01, W04_SPANS

OWN = "t_us - aobt_us between 1 and 7200000000"
AIRPORT, RUNWAY, NORMAL, STAND = ("airport",), ("airport", "rk"), ("airport", "rn"), ("airport", "stand")


@dataclass(frozen=True)
class Asked:
    asks: dict[tuple[str, ...], dict[str, object]]
    columns: dict[str, str]


#: Kinds of events. rk is the runway with all unknown ones together, rn without them, rs without any placeholder.
MARKS = {
    "dep": Mark("t_us", "phase = 'DEP'"),
    "arr": Mark("t_us", "phase = 'ARR'"),
    "dep_nameless": Mark("t_us", "phase = 'DEP' and runway is null"),
    "dep_named": Mark("t_us", "phase = 'DEP' and runway is not null"),
    "proxy": Mark("t_us", "phase = 'DEP' and (t_us - aobt_us) div 1000000 between 0 and 7200", {"p": "(t_us - aobt_us) div 1000000"}),
    "landed": Mark("t_us", "phase = 'ARR' and taxi_sec between 0 and 3600", {"taxi_sec": "taxi_sec", "slow": "cast(taxi_sec >= 1200 as double)"}),
    "inblock": Mark("block_us", "phase = 'ARR' and block_us between t_us and t_us + 7200000000"),
    "block": Mark("block_us", "phase = 'ARR'", {"taxi_sec": "taxi_sec"}),
    "sound": Mark("block_us", f"phase = 'ARR' and rs is not null and {SOUND}", {"taxi_sec": "taxi_sec"}),
    "start": Mark("aobt_us", f"phase = 'DEP' and {OWN}"),
    "start_named": Mark("aobt_us", f"phase = 'DEP' and runway is not null and {OWN}"),
}


def _proxies(scope: str) -> dict[str, Over]:
    return {f"w04_{scope}_{side}{w}_{n}": Over("proxy", lo, hi, how, "p") for side, w, lo, hi in W04_SPANS for n, how in (("n", "count"), ("mean", "avg"), ("std", "std"))}


def _same(names) -> dict[str, str]:
    return {n: n for n in names}


_W04 = [n for scope in ("ap", "rw") for n in _proxies(scope)]
_W05 = {f"w05_w{w}_{n}": Over("landed", -w * MIN, -1, how, v) for w in (15, 60, 180) for n, how, v in (("n", "count", None), ("mean", "avg", "taxi_sec"), ("slow", "avg", "slow"))}
_W09 = {f"w09_{n}": Over("arr", lo, hi) for n, lo, hi in (("past15", -15 * MIN, -1), ("past60", -60 * MIN, -1), ("future15", 1, 15 * MIN), ("future60", 1, 60 * MIN))}
_W10 = {f"w10_{n}_{k}": Near(k, side, None) for k in ("arr", "dep") for n, side in (("prev", "past"), ("next", "future"))}
_W11 = {f"w11_w{w}_{n}": Over("sound", -w * MIN, -1, how, v) for w in (15, 60, 180) for n, how, v in (("n", "count", None), ("mean", "avg", "taxi_sec"), ("std", "std", "taxi_sec"))}

BLOCKS = {
    "w01": Asked(
        {AIRPORT: {f"w01_{n}": Over("dep" if s == "d" else "arr", lo * MIN, hi * MIN) for n, (s, lo, hi) in W01.items()}},
        {f"w01_{n}": f"greatest(w01_{n} - {1 if s == 'd' else 0}, 0)" for n, (s, _, _) in W01.items()},
    ),
    "w02": Asked(
        {RUNWAY: {"w02_nameless": Over("dep_nameless", -15 * MIN, 0), "w02_named": Over("dep_named", -15 * MIN, 0)}},
        {"w02_n": "greatest(case when runway is null then w02_nameless else w02_named end - 1, 0)"},
    ),
    "w03": Asked(
        {AIRPORT: {"w03_airport": Open("aobt_us", "t_us", "phase = 'DEP'", "aobt_us")}, RUNWAY: {"w03_runway": Open("aobt_us", "t_us", "phase = 'DEP' and runway is not null", "aobt_us")}},
        {"w03_airport_backlog": "case when aobt_us < t_us then w03_airport - 1 end", "w03_runway_backlog": "case when aobt_us < t_us and runway is not null then w03_runway - 1 end"},
    ),
    "w04": Asked({AIRPORT: _proxies("ap"), RUNWAY: _proxies("rw")}, _same(_W04)),
    "w05": Asked({AIRPORT: _W05}, _same(_W05)),
    "w06": Asked({AIRPORT: {"w06_n": Over("inblock", -60 * MIN, -1)}}, _same(["w06_n"])),
    "w07": Asked({AIRPORT: {"w07_n": Open("t_us", "block_us", "phase = 'ARR'", None, False, False)}}, _same(["w07_n"])),
    "w08": Asked(
        {STAND: {"w08_last": Near("block", "past", 86_400 * S, ("taxi_sec",)), "w08_n4h": Over("block", -14_400 * S, -1)}},
        {"w08_gap_s": "(t_us - w08_last_t) / 1000000e0", "w08_last_taxi": "w08_last_taxi_sec", "w08_n4h": "w08_n4h"},
    ),
    "w09": Asked({NORMAL: _W09}, _same(_W09)),
    "w10": Asked({NORMAL: _W10}, {n: f"(t_us - {n}_t) / 1000000e0" if "prev" in n else f"({n}_t - t_us) / 1000000e0" for n in _W10}),
    "w11": Asked({NORMAL: _W11}, {n: f"case when rs is not null then {n} end" for n in _W11}),
    "w12": Asked({NORMAL: {"w12_n": Open("t_us", "block_us", f"phase = 'ARR' and rs is not null and {SOUND}", None, False, False)}}, {"w12_n": "case when rs is not null then w12_n end"}),
    "w14": Asked(
        {
            AIRPORT: {"w14_airport_takeoffs": Inside("dep", "aobt_us", 7200 * S, OWN), "w14_airport_starts": Inside("start", "aobt_us", 7200 * S, OWN)},
            RUNWAY: {"w14_runway_takeoffs": Inside("dep_named", "aobt_us", 7200 * S, OWN), "w14_runway_starts": Inside("start_named", "aobt_us", 7200 * S, OWN)},
        },
        _same(["w14_airport_takeoffs", "w14_airport_starts"]) | {n: f"case when runway is not null then {n} end" for n in ("w14_runway_takeoffs", "w14_runway_starts")},
    ),
    "w15": Asked({AIRPORT: {"w15_n": Open("aobt_us", "t_us", f"phase = 'DEP' and {OWN}")}}, {"w15_n": f"case when {OWN} then w15_n end"}),
}
#: W16 counts by dominance and not by windows; its rows join the others in the exchange by id.
OVERTAKING = {"w16_overtakers": f"case when {OWN} then coalesce(w16_overtakers, 0) end", "w16_left_behind": f"case when {OWN} then coalesce(w16_left_behind, 0) end"}


def keyed(m: DataFrame) -> DataFrame:
    """m with the runway keys of the passes."""
    return m.withColumns({"rk": F.coalesce("runway", F.lit("?")), "rn": normal_key(F.col("runway"), ("?",)), "rs": normal_key(F.col("runway"))})


def parts(q: DataFrame, m: DataFrame, blocks: list[str], into: int | None = None) -> list[Part]:
    """One pass for each key that the blocks ask of. q and m have the columns of movements and the keys."""
    asked: dict[tuple[str, ...], dict[str, object]] = {}
    for b in blocks:
        for key, asks in BLOCKS[b].asks.items() if b in BLOCKS else ():
            asked.setdefault(key, {}).update(asks)
    needed = ["mvt_id", "airport", "runway", "rk", "rn", "rs", "stand", "t_us", "aobt_us"]
    bare = q.select(*needed)
    out = [context(bare, m, list(key), "t_us", MARKS, asks, "mvt_id", parts=into) for key, asks in asked.items()]
    if "w16" in blocks:
        i = bare.where(OWN)
        turned = i.withColumns({"aobt_us": -F.col("aobt_us"), "t_us": -F.col("t_us")})
        for frame, name in ((i, "w16_overtakers"), (turned, "w16_left_behind")):
            found = dominated(frame, "mvt_id", ["airport"], "aobt_us", "t_us", 7200 * S, name)
            out.append(Part(found.select("mvt_id", F.struct(name).alias(f"one_{name}")), {f"one_{name}": [name]}))
    return out


def with_blocks(spark, sf, q: DataFrame, blocks: list[str], more: list[Part] = []) -> DataFrame:
    """q (departures) with the columns of the blocks, `{block}_{column}`, and those of other parts: a pass a key, one exchange by id."""
    q, m = keyed(q), moves(spark, sf)
    into = dealt(m)
    found = q.repartition(into, "mvt_id").join(fuse([*parts(q, keyed(m), blocks, into), *more], "mvt_id", into), "mvt_id", "left")
    made = {n: F.expr(x) for b in blocks for n, x in (OVERTAKING if b == "w16" else BLOCKS[b].columns).items()}
    return found.select(*[c for c in q.columns if c not in ("rk", "rn", "rs")], *[c.alias(n) for n, c in made.items()], *[n for p in more for ns in p.structs.values() for n in ns])
