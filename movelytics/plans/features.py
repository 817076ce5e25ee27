"""Feature views F01-F07 and the event sequence W17.

Columns that need nothing but their own row are written once, in the SQL that both engines read (with {div}, {ts} and
{local} for what they spell differently); context columns come from the window operators on one side and from correlated
counts on the other. Flights have clocks and attributes that the movements view lacks; they are derived from it alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import EVENT_PLACEHOLDERS, normal_key
from ..operators.context import nearest_events
from ..operators.weather import CODES, MAXIMA, MEDIANS, MINIMA, at_hour, weather_table
from ..sources.tables import refuse_labels, weather_observations
from .base import FL, ORACLES, QUERIES, S, flights, moves, query, rounded
from .joins import RELATED
from .passes import BLOCKS, OVERTAKING, with_blocks
from .scalars import ZONES
from .windows import W01

_ZONE = "case airport " + " ".join(f"when '{a}' then '{z}'" for a, z in ZONES.items()) + " end"
_SPARK = {"div": "div", "ts": "timestamp_micros({})", "local": "unix_micros(from_utc_timestamp(timestamp_micros({}), " + _ZONE + "))"}
_DUCK = {"div": "//", "ts": "make_timestamp({})", "local": "epoch_us(make_timestamptz({}) at time zone (" + _ZONE + "))"}


def _said(text: str, words: dict[str, str]) -> str:
    """text with a ~ b (whole quotient), TS(column) and LOCAL(column) in one engine's words."""
    for name, key in (("TS", "ts"), ("LOCAL", "local")):
        while (at := text.find(f"{name}(")) >= 0:
            end = text.index(")", at)
            text = text[:at] + words[key].format(text[at + len(name) + 1 : end]) + text[end + 1 :]
    return text.replace("~", words["div"])


class Block:
    """Named row-wise columns: `double` ones are rounded before comparison."""

    def __init__(self, **columns: str):
        self.columns = columns

    def spark(self, df: DataFrame, names=None) -> DataFrame:
        return df.select("*", *[F.expr(_said(self.columns[c], _SPARK)).alias(c) for c in names or self.columns if c not in df.columns])

    def sql(self, names=None) -> str:
        return ", ".join(f"{_said(self.columns[c], _DUCK)} as {c}" for c in names or self.columns)


def _gap(a: str, b: str, cut: float = 86400) -> str:
    return f"case when {a} is not null and {b} is not null then greatest(least(({a} - {b}) / 1e6, {cut}e0), -{cut}e0) end"


def _day(t: str) -> str:
    return f"({t} ~ 86400000000)"


def _sod(t: str) -> str:
    return f"(({t} ~ 1000000) % 86400)"


def _text(c: str, pattern: str) -> str:
    return f"nullif(regexp_extract({c}, '{pattern}', 1), '')"


def _same(a: str, b: str) -> str:
    return f"case when {a} = {b} then 1 else 0 end"


CLOCKS = ("aobt_us", "lobt_us", "iobt_us", "eobt_us", "sched_us", "planned_us", "flown_us")
PAIRS = (("aobt_us", "lobt_us"), ("aobt_us", "iobt_us"), ("aobt_us", "eobt_us"), ("lobt_us", "eobt_us"), ("sched_us", "lobt_us"))
PROXY = "((t_us - aobt_us) / 1e6)"
_LOCAL = "LOCAL(t_us)"
ROWWISE = Block(
    **{f"takeoff_minus_{c[:-3]}": _gap("t_us", c) for c in CLOCKS},
    **{f"delta_{a[:-3]}_{b[:-3]}": _gap(a, b) for a, b in PAIRS},
    proxy_valid=f"case when {PROXY} between 0e0 and 7200e0 then 1 else 0 end",
    proxy_seconds=f"case when {PROXY} between 0e0 and 7200e0 then {PROXY} end",
    aobt_lobt_abs_difference=f"abs({_gap('aobt_us', 'lobt_us')})",
    **{f"{c[:-3]}_missing": f"case when {c} is null then 1 else 0 end" for c in ("aobt_us", "lobt_us", "eobt_us", "iobt_us")},
    flight_airport_agrees=_same("adep_flt", "airport"),
    aircraft_type_agrees=_same("type_flt", "ac_type"),
    destination_agrees=_same("ades_flt", "dest"),
    utc_hour=f"{_sod('t_us')} ~ 3600 + (({_sod('t_us')} % 3600) ~ 60) / 60e0",
    utc_weekday=f"({_day('t_us')} + 3) % 7",
    utc_month="cast(month(TS(t_us)) as bigint)",
    utc_dayofyear="cast(dayofyear(TS(t_us)) as bigint)",
    is_weekend=f"case when ({_day('t_us')} + 3) % 7 >= 5 then 1 else 0 end",
    local_hour=f"{_sod(_LOCAL)} ~ 3600 + (({_sod(_LOCAL)} % 3600) ~ 60) / 60e0",
    local_weekday=f"({_day(_LOCAL)} + 3) % 7",
    hour_sin=f"sin(2e0 * pi() * ({_sod(_LOCAL)} ~ 3600 + (({_sod(_LOCAL)} % 3600) ~ 60) / 60e0) / 24e0)",
    hour_cos=f"cos(2e0 * pi() * ({_sod(_LOCAL)} ~ 3600 + (({_sod(_LOCAL)} % 3600) ~ 60) / 60e0) / 24e0)",
    year_sin="sin(2e0 * pi() * dayofyear(TS(t_us)) / 365.25e0)",
    year_cos="cos(2e0 * pi() * dayofyear(TS(t_us)) / 365.25e0)",
    **{f"{c}_category": f"coalesce({c}, '__MISSING__')" for c in ("airport", "dest", "runway", "stand", "ac_type", "rule", "adep_flt", "ades_flt", "type_flt", "filed_dest", "operator", "segment", "wake", "rule_flt", "kind")},
    flight_prefix=f"coalesce({_text('flight', '^([A-Za-z]{1,3})')}, '__MISSING__')",
    callsign_prefix=f"coalesce({_text('callsign', '^([A-Za-z]{1,3})')}, '__MISSING__')",
    flight_number=f"cast({_text('flight', '([0-9]{1,4})')} as double)",
    stand_zone=f"coalesce({_text('stand', '^([A-Za-z]{1,3})')}, '__MISSING__')",
    stand_number=f"cast({_text('stand', '([0-9]{1,4})')} as double)",
    route="coalesce(airport, '?') || '_' || coalesce(dest, '?')",
    airport_runway="coalesce(airport, '?') || '_' || coalesce(runway, '?')",
    airport_stand="coalesce(airport, '?') || '_' || coalesce(stand, '?')",
    airport_stand_runway="coalesce(airport, '?') || '_' || coalesce(stand, '?') || '_' || coalesce(runway, '?')",
)
TRAFFIC = (*W01, "same_runway_prev15", "airport_backlog", "runway_backlog")


#: Names of TRAFFIC in the passes.
PASSED = {n: f"w01_{n}" for n in W01} | {"same_runway_prev15": "w02_n", "airport_backlog": "w03_airport_backlog", "runway_backlog": "w03_runway_backlog"}


def _joined_sql(columns: str, *names: str) -> str:
    """{with} ... select columns from fl and the SQL of other queries, by id."""
    return "{with}, " + FL + f" select {columns} from fl" + "".join(f" left join ({ORACLES[n]}) {n[:3]} using (mvt_id)" for n in names)


TRAFFIC_SQL = ", ".join([*[f"w01.{n}" for n in W01], "w02.n as same_runway_prev15", "w03.airport_backlog", "w03.runway_backlog"])
_F01 = list(ROWWISE.columns)


def _rounded_sql(inner: str, doubles: list[str]) -> str:
    return "select * replace (" + ", ".join(f"round({c}, 6) + 0e0 as {c}" for c in doubles) + f") from ({inner})"


_F01_DOUBLE = [c for c in _F01 if c.startswith(("takeoff_", "delta_", "hour_", "year_")) or c in ("proxy_seconds", "aobt_lobt_abs_difference", "utc_hour", "local_hour", "flight_number", "stand_number")]
F01_SQL = _rounded_sql(_joined_sql(f"mvt_id, {ROWWISE.sql()}, {TRAFFIC_SQL}", "w01_airport_counts", "w02_runway_counts", "w03_taxi_backlog"), _F01_DOUBLE)


@query("f01_baseline_features", F01_SQL)
def f01(spark, sf):
    """Baseline features of every departure: clock gaps, flags, agreement, calendar, keys, traffic."""
    f = with_blocks(spark, sf, flights(spark, sf), ["w01", "w02", "w03"]).withColumnsRenamed({p: n for n, p in PASSED.items()})
    return rounded(ROWWISE.spark(f).select("mvt_id", *_F01, *TRAFFIC))


STAMPS = ("t_us", *CLOCKS)
STAMP_BLOCK = Block(
    **{f"{c[:-3]}_{n}": e for c in STAMPS for n, e in (("second", f"({c} ~ 1000000) % 60"), ("minute", f"(({c} ~ 1000000) % 3600) ~ 60"), ("hour", f"{_sod(c)} ~ 3600"), ("weekday", f"({_day(c)} + 3) % 7"))},
    planned_duration="(planned_us - eobt_us) / 1e6", flown_duration="(flown_us - aobt_us) / 1e6", arrival_delay="(flown_us - planned_us) / 1e6", revision="(eobt_us - iobt_us) / 1e6", schedule_gap="(t_us - sched_us) / 1e6",
    flight_id_missing="case when flight_id is null then 1 else 0 end",
    gap_days="cast(floor((t_us - sched_us) / 86400e6) as bigint)", callsign_is_flight="case when callsign = flight || 'X' then 1 else 0 end",
)
_F02_DOUBLE = ["planned_duration", "flown_duration", "arrival_delay", "revision", "schedule_gap"]


@query("f02_timestamp_block", _rounded_sql(_joined_sql(f"mvt_id, {STAMP_BLOCK.sql()}"), _F02_DOUBLE))
def f02(spark, sf):
    """Second, minute, hour and weekday of each clock, durations, callsign equality."""
    return rounded(STAMP_BLOCK.spark(flights(spark, sf)).select("mvt_id", *STAMP_BLOCK.columns))


_SL = "LOCAL(sched_us)"
SCHEDULE_BLOCK = Block(
    quarter_phase="(sched_us ~ 1000000) % 900", distance="least((sched_us ~ 1000000) % 900, 900 - (sched_us ~ 1000000) % 900)",
    exact_quarter="case when (sched_us ~ 1000000) % 900 = 0 then 1 else 0 end", exact_five="case when (sched_us ~ 1000000) % 300 = 0 then 1 else 0 end",
    day_offset=f"{_day('t_us')} - {_day('sched_us')}", schedule_local_hour=f"{_sod(_SL)} ~ 3600", schedule_local_weekday=f"({_day(_SL)} + 3) % 7",
)


@query("f03_schedule_clock", _joined_sql(f"mvt_id, {SCHEDULE_BLOCK.sql()}"))
def f03(spark, sf):
    """Place of the schedule within the quarter hour, day offset, local hour and weekday."""
    return SCHEDULE_BLOCK.spark(flights(spark, sf)).select("mvt_id", *SCHEDULE_BLOCK.columns)


DERIVED = Block(
    flight_name="coalesce(flight, '__MISSING__')", mvt_utc_minute="((t_us ~ 1000000) % 3600) ~ 60", mvt_utc_second="(t_us ~ 1000000) % 60",
    schedule_utc_hour=f"{_sod('sched_us')} ~ 3600", schedule_utc_minute="((sched_us ~ 1000000) % 3600) ~ 60", schedule_utc_second="(sched_us ~ 1000000) % 60", schedule_utc_weekday=f"({_day('sched_us')} + 3) % 7",
    schedule_local_hour=f"{_sod(_SL)} ~ 3600", schedule_local_weekday=f"({_day(_SL)} + 3) % 7",
    mvt_schedule_gap_seconds=_gap("t_us", "sched_us", 604800), mvt_schedule_day_offset="greatest(least(cast(floor((t_us - sched_us) / 86400e6) as bigint), 30), -30)", schedule_missing="case when sched_us is null then 1 else 0 end",
)
ARRIVAL = {
    **{f"arr_taxi_{n}_{w}m": f"w05.w{w}_{c}" for w in (15, 60, 180) for n, c in (("count", "n"), ("mean", "mean"), ("highshare", "slow"))},
    "arr_taxiing_now": "w07.n", "arr_block_prev_60m": "w06.n", "arr_same_stand_last_block_gap": "w08.gap_s", "arr_same_stand_last_taxi": "w08.last_taxi", "arr_same_stand_blocks_4h": "w08.n4h",
}
WEATHER = ["n_obs", *MEDIANS, *MAXIMA, *MINIMA, *CODES, "wind_dir", "fog_hour", "deicing"]
#: Wind along and across the runway, by the heading that its number says.
_HEADING = "(case when cast(nullif(regexp_extract(runway, '^([0-9][0-9])', 1), '') as int) between 1 and 36 then cast(regexp_extract(runway, '^([0-9][0-9])', 1) as int) * 10 end)"
_ANGLE = f"radians(wx_wind_dir - {_HEADING})"
WIND = {"wx_headwind": f"wx_wind_speed * cos({_ANGLE})", "wx_crosswind": f"wx_wind_speed * abs(sin({_ANGLE}))"}
SAFE_NUMERIC = [*W01, "same_runway_prev15", "utc_hour", "utc_weekday", "utc_month", "utc_dayofyear", "is_weekend", "local_hour", "local_weekday", "hour_sin", "hour_cos", "year_sin", "year_cos", "stand_number", "flight_number"]
SAFE_TEXT = [*[f"{c}_category" for c in ("airport", "dest", "runway", "stand", "ac_type", "rule")], "flight_prefix", "stand_zone", "route", "airport_runway", "airport_stand", "airport_stand_runway"]
# Names and order of the movement-only view (SAFE_NUMERIC, SAFE_TEXT, DERIVED, weather, ARRIVAL).
#: The ordered allow-list of the movement-only view, and parts of names that give away flight clocks or labels.
ALLOWED = [*SAFE_NUMERIC, *SAFE_TEXT, *DERIVED.columns, *[f"wx_{c}" for c in WEATHER], *WIND, *ARRIVAL]
#: Parts of our own names that give away clocks or attributes of the flight plan, identities or labels.
FORBIDDEN = tuple(c.removesuffix("_us") for c in CLOCKS if c not in ("sched_us", "planned_us", "flown_us")) + ("_flt", "callsign", "_id", "taxi_sec", "block_us")

WEATHER_SQL = (
    "wh as (select airport, (t_us // 3600000000) * 3600000000 as hour_us, count(*) as n_obs, "
    + ", ".join([*[f"median({c}) as {c}" for c in MEDIANS], *[f"max({c}) as {c}" for c in MAXIMA], *[f"min({c}) as {c}" for c in MINIMA]])
    + ", "
    + ", ".join(f"coalesce(bool_or(regexp_matches(upper(code), '{p}')), false) as {n}" for n, p in CODES.items())
    + ", max_by(wind_dir, (t_us, wind_dir)) filter (wind_dir between 0 and 360) as wind_dir from wx group by all), "
    + "wg as (select airport, unnest(range((lo // 86400000000) * 86400000000, (hi // 86400000000) * 86400000000 + 86400000000, 3600000000)) as hour_us from (select distinct airport from wx), (select min(t_us) as lo, max(t_us) as hi from wx)), "
    + "wf as materialized (select wg.airport, wg.hour_us, coalesce(n_obs, 0) as n_obs, "
    + ", ".join([*MEDIANS, *MAXIMA, *MINIMA, *[f"coalesce({c}, false) as {c}" for c in CODES], "wind_dir"])
    + ", coalesce(wh.fog, false) or coalesce(visibility < 1000, false) as fog_hour, coalesce(temperature <= 0 and (wh.snow or wh.freezing or precip > 0), false) as deicing"
    + " from wg left join wh on wg.airport = wh.airport and wg.hour_us = wh.hour_us)"
)
_WIND_SQL = {n: e.replace("wx_wind", "wf.wind") for n, e in WIND.items()}
_F04_DOUBLE = [c for c in ALLOWED if c in WIND or c in _F01_DOUBLE or c == "mvt_schedule_gap_seconds" or "mean" in c or "highshare" in c or c.startswith("arr_same_stand_last") or c[3:] in MEDIANS or c[3:] in ("gust", "precip", "visibility", "ceiling")]
F04_SQL = _rounded_sql(
    "{with}, {wx}, " + WEATHER_SQL + ", " + FL + ", base as (select fl.*, " + ROWWISE.sql([c for c in [*SAFE_NUMERIC, *SAFE_TEXT] if c in ROWWISE.columns]) + ", " + DERIVED.sql() + " from fl) select mvt_id, "
    + ", ".join([*[f"w01.{c}" for c in W01], "w02.n as same_runway_prev15", *[f"base.{c}" for c in SAFE_NUMERIC[8:]], *[f"base.{c}" for c in SAFE_TEXT], *[f"base.{c}" for c in DERIVED.columns], *[f"wf.{c} as wx_{c}" for c in WEATHER]])
    + ", " + ", ".join([*[f"{e} as {n}" for n, e in _WIND_SQL.items()], *[f"{e} as {n}" for n, e in ARRIVAL.items()]])
    + " from base left join wf on base.airport = wf.airport and wf.hour_us = (base.t_us // 3600000000) * 3600000000"
    + "".join(f" left join ({ORACLES[n]}) {n[:3]} using (mvt_id)" for n in ("w01_airport_counts", "w02_runway_counts", "w05_arrival_taxi", "w06_inblocks", "w07_arrivals_taxiing", "w08_same_stand")),
    _F04_DOUBLE,
)


#: Names of ARRIVAL in the passes.
ARRIVED = {n: e.replace(".", "_") for n, e in ARRIVAL.items()}
ARRIVAL_BLOCKS = ["w05", "w06", "w07", "w08"]


def _with_weather(spark, sf, f: DataFrame) -> DataFrame:
    wx = weather_table(weather_observations(spark, sf)).select("airport", "hour_us", *[F.col(c).alias(f"wx_{c}") for c in WEATHER])
    f = at_hour(f, wx)
    return f.select("*", *[F.expr(e).alias(n) for n, e in WIND.items()])


@query("f04_movement_only", F04_SQL)
def f04(spark, sf):
    """The movement-only view: calendar, keys, traffic, schedule, weather and arrivals, in the order of the allow-list and held against it."""
    f = with_blocks(spark, sf, flights(spark, sf), ["w01", "w02", *ARRIVAL_BLOCKS]).withColumnsRenamed({p: n for n, p in (PASSED | ARRIVED).items()})
    f = DERIVED.spark(ROWWISE.spark(_with_weather(spark, sf, f), [c for c in [*SAFE_NUMERIC, *SAFE_TEXT] if c in ROWWISE.columns]))
    return rounded(f.select("mvt_id", *refuse_labels(f.select(*ALLOWED), FORBIDDEN, ALLOWED).columns))


#: Blocks of the wide stack: prefix -> the query whose columns it takes.
STACK = {
    "ts": "f02_timestamp_block", "at": "w05_arrival_taxi", "ib": "w06_inblocks", "an": "w07_arrivals_taxiing", "st": "w08_same_stand", "nb": "w04_neighbour_proxies", "ra": "w09_runway_arrivals", "rh": "w10_runway_headway",
    "ct": "w11_completed_taxi", "aa": "w12_active_arrivals", "bk": "w03_taxi_backlog", "fi": "w14_inside_own_interval", "fa": "w15_active_at_takeoff", "fo": "w16_overtakers", "gw": "g05_geometry_wind", "rt": "w13_related_traffic",
}


def wide_sql() -> str:
    joins = "".join(f" left join (select {p}_mvt_id as mvt_id, * exclude ({p}_mvt_id) from (select columns(*) as '{p}_\\0' from ({ORACLES[n]}))) b_{p} using (mvt_id)" for p, n in STACK.items())
    return "{with} select * from (select mvt_id from d) d" + joins


def wide(spark, sf) -> DataFrame:
    """One row per departure with the columns of all blocks of STACK, each under its prefix; names that collide are errors.

    Blocks of the passes are asked for together; those with tables of their own are joined by id. The counts on related strips
    are in the geometry view too, so that one pass serves both blocks.
    """
    passed = {p: name[:3] for p, name in STACK.items() if name[:3] in BLOCKS or name[:3] == "w16"}
    f = with_blocks(spark, sf, flights(spark, sf), list(passed.values()))
    own = {p: {c: f"{p}_{c[4:]}" for c in (OVERTAKING if b == "w16" else BLOCKS[b].columns)} for p, b in passed.items()}
    stamps = {c: f"ts_{c}" for c in STAMP_BLOCK.columns}
    out = STAMP_BLOCK.spark(f).select("mvt_id", *[F.col(c).alias(n) for names in (stamps, *own.values()) for c, n in names.items()])
    for p, name in STACK.items():
        if p not in passed and p not in ("ts", "rt"):
            block = QUERIES[name](spark, sf)
            names = {c: f"{p}_{c}" for c in block.columns if c != "mvt_id"}
            if clash := set(out.columns) & set(names.values()):
                raise ValueError(f"columns collide: {clash}")
            out = out.join(block.withColumnsRenamed(names), "mvt_id", "left")
    return rounded(out.select("*", *[F.col(f"gw_{n}").alias(f"rt_{n}") for n, *_ in RELATED]))


FAR = 600
ALTERNATES = {"sched": "sched_us", "lobt": "lobt_us", "iobt": "iobt_us", "eobt": "eobt_us"}
SOURCE_BLOCK = Block(
    **{f"{n}_delta": f"(aobt_us - {c}) / 1e6" for n, c in ALTERNATES.items()},
    **{f"{n}_option": f"case when (t_us - {c}) / 1e6 between 0e0 and 7200e0 and abs((aobt_us - {c}) / 1e6) > {FAR}e0 then 1 else 0 end" for n, c in list(ALTERNATES.items())[:3]},
    options=" + ".join(f"case when (t_us - {c}) / 1e6 between 0e0 and 7200e0 and abs((aobt_us - {c}) / 1e6) > {FAR}e0 then 1 else 0 end" for c in list(ALTERNATES.values())[:3]),
)


@query("f06_source_deltas", _rounded_sql(_joined_sql(f"mvt_id, {SOURCE_BLOCK.sql()}"), [f"{n}_delta" for n in ALTERNATES]))
def f06(spark, sf):
    """How far each alternate clock lies from off-block time, which are options, and how many."""
    return rounded(SOURCE_BLOCK.spark(flights(spark, sf)).select("mvt_id", *SOURCE_BLOCK.columns))


NO_CLOCK = "aobt_us is null and lobt_us is null"
MASK = ["proxy_valid", "aobt_missing", "lobt_missing"]
CLOCK_BLOCK = Block(
    schedule_unclipped_sec="(t_us - sched_us) / 1e6", schedule_day_offset="cast(floor((t_us - sched_us) / 86400e6) as bigint)",
    schedule_hour=f"{_sod('sched_us')} ~ 3600", schedule_minute="((sched_us ~ 1000000) % 3600) ~ 60", schedule_second="(sched_us ~ 1000000) % 60", schedule_weekday=f"({_day('sched_us')} + 3) % 7",
    schedule_quarter_distance="least((sched_us ~ 1000000) % 900, 900 - (sched_us ~ 1000000) % 900)",
    schedule_long_7200="case when t_us - sched_us > 7200000000 then 1 else 0 end", schedule_long_20000="case when t_us - sched_us > 20000000000 then 1 else 0 end",
    schedule_local_hour=f"{_sod(_SL)} ~ 3600", schedule_local_weekday=f"({_day(_SL)} + 3) % 7", flight_name="coalesce(flight, '?')",
)
_F07 = [*MASK, *CLOCK_BLOCK.columns, *[f"wx_{c}" for c in WEATHER], *WIND, *ARRIVAL]
_F07_DOUBLE = [c for c in _F07 if c in _F04_DOUBLE or c == "schedule_unclipped_sec"]


@query(
    "f07_no_clock_subset",
    _rounded_sql(
        "{with}, {wx}, " + WEATHER_SQL + ", " + FL + ", base as (select fl.*, " + ROWWISE.sql(MASK) + ", " + CLOCK_BLOCK.sql() + f" from fl where {NO_CLOCK}) select mvt_id, base.airport, "
        + ", ".join([*[f"base.{c}" for c in [*MASK, *CLOCK_BLOCK.columns]], *[f"wf.{c} as wx_{c}" for c in WEATHER], *[f"{e} as {n}" for n, e in _WIND_SQL.items()], *[f"{e} as {n}" for n, e in ARRIVAL.items()]])
        + " from base left join wf on base.airport = wf.airport and wf.hour_us = (base.t_us // 3600000000) * 3600000000"
        + "".join(f" left join ({ORACLES[n]}) {n[:3]} using (mvt_id)" for n in ("w05_arrival_taxi", "w06_inblocks", "w07_arrivals_taxiing", "w08_same_stand")),
        _F07_DOUBLE,
    ),
)
def f07(spark, sf):
    """Departures without off-block and last planned times: the mask's columns, schedule clock, weather with wind along the runway, and all arrival columns.

    The subset is taken before any join, so that the passes answer for its rows alone.
    """
    f = with_blocks(spark, sf, flights(spark, sf).where(NO_CLOCK), ARRIVAL_BLOCKS).withColumnsRenamed({p: n for n, p in ARRIVED.items()})
    f = CLOCK_BLOCK.spark(ROWWISE.spark(_with_weather(spark, sf, f), MASK))
    return rounded(f.select("mvt_id", "airport", *_F07))


SLOTS = 16
HOUR = 3600 * S


def sequences(spark, sf, k: int = SLOTS) -> DataFrame:
    """(mvt_id, t_us, rk, past, future): nearest events of each departure's airport, nearest first."""
    valid = F.expr("phase = 'DEP' and t_us - aobt_us between 1 and 7200000000")
    m = moves(spark, sf).select("mvt_id", "airport", "t_us", "flight_id", "phase", F.coalesce(normal_key(F.col("runway"), EVENT_PLACEHOLDERS), F.lit("")).alias("rk"), F.coalesce(F.when(valid, F.col("aobt_us")), F.lit(-1)).alias("aobt"))
    q = m.where("phase = 'DEP'").select("mvt_id", "airport", "t_us", "flight_id", "rk")
    return nearest_events(q, m.withColumnRenamed("rk", "runway"), "airport", "t_us", "mvt_id", "flight_id", ["phase", "runway", "aobt"], [], HOUR, k)


def event_arrays(found: DataFrame, k: int = SLOTS) -> DataFrame:
    """found with events (2k x 6 doubles) and presence (2k flags): the past right-aligned before the future, in order of time, padded with zeros.

    Channels: time difference in hours, -1 for arrivals and 1 for departures, same runway (1), another (0) or unknown (-1),
    the event's off-block time likewise, whether that is valid, and its taxi time in hours.
    """
    hours = lambda x: F.greatest(F.least(x / HOUR, F.lit(1.0)), F.lit(-1.0))

    def channels(x):
        ok = x["aobt"] >= 0
        runway = F.when((F.col("rk") == "") | (x["runway"] == ""), -1.0).when(x["runway"] == F.col("rk"), 1.0).otherwise(0.0)
        return F.array(hours(x["t_us"] - F.col("t_us")), F.when(x["phase"] == "ARR", -1.0).otherwise(1.0), runway, F.when(ok, hours(x["aobt"] - F.col("t_us"))).otherwise(0.0), ok.cast("double"), F.when(ok, (x["t_us"] - x["aobt"]) / HOUR).otherwise(0.0))

    key = lambda x: F.struct(x["t_us"].alias("t_us"), *[x[c].alias(c) for c in ("phase", "runway", "aobt", "mvt_id")])
    ordered = lambda c: F.array_sort(F.transform(c, key))
    blank = F.array(*[F.lit(0.0)] * 6)
    pad = lambda c, v: F.array_repeat(v, k - F.size(c))
    side = lambda c, v: F.transform(ordered(c), channels) if v is None else F.array_repeat(v, F.size(c))
    return found.withColumns({
        "events": F.concat(pad("past", blank), side("past", None), side("future", None), pad("future", blank)),
        "presence": F.concat(pad("past", F.lit(0)), side("past", F.lit(1)), side("future", F.lit(1)), pad("future", F.lit(0))),
    })


_PAIRS_SQL = f"""mm as materialized (select mvt_id, airport, t_us, flight_id, phase, coalesce(nullif(upper(trim(runway)), '?'), '') as rk, case when phase = 'DEP' and t_us - aobt_us between 1 and 7200000000 then aobt_us else -1 end as aobt from m),
 p as (select q.mvt_id, q.t_us as qt, q.rk as qrk, e.mvt_id as eid, e.t_us < q.t_us as past, e.t_us, e.phase, e.rk, e.aobt,
    row_number() over (partition by q.mvt_id, e.t_us < q.t_us order by abs(e.t_us - q.t_us), e.phase, e.rk, e.aobt, e.mvt_id) as rank
  from mm q join mm e on e.airport = q.airport and abs(e.t_us - q.t_us) <= {HOUR} and e.t_us <> q.t_us and e.mvt_id <> q.mvt_id and coalesce(e.flight_id, -1) <> coalesce(q.flight_id, -2)
    and strftime(make_timestamp(e.t_us), '%Y%m') = strftime(make_timestamp(q.t_us), '%Y%m') where q.phase = 'DEP')"""
_CUT = "cast(round(1e6 * greatest(least(({} - qt) / 3600e6, 1e0), -1e0)) as bigint)"
_SLOT_SQL = f"concat_ws(':', {_CUT.format('t_us')}, case when phase = 'ARR' then -1 else 1 end, case when qrk = '' or rk = '' then -1 when qrk = rk then 1 else 0 end, case when aobt >= 0 then {_CUT.format('aobt')} else 0 end, case when aobt >= 0 then 1 else 0 end, case when aobt >= 0 then cast(round(1e6 * (t_us - aobt) / 3600e6) as bigint) else 0 end)"


@query(
    "w17_event_sequence",
    f"""{{with}}, {_PAIRS_SQL},
 s as (select mvt_id, count(*) filter (past) as n_past, count(*) filter (not past) as n_future, string_agg({_SLOT_SQL}, '|' order by t_us, phase, rk, aobt, eid) as events from p where rank <= {SLOTS} group by mvt_id)
select d.mvt_id, coalesce(n_past, 0) as n_past, coalesce(n_future, 0) as n_future,
  repeat('0', {SLOTS} - cast(coalesce(n_past, 0) as int)) || repeat('1', cast(coalesce(n_past, 0) + coalesce(n_future, 0) as int)) || repeat('0', {SLOTS} - cast(coalesce(n_future, 0) as int)) as presence,
  concat_ws('|', case when coalesce(n_past, 0) < {SLOTS} then rtrim(repeat('0:0:0:0:0:0|', {SLOTS} - cast(coalesce(n_past, 0) as int)), '|') end, events, case when coalesce(n_future, 0) < {SLOTS} then rtrim(repeat('0:0:0:0:0:0|', {SLOTS} - cast(coalesce(n_future, 0) as int)), '|') end) as events
from d left join s on d.mvt_id = s.mvt_id""",
)
def w17(spark, sf):
    """16 events before and 16 after each departure with six channels, as text in millionths of an hour; padding and presence."""
    a = event_arrays(sequences(spark, sf))
    whole = lambda x, i: F.round(x[i] * (1e6 if i in (0, 3, 5) else 1.0)).cast("long").cast("string")
    said = F.array_join(F.transform("events", lambda x: F.concat_ws(":", *[whole(x, i) for i in range(6)])), "|")
    return a.select("mvt_id", F.size("past").cast("long").alias("n_past"), F.size("future").cast("long").alias("n_future"), F.array_join(F.transform("presence", lambda x: x.cast("string")), "").alias("presence"), said.alias("events"))


@query("j10_nearest_k", f"{{with}}, {_PAIRS_SQL} select mvt_id, case when past then 'past' else 'future' end as side, rank, eid as other from p where rank <= {SLOTS}")
def j10(spark, sf):
    """The 16 nearest events on each side within an hour, but for the own flight's, those of the same time and of another month."""
    f = sequences(spark, sf)
    sides = [f.select("mvt_id", F.lit(s).alias("side"), F.posexplode(s).alias("i", "x")) for s in ("past", "future")]
    return sides[0].union(sides[1]).select("mvt_id", "side", (F.col("i") + 1).cast("long").alias("rank"), F.col("x.mvt_id").alias("other"))
