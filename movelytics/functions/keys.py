"""Keys, identities and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing key, after trimming and upper-casing; of runways, and of event sequences.
RUNWAY_PLACEHOLDERS = ("", "?", "UNKNOWN", "UNKN", "UNK", "N/A", "NA", "NONE", "NULL", "NIL", "__MISSING__")
EVENT_PLACEHOLDERS = ("", "?", "-", "NA", "N/A", "NAN", "NONE", "NULL", "UNKNOWN", "\\N")
#: Largest integer below which doubles are exact.
EXACT = 2**53


def normal_key(c: Column, missing: tuple[str, ...] = RUNWAY_PLACEHOLDERS) -> Column:
    """Trimmed and upper-cased; placeholders are null."""
    up = F.upper(F.trim(c))
    return F.when(~up.isin(*missing), up)


def grouped_key(c: Column) -> Column:
    """Missing keys share one group."""
    return F.coalesce(c, F.lit("__MISSING__"))


def identity(c: Column) -> Column:
    """Typed identity of a number or text: 'i:' + integer, 's:' + text, null for fractions and inexact integers."""
    number = c.cast("double")
    return F.when((number == F.floor(number)) & (F.abs(number) < EXACT), F.concat(F.lit("i:"), number.cast("long").cast("string")))


def text_identity(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.concat(F.lit("s:"), F.trim(c)))


def seconds(a: Column, b: Column) -> Column:
    """a - b in seconds, of microsecond columns."""
    return (a - b) / F.lit(1_000_000.0)


def clipped(c: Column, lo: float, hi: float) -> Column:
    """c within [lo, hi]; null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def valid_proxy(d: Column, strict: str = "closed") -> Column:
    """Strictness of a proxy duration in seconds: closed 0..7200, open (0, 7200], arrival 0..3600, ordered > 0."""
    return {"closed": d.between(0, 7200), "open": (d > 0) & (d <= 7200), "arrival": d.between(0, 3600), "ordered": d > 0}[strict]


def agree(a: Column, b: Column) -> Column:
    """1 if both are present and equal, else 0."""
    return F.coalesce(a == b, F.lit(False)).cast("int")


def within(t: Column, lo: int, hi: int) -> Column:
    """t, or null outside of [lo, hi]."""
    return F.when(t.between(lo, hi), t)


def strictly_above(c: Column, edges: list[float]) -> Column:
    """Number of edges below c; -1 for null."""
    n = sum(((c > e).cast("int") for e in edges[1:]), (c > edges[0]).cast("int"))
    return F.coalesce(n, F.lit(-1))


def cut_right(c: Column, edges: list[float]) -> Column:
    """Index of the right-closed bin (edge[i], edge[i+1]], null outside."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out = F.when((c > lo) & (c <= hi), F.lit(i)).otherwise(out)
    return out
