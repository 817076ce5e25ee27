"""Joins by place: pairs of near segments by way of grid cells.

Coordinates are local metres within a key (an airport). Equality joins on cells bring together what can be near; exact
predicates decide. No pair is made beyond those that share a cell, and none twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(c: Column, cell_m: float) -> Column:
    return F.floor(c / cell_m).cast("long")


def segment_pairs(s: DataFrame, key: list[str], id_col: str, reach_m: float, cell_m: float, others: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of different segments of a key whose boxes lie within reach_m: the columns of s, and those of the other with the prefix o_.

    The second of a pair is of `others` (of s without them), which have the same columns. s has the ends le_x, le_y, he_x, he_y. A segment stands in each cell that its box, widened by half of reach_m, touches;
    a pair is kept only in the least cell that both boxes touch, so that it comes once. Rows with a null key or coordinate have no pairs.
    """
    half = reach_m / 2
    ends = {"x": ("le_x", "he_x"), "y": ("le_y", "he_y")}
    box = {f"__lo_{a}": _cell(F.least(*c) - half, cell_m) for a, c in ends.items()} | {f"__hi_{a}": _cell(F.greatest(*c) + half, cell_m) for a, c in ends.items()}

    def in_cells(rows: DataFrame) -> DataFrame:
        placed = rows.dropna(subset=[*key, "le_x", "le_y", "he_x", "he_y"]).withColumns(box)
        return placed.withColumn("__cx", F.explode(F.sequence("__lo_x", "__hi_x"))).withColumn("__cy", F.explode(F.sequence("__lo_y", "__hi_y")))

    cells, other = in_cells(s), in_cells(s if others is None else others.select(*s.columns))
    other = other.select(*[F.col(c).alias(f"o_{c}") for c in other.columns])
    on = (F.col("__cx") == F.col("o___cx")) & (F.col("__cy") == F.col("o___cy")) & (F.col(id_col) != F.col(f"o_{id_col}"))
    for k in key:
        on = on & (F.col(k) == F.col(f"o_{k}"))
    least = (F.col("__cx") == F.greatest("__lo_x", "o___lo_x")) & (F.col("__cy") == F.greatest("__lo_y", "o___lo_y"))
    return cells.join(other, on & least).select(*s.columns, *[f"o_{c}" for c in s.columns])
