"""Registered queries: each pairs a Spark plan with the SQL it must agree with."""

from __future__ import annotations

from . import aggregates, audits, base, estimates, extras, features, joins, models, scalars, windows
from . import wide

__all__ = ["aggregates", "audits", "base", "estimates", "extras", "features", "joins", "models", "oracles", "queries", "scalars", "wide", "windows"]


def queries():
    return base.QUERIES


def oracles():
    return base.ORACLES
