"""Registered queries over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from . import book, catalogue, features, feeds, market, merging, models, more, simulations, statistics, streams

FAMILIES = (market, merging, features, statistics, simulations, more, book, feeds, models, streams, catalogue)
QUERIES = {name: f for family in FAMILIES for name, f in family.QUERIES.items()}
ORACLE = {name: sql for family in FAMILIES for name, sql in family.ORACLE.items()}
