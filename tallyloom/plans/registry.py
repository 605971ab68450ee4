"""All queries over the star-schema tables, and the SQL they are compared with."""

from __future__ import annotations

from . import cleaning, filed, fundamentals, kin, lab, linked, market, models, peers, relational, serve, signals, streams, trading

_MODULES = [signals, cleaning, linked, filed, fundamentals, market, models, peers, kin, lab, relational, serve, streams, trading]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
