"""All registered queries and their SQL."""

from __future__ import annotations

from . import core, loc, more, ops

MODULES = (core, loc, ops, more)
QUERIES = {k: f for m in MODULES for k, f in m.Q.items()}
ORACLE_SQL = {k: f for m in MODULES for k, f in m.O.items()}
