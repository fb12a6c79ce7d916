"""All queries of the reference's own operators."""

from __future__ import annotations

from quarrylens.queries import ingest, lookup, more, search, slots

_MODULES = [lookup, slots, search, ingest, more]
QUERIES = {n: f for m in _MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in _MODULES for n, s in m.SQL.items()}
