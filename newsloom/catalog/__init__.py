"""Every query of the library over the given tables, with its independent DuckDB statement."""

from __future__ import annotations

from newsloom.catalog import curation, dedup, ledgers, reading, search, sources, texts

_MODULES = (sources, texts, curation, dedup, reading, ledgers, search)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
