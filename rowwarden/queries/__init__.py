"""Queries over the driver's tables: one for each operator, with SQL that gives the same rows where SQL can."""

from . import contracts, files, planning, reports, texts

_MODULES = (contracts, texts, planning, reports, files)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
