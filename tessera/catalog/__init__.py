"""Registered queries (one per operator key) and their DuckDB oracle SQL.

Each submodule defines ``QUERIES: dict[name, fn(spark, sf_dir) -> DataFrame]``
and ``SQL: dict[name, str]``.  Every query reads the fixture tables (or data
Spark derives from them) in full.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ["pages", "documents", "profile", "retrieval", "training", "relational", "sources",
           "streams"]


def _load():
    queries, sql = {}, {}
    for m in MODULES:
        mod = import_module(f"{__name__}.{m}")
        queries.update(mod.QUERIES)
        sql.update(getattr(mod, "SQL", {}))
    return queries, sql


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
