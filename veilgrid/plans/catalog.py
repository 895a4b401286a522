"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from veilgrid.plans import analysis_queries, finding_queries, literal_queries, program_queries

_MODULES = (literal_queries, finding_queries, program_queries, analysis_queries)


def queries():
    found = {}
    for module in _MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql():
    found = {}
    for module in _MODULES:
        found.update(module.ORACLE_SQL)
    return found
