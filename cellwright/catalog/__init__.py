"""Registered queries on the given tables, each with the same question in SQL where SQL can ask it."""

from cellwright.catalog import cells, coded, estimation, flows, models, panels, recodes, sources, tabulations

_MODULES = (cells, sources, recodes, tabulations, panels, flows, estimation, models, coded)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
