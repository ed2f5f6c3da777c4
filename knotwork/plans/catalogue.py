"""All queries of the core, by name, and the SQL that checks them."""

from __future__ import annotations

from knotwork.plans import audit, evaluate, files, general, graph, linking, retrieval, seeds, streams, text, traverse, verdict

_MODULES = (general, audit, text, retrieval, graph, traverse, evaluate, streams, files, seeds, linking, verdict)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
