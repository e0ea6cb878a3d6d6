"""All queries of the core, with the SQL they must agree with."""

from __future__ import annotations

from plainsift.plans import containers, joins, markups, oracle, pipeline, reports, structures, texts, vectors

MODULES = (oracle, joins, markups, reports, texts, vectors, containers, structures, pipeline)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
FLAGSHIP = oracle.variance_decompose
