"""All core queries and the SQL that gives the same rows."""

from weblens.queries import documents, events, instants, more, pages, payloads, ranking, relational, scalars

MODULES = [instants, scalars, ranking, events, relational, pages, more, payloads, documents]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
