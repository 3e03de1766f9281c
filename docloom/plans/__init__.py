"""The registered queries of the core."""

from docloom.plans import chunking, graphs, nested, relational, retrieval, streams, structure, texts, universal

_MODULES = (nested, relational, retrieval, texts, structure, chunking, graphs, streams, universal)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
