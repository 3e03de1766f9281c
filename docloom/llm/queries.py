"""The registered queries of this subpackage; each over its whole tables."""

from __future__ import annotations

from docloom.llm import q_corpus, q_names, q_text

_MODULES = (q_text, q_names, q_corpus)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
