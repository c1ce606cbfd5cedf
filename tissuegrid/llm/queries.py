"""All queries of this package and their SQL."""

from tissuegrid.llm import cell_queries, document_queries, feature_queries, set_queries

_MODULES = (cell_queries, set_queries, feature_queries, document_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
