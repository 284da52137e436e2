"""All registered queries of the engine and their SQL."""

from . import check_queries, field_queries, inference_queries, lattice_queries, optimizer_queries, table_queries

_ALL = (field_queries, inference_queries, lattice_queries, table_queries, optimizer_queries, check_queries)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _ALL for k, q in m.ORACLES.items()}
