"""Every registered query of the engine, by name, with its SQL where SQL can express it."""

from . import graph_queries, part_queries, seam_queries, search_queries, state_queries, store_queries, term_queries, text_queries  # noqa: F401
from .registry import FIXED, ORACLE_SQL, QUERIES

FLAGSHIP = "ret16_search_hybrid"

__all__ = ["FIXED", "FLAGSHIP", "ORACLE_SQL", "QUERIES"]
