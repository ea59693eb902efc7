"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from formloom.plans import cell_queries, file_queries, fill_queries, form_queries, grid_queries, kept_queries, label_queries, price_queries, review_queries, search_queries, span_queries, value_queries, work_queries  # noqa: F401  (they register their queries)
from formloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
