"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from tideline.plans import queries_contracts, queries_ledger, queries_measures, queries_more, queries_planning, queries_receipts, queries_rest, queries_scalar, queries_sources  # noqa: F401
from tideline.plans.catalog import QUERIES, SQL  # noqa: F401
