"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from variantlab.plans import cleaning, decisions, features, inputs, modelling, reports, splitting, statistics  # noqa: F401  they register their queries
from variantlab.plans.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
