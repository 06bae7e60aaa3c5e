"""Importing this module fills the catalog."""

from tillwatch.plans import feature_queries, fleet_queries, model_queries, raw_queries  # noqa: F401
from tillwatch.plans.catalog import CATALOG  # noqa: F401
