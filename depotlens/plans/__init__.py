"""Importing this package registers every query."""

from depotlens.plans import (  # noqa: F401
    catalog_clean,
    catalog_joins,
    catalog_rollups,
    catalog_kpi,
    catalog_windows,
    catalog_reshape,
    catalog_supply,
    catalog_ledger,
    catalog_forecast,
    catalog_sources,
    catalog_stream,
)
from depotlens.plans.registry import QUERIES, STEPS, query  # noqa: F401
