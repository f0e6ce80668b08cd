"""All registered queries and oracles."""

from __future__ import annotations

from tidemark.plans import catalog_log, catalog_matrix, catalog_metrics, catalog_models, catalog_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (catalog_log, catalog_matrix, catalog_metrics, catalog_text, catalog_models):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
