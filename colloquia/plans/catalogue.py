"""All registered queries."""

from colloquia.plans import catalog_queries, content_queries, coverage_queries, media_queries, run_queries  # noqa: F401
from colloquia.plans.registry import ORACLES, QUERIES  # noqa: F401
