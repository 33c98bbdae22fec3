"""Registered queries: every operator applied to the shared test tables, with comparison SQL."""

from towline.catalog.base import REGISTRY
from towline.catalog import (  # noqa: F401  (importing a module registers its queries)
    aggregate_queries,
    cleaning_queries,
    distribution_queries,
    estimator_queries,
    join_queries,
    pipeline_queries,
    resampling_queries,
    source_queries,
)

__all__ = ["REGISTRY"]
