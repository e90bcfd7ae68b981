"""Importing this module registers every query."""

from doselake.plans import (  # noqa: F401
    join_queries,
    matrix_queries,
    model_queries,
    network_queries,
    select_queries,
    source_queries,
    split_queries,
    stat_queries,
    stream_queries,
)
from doselake.plans.catalog import CATALOG

__all__ = ["CATALOG"]
