"""All registered queries of the library with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofact.plans import catalog_entities, catalog_facts, catalog_links, catalog_more, catalog_planning, catalog_retrieval, catalog_search, catalog_temporal

MODULES = [catalog_facts, catalog_temporal, catalog_retrieval, catalog_entities, catalog_links, catalog_planning, catalog_more, catalog_search]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked evidence for a phrase over the mixed corpus."""
    return catalog_retrieval.search_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return catalog_more.FOLDS | {k: s for m in MODULES for k, s in m.SQL.items()}
