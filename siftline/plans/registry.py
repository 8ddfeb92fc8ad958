"""All core queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.plans import browse, retrieval, text

MODULES = (text, retrieval, browse)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Best records for a batch of questions."""
    return retrieval.bm25_topk(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
