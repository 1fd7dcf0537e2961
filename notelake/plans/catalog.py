"""All core queries; the optional subpackages are added by the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .general import general
from .vault import vault
from .views import shown
from .writing import writing
from .registry import Query

PARTS = (general, vault, writing, shown)


def queries() -> dict[str, Query]:
    return {k: v for p in PARTS for k, v in p.queries.items()}


def sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.sql.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return vault.queries["search_hybrid"](spark, folder)
