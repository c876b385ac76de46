"""The registered queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversation, entities, evaluation, evidence, planner, quality, replies, rules, selection, text  # noqa: F401  the modules register their queries
from .common import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["prune_paragraphs"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
