"""Tables of rules laid over each other, and columns that stand in for each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that df has and whose trimmed value is not empty."""
    there = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by a total order: an aggregated least row, so that no key's rows are sorted together."""
    rest = [c for c in df.columns if c not in keys]
    ranks = [F.col(c).alias(f"__o{i}") if isinstance(c, str) else c.alias(f"__o{i}") for i, c in enumerate(order)]
    least = F.min(F.struct(*ranks, F.struct(*rest).alias("__row"))).alias("__least")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"__least.__row.{c}").alias(c) for c in rest])


def overlay(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of layers of one schema; a key's rows come from the first layer that has the key."""
    marked = [layer.withColumn("__layer", F.lit(i)) for i, layer in enumerate(layers)]
    rows = reduce(DataFrame.unionByName, marked)
    first = rows.groupBy(*keys).agg(F.min("__layer").alias("__first"))
    return rows.join(first, keys).where("__layer = __first").drop("__layer", "__first")
