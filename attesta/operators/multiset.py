"""Multiset difference both ways, per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, missing, extra``: how often a value stands more often on the left, or on the right.

    Both sides are counted before they meet, so equal values cost one row each.
    """
    counts = (
        left.select(*keys, F.col(value).alias("value"), F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(*keys, F.col(value).alias("value"), F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(*keys, "value").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    return _unequal(counts, keys)


def array_difference(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """The same of two arrays in each row: rows are read once for both sides."""
    one = lambda c, l, r: F.transform(c, lambda x: F.struct(x.alias("value"), F.lit(l).alias("l"), F.lit(r).alias("r")))  # noqa: E731, E741
    values = rows.select(*keys, F.explode(F.concat(one(left, 1, 0), one(right, 0, 1))).alias("x")).select(*keys, "x.*")
    return _unequal(values.groupBy(*keys, "value").agg(F.sum("l").alias("l"), F.sum("r").alias("r")), keys)


def _unequal(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.where("l <> r").select(*keys, "value", F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("missing"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("extra"))
