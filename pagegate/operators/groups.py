"""Group statistics put back on their rows without gathering a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def with_group_stats(
    df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner", spread_by: Column | None = None, salts: int = SALTS
) -> DataFrame:
    """Joins rows with per-group statistics. Rows of a hot group are dealt over `salts` buckets and
    each group's single statistics row is repeated once per bucket, so no task meets the whole group."""
    salt = F.pmod(F.xxhash64(spread_by) if spread_by is not None else F.xxhash64(*df.columns), F.lit(salts))
    left = df.withColumn("__salt", salt)
    right = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def duplicates(pages: DataFrame, text: str, keys: list[str], page: str = "url") -> DataFrame:
    """Pages whose text is shared within the keys, with the number of pages sharing it."""
    shared = pages.groupBy(*keys, text).agg(F.count("*").alias("shared_by")).filter("shared_by > 1")
    return with_group_stats(pages, shared, [*keys, text], spread_by=F.col(page))
