"""Ordered computations inside groups of any size.

A plain window puts a whole group in one task. Here rows are first range-partitioned by (keys,
order) into blocks of even size, ranked inside each block, and shifted by the sizes of the blocks
before. Only one row per (group, block) meets in the second step. The blocks are checkpointed before
they are read twice, so both readings see the same borders even after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegate.session import cut_lineage


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based position of each row within its group by `order`, which must be unique per group."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocked = cut_lineage(
        df.repartitionByRange(parts, *keys, *order).withColumn("__block", F.spark_partition_id())
    )
    sizes = blocked.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    ranked = blocked.withColumn("__r", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, "__block"])
        .withColumn(name, (F.col("__r") + F.col("__offset")).cast("long"))
        .drop("__block", "__r", "__offset")
    )


def with_previous(df: DataFrame, keys: list[str], pos: str, columns: dict[str, str], step: int = 1) -> DataFrame:
    """Adds columns of the row `step` positions before (after, when negative), by an equal join on
    the position. `columns` maps existing names to the names of the copies."""
    other = df.select(*keys, (F.col(pos) + step).alias(pos), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(other, [*keys, pos], "left")


BLOCK = 4096


def running_max(df: DataFrame, keys: list[str], pos: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Largest `value` up to each position. Windows span at most `block` rows, then one row per block."""
    b = df.withColumn("__b", F.floor((F.col(pos) - 1) / block))
    inside = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = b.groupBy(*keys, "__b").agg(F.max(value).alias("__m")).select(*keys, "__b", F.max("__m").over(before).alias("__p"))
    return (
        b.join(tops, [*keys, "__b"])
        .withColumn(name, F.greatest(F.max(value).over(inside), F.col("__p")))
        .drop("__b", "__p")
    )


def running_sum(df: DataFrame, keys: list[str], pos: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    b = df.withColumn("__b", F.floor((F.col(pos) - 1) / block))
    inside = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy(*keys, "__b").agg(F.sum(value).alias("__m")).select(
        *keys, "__b", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__p")
    )
    return (
        b.join(sums, [*keys, "__b"])
        .withColumn(name, F.sum(value).over(inside) + F.col("__p"))
        .drop("__b", "__p")
    )
