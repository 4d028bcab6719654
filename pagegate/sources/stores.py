"""Append-only tables and JSON outputs. Every writer is safe to repeat."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.operators.history import new_rows
from pagegate.session import cut_lineage

C = F.col


def read_or_empty(spark: SparkSession, path: str, like: DataFrame, kind: str = "parquet") -> DataFrame:
    """The stored table, or an empty one of the same columns before the first write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return like.limit(0)
    return spark.read.schema(like.schema).format(kind).load(path)


def append_new(rows: DataFrame, path: str, key: str | list[str], partition_by: list[str] | None = None, kind: str = "parquet") -> None:
    """Appends rows whose key is not stored yet; a second run of the same rows adds nothing. One writer at a time."""
    fresh = cut_lineage(new_rows(rows, read_or_empty(rows.sparkSession, path, rows, kind), key))
    if fresh.isEmpty():
        return
    writer = fresh.write.mode("append").format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def clean_label(label: str) -> str:
    """The label as a folder name: every run of other characters than ASCII letters, digits, dot, underscore and dash becomes one dash."""
    return re.sub("[^A-Za-z0-9._-]+", "-", label).strip("-") or "baseline"


def save_baseline(results: DataFrame, store: str, label: str) -> None:
    """Keeps scan results under a label; saving the label again replaces it."""
    (
        results.withColumn("label", F.lit(clean_label(label)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("label")
        .parquet(store)
    )


def labels(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).select("label").distinct()


def scan_records(results: DataFrame) -> DataFrame:
    """Light record of each scan; one that skipped suites is marked partial."""
    skipped = F.coalesce(C("skipped.suites"), F.array().cast("array<string>"))
    return results.select(
        "host", "target", C("generated").alias("ts"), "verdict", "score", "ready", (F.size(skipped) > 0).alias("partial"),
        skipped.alias("skipped_suites"),
    )


def record_scans(results: DataFrame, path: str) -> None:
    """Appends the record of each scan once; a scan is its target and time."""
    append_new(scan_records(results), path, ["host", "target", "ts"], ["host"])


def append_cases(cases: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Portfolio ledger as JSON lines; a case is known by `key`, or by all its columns."""
    append_new(cases, path, key or cases.columns, kind="json")


def append_ids(minted: DataFrame, path: str) -> None:
    """Identity ledger; known identities of a site and type are left out, so ids never change."""
    append_new(minted, path, [c for c in minted.columns if c != "id"])


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, one per finding, in folders by site and, where there is one, scan. Only the folders of the sites
    and scans at hand are replaced."""
    folders = [c for c in ("site", "scan_id") if c in findings.columns]
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).json(path)
