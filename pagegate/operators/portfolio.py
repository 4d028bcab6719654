"""Portfolio of certified migrations: `portfolio_case(seq, name, category, source, target, at,
verdict, is_reference, pages, assets, forms, globals, inventory, findings, blocking, runtime_ms)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegate.functions.text import round_half_up

C = F.col

# Kinds of site the portfolio should cover.
CATEGORIES = (
    "small-brochure", "corporate", "large-marketing", "blog", "woocommerce", "membership", "lms", "multi-language",
    "large-asset-library", "high-page-count", "reference",
)


def with_superseded(cases: DataFrame) -> DataFrame:
    """Marks all but the newest run of each source and target pair."""
    newest = cases.groupBy("source", "target").agg(F.max("seq").alias("newest"))
    return cases.join(newest, ["source", "target"]).withColumn("superseded", C("seq") != C("newest")).drop("newest")


def cumulative(cases: DataFrame) -> DataFrame:
    """Statistics over the current runs."""
    cur = with_superseded(cases).filter("NOT superseded")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias("total_" + c)
    return cur.agg(
        F.count("*").alias("projects"), F.count_if(~C("is_reference")).alias("real_projects"),
        *[total(c) for c in ("pages", "assets", "forms", "globals", "inventory", "findings", "blocking")],
        round_half_up(F.sum("runtime_ms") / F.greatest(F.count("*"), F.lit(1))).alias("avg_runtime_ms"),
        F.count_if(C("verdict") == "PASS").alias("n_pass"), F.count_if(C("verdict") == "PASS WITH MINOR ISSUES").alias("n_minor"),
        F.count_if(C("verdict") == "FAIL").alias("n_fail"), F.count_distinct("category").alias("categories"),
    )


def category_coverage(cases: DataFrame) -> DataFrame:
    """Qualified real migrations per category and verdict, with subtotals; reference runs do not count."""
    real = cases.filter("NOT is_reference")
    return real.cube("category", "verdict").agg(F.count("*").alias("cases"))


def missing_categories(cases: DataFrame) -> DataFrame:
    wanted = cases.sparkSession.createDataFrame([(c,) for c in CATEGORIES if c != "reference"], "category string")
    return wanted.join(cases.filter("NOT is_reference").select("category").distinct(), "category", "left_anti")
