"""The page context: what every page rule reads, derived from a stored response once.

Each stage is its own projection. Catalyst keeps a projection apart when the next one reads an
expensive column more than once, so head, main text and prose are computed once per page; columns no
chosen rule reads are pruned away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegate.functions import html as H
from pagegate.functions.html import header
from pagegate.functions.text import WS, reading
from pagegate.functions.urls import detect_env
from pagegate.operators.detect_advisory import paragraph_words, rhythm
from pagegate.operators.detect_static import located_images

KEYS = ("site", "scan_id")

Q = H.Q


def html_pages(crawl: DataFrame) -> DataFrame:
    """Pages that can be audited: status 200 and HTML. The status test reaches the file scan."""
    return crawl.filter(F.col("status") == 200).filter(H.is_html(F.col("body"), F.col("content_type")))


def page_ctx(crawl: DataFrame, env: str | None = None) -> DataFrame:
    """Context columns for every stored response. `env` fixes the environment; else the host tells."""
    base = crawl.select(
        *KEYS,
        "url",
        F.col("ord") if "ord" in crawl.columns else F.lit(0).alias("ord"),
        "status",
        "headers",
        "content_type",
        "location",
        (F.lit(env) if env else detect_env(F.col("site"))).alias("env"),
        F.coalesce(F.col("body"), F.lit("")).alias("html"),
        H.is_html(F.coalesce(F.col("body"), F.lit("")), F.col("content_type")).alias("is_html"),
    )
    html = F.col("html")
    sliced = base.select(
        "*",
        H.head_slice(html).alias("head"),
        H.main_slice(html).alias("main"),
        H.title_of(html).alias("title"),
        H.find_all(html, r"(?i)<img\b[^>]*>").alias("imgs"),
        H.find_all(html, r"(?i)<h([1-6])\b", 1).alias("levels"),
        H.first_doctype(html).alias("doctype"),
        H.hidden_removed(html).alias("shown"),
        F.lower(html).alias("html_lower"),
    )
    head, main, shown = F.col("head"), F.col("main"), F.col("shown")
    read = sliced.select(
        "*",
        H.visible_prose(shown).alias("visible"),
        H.strip_tags(main).alias("text"),
        H.meta_content(head, "description").alias("description"),
        F.lower(F.coalesce(H.meta_content(head, "robots"), F.lit(""))).alias("robots"),
        F.regexp_extract(head, rf"(?i)<link\b[^>]*rel{WS}*={WS}*{Q}canonical{Q}[^>]*>", 0).alias("canonical_tag"),
        F.lower(header("x-robots-tag")).alias("x_robots"),
        H.find_where(html, F.col("html_lower"), ("<input",), r"(?i)<input\b[^>]*>").alias("inputs"),
        H.find_all(html, r"(?i)<a\b[^>]*>").alias("anchors"),
        F.when(F.size("imgs") > 0, located_images(html)).alias("img_located"),
        rhythm(paragraph_words(H.paragraph_texts(shown))).alias("rhythm"),
    )
    quotes = main.rlike(f"(?i)<(?:{'|'.join(H.QUOTING)})")
    said = read.select(
        "*",
        F.lower("visible").alias("visible_lower"),
        F.when(quotes, H.strip_tags(H.without_code(main))).otherwise(F.col("text")).alias("prose"),
        H.matches(html, r"(?i)<(main|article)\b").alias("has_main"),
    )
    copy = F.when(F.col("prose") != "", F.col("prose")).otherwise(F.col("text"))
    return said.select("*", F.lower("prose").alias("prose_lower"), F.when(F.col("has_main"), reading(copy)).alias("reading"))

