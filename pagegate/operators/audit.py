"""The site audit end to end: one detection pass, site rules, rows, coverage, scores."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegate import rules as R
from pagegate.operators import rows as W
from pagegate.operators.detect_advisory import ADVISORY
from pagegate.operators.detect_interaction import INTERACTION
from pagegate.operators.detect_more import INDEXING, SECURITY, STRUCTURE
from pagegate.operators.detect_static import SEO, STATIC
from pagegate.operators.findings import ITEMS, Detector, Hit, detect, text
from pagegate.operators.groups import duplicates
from pagegate.operators.page_ctx import KEYS, page_ctx
from pagegate.session import cut_lineage

C = F.col

# Checks only the migration gate runs.
MIGRATION_ONLY = ("staging-leak", "security-headers")


def page_detectors(skip_suites: Iterable[str] = ()) -> list:
    """Detectors of the site audit whose suite is on. Interaction runs when any of its suites is."""
    keep = set(W.chosen_checks(skip_suites))
    out = [d for k, d in STATIC.items() if k in keep and k not in MIGRATION_ONLY]
    for group in (SECURITY, INDEXING, STRUCTURE):
        out += [d for k, d in group.items() if k in keep]
    if keep & {"interactive-link", "interactive-control", "interactive-nesting"}:
        out += list(INTERACTION.values())
    return out


SHARED = (("title", "SEO-009", "duplicate-title"), ("description", "SEO-010", "duplicate-description"))
_TOLD = "page-facts"


def _told_hits() -> list[Hit]:
    live = C("is_html") & (C("status") == 200)
    return [Hit(rule_id, SEO, live & (F.trim(column) != ""), "", F.trim(column)) for column, rule_id, _ in SHARED]


TELL = Detector(_TOLD, _told_hits)


def told(ctx: DataFrame, detectors: Iterable[Detector]) -> DataFrame:
    """Findings of the detectors, and beside them the titles and descriptions of pages, in one pass over the HTML.
    They are written once; whatever compares pages with each other reads these narrow rows."""
    return cut_lineage(detect(ctx, [*detectors, TELL]))


def duplicate_findings(facts: DataFrame) -> DataFrame:
    """Titles and descriptions shared by several auditable pages of a site, from what `told` wrote."""
    out = None
    for _, rule_id, check in SHARED:
        mine = facts.filter((C("check_id") == _TOLD) & (C("rule_id") == rule_id))
        pages = mine.select(*KEYS, "url", "ord", C("value").alias("shared"))
        dup = duplicates(pages, "shared", list(KEYS)).select(
            *KEYS, "url", "ord", F.lit(rule_id).alias("rule_id"), F.lit(check).alias("check_id"),
            F.lit(SEO).alias("section"),
            text("shared by ", C("shared_by"), ' pages: "', F.substring("shared", 1, 50), '"').alias("detail"),
            C("shared_by").cast("string").alias("value"), F.lit(None).cast(ITEMS).alias("items"),
        )
        out = dup if out is None else out.unionByName(dup)
    return out


def page_findings(
    crawl: DataFrame, env: str | None = "live", skip_suites: Iterable[str] = (), beside: Iterable[Detector] = ()
) -> DataFrame:
    """Findings of the audit, and in the same pass those of the detectors to run `beside` it."""
    ctx = page_ctx(crawl, env)
    detectors = [*page_detectors(skip_suites), *beside]
    if "seo" in W.normalize_skip(skip_suites):
        return detect(ctx, detectors)
    facts = told(ctx, detectors)
    return facts.filter(C("check_id") != _TOLD).unionByName(duplicate_findings(facts))


def gate_findings(crawl: DataFrame, env: str | None = None) -> DataFrame:
    """Findings of the migration gate: every static rule, in the environment of each host."""
    return detect(page_ctx(crawl, env), STATIC.values())


def advisory_findings(crawl: DataFrame) -> DataFrame:
    return detect(page_ctx(crawl, "live"), ADVISORY.values())


class Audit(NamedTuple):
    findings: DataFrame
    coverage: DataFrame
    rows: DataFrame
    advisory: DataFrame


def audit(
    crawl: DataFrame, site_findings: DataFrame | None = None, failures: DataFrame | None = None, skip_suites: Iterable[str] = (),
    advisory: bool = False,
) -> Audit:
    """Findings, coverage and check rows of every site of a crawl, and where asked for the findings of the advisory rules.

    Findings and coverage are written once: rows, scores and lists read them several times, and the
    pages must be read only once.
    """
    found = page_findings(crawl, "live", skip_suites, ADVISORY.values() if advisory else ())
    if site_findings is not None:
        off = W.normalize_skip(skip_suites)
        dropped = [c for c, (suite, _) in R.CHECKS.items() if suite in off]
        found = found.unionByName(site_findings.filter(~C("check_id").isin(*dropped)))
    every = cut_lineage(found)
    found = every.filter(~C("check_id").isin(*ADVISORY)) if advisory else every
    coverage = cut_lineage(W.verified(W.ledger(crawl, failures), skip_suites))
    rows = W.check_rows(found).unionByName(W.evidence_rows(coverage, found))
    return Audit(found, coverage, rows, every.filter(C("check_id").isin(*ADVISORY)))


def advisory_rows(sites: DataFrame, advisory: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """A row per site and advisory rule: loose symbols and misspellings count, markup and copy only inform.

    Copy rows are always `manual`; phrases also carry their density per thousand words, where the words of a site are given.
    """
    spark = sites.sparkSession
    facts = F.broadcast(R.rules_df(spark).select("rule_id", "title", "severity", C("suite").alias("rule_suite")))
    ids = [r["rule_id"] for r in R.rule_rows() if r["suite"] in ("best-practices", "copy")] + ["FUNC-008", "FUNC-009"]
    asked = sites.select(*KEYS).distinct().select("*", F.explode(F.array(*[F.lit(i) for i in ids])).alias("rule_id"))
    hits = advisory.groupBy(*KEYS, "rule_id").agg(
        F.sum(F.size("items")).alias("occurrences"), F.count_distinct("url").alias("pages")
    )
    j = asked.join(hits, [*KEYS, "rule_id"], "left").join(facts, "rule_id")
    j = j.withColumn("words", F.lit(None).cast("long")) if words is None else j.join(words, list(KEYS), "left")
    n = F.coalesce(C("occurrences"), F.lit(0))
    density = F.round(F.try_divide(n * 1000.0, C("words")), 1)
    share = "" if words is None else text(", ", F.format_string("%.1f", density), " in a thousand words")
    status = (
        F.when(C("rule_suite") == "copy", "manual")
        .when(n == 0, "pass")
        .when(C("severity").isin("critical", "high"), "fail")
        .otherwise("warn")
    )
    detail = (
        F.when((n == 0) & (C("rule_suite") == "copy"), "clean — nothing flagged for review")
        .when((n == 0) & (C("rule_suite") == "best-practices"), "ok")
        .when(n == 0, "clean")
        .when(C("rule_id") == "COPY-003", text(n, " phrases to look at", share, "; the score is not changed"))
        .when(C("rule_suite") == "copy", text(n, " items to look at; the score is not changed"))
        .when(C("rule_id") == "FUNC-008", text(n, " loose symbols"))
        .when(C("rule_id") == "FUNC-009", text(n, " words to check"))
        .otherwise(text(n, " times"))
    )
    return j.select(
        *KEYS, C("rule_suite").alias("suite"), F.lit("advisory").alias("check_id"), status.alias("status"),
        C("title").alias("name"), "rule_id", F.lit("").alias("target"), detail.alias("detail"), F.lit("").alias("value"),
        n.cast("long").alias("occurrences"), F.coalesce(C("pages"), F.lit(0)).alias("pages"),
        F.lit(False).alias("not_run"), F.lit(None).cast("string").alias("reason"),
    )
