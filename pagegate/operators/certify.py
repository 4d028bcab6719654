"""Certification of a migration: what the new site kept, lost and gained, and what that means.

Items of both sites carry `pair`, the migration they belong to. Every step is a join on
(pair, type, identity_key) or an aggregate by item, so nothing depends on the size of one site
fitting anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegate import rules as R
from pagegate.functions.text import round_half_up
from pagegate.functions.urls import path_of
from pagegate.operators.inventory import is_blocking

C = F.col
ITEM_KEY = ["pair", "type", "identity_key"]
FINDING = (
    "pair", "type", "identity_key", "axis", "rule_id", "severity", "detail", "viewport", "confidence",
)


def compare(ref: DataFrame, tgt: DataFrame, allowed: DataFrame | None = None, capped: DataFrame | None = None) -> DataFrame:
    """Full outer match of source and target items.

    result is present, missing, approved-removed or added. `allowed(pair, identity_key)` lists
    removals that were agreed; `capped(pair)` lists migrations whose target crawl hit its page cap,
    where absence cannot be confirmed.
    """
    a = ref.select(*ITEM_KEY, C("meta").alias("ref_meta"), C("page").alias("ref_page"), C("parent").alias("ref_parent"))
    b = tgt.select(*ITEM_KEY, C("meta").alias("tgt_meta"), C("page").alias("tgt_page"), C("parent").alias("tgt_parent"))
    j = a.join(b, ITEM_KEY, "full_outer")
    if allowed is not None:
        ok = allowed.select("pair", "identity_key").distinct().withColumn("ok", F.lit(True))
        j = j.join(ok, ["pair", "identity_key"], "left")
    else:
        j = j.withColumn("ok", F.lit(None).cast("boolean"))
    if capped is not None:
        j = j.join(capped.select("pair").distinct().withColumn("cap", F.lit(True)), "pair", "left")
    else:
        j = j.withColumn("cap", F.lit(None).cast("boolean"))
    meta = F.coalesce("ref_meta", "tgt_meta")
    result = (
        F.when(C("ref_meta").isNull(), "added")
        .when(C("tgt_meta").isNotNull(), "present")
        .when(C("ok"), "approved-removed")
        .otherwise("missing")
    )
    return j.select(
        *ITEM_KEY, result.alias("result"), meta.alias("meta"), F.coalesce("ref_page", "tgt_page").alias("page"),
        F.coalesce("ref_parent", "tgt_parent").alias("parent"), F.coalesce(is_blocking(C("type"), meta), F.lit(False)).alias("blocking"),
        F.coalesce("cap", F.lit(False)).alias("capped"),
    )


def compare_summary(compared: DataFrame) -> DataFrame:
    n = lambda *r: F.count_if(C("result").isin(*r))
    return compared.groupBy("pair", "type").agg(
        n("present", "missing", "approved-removed").alias("ref"), n("present", "added").alias("target"),
        n("present").alias("matched"), n("missing").alias("missing"), n("added").alias("added"),
    )


def completeness_findings(compared: DataFrame) -> DataFrame:
    missing = C("result") == "missing"
    severity = F.when(~missing, "advisory").when(C("capped"), "manual").when(C("blocking"), "blocking").otherwise("advisory")
    detail = (
        F.when(missing & C("capped"), "present on source; target crawl was CAPPED — cannot confirm absence, verify manually")
        .when(missing, "present on source, missing on target")
        .otherwise("page exists only on the migrated site — review whether intentional")
    )
    hit = missing | ((C("result") == "added") & (C("type") == "page"))
    return compared.filter(hit).select(
        *ITEM_KEY, F.lit("completeness").alias("axis"), F.lit(None).cast("string").alias("rule_id"),
        severity.alias("severity"), detail.alias("detail"), F.lit(None).cast("string").alias("viewport"),
        F.when(missing & C("capped"), 0.5).otherwise(1.0).alias("confidence"),
    )


# The axis each suite reports on.
SUITE_AXIS = {
    "functional": "production", "links": "production", "console": "production", "security": "production",
    "crossbrowser": "production", "best-practices": "production", "audit": "production", "forms": "forms",
    "responsive": "responsive", "a11y": "accessibility", "seo": "seo", "performance": "performance", "visual": "visual",
}


def item_type_of_rule(rule_id: Column) -> Column:
    return (
        F.when(rule_id.rlike("^A11Y-00[678]$"), "asset")
        .when(rule_id.startswith("FORM-"), "form")
        .when(rule_id == "FUNC-005", "global")
        .otherwise("page")
    )


def audit_findings(occurrences: DataFrame, ref: DataFrame, tgt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maps audit occurrences `(pair, rule_id, page, detail)` to inventory items.

    An item of the rule's type on that page is meant, else the page itself; the source site's
    inventory is asked first. Returns (findings, orphans that fit no item).
    """
    rules = F.broadcast(R.rules_df(occurrences.sparkSession).select("rule_id", "suite", "severity"))
    axis = F.create_map(*[F.lit(x) for kv in SUITE_AXIS.items() for x in kv])
    occ = occurrences.join(rules, "rule_id", "left").select(
        "pair", "rule_id", "page", "detail",
        item_type_of_rule(C("rule_id")).alias("want"), F.concat(F.lit("page:"), path_of(C("page"))).alias("page_key"),
        F.coalesce(axis[C("suite")], F.lit("production")).alias("axis"),
        F.when(C("severity") == "manual", "manual").when(C("severity").isin("critical", "high"), "blocking").otherwise("advisory").alias("severity"),
    )

    def page_keys(inv: DataFrame, name: str) -> DataFrame:
        return inv.filter("type = 'page'").select("pair", C("identity_key").alias("page_key"), F.lit(True).alias(name))

    def typed(inv: DataFrame, name: str) -> DataFrame:
        shown = inv.filter("type IN ('asset', 'form', 'global')")
        return shown.groupBy("pair", C("type").alias("want"), "page").agg(F.min("identity_key").alias(name))

    j = (
        occ.join(page_keys(ref, "on_ref"), ["pair", "page_key"], "left")
        .join(page_keys(tgt, "on_tgt"), ["pair", "page_key"], "left")
        .join(typed(ref, "ref_item"), ["pair", "want", "page"], "left")
        .join(typed(tgt, "tgt_item"), ["pair", "want", "page"], "left")
    )
    item = F.when(C("on_ref"), C("ref_item")).otherwise(C("tgt_item"))
    mapped = j.filter("on_ref OR on_tgt").select(
        "pair", F.when(item.isNotNull(), C("want")).otherwise("page").alias("type"),
        F.coalesce(item, C("page_key")).alias("identity_key"), "axis", "rule_id", "severity", "detail",
        F.lit(None).cast("string").alias("viewport"), F.lit(1.0).alias("confidence"),
    )
    orphans = j.filter("on_ref IS NULL AND on_tgt IS NULL").groupBy("pair").agg(F.count("*").alias("orphans"))
    return mapped, orphans


def visual_findings(viewports: DataFrame, unmatched: DataFrame, pages: DataFrame, match_min: float = 90, pixel_max: float = 8) -> DataFrame:
    """Visual results per viewport mapped to page items; below 75 a page counts as lost.

    `viewports(pair, path, label, pixel_pct, match_score)`, `unmatched(pair, path)`,
    `pages(pair, identity_key)` are the page items of either site.
    """
    over = F.coalesce(C("pixel_pct") > pixel_max, F.lit(False)) | F.coalesce(C("match_score") < match_min, F.lit(False))
    v = viewports.filter(over).select(
        "pair", F.concat(F.lit("page:"), C("path")).alias("identity_key"), F.lit("VIS-001").alias("rule_id"),
        F.when(C("match_score") < 75, "blocking").otherwise("advisory").alias("severity"),
        F.concat_ws(
            " · ",
            F.concat(C("pixel_pct"), F.lit("% px")),
            F.concat(C("match_score"), F.lit("/100 match")),
        ).alias("detail"),
        C("label").alias("viewport"),
    )
    u = unmatched.select(
        "pair", F.concat(F.lit("page:"), C("path")).alias("identity_key"), F.lit("VIS-002").alias("rule_id"),
        F.lit("blocking").alias("severity"), F.lit("reference page has no visual match on target").alias("detail"),
        F.lit(None).cast("string").alias("viewport"),
    )
    hits = v.unionByName(u).join(pages.select("pair", "identity_key").distinct(), ["pair", "identity_key"], "left_semi")
    return hits.select(
        "pair", F.lit("page").alias("type"), "identity_key", F.lit("visual").alias("axis"), "rule_id", "severity",
        "detail", "viewport", F.lit(1.0).alias("confidence"),
    )


def evidence(compared: DataFrame) -> DataFrame:
    """Evidence package of every compared item."""
    heuristic = C("type").isin("global", "behavior")
    exact = C("type").isin("page", "section", "form", "asset")
    return compared.select(
        *ITEM_KEY,
        F.when(exact, 1.0).when(heuristic, 0.75).otherwise(0.9).alias("detection_confidence"),
        F.coalesce(C("meta")["url"], C("meta")["firstPage"], C("meta")["page"], F.lit("")).alias("page_url"),
        F.when(C("type") == "section", C("meta")["heading"]).otherwise(C("parent")).alias("section"),
        C("result").alias("comparison"),
        F.when(C("result") == "added", "absent on source").otherwise("present on source").alias("before"),
        F.when(C("result").isin("added", "present"), "present on target").otherwise("ABSENT on target").alias("after"),
        F.when(C("result") == "present", 1.0).when(C("result") == "added", F.lit(None)).otherwise(0.0).alias("similarity"),
    )


def certify_items(compared: DataFrame, findings: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """State of each item from its worst finding. `exceptions(pair, identity_key)` were approved."""
    rank = F.when(C("severity") == "blocking", 3).when(C("severity") == "manual", 2).when(C("severity") == "advisory", 1)
    worst = findings.groupBy(*ITEM_KEY).agg(F.max(rank).alias("worst"), F.count("*").alias("findings"))
    j = compared.join(worst, ITEM_KEY, "left")
    if exceptions is not None:
        ex = exceptions.select("pair", "identity_key").distinct().withColumn("excused", F.lit(True))
        j = j.join(ex, ["pair", "identity_key"], "left")
    else:
        j = j.withColumn("excused", F.lit(None).cast("boolean"))
    state = (
        F.when((C("result") == "approved-removed") | C("excused"), "APPROVED")
        .when(C("worst") == 3, "FAIL")
        .when(C("worst") == 2, "MANUAL")
        .when(C("worst") == 1, "WARNING")
        .otherwise("PASS")
    )
    return j.select(*ITEM_KEY, "result", state.alias("certification"), F.coalesce("findings", F.lit(0)).alias("findings"))


STATES = (("PASS", "passed"), ("WARNING", "warning"), ("FAIL", "failed"), ("MANUAL", "manual"), ("APPROVED", "approved"))


def type_gates(items: DataFrame) -> DataFrame:
    return items.groupBy("pair", "type").agg(
        F.count("*").alias("total"),
        *[F.count_if(C("certification") == s).alias(n) for s, n in STATES],
        F.when(F.bool_or(C("certification") == "FAIL"), "FAIL").otherwise("PASS").alias("gate"),
    )


def certificate(items: DataFrame) -> DataFrame:
    """Tally, verdict and confidence of each migration."""
    t = items.groupBy("pair").agg(*[F.count_if(C("certification") == s).alias(n) for s, n in STATES])
    total = sum((C(n) for _, n in STATES), F.lit(0))
    return t.select(
        "*",
        F.when(C("failed") > 0, "FAIL").when((C("warning") > 0) | (C("manual") > 0), "PASS WITH MINOR ISSUES").otherwise("PASS").alias("verdict"),
        F.coalesce(round_half_up(F.try_divide(F.lit(100.0) * (C("passed") + C("approved")), total)), F.lit(100)).cast("int").alias("confidence"),
    )


def explanations(items: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings that explain a verdict: those of items that were not excused."""
    open_ = items.filter("certification <> 'APPROVED'").select(*ITEM_KEY, "certification")
    return findings.join(open_, ITEM_KEY)


def axis_summary(explained: DataFrame) -> DataFrame:
    """Findings by axis and by viewport in one pass: rows of either grouping, told apart by nulls."""
    sev = [F.count_if(C("severity") == s).alias(s) for s in ("blocking", "advisory", "manual")]
    by_axis = explained.groupBy("pair", "axis").agg(*sev).select("pair", F.lit("axis").alias("kind"), C("axis").alias("name"), "blocking", "advisory", "manual")
    by_view = explained.filter("viewport IS NOT NULL").groupBy("pair", "viewport").agg(*sev).select(
        "pair", F.lit("viewport").alias("kind"), C("viewport").alias("name"), "blocking", "advisory", "manual"
    )
    return by_axis.unionByName(by_view)


def report_facts(compared: DataFrame, items: DataFrame, findings: DataFrame) -> DataFrame:
    """Numbers of the migration report that are not in the certificate."""
    c = compared.groupBy("pair").agg(
        F.count_if(C("result") == "missing").alias("completeness_findings"), F.count_if(C("result") == "added").alias("added"),
        F.count_if(C("result") != "added").alias("source_items"),
    )
    f = findings.groupBy("pair").agg(
        F.count_if(C("axis") == "visual").alias("visual_findings"),
        F.count_if(C("rule_id").isNotNull() & (C("axis") != "visual")).alias("production_findings"),
    )
    m = items.groupBy("pair").agg(F.count_if(C("certification") == "MANUAL").alias("manual_items"))
    return c.join(f, "pair", "left").join(m, "pair", "left").fillna(0)


# States an item may move between.
TRANSITIONS = {
    "": "DISCOVERED",
    "DISCOVERED": "MATCHED COMPARED VALIDATED MANUAL_VERIFICATION_REQUIRED IGNORED APPROVED_EXCEPTION FAILED",
    "MATCHED": "COMPARED VALIDATED MANUAL_VERIFICATION_REQUIRED IGNORED APPROVED_EXCEPTION",
    "COMPARED": "VALIDATED MANUAL_VERIFICATION_REQUIRED IGNORED APPROVED_EXCEPTION",
    "VALIDATED": "EVIDENCE_PENDING EVIDENCE_COLLECTED MANUAL_VERIFICATION_REQUIRED IGNORED APPROVED_EXCEPTION",
    "EVIDENCE_PENDING": "EVIDENCE_COLLECTED MANUAL_VERIFICATION_REQUIRED IGNORED APPROVED_EXCEPTION",
    "EVIDENCE_COLLECTED": "PASSED WARNING FAILED MANUAL_VERIFICATION_REQUIRED IGNORED APPROVED_EXCEPTION",
    "PASSED": "IGNORED APPROVED_EXCEPTION",
    "WARNING": "IGNORED APPROVED_EXCEPTION FAILED",
    "FAILED": "APPROVED_EXCEPTION IGNORED",
    "MANUAL_VERIFICATION_REQUIRED": "PASSED WARNING FAILED APPROVED_EXCEPTION IGNORED",
    "IGNORED": "",
    "APPROVED_EXCEPTION": "",
}


def item_history(certified: DataFrame) -> DataFrame:
    """States each item went through, one row per step."""
    end = (
        F.when(C("certification") == "PASS", "PASSED")
        .when(C("certification") == "FAIL", "FAILED")
        .when(C("certification") == "MANUAL", "MANUAL_VERIFICATION_REQUIRED")
        .when(C("certification") == "APPROVED", "APPROVED_EXCEPTION")
        .otherwise("WARNING")
    )
    steps = F.filter(
        F.array(
            F.lit("DISCOVERED"), F.when(C("result") == "present", "MATCHED"), F.lit("COMPARED"), F.lit("VALIDATED"),
            F.lit("EVIDENCE_PENDING"), F.lit("EVIDENCE_COLLECTED"), end,
        ),
        lambda s: s.isNotNull(),
    )
    with_steps = certified.select(*ITEM_KEY, steps.alias("steps"))
    return with_steps.select(
        *ITEM_KEY,
        F.posexplode(
            F.transform(
                C("steps"),
                lambda s, i: F.struct(F.when(i > 0, F.get(C("steps"), i - 1)).alias("from_state"), s.alias("to_state")),
            )
        ).alias("step", "move"),
    ).select(*ITEM_KEY, "step", "move.from_state", "move.to_state")


def illegal_moves(history: DataFrame) -> DataFrame:
    """Steps of item histories the lifecycle does not allow."""
    rows = [(a, b) for a, bs in TRANSITIONS.items() for b in bs.split()]
    allowed = history.sparkSession.createDataFrame(rows, "f string, to_state string")
    return (
        history.withColumn("f", F.coalesce("from_state", F.lit("")))
        .join(F.broadcast(allowed), ["f", "to_state"], "left_anti")
        .drop("f")
    )


def capture_summary(captures: DataFrame) -> DataFrame:
    """How screenshots were taken, per migration, with the first five as samples."""
    from pyspark.sql import Window

    s = captures.groupBy("pair").agg(
        F.count("*").alias("captures"), F.bool_and("fonts_loaded").alias("all_fonts_loaded"),
        F.bool_and("lazy_pass").alias("all_lazy_pass"), F.bool_and("image_decode").alias("all_image_decode"),
        round_half_up(F.avg(F.coalesce("duration_ms", F.lit(0)))).alias("avg_duration_ms"),
    )
    w = Window.partitionBy("pair").orderBy("ord")
    first = captures.withColumn("n", F.row_number().over(w)).filter("n <= 5")
    samples = first.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("n", "context"))).alias("s"))
    return s.join(samples.select("pair", F.transform("s", lambda x: x["context"]).alias("samples")), "pair")
