"""Rules over facts a browser captured: layout, contrast, console, vitals, fonts, engines.

Every element that breaks a rule is a row; a report that wants the first few ranks them itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegate.functions.grades import contrast_ratio

C = F.col
PAGE = ["site", "page"]
VIEW = ["site", "page", "viewport"]


def _hit(df: DataFrame, rule: str, value: Column, view: bool = True) -> DataFrame:
    viewport = C("viewport") if view else F.lit(None).cast("string")
    return df.select(*PAGE, viewport.alias("viewport"), F.lit(rule).alias("rule_id"), F.coalesce(C("selector") if "selector" in df.columns else F.lit(""), F.lit("")).alias("selector"), value.cast("string").alias("value"))


def overflow(docs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pages wider than their viewport, and all elements that bleed out of them.
    `docs(.., width, doc_width)`, `boxes(.., selector, pos, x, w, h)`."""
    wide = docs.filter(C("doc_width") > C("width") + 2)
    page = _hit(wide, "RESP-002", F.concat("doc_width", F.lit("px")))
    right = C("x") + C("w")
    out = boxes.join(wide.select(*VIEW, "width"), VIEW).filter(
        (right > C("width") + 1) & (C("w") <= C("width") * 1.5) & (C("w") > 4)
    ).withColumn("bleed", right - C("width"))
    return page.unionByName(_hit(out, "RESP-003", F.concat(F.lit("+"), "bleed", F.lit("px"))))


def too_wide(docs: DataFrame, boxes: DataFrame) -> DataFrame:
    out = boxes.join(docs.select(*VIEW, "width"), VIEW).filter(C("w") > C("width") + 1)
    return _hit(out, "RESP-004", F.concat("w", F.lit("px")))


def touch_targets(docs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Small tap targets and small input fonts, on viewports that are touched."""
    b = boxes.join(docs.filter("touch").select(*VIEW), VIEW)
    small = b.filter(C("interactive") & ((C("w") < 44) | (C("h") < 44)))
    font = b.filter(C("is_field") & (C("font_size") < 16))
    return _hit(small, "RESP-005", F.concat("w", F.lit("x"), "h")).unionByName(_hit(font, "RESP-006", F.concat("font_size", F.lit("px"))))


def low_contrast(texts: DataFrame) -> DataFrame:
    """Text below AA contrast: 4.5, or 3 for large text. One row for each selector of a page."""
    large = (C("font_size") >= 24) | ((C("font_size") >= 18.66) & (C("weight") >= 700))
    t = texts.withColumn("ratio", contrast_ratio(C("fg"), C("bg"))).filter(C("ratio") < F.when(large, 3.0).otherwise(4.5))
    once = t.groupBy(*PAGE, "selector").agg(F.min_by(F.struct("ratio", "pos"), "pos").alias("m"))
    return _hit(once.select(*PAGE, "selector", "m.ratio", "m.pos"), "A11Y-002", F.format_string("%.2f", F.round("ratio", 2)), view=False)


def wcag_violations(violations: DataFrame) -> DataFrame:
    """Violations of a page with the severity their impact stands for."""
    sev = F.when(C("impact").isin("critical", "serious"), "high").when(C("impact") == "moderate", "medium").otherwise("low")
    return violations.select(*PAGE, F.lit("A11Y-001").alias("rule_id"), "violation", "impact", sev.alias("severity"))


def console_and_network(console: DataFrame, failed: DataFrame) -> DataFrame:
    """Console errors counted, failed requests counted once each."""
    a = console.groupBy(*PAGE).agg(F.count("*").alias("n")).select(*PAGE, F.lit("CON-001").alias("rule_id"), "n")
    b = failed.groupBy(*PAGE).agg(F.count_distinct("request").alias("n")).select(*PAGE, F.lit("CON-002").alias("rule_id"), "n")
    return a.unionByName(b)


def page_weight(requests: DataFrame) -> DataFrame:
    w = requests.groupBy(*PAGE).agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"))
    return w.filter((C("requests") > 120) | (C("bytes") > 4 * 1048576)).withColumn("rule_id", F.lit("PERF-006"))


def web_vitals(entries: DataFrame) -> DataFrame:
    """Largest paint and layout shift per page. No entry means not measured, never a good value."""
    v = entries.groupBy(*PAGE).agg(
        F.max(F.when(C("kind") == "lcp", C("value"))).alias("lcp"),
        F.sum(F.when((C("kind") == "cls") & ~C("recent_input"), C("value"))).alias("shift"),
        F.bool_or(C("kind") == "cls").alias("cls_seen"),
    )
    cls = F.when(C("cls_seen"), F.coalesce("shift", F.lit(0.0)))
    grade = lambda c, ok, poor: F.when(c.isNull(), "unmeasured").when(c > poor, "poor").when(c > ok, "needs-improvement").otherwise("good")
    return v.select(*PAGE, "lcp", F.round(cls, 3).alias("cls"), grade(C("lcp"), 2500, 4000).alias("lcp_grade"), grade(F.round(cls, 6), 0.1, 0.25).alias("cls_grade"))


# Families every machine may resolve by itself.
GENERIC = (
    "(?i)^(serif|sans-serif|monospace|cursive|fantasy|system-ui|ui-|-apple-|blinkmac|segoe|roboto|helvetica|arial|georgia|times|"
    "courier|tahoma|verdana|inherit|initial)"
)


def sample_choice(samples: DataFrame) -> DataFrame:
    """One sample per family: the first italic one, or the first."""
    upright = ~C("style").rlike("^(italic|oblique)")
    return samples.groupBy(*PAGE, "family").agg(F.min_by(F.struct("selector", "weight", "style"), F.struct(upright, C("pos"))).alias("s"))


def font_findings(faces: DataFrame, used: DataFrame, samples: DataFrame, preloads: DataFrame) -> DataFrame:
    """Fonts that failed, were never declared, are faked, block text, or are preloaded for nothing."""
    w = F.lower(F.coalesce("weight", F.lit("400")))
    lo = F.when(w.contains(" "), F.regexp_extract(w, "^([0-9]+)", 1).cast("int")).when(w == "bold", 600).when(w == "normal", 0).otherwise(w.cast("int") - 49)
    hi = F.when(w.contains(" "), F.regexp_extract(w, "([0-9]+)$", 1).cast("int")).when(w == "bold", 1000).when(w == "normal", 500).otherwise(w.cast("int") + 49)
    f = faces.select(*PAGE, "family", "status", "style", "display", lo.alias("lo"), hi.alias("hi"))
    fam = f.groupBy(*PAGE, "family").agg(
        F.bool_or(C("status") == "error").alias("error"), F.bool_or(C("status") == "loaded").alias("loaded"),
        F.bool_or(C("style").rlike("^(italic|oblique)")).alias("has_italic"),
        F.bool_and(F.coalesce((C("display") != "") & (C("display") != "auto"), F.lit(False))).alias("display_set"),
    )
    u = used.groupBy(*PAGE, "family").agg(F.sum("n").alias("n"))
    j = fam.join(u, [*PAGE, "family"], "full_outer")
    s = sample_choice(samples).select(*PAGE, "family", C("s.weight").alias("want"), C("s.style").alias("want_style"))
    j = j.join(s, [*PAGE, "family"], "left")
    # weight range: one row per sample, its faces joined on the family and tested by range
    covers = s.join(f, [*PAGE, "family"]).filter(C("want").cast("int").between(C("lo"), C("hi"))).select(*PAGE, "family").distinct().withColumn("covered", F.lit(True))
    j = j.join(covers, [*PAGE, "family"], "left")
    generic = C("family").rlike(GENERIC)
    loaded = F.coalesce("loaded", F.lit(False))
    rules = F.filter(
        F.array(
            F.when(C("error"), "FONT-001"),
            F.when(C("n").isNotNull() & ~generic & ~loaded & ~F.coalesce("error", F.lit(False)), "FONT-002"),
            F.when(loaded & (C("want").cast("int") >= 600) & C("covered").isNull(), "FONT-003"),
            F.when(loaded & C("n").isNotNull() & ~C("display_set"), "FONT-004"),
            F.when(loaded & C("want_style").rlike("^(italic|oblique)") & ~F.coalesce("has_italic", F.lit(False)), "FONT-006"),
        ),
        lambda r: r.isNotNull(),
    )
    hits = j.select(*PAGE, "family", F.explode(rules).alias("rule_id"), F.when(C("error") & C("n").isNull(), "low").alias("severity_override"))
    idle = preloads.filter("NOT used_family").select(
        *PAGE, F.coalesce("family", F.lit("(unknown)")).alias("family"), F.lit("FONT-005").alias("rule_id"), F.lit(None).cast("string").alias("severity_override")
    )
    return hits.select(
        *PAGE, "family", "rule_id", F.when(C("rule_id") == "FONT-001", C("severity_override")).alias("severity_override")
    ).unionByName(idle)


def icon_findings(icons: DataFrame) -> DataFrame:
    """Icon fonts that did not load, icon names shown as words, and boxes for private codepoints."""
    bad = icons.filter("NOT loaded")
    fonts = bad.filter((C("family") != "") & ~C("family").rlike(GENERIC)).groupBy(*PAGE, "family").agg(F.count("*").alias("n"))
    words = bad.filter(C("is_word") & (C("text") != "")).groupBy(*PAGE).agg(F.count("*").alias("n"))
    tofu = bad.filter("pua").groupBy(*PAGE).agg(F.count("*").alias("n"))
    row = lambda df, rule: df.select(*PAGE, F.lit(rule).alias("rule_id"), "n")
    return row(fonts, "ICON-001").unionByName(row(words, "ICON-002")).unionByName(row(tofu, "ICON-003"))


def font_drift(ref_used: DataFrame, cand_used: DataFrame) -> DataFrame:
    """Families the reference page renders and the candidate page does not use at all."""
    r = ref_used.filter(~C("family").rlike(GENERIC)).select(*PAGE, "family").distinct()
    return r.join(cand_used.select(*PAGE, "family"), [*PAGE, "family"], "left_anti")


def fonts_kept(ref_used: DataFrame, cand_used: DataFrame) -> DataFrame:
    named = lambda df: df.filter(~C("family").rlike(GENERIC)).select(*PAGE, "family")
    return named(ref_used).intersect(named(cand_used))


def engine_rows(results: DataFrame, nav_failures: DataFrame) -> DataFrame:
    """Outcome per browser engine. An engine that is absent or never came back was not measured; a
    failure the primary engine shares is the page's, not the browser's."""
    f = nav_failures.select("site", "page").distinct().withColumn("primary_failed", F.lit(True))
    j = results.join(f, ["site", "page"], "left")
    rule = F.when(C("engine") == "webkit", "XBR-002").otherwise("XBR-001")
    status = (
        F.when(~C("available"), "manual").when(C("abandoned"), "manual").when(~C("ok"), "fail").when(C("errors") > 0, "warn").otherwise("pass")
    )
    reason = F.when(~C("available"), "engine-missing").when(C("abandoned"), "engine-abandoned")
    return j.select(
        "site", "page", "engine", status.alias("status"),
        F.when(status == "fail", rule).when(status == "warn", "XBR-003").alias("rule_id"), reason.alias("reason"),
        F.when(status == "fail", F.coalesce("primary_failed", F.lit(False))).alias("shared_with_primary"),
    )


def blocking_overlays(overlays: DataFrame) -> DataFrame:
    """Overlays still covering a page after dismissal was tried."""
    return overlays.filter(C("still_blocking")).select(
        *PAGE, F.lit("CON-003").alias("rule_id"),
        F.concat(F.when(C("reason") == "intercepts", "blocks interaction across ").otherwise("paints over "), F.floor(C("cover") * 100 + 0.5), F.lit("% of the viewport")).alias("detail"),
    )


def consent_rows(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("site").agg(F.count("*").alias("clicks"), F.count_distinct("page").alias("pages"))


def swept_viewports(sweeps: DataFrame) -> DataFrame:
    """Viewports swept on every rendered page of a site; only those were really looked at."""
    pages = sweeps.groupBy("site").agg(F.count_distinct("page").alias("n_pages"))
    v = sweeps.filter("swept").groupBy("site", "viewport").agg(F.count_distinct("page").alias("n"))
    return v.join(pages, "site").filter("n = n_pages").select("site", "viewport")


# Rules that rest on a measurement of a page, and rules that rest on the sweep of viewports.
MEASURED_RULES = ("A11Y-001", "PERF-001", "PERF-002")
SWEPT_RULES = ("RESP-002", "RESP-003", "RESP-004", "RESP-005", "RESP-006")


def sweep_gaps(pages: DataFrame, sweeps: DataFrame, viewports: list[str]) -> DataFrame:
    """site, page, viewport of every rendered page that a needed viewport was not swept on."""
    wanted = pages.select("site", "page").distinct().withColumn("viewport", F.explode(F.array(*map(F.lit, viewports))))
    return wanted.join(sweeps.filter("swept").select("site", "page", "viewport"), ["site", "page", "viewport"], "left_anti")


def unverified_rules(pages: DataFrame, sweeps: DataFrame, measures: DataFrame, viewports: list[str]) -> DataFrame:
    """site, rule_id, reason of the rules that a site's rendering says nothing about: neither a pass nor a finding.

    A rule of measurements is left open where no page gave any (`measures(site, page, rule_id)`). A rule of sweeps needs one
    viewport without a gap on any page, which is a relational division by two anti-joins: viewports less those with gaps, sites less
    those that have a viewport left. A sweep of some viewports only has been done, on fewer of them, and is not listed."""
    sites = pages.select("site").distinct()
    gaps = sweep_gaps(pages, sweeps, viewports).select("site", "viewport").distinct()
    whole = sites.withColumn("viewport", F.explode(F.array(*map(F.lit, viewports)))).join(gaps, ["site", "viewport"], "left_anti")
    blind = sites.join(whole.select("site").distinct(), "site", "left_anti")
    needed = sites.withColumn("rule_id", F.explode(F.array(*map(F.lit, MEASURED_RULES))))
    silent = needed.join(measures.select("site", "rule_id").distinct(), ["site", "rule_id"], "left_anti")
    unswept = blind.withColumn("rule_id", F.explode(F.array(*map(F.lit, SWEPT_RULES))))
    return silent.withColumn("reason", F.lit("no page gave a measurement")).unionByName(unswept.withColumn("reason", F.lit("no viewport was swept on every page")))
