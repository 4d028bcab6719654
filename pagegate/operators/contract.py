"""Findings as contract rows: locator, evidence, impact, fix, fingerprint, sentence and ticket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegate import rules as R
from pagegate.functions.digest import canonical_json, json_string, sha256
from pagegate.functions.text import js_trim
from pagegate.functions.urls import normalize_url
from pagegate.operators.page_ctx import KEYS

C = F.col

# Wording of the plain-language sentence.
AXIS_PHRASE = {"a11y": "accessibility for assistive-tech users", "seo": "search visibility", "security": "site security"}
SUITE_PHRASE = {
    "functional": "core page functionality", "links": "working links and navigation", "forms": "forms and submissions",
    "responsive": "the mobile / responsive layout", "a11y": "accessibility for assistive-tech users",
    "seo": "search-engine visibility", "performance": "page performance and load speed", "security": "site security",
    "crossbrowser": "cross-browser consistency", "console": "runtime stability (browser console)",
    "best-practices": "code best-practice", "visual": "visual fidelity",
}
RATING_WORD = {"high": "high", "med": "medium", "medium": "medium", "low": "low"}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def locator_strategies(tag: Column, attrs: Column) -> Column:
    """Ways to find an element again, most stable first: id, test attribute, classes, attribute, tag."""
    text = lambda k: F.coalesce(attrs[k], F.lit(""))
    classes = F.filter(F.split(js_trim(text("class")), "[ \t\n]+"), lambda c: c != "")
    test = F.coalesce(*[F.nullif(text(k), F.lit("")) for k in ("data-testid", "data-test", "data-cy")])
    named = F.coalesce(
        *[
            F.when(text(k) != "", F.concat(tag, F.lit(f"[{k}='"), F.substring(text(k), 1, 40), F.lit("']")))
            for k in ("name", "type", "role", "aria-label")
        ]
    )
    way = lambda kind, value, stability: F.struct(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), value.alias("value"), F.lit(stability).alias("stability")
    )
    found = F.filter(
        F.array(
            F.when(text("id") != "", way("id", F.concat(F.lit("#"), text("id")), "high")),
            F.when(test.isNotNull(), way("data-testid", F.concat(F.lit("[data-testid='"), test, F.lit("']")), "high")),
            F.when(
                F.size(classes) > 0,
                way(F.when(F.size(classes) == 1, "unique-class").otherwise("class-combo"), F.concat_ws(".", tag, F.array_join(classes, ".")), "medium"),
            ),
            F.when(named.isNotNull(), way("attr", named, "medium")),
        ),
        lambda w: w.isNotNull(),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(way("tag", F.coalesce(F.nullif(tag, F.lit("")), F.lit("*")), "low")))


def copy_as(css: Column) -> Column:
    quoted = json_string(css)
    return F.struct(
        css.alias("css"), F.concat(F.lit("document.querySelector("), quoted, F.lit(")")).alias("querySelector"),
        F.concat(F.lit("page.locator("), quoted, F.lit(")")).alias("playwright"), F.concat(F.lit("cy.get("), quoted, F.lit(")")).alias("cypress"),
    )


def locator_id(page: Column, preferred: Column, tag: Column) -> Column:
    return sha256(
        canonical_json(page=json_string(normalize_url(page)), preferred=json_string(F.coalesce(preferred, F.lit(""))), tag=json_string(F.lower(tag)))
    )


def fingerprint(rule_id: Column, url: Column, selector: Column, evidence: Column) -> Column:
    """Stable identity of a finding: rule, normalised page, selector and measured value."""
    return sha256(
        canonical_json(
            ruleId=json_string(rule_id), url=json_string(normalize_url(url)), selector=json_string(F.coalesce(selector, F.lit(""))),
            evidence=json_string(F.substring(js_trim(F.coalesce(evidence, F.lit(""))), 1, 300)),
        )
    )


def _joined(parts: Column) -> Column:
    n = F.size(parts)
    return (
        F.when(n <= 1, F.array_join(parts, ""))
        .when(n == 2, F.array_join(parts, " and "))
        .otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.try_element_at(parts, F.lit(-1))))
    )


def sentence() -> Column:
    """What a finding touches, how much, and what it takes to fix; from rule facts alone."""
    word = _map(RATING_WORD)
    rank = lambda c: F.when(c == "high", 3).when(c.isin("med", "medium"), 2).when(c == "low", 1)
    axes = F.filter(
        F.array(
            *[
                F.when(C(k).isNotNull(), F.struct((-rank(C(k))).alias("r"), F.lit(i).alias("i"), C(k).alias("rating"), F.lit(p).alias("phrase")))
                for i, (k, p) in enumerate(AXIS_PHRASE.items())
            ]
        ),
        lambda a: a.isNotNull(),
    )
    ordered = F.array_sort(axes)
    by_axis = _joined(F.transform(ordered, lambda a: F.concat(a["phrase"], F.lit(" ("), word[a["rating"]], F.lit(")"))))
    severity = F.when(C("severity").isin("critical", "high"), "high").when(C("severity").isin("medium", "low"), C("severity"))
    phrase = F.coalesce(_map(SUITE_PHRASE)[C("suite")], F.lit("the site"))
    by_suite = F.when(severity.isNotNull(), F.concat(phrase, F.lit(" ("), severity, F.lit(")"))).otherwise(phrase)
    worst = F.when(F.size(axes) > 0, F.try_element_at(ordered, F.lit(1))["rating"]).otherwise(severity)
    clause = F.when(F.size(axes) > 0, by_axis).otherwise(by_suite)
    effort = F.concat(
        word[C("effort")], F.lit(" dev effort to fix"),
        F.when(C("fixability").isin("guided", "automatic"), F.concat(F.lit(" ("), C("fixability"), F.lit(")"))).otherwise(""),
    )
    fix = F.when(C("effort").isNotNull(), effort).when(C("fixability") == "guided", "guided fix available").otherwise("requires a manual fix")
    return F.concat(F.when(worst == "high", "Hurts ").otherwise("Affects "), clause, F.lit("; "), fix, F.lit("."))


def project(occurrences: DataFrame) -> DataFrame:
    """Contract row of every occurrence `(site, scan_id, rule_id, page, section, id, value)`."""
    o = occurrences.join(F.broadcast(R.rules_df(occurrences.sparkSession)), "rule_id", "left")
    selector = F.when(C("id") != "(whole page)", C("id"))
    c = o.withColumn("selector", selector).withColumn("fingerprint", fingerprint(C("rule_id"), C("page"), C("selector"), C("value")))
    impacts = F.map_from_arrays(F.array(*[F.lit(k) for k in ("seo", "a11y", "security", "devEffort")]), F.array("seo", "a11y", "security", "effort"))
    return c.select(
        *KEYS, "fingerprint", "rule_id", C("since").alias("rule_version"), "inspector", C("suite").alias("category"), "suite", "section",
        C("interaction"), "severity", "tier", C("quality").alias("evidence_quality"), C("page").alias("url"), "selector", "value",
        C("title").alias("name"), "deduction", "method", "fixability", "effort", "seo", "a11y", "security", impacts.alias("impacts"), sentence().alias("why"),
    )


def gaps() -> Column:
    """Of the five questions a finding must answer, those it leaves open."""
    return F.filter(
        F.array(
            F.when(C("rule_id").isNull() | C("name").isNull(), "what"),
            F.when(C("selector").isNull() & (F.coalesce("url", F.lit("")) == ""), "where"),
            F.when(~F.coalesce(C("evidence_quality").isin("verified", "derived", "heuristic"), F.lit(False)), "certainty"),
            F.when(C("severity").isNull() & C("tier").isNull(), "why"),
            F.when(C("fixability").isNull(), "how"),
        ),
        lambda g: g.isNotNull(),
    )


def ticket() -> Column:
    """Markdown ticket of one finding; lines without content are left out."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- **{label}:** "), value))
    status = F.concat_ws(
        " · ", F.concat(F.lit("severity "), "severity"), F.concat(F.lit("launch-tier "), "tier"), F.concat(F.lit("rule "), "rule_id"),
        F.concat(F.lit("certainty "), "evidence_quality"),
    )
    impact = F.concat_ws(
        " · ", *[F.concat(F.lit(f"{k}:"), C(c)) for k, c in (("seo", "seo"), ("a11y", "a11y"), ("security", "security"), ("devEffort", "effort"))]
    )
    lines = F.filter(
        F.array(
            F.concat(F.lit("## QA issue: "), F.coalesce("name", "rule_id", F.lit("finding"))), line("Status", status), line("Page", C("url")),
            line("Section", C("section")), line("Element", F.concat(F.lit("`"), "selector", F.lit("`"))), line("Measured", C("value")),
            line("Impact", impact), line("Impact / why", C("why")), line("Fix", F.concat(F.lit("("), "fixability", F.lit(")"))),
            line("Locate (CSS)", F.concat(F.lit("`"), "selector", F.lit("`"))), line("Fingerprint", F.concat(F.lit("`"), F.substring("fingerprint", 1, 16), F.lit("`"))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.array_join(lines, "\n")


# Findings a ticket for a whole check lists.
LISTED = 30


def check_ticket(contracts: DataFrame) -> DataFrame:
    """Markdown ticket per check: the first thirty findings as a table and how many more there are."""
    keys = [*KEYS, "rule_id"]
    w = Window.partitionBy(*keys).orderBy("url", "fingerprint")
    n = contracts.groupBy(*keys).agg(F.count("*").alias("findings"), F.min("name").alias("name"), F.min("severity").alias("severity"))
    top = contracts.withColumn("rn", F.row_number().over(w)).filter(C("rn") <= LISTED)
    row = F.concat(F.lit("| "), F.coalesce("url", F.lit("—")), F.lit(" | "), F.coalesce(F.concat(F.lit("`"), "selector", F.lit("`")), F.lit("—")), F.lit(" | "), F.coalesce("value", F.lit("")), F.lit(" |"))
    table = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", row.alias("row")))).alias("rows"))
    j = n.join(table, keys)
    more = F.when(C("findings") > LISTED, F.concat(F.lit("\n\n+"), C("findings") - LISTED, F.lit(" more in report.json"))).otherwise("")
    text = F.concat(
        F.lit("## QA issue: "), "name", F.lit("\n- **Status:** severity "), "severity", F.lit(" · rule "), "rule_id",
        F.lit("\n\n| Page | Where | Measured |\n|---|---|---|\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), more,
    )
    return j.select(*keys, "findings", text.alias("ticket"))
