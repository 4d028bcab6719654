"""Queries over contract rows, text checks on documents, and the migration portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegate import rules as R
from pagegate.functions import html as H
from pagegate.functions.text import WS, flesch_reading_ease, collapse_ws
from pagegate.operators import contract as K
from pagegate.operators import portfolio as P
from pagegate.operators import rows as W
from pagegate.operators.audit import gate_findings
from pagegate.operators.detect_advisory import (
    DOUBLE_WORDS, MISSPELLINGS, STOCK_PHRASES, copy_items, doubled_words, is_uniform, misspelled_words, paragraph_words, rhythm,
)
from pagegate.plans import fixtures as X
from pagegate.plans.page_rules import edged
from pagegate.plans.site_audit import _gate_sql
from pagegate.plans.sqltext import every, q, sub
from pagegate.session import cut_lineage

C = F.col
CASE_COLUMNS = {
    "seq": "event_id",
    "name": "concat('case-', CAST(user_id AS VARCHAR(20)))",
    "category": "CASE user_id % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(P.CATEGORIES[:9])) + " ELSE 'reference' END",
    "source": "concat('old-', CAST(user_id % 40 AS VARCHAR(20)))",
    "target": "concat('new-', CAST(user_id % 40 AS VARCHAR(20)))",
    "verdict": "CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'view' THEN 'PASS' ELSE 'PASS WITH MINOR ISSUES' END",
    "is_reference": "user_id % 12 > 8",
    "pages": "user_id % 50",
    "assets": "user_id % 70",
    "forms": "user_id % 5",
    "globals": "user_id % 9",
    "inventory": "user_id % 200",
    "findings": "event_id % 30",
    "blocking": "event_id % 3",
    "runtime_ms": "event_id % 1000",
}


def _cases(s, d):
    return X.events(s, d).select(*[X._expr(v).alias(k) for k, v in CASE_COLUMNS.items()])


def _contracts(s, d):
    return K.project(W.occurrences(gate_findings(X.crawl(s, d)).select("*")))


def _kept_contracts(s, d):
    """The same from findings that are written once, for what reads them more than once."""
    return K.project(W.occurrences(cut_lineage(gate_findings(X.crawl(s, d)))))


def _docs(s, d):
    return X.documents(s, d)


def queries():
    return {
        "contract_rows": lambda s, d: _contracts(s, d).groupBy("site", "rule_id", "category", "severity", "tier", "evidence_quality").agg(F.count("*").alias("n")),
        "contract_fingerprints": lambda s, d: _contracts(s, d).filter("rule_id IN ('RESP-001', 'SEO-014', 'FUNC-005')").select("url", "rule_id", "fingerprint"),
        "impact_sentence": lambda s, d: _contracts(s, d).select("rule_id", "why").distinct(),
        "contract_gaps": lambda s, d: _contracts(s, d).select(F.explode(K.gaps()).alias("gap")).groupBy("gap").agg(F.count("*").alias("n")),
        "finding_tickets": lambda s, d: _contracts(s, d).select("rule_id", F.regexp_count(K.ticket(), F.lit("\n")).alias("lines")).groupBy("rule_id", "lines").agg(F.count("*").alias("n")),
        "check_tickets": lambda s, d: K.check_ticket(_kept_contracts(s, d)).select("site", "rule_id", "findings", C("ticket").contains(" more in report.json").alias("more")),
        "locators": lambda s, d: X.crawl(s, d).select(
            F.explode(H.find_all(C("body"), r"(?i)<(?:a|button|input)\b[^>]*>")).alias("raw")
        ).select(F.lower(F.regexp_extract("raw", "^<([A-Za-z]+)", 1)).alias("tag"), H.attr_map(F.regexp_replace(F.regexp_replace("raw", "^<[A-Za-z]+", ""), "/?>$", "")).alias("at")).select(
            K.locator_strategies(C("tag"), C("at"))[0].alias("w")
        ).groupBy("w.kind", "w.value", "w.stability").agg(F.count("*").alias("n")),
        "doubled_words": lambda s, d: _docs(s, d).select("doc_id", F.explode(doubled_words(C("text"))).alias("phrase")),
        "misspellings": lambda s, d: _docs(s, d).select("doc_id", F.explode(misspelled_words(F.lower("text"))).alias("word")),
        "paragraph_rhythm": lambda s, d: _docs(s, d).select("doc_id", rhythm(paragraph_words(H.text_paragraphs(C("text")))).alias("r")).select(
            "doc_id", "r.paragraphs", "r.words", F.round("r.cv", 6).alias("cv"), is_uniform(C("r")).alias("uniform")
        ),
        "stock_phrases": lambda s, d: _docs(s, d).select("doc_id", F.size(copy_items(C("text"), F.lower("text"), "ai-tell-phrasing", STOCK_PHRASES, False)).alias("n")).filter("n > 0"),
        "readability": lambda s, d: _docs(s, d).select("doc_id", F.round(flesch_reading_ease(collapse_ws(C("text"))), 4).alias("ease")),
        "portfolio": lambda s, d: P.cumulative(_cases(s, d)),
        "portfolio_superseded": lambda s, d: P.with_superseded(_cases(s, d)).groupBy("source", "superseded").agg(F.count("*").alias("n")),
        "portfolio_categories": lambda s, d: P.category_coverage(_cases(s, d)),
        "portfolio_gaps": lambda s, d: P.missing_categories(_cases(s, d)),
    }


def oracles():
    g = _gate_sql()
    cases = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in CASE_COLUMNS.items()) + " FROM events"
    cur = f"WITH p AS ({cases}), c AS (SELECT *, seq <> max(seq) OVER (PARTITION BY source, target) AS superseded FROM p)"
    totals = ", ".join(f"sum({c}) AS total_{c}" for c in ("pages", "assets", "forms", "globals", "inventory", "findings", "blocking"))
    pairs = "|".join(f"{w}{WS}+{w}" for w in DOUBLE_WORDS)
    doubles = f"list_distinct(list_transform({every('text', rf'(?i)\b(?:{pairs})\b')}, lambda d: lower({sub('d', WS + '+', ' ')})))"
    words = every("lower(text)", "[a-z][a-z']*[a-z]|[a-z]")
    listed = ", ".join(q(w) for w in MISSPELLINGS)
    paras = f"regexp_split_to_array(text, {q(chr(10) + WS + '*' + chr(10) + '+')})"
    counts = f"list_filter(list_transform({paras}, lambda p: len({every('p', "[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*")})), lambda n: n > 0)"
    prose = f"trim({sub('text', WS + '+', ' ')})"
    letters = "list_transform(w, lambda t: regexp_replace(lower(t), '[^a-z]', '', 'g'))"
    body = "regexp_replace(regexp_replace(t, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', '')"
    syl = f"list_sum(list_transform({letters}, lambda t: CASE WHEN t = '' THEN 0 WHEN length(t) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all({body}, '[aeiouy]{{1,2}}'))) END))"
    stock = " + ".join(f"len({every('text', edged(p))})" for p in STOCK_PHRASES)
    whole = "CASE WHEN n_items = 0 THEN 1 ELSE n_items END"
    quality = "CASE " + " ".join(f"WHEN rule_id = {q(r['rule_id'])} THEN {q(r['quality'])}" for r in R.rule_rows() if r["quality"] != "verified") + " ELSE 'verified' END"
    norm = "rtrim(concat(lower(regexp_extract(url, '^[a-z]+://[^/?#]*')), regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/')"
    null = lambda v: "NULL" if v is None else q(v)
    rules = ", ".join("(" + ", ".join(null(r[k]) for k in ("rule_id", "suite", "severity", "a11y", "seo", "security", "effort", "fixability")) + ")" for r in R.rule_rows())
    rating = lambda c: f"CASE {c} WHEN 'high' THEN 3 WHEN 'med' THEN 2 WHEN 'low' THEN 1 END"
    said = lambda c, text: f"CASE WHEN {c} IS NOT NULL THEN {{'o': -({rating(c)}), 't': concat('{text} (', CASE {c} WHEN 'med' THEN 'medium' ELSE {c} END, ')')}} END"
    told = ", ".join((said("a11y", "accessibility for assistive-tech users"), said("seo", "search visibility"), said("security", "site security")))
    suites = "CASE suite WHEN 'functional' THEN 'core page functionality' WHEN 'links' THEN 'working links and navigation' WHEN 'forms' THEN 'forms and submissions' WHEN 'responsive' THEN 'the mobile / responsive layout' WHEN 'a11y' THEN 'accessibility for assistive-tech users' WHEN 'seo' THEN 'search-engine visibility' WHEN 'performance' THEN 'page performance and load speed' WHEN 'security' THEN 'site security' WHEN 'crossbrowser' THEN 'cross-browser consistency' WHEN 'console' THEN 'runtime stability (browser console)' WHEN 'best-practices' THEN 'code best-practice' WHEN 'visual' THEN 'visual fidelity' ELSE 'the site' END"
    return {
        "impact_sentence": f"""{g}, rl(rule_id, suite, severity, a11y, seo, security, effort, fixability) AS (VALUES {rules}),
ax AS (SELECT *, list_filter([{told}], lambda x: x IS NOT NULL) AS a, CASE WHEN severity IN ('critical', 'high') THEN 'high' WHEN severity IN ('medium', 'low') THEN severity END AS sev FROM rl WHERE rule_id IN (SELECT rule_id FROM g)),
so AS (SELECT *, list_transform(list_concat(list_filter(a, lambda x: x.o = -3), list_filter(a, lambda x: x.o = -2), list_filter(a, lambda x: x.o = -1)), lambda x: x.t) AS t, list_min(list_transform(a, lambda x: x.o)) AS top FROM ax)
SELECT rule_id, concat(CASE WHEN top = -3 OR (len(a) = 0 AND sev = 'high') THEN 'Hurts ' ELSE 'Affects ' END,
 CASE len(t) WHEN 0 THEN concat({suites}, CASE WHEN sev IS NOT NULL THEN concat(' (', sev, ')') ELSE '' END) WHEN 1 THEN t[1] WHEN 2 THEN concat(t[1], ' and ', t[2]) ELSE concat(t[1], ', ', t[2], ', and ', t[3]) END, '; ',
 CASE WHEN effort IS NOT NULL THEN concat(CASE effort WHEN 'med' THEN 'medium' ELSE effort END, ' dev effort to fix', CASE WHEN fixability IN ('guided', 'automatic') THEN concat(' (', fixability, ')') ELSE '' END) WHEN fixability = 'guided' THEN 'guided fix available' ELSE 'requires a manual fix' END, '.') AS why FROM so""",
        "contract_rows": f"{g} SELECT site, rule_id, suite AS category, severity, tier, {quality} AS evidence_quality, sum({whole}) AS n FROM g GROUP BY ALL",
        "contract_fingerprints": f"""{g} SELECT url, rule_id, sha256(concat('{{"evidence":"', value, '","ruleId":"', rule_id, '","selector":"","url":"', {norm}, '"}}')) AS fingerprint FROM g WHERE rule_id IN ('RESP-001', 'SEO-014', 'FUNC-005')""",
        "contract_gaps": "SELECT '' AS gap, 0 AS n WHERE FALSE",
        "check_tickets": f"{g} SELECT site, rule_id, sum({whole}) AS findings, sum({whole}) > 30 AS more FROM g GROUP BY site, rule_id",
        "doubled_words": f"SELECT doc_id, unnest({doubles}) AS phrase FROM documents",
        "misspellings": f"SELECT doc_id, unnest(list_filter(list_distinct({words}), lambda w: w IN ({listed}))) AS word FROM documents",
        "paragraph_rhythm": f"""WITH r AS (SELECT doc_id, {counts} AS c FROM documents), t AS (SELECT doc_id, c, len(c) AS n, CAST(coalesce(list_sum(c), 0) AS BIGINT) AS s FROM r),
v AS (SELECT *, sqrt(list_sum(list_transform(c, lambda k: (k - s / n) * (k - s / n))) / n) / (s / n) AS cv FROM t)
SELECT doc_id, n AS paragraphs, s AS words, round(cv, 6) AS cv, coalesce(n >= 8 AND s >= 300 AND cv < 0.18, FALSE) AS uniform FROM v""",
        "stock_phrases": f"SELECT doc_id, {stock} AS n FROM documents WHERE {stock} > 0",
        "readability": f"""WITH p AS (SELECT doc_id, {prose} AS p FROM documents), w AS (SELECT doc_id, p, list_filter(string_split(p, ' '), lambda t: t <> '') AS w FROM p)
SELECT doc_id, CASE WHEN len(w) >= 30 THEN round(206.835::DOUBLE - 1.015::DOUBLE * (len(w)::DOUBLE / greatest(1, len(regexp_extract_all(p, '[.!?]+')))) - 84.6::DOUBLE * ({syl}::DOUBLE / len(w)), 4) END AS ease FROM w""",
        "portfolio": f"""{cur} SELECT count(*) AS projects, count(*) FILTER (NOT is_reference) AS real_projects, {totals}, CAST(floor(sum(runtime_ms)::DOUBLE / greatest(count(*), 1) + 0.5) AS BIGINT) AS avg_runtime_ms,
 count(*) FILTER (verdict = 'PASS') AS n_pass, count(*) FILTER (verdict = 'PASS WITH MINOR ISSUES') AS n_minor, count(*) FILTER (verdict = 'FAIL') AS n_fail, count(DISTINCT category) AS categories FROM c WHERE NOT superseded""",
        "portfolio_superseded": f"{cur} SELECT source, superseded, count(*) AS n FROM c GROUP BY ALL",
        "portfolio_categories": f"{cur} SELECT category, verdict, count(*) AS cases FROM c WHERE NOT is_reference GROUP BY CUBE (category, verdict)",
        "portfolio_gaps": f"WITH p AS ({cases}) SELECT c AS category FROM (SELECT unnest([{', '.join(q(c) for c in P.CATEGORIES if c != 'reference')}]) AS c) WHERE c NOT IN (SELECT category FROM p WHERE NOT is_reference)",
    }
