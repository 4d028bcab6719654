"""Queries over whole sites: site rules, rows, coverage, scores, readiness."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from pagegate import rules as R
from pagegate.operators import audit as A
from pagegate.operators import reach as E
from pagegate.operators import rows as W
from pagegate.operators import score as S
from pagegate.operators import site_rules as P
from pagegate.operators.detect_advisory import copy_words
from pagegate.operators.page_ctx import page_ctx
from pagegate.plans import fixtures as X
from pagegate.plans.page_rules import VISIBLE_CHECKS, rule_arms
from pagegate.plans.sqltext import CTX, LIVE_CTX, VISIBLE_STEP, every, keep, q

C = F.col
EXCLUDED = ("SEO-003", "SEC-011", "FORM-001", "FORM-002", "FORM-900", "FUNC-001")
SKIPPED = ("seo", "security")
GATES = (("SEO-002", "SEO-003"), ("SEO-012", "SEO-011"), ("RESP-001", "FUNC-002"))
TOOL_WEIGHTS = {"seo": 60, "security": 40}


def _site_findings(spark, d):
    meta, probe = X.site_meta(spark, d), X.probe(spark, d)
    return (
        P.robots_findings(X.robots_doc(spark, d), meta)
        .unionByName(P.sitemap_findings(meta))
        .unionByName(P.soft_404_findings(probe))
        .unionByName(P.https_findings(meta, probe))
        .unionByName(P.exposure_findings(probe))
    )


def _audit(spark, d, skip=(), advisory=False):
    return A.audit(X.crawl(spark, d), _site_findings(spark, d), X.check_failures(spark, d), skip, advisory)


def _numbered(spark, d):
    return E.numbered(E.page_states(X.crawl(spark, d), X.sitemap_urls(spark, d)))


def _coverage(spark, d):
    return W.verified(W.ledger(X.crawl(spark, d), X.check_failures(spark, d)))


def _plain(df):
    return df.select("site", "url", "rule_id", "value")


def q_site(fn):
    return lambda spark, d: _plain(fn(spark, d))


def _forms(spark, d):
    f = W.form_audit(X.crawl(spark, d)).groupBy("site", "scan_id").agg(F.count("*").alias("forms"))
    return X.sites(spark, d).join(f, ["site", "scan_id"], "left").fillna(0, ["forms"]).select("site", "scan_id", "forms")


def _merged_rows(spark, d):
    """Rows of the audit and of the advisory rules, from one pass over the pages. Rows for a person count in no score
    and name no further site, so they are not asked for; neither are the words of a site, which stand in details alone."""
    a = _audit(spark, d, advisory=True)
    return a.rows.unionByName(A.advisory_rows(a.rows, a.advisory))


def _advisory_rows(spark, d):
    """Advisory rows come from the advisory rules alone. Every site of a crawl has rows, so sites are read off its keys."""
    crawl = X.crawl(spark, d)
    return A.advisory_rows(crawl, A.advisory_findings(crawl), copy_words(page_ctx(crawl, "live")))


def queries():
    out = {
        "robots_directives": lambda s, d: P.robots_directives(X.robots_doc(s, d)).select(
            "site", "status", F.size("sitemaps").alias("sitemaps"), "has_sitemap", "blocks_all"
        ),
        "robots_findings": q_site(lambda s, d: P.robots_findings(X.robots_doc(s, d), X.site_meta(s, d))),
        "sitemap_findings": q_site(lambda s, d: P.sitemap_findings(X.site_meta(s, d))),
        "soft_404": q_site(lambda s, d: P.soft_404_findings(X.probe(s, d))),
        "https_enforced": q_site(lambda s, d: P.https_findings(X.site_meta(s, d), X.probe(s, d))),
        "exposure_probes": q_site(lambda s, d: P.exposure_findings(X.probe(s, d))),
        "tls_verdict": lambda s, d: P.tls_rows(X.tls_fact(s, d)).select("site", "status", "name", "rule_id", "value"),
        "duplicate_titles": lambda s, d: _plain(
            A.duplicate_findings(A.told(page_ctx(X.crawl(s, d)), [])).filter("rule_id = 'SEO-009'")
        ),
        "duplicate_descriptions": lambda s, d: _plain(
            A.duplicate_findings(A.told(page_ctx(X.crawl(s, d)), [])).filter("rule_id = 'SEO-010'")
        ),
        "form_audit": lambda s, d: W.form_audit(X.crawl(s, d)).select("site", "url", "pos", F.size("problems").alias("problems")),
        "check_rows": lambda s, d: W.check_rows(_audit(s, d).findings).select(
            "site", "check_id", "rule_id", "suite", "status", "name", "occurrences", "pages"
        ),
        "row_occurrences": lambda s, d: W.occurrences(_audit(s, d).findings).groupBy("site", "rule_id").agg(
            F.count("*").alias("occurrences"), F.count_distinct("page").alias("pages")
        ),
        "evidence_rows": lambda s, d: (lambda a: W.evidence_rows(a.coverage, a.findings).select("site", "check_id", "status", "reason"))(
            _audit(s, d)
        ),
        "coverage_rules": lambda s, d: W.coverage_rules(_coverage(s, d)).select("site", "rule_id", "evaluated"),
        "coverage_reasons": lambda s, d: E.rule_reach(_numbered(s, d), X.check_failures(s, d), _coverage(s, d)).drop("scan_id"),
        "rule_broken_pages": lambda s, d: E.broken_pages(_numbered(s, d), X.check_failures(s, d)).drop("scan_id"),
        "page_states": lambda s, d: E.page_states(X.crawl(s, d), X.sitemap_urls(s, d)).select("site", "url", "state"),
        "coverage_counts": lambda s, d: W.coverage_counts(_coverage(s, d)).drop("scan_id"),
        "suite_tally": lambda s, d: W.suite_tally(_audit(s, d).rows).drop("scan_id"),
        "checks_passing": lambda s, d: W.checks_passing(_audit(s, d).rows).drop("scan_id"),
        "quality_suites": lambda s, d: (
            lambda a: S.suite_scores(a.rows, W.coverage_rules(a.coverage).filter("evaluated")).drop("scan_id")
        )(_audit(s, d)),
        "quality_score": lambda s, d: (
            lambda a: S.overall_score(S.suite_scores(a.rows, W.coverage_rules(a.coverage).filter("evaluated"))).drop("scan_id")
        )(_audit(s, d)),
        "scoped_score": lambda s, d: S.suite_scores(_audit(s, d).rows, None, EXCLUDED).drop("scan_id"),
        "weighted_score": lambda s, d: S.overall_score(S.suite_scores(_audit(s, d).rows, weights=TOOL_WEIGHTS)).drop("scan_id"),
        "deduction_list": lambda s, d: S.deductions(_audit(s, d).rows).select("site", "suite", "rule_id", "deduction", "status"),
        "readiness": lambda s, d: S.readiness(_audit(s, d).rows).drop("scan_id"),
        "lenses": lambda s, d: S.lenses(W.occurrences(_audit(s, d).findings)).drop("scan_id"),
        "scope_facts": lambda s, d: S.scope_facts(_audit(s, d).rows, EXCLUDED).drop("scan_id"),
        "suite_skip": lambda s, d: W.suite_tally(_audit(s, d, SKIPPED).rows).drop("scan_id"),
        "worklist": lambda s, d: S.worklist(_audit(s, d).rows).select("site", "kind", "rule_id", "name", "status"),
        "suite_consistency": lambda s, d: W.suite_consistency(_audit(s, d).rows).select("site", "rule_id", "suite", "rule_suite"),
        "severity_tally": lambda s, d: W.severity_tally(A.gate_findings(X.crawl(s, d))).drop("scan_id"),
        "section_matrix": lambda s, d: W.section_matrix(A.gate_findings(X.crawl(s, d))).drop("scan_id"),
        "findings_by_check": lambda s, d: A.gate_findings(X.crawl(s, d)).groupBy("site", "check_id").agg(F.count("*").alias("n")),
        "release_verdict": lambda s, d: W.release_verdict(A.gate_findings(X.crawl(s, d))).drop("scan_id"),
        "page_report_order": lambda s, d: W.worst_first(A.gate_findings(X.crawl(s, d))).select("site", "url", "rule_id", "rank", "page_rank"),
        "rule_suppression": lambda s, d: W.rule_suppression(
            A.gate_findings(X.crawl(s, d)), s.createDataFrame(GATES, "rule_id string, gate string")
        ).groupBy("site", "rule_id").agg(F.count("*").alias("n")),
        "advisory_rows": lambda s, d: _advisory_rows(s, d).select(
            "site", "rule_id", "suite", "status", "occurrences", "pages"
        ),
        "manual_rows": lambda s, d: W.manual_rows(_forms(s, d)).select("site", "suite", "name", "rule_id", "status"),
        "merged_score": lambda s, d: S.overall_score(S.suite_scores(_merged_rows(s, d))).drop("scan_id"),
        "rule_enrichment": lambda s, d: R.enrich(A.gate_findings(X.crawl(s, d))).groupBy("suite", "severity", "tier").agg(
            F.count("*").alias("n"), F.sum("deduction").alias("points")
        ),
    }
    return out


# ---- the same in SQL -------------------------------------------------------------------------


@lru_cache(maxsize=1)
def rules_sql() -> str:
    def lit(v):
        return "NULL" if v is None else (str(v) if isinstance(v, (int, bool)) else q(v))

    cols = ("rule_id", "suite", "severity", "deduction", "tier", "title", "manual", "inspector", "interaction")
    vals = ", ".join("(" + ", ".join(lit(r[c]) for c in cols) + ")" for r in R.rule_rows())
    return f"(SELECT * FROM (VALUES {vals}) t({', '.join(cols)}))"


def checks_sql() -> str:
    vals = ", ".join(f"({q(c)}, {q(s)}, {q(r)}, {q(R.PASS_LABEL[c]) if c in R.PASS_LABEL else 'NULL'})" for c, (s, r) in R.CHECKS.items())
    return f"(SELECT check_id, suite, string_split(rules, ' ') AS rule_ids, pass_label FROM (VALUES {vals}) t(check_id, suite, rules, pass_label))"


def weights_sql(weights: dict | None = None) -> str:
    vals = ", ".join(f"({q(k)}, {weights.get(k, 0) if weights is not None else w})" for k, _, w in R.SUITES)
    return f"(SELECT * FROM (VALUES {vals}) t(suite, weight))"


def _dups(column: str, rule: str) -> str:
    return (
        f"SELECT site, url, '{rule}' AS rule_id, CAST(n AS VARCHAR) AS value, CAST(0 AS INTEGER) AS n_items FROM "
        f"(SELECT site, url, count(*) OVER (PARTITION BY site, trim({column})) AS n FROM x WHERE status = 200 AND trim({column}) <> '') WHERE n > 1"
    )


def _site_arms() -> dict[str, str]:
    s = f"(SELECT *, {X.ORIGIN_SQL} AS origin, {X.ROBOTS_STATUS} AS r_status, {X.ROBOTS_BODY} AS r_body FROM ({X.sites_sql()}))"
    row = lambda rule, url, value, cond: (
        f"SELECT site, {url} AS url, {q(rule)} AS rule_id, CAST({value} AS VARCHAR) AS value, CAST(0 AS INTEGER) AS n_items FROM {s} WHERE {cond}"
    )
    robots = "concat(origin, '/robots.txt')"
    ok = "r_status < 400"
    block, line = "r_body LIKE '%Disallow: /'", "contains(r_body, 'Sitemap:')"
    return {
        "robots-txt": " UNION ALL ".join((
            row("SEO-029", robots, "''", f"NOT {ok}"),
            row("SEO-020", robots, "''", f"{ok} AND {block}"),
            row("SEO-021", robots, "''", f"{ok} AND NOT {block} AND NOT {line}"),
        )),
        "sitemap": row("SEO-022", "origin", "''", f"NOT ({X.HAD_SITEMAP})"),
        "404-config": row("LINK-004", "concat(origin, '/__no_such_page')", "'200'", f"{X.SOFT404_STATUS} = 200"),
        "https-enforce": " UNION ALL ".join((
            row("SEC-007", "origin", "''", "origin LIKE 'http:%'"),
            row("SEC-008", "origin", "'200'", f"origin LIKE 'https:%' AND {X.TWIN_STATUS} = 200"),
        )),
        "sec-exposure": " UNION ALL ".join((
            row("SEC-019", "concat(origin, '/.git/config')", "'exposed'", "k % 8 = 1"),
            row("SEC-021", "concat(origin, '/.env')", "'exposed'", "k % 8 = 2"),
            row("SEC-020", "concat(origin, '/backup.zip')", "'exposed'", "k % 8 = 4"),
            row("SEC-020", "concat(origin, '/wp-config.php.bak')", "'exposed'", "k % 8 = 5"),
            row("SEC-022", "origin", "'dir-listing'", "k % 9 = 4"),
        )),
    }


INTERACTION_CHECK = (
    "CASE WHEN rule_id LIKE 'LINK-%' THEN 'interactive-link' WHEN rule_id IN ('DOM-010', 'DOM-011') THEN 'interactive-control' "
    "ELSE 'interactive-nesting' END"
)


@lru_cache(maxsize=4)
def found_sql(skip: tuple[str, ...] = ()) -> str:
    """Findings `f`, coverage `cov`, rows `r` of the site audit as one WITH chain."""
    arms_by_check = {k: v for k, v in rule_arms().items() if k not in (*VISIBLE_CHECKS, "best-practices", *A.MIGRATION_ONLY)}
    parts = []
    for check, sql in arms_by_check.items():
        check_sql = INTERACTION_CHECK if check == "interaction" else q(check)
        parts.append(f"SELECT *, {check_sql} AS check_id FROM ({sql})")
    parts.append(f"SELECT *, 'duplicate-title' AS check_id FROM ({_dups('title', 'SEO-009')})")
    parts.append(f"SELECT *, 'duplicate-description' AS check_id FROM ({_dups('description', 'SEO-010')})")
    for check, sql in _site_arms().items():
        items = "SELECT * REPLACE (CAST(rule_id <> 'SEC-022' AS INTEGER) AS n_items)" if check == "sec-exposure" else "SELECT *"
        parts.append(f"SELECT *, {q(check)} AS check_id FROM ({items} FROM ({sql}))")
    off = ", ".join(q(s) for s in skip) or "''"
    return f"""{LIVE_CTX}, rules AS {rules_sql()}, checks AS {checks_sql()},
f0 AS ({' UNION ALL '.join(parts)}),
f AS (SELECT f0.*, checks.suite FROM f0 JOIN checks USING (check_id) WHERE checks.suite NOT IN ({off}) OR FALSE),
facts AS (SELECT site, count(*) FILTER (status = 200) AS html_pages, count(*) FILTER (status >= 100) AS responses FROM x GROUP BY site),
broken AS (SELECT site, check_id, count(*) AS err FROM (
  SELECT site, 'schema' AS check_id FROM x WHERE status = 200 AND page_id % 61 = 7
  UNION ALL SELECT site, 'title' FROM x WHERE status = 200 AND site LIKE 'blog.%') GROUP BY site, check_id),
lg AS (SELECT facts.site, checks.*, coalesce(err, 0) AS err,
  CASE WHEN checks.check_id IN ('robots-txt', 'sitemap') THEN 1
       WHEN checks.check_id IN ('404-config', 'https-enforce', 'sec-exposure') THEN least(responses, 1)
       WHEN checks.check_id = 'page-status' THEN responses ELSE html_pages END AS applicable
  FROM facts CROSS JOIN checks LEFT JOIN broken ON broken.site = facts.site AND broken.check_id = checks.check_id),
cov AS (SELECT *, applicable - err > 0 AND err = 0 AND suite NOT IN ({off}) AS verified,
  CASE WHEN suite IN ({off}) THEN 'skipped-by-operator' WHEN applicable - err > 0 AND err = 0 THEN 'evaluated'
       WHEN applicable = 0 THEN 'no-evidence' WHEN applicable <= err THEN 'check-error' ELSE 'partial-error' END AS reason FROM lg),
cr AS (SELECT f.site, f.check_id, f.rule_id, f.suite, any_value(title) AS name, any_value(severity) AS severity,
  CASE WHEN any_value(severity) IN ('critical', 'high') THEN 'fail' ELSE 'warn' END AS status,
  sum(greatest(n_items, 1)) AS occurrences, count(DISTINCT url) AS pages
  FROM f JOIN rules USING (rule_id) GROUP BY f.site, f.check_id, f.rule_id, f.suite),
ev AS (SELECT cov.site, cov.check_id, cov.suite, CASE WHEN verified THEN 'pass' ELSE 'manual' END AS status,
  CASE WHEN NOT verified THEN reason END AS reason, pass_label FROM cov
  LEFT JOIN (SELECT DISTINCT site, check_id FROM f) fired ON fired.site = cov.site AND fired.check_id = cov.check_id
  WHERE reason <> 'skipped-by-operator' AND (NOT verified OR (fired.check_id IS NULL AND pass_label IS NOT NULL))),
r AS (SELECT site, check_id, suite, status, rule_id, name, FALSE AS not_run FROM cr
  UNION ALL SELECT site, check_id, suite, status, NULL, CASE WHEN status = 'pass' THEN pass_label ELSE 'Not verified — ' || coalesce(pass_label, check_id) END, status = 'manual' FROM ev),
erules AS (SELECT site, rule_id, bool_or(verified) AS evaluated FROM (SELECT site, verified, unnest(rule_ids) AS rule_id FROM cov) GROUP BY site, rule_id)
"""


TALLY = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("pass", "warn", "fail", "manual"))
SEVERITIES = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in R.SEVERITY_ORDER)
ROUND = "CAST(floor({} + 0.5) AS INTEGER)"


def _scores(evaluated: bool, excluded=(), weights=None, source="r", suites=R.AUDIT_SUITES) -> str:
    ex = ", ".join(q(e) for e in excluded) or "''"
    names = ", ".join(q(s) for s in suites)
    looked = "er.evaluated" if evaluated else "TRUE"
    return f"""
op AS (SELECT DISTINCT {source}.site, {source}.suite, rule_id, rules.deduction FROM {source} JOIN rules USING (rule_id)
  WHERE status IN ('fail', 'warn') AND NOT manual AND deduction > 0 AND rule_id NOT IN ({ex})),
sc AS (SELECT b.site, b.suite, coalesce(sum(op.deduction), 0) AS open_risk,
  coalesce(sum(b.deduction) FILTER (coalesce({looked}, FALSE) OR op.rule_id IS NOT NULL), 0) AS total_risk,
  count(*) FILTER (b.rule_id IS NOT NULL AND NOT (coalesce({looked}, FALSE) OR op.rule_id IS NOT NULL)) AS not_evaluated
  FROM (SELECT s.site, u.suite, g.rule_id, g.deduction FROM (SELECT DISTINCT site FROM {source}) s CROSS JOIN {weights_sql()} u
        LEFT JOIN (SELECT * FROM rules WHERE NOT manual AND deduction > 0 AND rule_id NOT IN ({ex})) g ON g.suite = u.suite
        WHERE u.suite IN ({names})) b
  LEFT JOIN op ON op.site = b.site AND op.suite = b.suite AND op.rule_id = b.rule_id
  LEFT JOIN (SELECT * FROM erules WHERE evaluated) er ON er.site = b.site AND er.rule_id = b.rule_id
  GROUP BY b.site, b.suite),
scored AS (SELECT sc.*, w.weight, CASE WHEN total_risk > 0 THEN greatest(0, {ROUND.format('100.0::DOUBLE * (1 - open_risk::DOUBLE / total_risk)')}) END AS score
  FROM sc JOIN {weights_sql(weights)} w USING (suite)),
overall AS (SELECT site, {ROUND.format('sum(score * weight) FILTER (score IS NOT NULL AND weight > 0)::DOUBLE / nullif(sum(weight) FILTER (score IS NOT NULL AND weight > 0), 0)')} AS overall
  FROM scored GROUP BY site)
"""


def _gate_sql() -> str:
    from pagegate.plans.page_rules import _static_sql

    section = {
        "page-status": "10 Technical", "viewport-meta": "4 Responsive", "title": "8 SEO", "meta-description": "8 SEO",
        "canonical": "8 SEO", "indexability": "8 SEO", "staging-leak": "8 SEO", "headings": "7 Accessibility",
        "images": "1 Visual", "image-perf": "6 Performance", "social-meta": "8 SEO", "favicon": "8 SEO", "schema": "8 SEO",
        "placeholder-content": "2 Content", "broken-rich-content": "2 Content", "mixed-content": "10 Technical",
        "security-headers": "10 Technical", "compression": "6 Performance", "analytics": "9 Analytics",
        "global-components": "12 Global Components", "html-lang": "7 Accessibility", "render-blocking": "6 Performance",
        "anchor-target": "2 Links", "mobile-web": "6 Performance", "privacy-links": "8 SEO",
    }
    parts = [
        f"SELECT *, {q(k)} AS check_id, {q(section[k])} AS section FROM ({v})" for k, v in _static_sql().items()
    ]
    return f"{CTX}, rules AS {rules_sql()}, g AS (SELECT u.*, rules.suite, rules.severity, rules.tier, rules.deduction FROM ({' UNION ALL '.join(parts)}) u LEFT JOIN rules USING (rule_id))"


def oracles():
    sites = X.sites_sql()
    out = {
        "robots_directives": f"SELECT site, {X.ROBOTS_STATUS} AS status, CAST(contains({X.ROBOTS_BODY}, 'Sitemap:') AS INTEGER) AS sitemaps, "
        f"contains({X.ROBOTS_BODY}, 'Sitemap:') AS has_sitemap, {X.ROBOTS_BODY} LIKE '%Disallow: /' AS blocks_all FROM ({sites})",
    }
    arm = _site_arms()
    for name, check in (
        ("robots_findings", "robots-txt"), ("sitemap_findings", "sitemap"), ("soft_404", "404-config"),
        ("https_enforced", "https-enforce"), ("exposure_probes", "sec-exposure"),
    ):
        out[name] = f"SELECT site, url, rule_id, value FROM ({arm[check]})"
    facts = ", ".join(f"{sql} AS {n}" for n, sql in X.TLS.items())
    out["tls_verdict"] = f"""
WITH t AS (SELECT site, {facts} FROM ({sites})),
m AS (SELECT *, cert_name = site OR (cert_name LIKE '*.%' AND ends_with(site, substr(cert_name, 2))) AS host_ok FROM t)
SELECT site, v.status, v.name, v.rule_id, v.value FROM (SELECT site, CASE
  WHEN NOT reachable THEN {{'status': 'fail', 'name': 'TLS handshake failed', 'rule_id': 'SEC-002', 'value': 'error'}}
  WHEN days_remaining < 0 THEN {{'status': 'fail', 'name': 'TLS certificate has expired', 'rule_id': 'SEC-001', 'value': 'expired'}}
  WHEN NOT authorized THEN {{'status': 'warn', 'name': 'TLS certificate not fully trusted', 'rule_id': 'SEC-003', 'value': 'untrusted'}}
  WHEN NOT host_ok THEN {{'status': 'warn', 'name': 'TLS certificate hostname mismatch', 'rule_id': 'SEC-004', 'value': 'host'}}
  WHEN days_remaining < 21 THEN {{'status': 'warn', 'name': 'TLS certificate expiring soon', 'rule_id': 'SEC-005', 'value': days_remaining || 'd'}}
  ELSE {{'status': 'pass', 'name': 'Valid TLS certificate', 'rule_id': NULL, 'value': days_remaining || 'd'}} END AS v FROM m
  UNION ALL SELECT site, CASE WHEN protocol = 'TLSv1.1' THEN {{'status': 'warn', 'name': 'Outdated TLS protocol', 'rule_id': 'SEC-006', 'value': protocol}}
  ELSE {{'status': 'pass', 'name': 'Modern TLS protocol', 'rule_id': NULL, 'value': protocol}} END FROM m WHERE reachable)"""
    out["duplicate_titles"] = f"{CTX} SELECT site, url, rule_id, value FROM ({_dups('title', 'SEO-009')})"
    out["duplicate_descriptions"] = f"{CTX} SELECT site, url, rule_id, value FROM ({_dups('description', 'SEO-010')})"
    fields = f"len({keep(every('form', r'(?i)<input\b[^>]*>'), 't', "NOT regexp_matches(t, '(?i)type=\"(hidden|submit|button)\"')")})"
    out["form_audit"] = f"""{CTX} SELECT site, url, CAST(pos AS INTEGER) AS pos,
  CAST({fields} > 0 AND len({every('form', r'(?i)<label\b')}) < {fields} AS INTEGER)
  + CAST(NOT regexp_matches(form, '(?i) method=') AND NOT regexp_matches(form, '(?i) action=') AS INTEGER) AS problems
FROM (SELECT site, url, unnest(forms) AS form, generate_subscripts(forms, 1) - 1 AS pos
      FROM (SELECT site, url, {every('html', r'(?is)<form\b.*?</form>')} AS forms FROM x WHERE status = 200))"""
    w = found_sql()
    out["check_rows"] = f"{w} SELECT site, check_id, rule_id, suite, status, name, occurrences, pages FROM cr"
    out["row_occurrences"] = f"{w} SELECT site, rule_id, sum(occurrences) AS occurrences, max(pages) AS pages FROM cr GROUP BY site, rule_id"
    out["evidence_rows"] = f"{w} SELECT site, check_id, status, reason FROM ev"
    out["coverage_rules"] = f"{w} SELECT site, rule_id, evaluated FROM erules"
    listed = f"SELECT site, url FROM x WHERE page_id % 3 <> 1 UNION SELECT site, 'https://' || site || '/never-fetched' FROM ({sites})"
    states = f"""pg AS MATERIALIZED (SELECT site, url, bool_or(html) AS html, bool_or(responded) AS responded, bool_or(seen) AS seen, bool_or(no_schema) AS no_schema FROM (
  SELECT site, url, status = 200 AS html, status >= 100 AS responded, TRUE AS seen, status = 200 AND page_id % 61 = 7 AS no_schema FROM x
  UNION ALL SELECT site, url, FALSE, FALSE, FALSE, FALSE FROM ({listed})) GROUP BY site, url)"""
    out["page_states"] = f"{CTX}, {states} SELECT site, url, CASE WHEN html THEN 'audited' WHEN seen THEN 'errored' ELSE 'not-reached' END AS state FROM pg"
    once = ", ".join(q(c) for c in E.SITE_CHECKS)
    answers = f"""{states}, pr AS (SELECT site, url, rule_id, bool_or(read) AS read, bool_or(read AND NOT broke) AS answered FROM (
  SELECT site, url, rule_id, CASE WHEN check_id = 'page-status' THEN responded ELSE html END AS read, (check_id = 'schema' AND no_schema) OR (check_id = 'title' AND html AND site LIKE 'blog.%') AS broke
  FROM pg CROSS JOIN (SELECT check_id, unnest(rule_ids) AS rule_id FROM checks WHERE check_id NOT IN ({once}))) GROUP BY site, url, rule_id)"""
    out["rule_broken_pages"] = f"{w}, {answers} SELECT site, rule_id, url FROM pr WHERE read AND NOT answered"
    out["coverage_reasons"] = f"""{w}, {answers}, pc AS (SELECT site, rule_id, count(*) FILTER (answered) AS pages_evaluated, count(*) FILTER (read AND NOT answered) AS pages_errored,
 count(*) FILTER (NOT read) AS pages_not_reached FROM pr GROUP BY site, rule_id),
why AS (SELECT site, rule_id, bool_or(verified) AS evaluated, CASE WHEN bool_or(reason = 'evaluated') THEN 'evaluated' WHEN bool_or(reason = 'partial-error') THEN 'partial-error'
 WHEN bool_or(reason = 'check-error') THEN 'check-error' WHEN bool_or(reason = 'no-evidence') THEN 'no-evidence' ELSE 'skipped-by-operator' END AS reason
 FROM (SELECT site, verified, reason, unnest(rule_ids) AS rule_id FROM cov) GROUP BY site, rule_id)
SELECT site, rule_id, evaluated, reason, pages_evaluated, pages_errored, pages_not_reached FROM why LEFT JOIN pc USING (site, rule_id)"""
    out["coverage_counts"] = f"""{w} SELECT a.*, b.rules_evaluated, b.rules_not_evaluated FROM
 (SELECT site, count(*) AS checks, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS not_run FROM cov GROUP BY site) a
 JOIN (SELECT site, count(*) FILTER (evaluated) AS rules_evaluated, count(*) FILTER (NOT evaluated) AS rules_not_evaluated FROM erules GROUP BY site) b USING (site)"""
    tally = f"SELECT site, suite, {TALLY}, count(*) FILTER (not_run) AS n_not_run FROM r GROUP BY site, suite UNION ALL SELECT site, NULL, {TALLY}, count(*) FILTER (not_run) FROM r GROUP BY site"
    out["suite_tally"] = f"{w} {tally}"
    out["suite_skip"] = f"{found_sql(SKIPPED)} {tally}"
    out["checks_passing"] = f"""{w} SELECT *, coalesce({ROUND.format('n_pass * 100.0::DOUBLE / nullif(n_pass + n_warn + n_fail, 0)')}, 0) AS score,
 CASE WHEN n_fail > 0 THEN 'NEEDS ATTENTION' WHEN n_warn > 0 THEN 'PASSED WITH WARNINGS' ELSE 'ALL PASSING' END AS verdict, n_fail = 0 AS ready
 FROM (SELECT site, {TALLY} FROM r GROUP BY site)"""
    out["quality_suites"] = f"{w}, {_scores(True)} SELECT * FROM scored"
    out["quality_score"] = f"{w}, {_scores(True)} SELECT * FROM overall"
    out["scoped_score"] = f"{w}, {_scores(False, EXCLUDED)} SELECT * FROM scored"
    out["weighted_score"] = f"{w}, {_scores(False, weights=TOOL_WEIGHTS)} SELECT * FROM overall"
    out["deduction_list"] = f"{w} SELECT r.site, r.suite, rule_id, deduction, status FROM r JOIN rules USING (rule_id) WHERE status IN ('fail', 'warn') AND deduction > 0"
    tier = lambda c: f"count(*) FILTER (status IN ('fail', 'warn') AND {c})"
    out["readiness"] = f"""{w}, t AS (SELECT r.site, {tier('tier = 1')} AS blockers, {tier('tier = 2')} AS majors, {tier('tier = 3')} AS polish,
 {tier('tier IS NULL')} AS untiered FROM r LEFT JOIN rules USING (rule_id) GROUP BY r.site)
SELECT *, majors + polish + untiered AS outstanding, blockers = 0 AS launch_ready, blockers = 0 AND majors + polish + untiered = 0 AS clean,
 CASE WHEN blockers > 0 THEN 'no' WHEN majors + polish + untiered = 0 THEN 'ok' ELSE 'part' END AS tone,
 CASE WHEN blockers > 0 THEN 'NOT LAUNCH-READY — ' || blockers || ' blocker' || CASE WHEN blockers > 1 THEN 's' ELSE '' END
  WHEN majors + polish + untiered = 0 THEN 'LAUNCH-READY'
  ELSE 'NO LAUNCH BLOCKERS — ' || (majors + polish + untiered) || ' issue' || CASE WHEN majors + polish + untiered > 1 THEN 's' ELSE '' END || ' outstanding' END AS verdict FROM t"""
    out["lenses"] = f"""{w}, o AS (SELECT f.site, url, greatest(n_items, 1) AS n, deduction, inspector, interaction FROM f JOIN rules USING (rule_id)),
l AS (SELECT *, inspector AS lens FROM o WHERE inspector IS NOT NULL UNION ALL SELECT *, 'interaction' FROM o WHERE interaction)
SELECT s.site, s.lens, CAST(greatest(0, 100 - coalesce(sum(l.deduction * l.n), 0)) AS INTEGER) AS score, coalesce(sum(l.n), 0) AS findings, count(DISTINCT l.url) AS pages
FROM (SELECT DISTINCT site, lens FROM f CROSS JOIN (VALUES ('seo'), ('security'), ('stability'), ('interaction')) v(lens)) s
LEFT JOIN l ON l.site = s.site AND l.lens = s.lens GROUP BY s.site, s.lens"""
    ex = ", ".join(q(e) for e in EXCLUDED)
    out["scope_facts"] = f"""{w} SELECT site, count(DISTINCT rule_id) FILTER (status IN ('fail', 'warn') AND rule_id IN ({ex})) AS open_hidden,
 count(DISTINCT rule_id) FILTER (status IN ('fail', 'warn') AND rule_id IN ({ex}) AND tier = 1) AS blockers_hidden, CAST(1 AS INTEGER) AS suites_fully_out
 FROM r LEFT JOIN (SELECT rule_id, tier FROM rules) t USING (rule_id) GROUP BY site"""
    out["worklist"] = f"{w} SELECT site, CASE WHEN status IN ('fail', 'warn') THEN 0 WHEN status = 'manual' THEN 1 ELSE 2 END AS kind, rule_id, name, status FROM r"
    out["suite_consistency"] = f"{w} SELECT r.site, rule_id, r.suite, rules.suite AS rule_suite FROM r JOIN rules USING (rule_id) WHERE status NOT IN ('pass', 'manual') AND r.suite <> rules.suite"
    g = _gate_sql()
    out["severity_tally"] = f"{g} SELECT site, {SEVERITIES} FROM g GROUP BY site"
    out["section_matrix"] = f"{g} SELECT site, section, {SEVERITIES}, count(*) AS findings FROM g GROUP BY site, section"
    out["findings_by_check"] = f"{g} SELECT site, check_id, count(*) AS n FROM g GROUP BY site, check_id"
    out["release_verdict"] = f"""{g} SELECT *, critical + high AS blocking_count, critical + high = 0 AS ready,
 CASE WHEN critical + high = 0 THEN 'AUTOMATED-PASS' ELSE 'NOT-READY' END AS automated FROM (SELECT site, {SEVERITIES} FROM g GROUP BY site)"""
    rank = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
    out["page_report_order"] = f"{g} SELECT site, url, rule_id, {rank} AS rank, min({rank}) OVER (PARTITION BY site, url) AS page_rank FROM g"
    pairs = " OR ".join(
        f"(g.rule_id = {q(a)} AND EXISTS (SELECT 1 FROM g h WHERE h.site = g.site AND h.url = g.url AND h.rule_id = {q(b)}))" for a, b in GATES
    )
    out["rule_suppression"] = f"{g} SELECT site, rule_id, count(*) AS n FROM g WHERE NOT ({pairs}) GROUP BY site, rule_id"
    out["rule_enrichment"] = f"{g} SELECT suite, severity, tier, count(*) AS n, sum(deduction) AS points FROM g GROUP BY suite, severity, tier"
    adv = {k: v for k, v in rule_arms().items() if k in (*VISIBLE_CHECKS, "best-practices")}
    adv_rows = f"""{VISIBLE_STEP}, a AS ({' UNION ALL '.join(f'SELECT * FROM ({v})' for v in adv.values())}),
ar AS (SELECT s.site, g.rule_id, g.suite, coalesce(sum(a.n_items), 0) AS occurrences, count(DISTINCT a.url) AS pages, any_value(severity) AS severity
 FROM (SELECT DISTINCT site FROM x) s CROSS JOIN (SELECT * FROM rules WHERE suite IN ('best-practices', 'copy') OR rule_id IN ('FUNC-008', 'FUNC-009')) g
 LEFT JOIN a ON a.site = s.site AND a.rule_id = g.rule_id GROUP BY s.site, g.rule_id, g.suite),
arows AS (SELECT site, rule_id, suite, CASE WHEN suite = 'copy' THEN 'manual' WHEN occurrences = 0 THEN 'pass' WHEN severity IN ('critical', 'high') THEN 'fail' ELSE 'warn' END AS status, occurrences, pages FROM ar)"""
    out["advisory_rows"] = f"{w} {adv_rows} SELECT * FROM arows"
    out["merged_score"] = f"""{w} {adv_rows}, m AS (SELECT site, suite, status, rule_id FROM r UNION ALL SELECT site, suite, status, rule_id FROM arows),
{_scores(False, source='m')} SELECT * FROM overall"""
    n_forms = f"len({every('html', r'(?is)<form\b.*?</form>')})"
    out["manual_rows"] = f"""{CTX}, n AS (SELECT site, coalesce(sum({n_forms}) FILTER (status = 200), 0) AS forms FROM x GROUP BY site)
SELECT site, 'functional' AS suite, 'Visual design matches the intended design' AS name, 'FUNC-900' AS rule_id, 'manual' AS status FROM n
UNION ALL SELECT site, 'responsive', 'Multi-device eyeball pass (Responsive Viewer)', 'RESP-900', 'manual' FROM n
UNION ALL SELECT site, 'forms', CASE WHEN forms = 0 THEN 'No forms detected to test' ELSE 'Form submission → email / CRM delivery' END,
 CASE WHEN forms > 0 THEN 'FORM-900' END, 'manual' FROM n"""
    return out


