"""A sample of registered queries against their SQL; `tools/check.py` runs them all."""

import importlib.util
import pathlib

import duckdb
import pytest

from pagegate.operators import audit
from pagegate.operators.page_ctx import html_pages
from pagegate.plans import migration, registry

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parents[1]
spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

SAMPLE = (
    "rule_title", "rule_images", "rule_interaction", "rule_spelling", "duplicate_titles", "quality_score", "release_verdict", "page_links",
    "redirect_chains", "reachable_pages", "stratified_sample", "completeness", "scan_records", "timeline", "finding_lifecycle", "regression_gate",
    "element_match", "fidelity_grade", "font_findings", "contract_fingerprints", "portfolio", "stream_progress",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracles()[name])
    cols = [d[0] for d in cur.description]
    want = check.rows_of(cols, cur.fetchall())
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_reachable_pages_of_equal_urls(spark, con, tmp_path):
    """Pages that share a url are pages of their own, as in the SQL."""
    src = f"read_parquet('{SF}/pages.parquet')"
    con.execute(f"COPY (SELECT page_id + k * 50 AS page_id, url, html FROM {src}, range(3) t(k)) TO '{tmp_path}/pages.parquet'")
    again = duckdb.connect()
    again.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    df = registry.queries()["reachable_pages"](spark, str(tmp_path))
    cur = again.execute(registry.oracles()["reachable_pages"])
    want = check.rows_of([d[0] for d in cur.description], cur.fetchall())
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == want and len(set(got)) < len(got)


@pytest.mark.parametrize("name", ["check_tickets", "merged_score"])
def test_pages_are_not_read_again_by_later_steps(spark, name):
    """what is read more than once is findings or rows that were written once."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan


def test_orphans_are_sought_among_other_responses_alone(spark, con, monkeypatch):
    """a page that can be audited is an item of its own side, so no rule is run on it; the counts are those of the SQL."""
    seen, whole = [], migration.gate_findings
    monkeypatch.setattr(migration, "gate_findings", lambda crawl: seen.append(crawl) or whole(crawl))
    df = registry.queries()["audit_orphans"](spark, SF)
    cur = con.execute(registry.oracles()["audit_orphans"])
    want = check.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
    assert html_pages(seen[0]).isEmpty() and not seen[0].isEmpty()


def test_advisory_rows_need_no_other_rule(spark, con, monkeypatch):
    """the advisory rules alone are run, and the rows are those of the SQL."""
    monkeypatch.setattr(audit, "page_detectors", lambda *_: pytest.fail("other rules are run"))
    df = registry.queries()["advisory_rows"](spark, SF)
    cur = con.execute(registry.oracles()["advisory_rows"])
    want = check.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_merged_score_runs_all_rules_in_one_pass(spark, con, monkeypatch):
    """F1: the pages are judged in one pass, neither words nor forms are counted for a score, and the scores are those of the SQL."""
    passes, whole = [], audit.detect
    monkeypatch.setattr(audit, "detect", lambda ctx, detectors: passes.append({d.check_id for d in detectors}) or whole(ctx, detectors))
    df = registry.queries()["merged_score"](spark, SF)
    cur = con.execute(registry.oracles()["merged_score"])
    want = check.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
    assert len(passes) == 1 and passes[0] > set(audit.ADVISORY)
