"""Queries over scan and finding history."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegate.operators import history as T
from pagegate.operators.prefix import with_previous
from pagegate.plans import fixtures as X
from pagegate.session import cut_lineage

C = F.col


def _base(s, d):
    """Records with parents, chronology and findings of the fixture."""
    f = cut_lineage(X.scan_finding(s, d))
    rec = T.scan_records(X.scan_heads(f), f)
    chrono = T.chronology(rec.drop("parent_scan_id", "digest"))
    linked = with_previous(chrono, ["target"], "n", {"scan_id": "prev"})
    linked = linked.withColumn("parent_scan_id", F.when(C("n") % 7 != 1, C("prev"))).drop("prev")
    linked = cut_lineage(linked.withColumn("digest", T.record_digest()))
    return f, linked


def _events(s, d):
    f, chrono = _base(s, d)
    return f, chrono, T.lifecycle_events(chrono, T.observations(chrono, f))


def _points(s, d):
    f, chrono = _base(s, d)
    return T.timeline(chrono, f)


def _picks(chrono):
    """Baseline and candidate of each target: a third into its history, and its latest scan."""
    last = chrono.groupBy("target").agg(F.max("n").alias("last"))
    return last.select("target", F.expr("(last + 2) div 3").alias("n")), last.select("target", C("last").alias("n"))


def _gate(s, d, known=None):
    f, chrono, ev = known or _events(s, d)
    base, cand = _picks(chrono)
    states = T.current_state(ev.join(base.select("target", C("n").alias("bn")), "target").filter("scan_n <= bn").drop("bn"))
    diff = T.finding_diff(chrono, f, states, base, cand)
    score = lambda p, name: chrono.join(p, ["target", "n"]).select("target", C("overall").alias(name))
    delta = score(base, "b").join(score(cand, "c"), "target").select("target", (C("c") - C("b")).alias("delta"))
    return chrono, diff, T.violations(diff, delta)


LOOPED = "target IN ('site-11', 'site-12') AND n = 1"


def _looped(s, d):
    """The scans with parents, the first scan of two targets coming from a later one."""
    _, chrono = _base(s, d)
    third = chrono.filter("n = 3").select("target", C("scan_id").alias("third"))
    return chrono.join(third, "target", "left").select("scan_id", F.when(F.expr(LOOPED), C("third")).otherwise(C("parent_scan_id")).alias("parent_scan_id"))


def _tampered(s, d):
    """A damaged copy of the scan store with its manifest: losses, strays, forgeries, repeats."""
    _, chrono = _base(s, d)
    manifest = chrono.filter("n % 9 <> 2").select("scan_id")
    manifest = manifest.unionByName(chrono.filter("n % 11 = 3").select("scan_id"))
    stored = chrono.filter("n % 9 <> 4").withColumn("overall", F.when(C("n") % 9 == 5, C("overall") + 1).otherwise(C("overall")))
    return stored.withColumn("ts", F.when(C("n") % 9 == 6, F.concat("ts", F.lit("!"))).otherwise(C("ts"))), manifest


def _bad_events(s, d):
    _, chrono, ev = _events(s, d)
    hurt = ev.filter("NOT (seq = 1 AND rule_id = 'SEO-003')").withColumn(
        "state", F.when((C("seq") == 2) & (C("rule_id") == "LINK-007"), "OPEN").otherwise(C("state"))
    )
    return hurt, chrono.filter("n <> 3")


LIGHT_NAME = "concat(event_type, ' check ', CAST(user_id % 5 AS VARCHAR(20)))"
LIGHT_STATUS = f"CASE {X.BUCKET} WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' WHEN 2 THEN 'manual' ELSE 'pass' END"


def _light(s, d):
    fix = lambda sql: F.expr(sql.replace("VARCHAR(20)", "STRING").replace("VARCHAR(40)", "STRING"))
    cols = X.HISTORY_COLUMNS
    rows = X.events(s, d).select(
        fix(cols["target"]).alias("host"), fix(cols["ts"]).alias("ts"), fix(cols["suite"]).alias("suite"),
        fix(LIGHT_NAME).alias("name"), fix(LIGHT_STATUS).alias("status"), "user_id",
    )
    a = rows.filter("substr(ts, 1, 10) < '2024-01-16'")
    b = rows.filter("substr(ts, 1, 10) >= '2024-01-16'")
    return a, b


def _records(s, d):
    f = X.scan_finding(s, d)
    h = X.scan_heads(f)
    return h.select(C("target").alias("host"), "ts", C("overall").alias("score"), (F.dayofmonth(F.to_date(F.substring("ts", 1, 10))) % 6 == 5).alias("partial"))


def queries():
    return {
        "scan_records": lambda s, d: (lambda f: T.scan_records(X.scan_heads(f), f).select("target", "ts", "scan_id", "fingerprint", "finding_count"))(X.scan_finding(s, d)),
        "scan_append": lambda s, d: (lambda r: T.new_rows(r.unionByName(r), r.filter("substr(ts, 9, 2) < '20'"), "scan_id").select("scan_id", "ts"))(_base(s, d)[1]),
        "scan_index": lambda s, d: (lambda b: T.scan_index(b[1], b[0]).filter("name <> 'by-digest'").select("name", "key", "scan_id"))(_base(s, d)),
        "scans_by_rule": lambda s, d: (lambda b: T.index_lookup(T.scan_index(b[1], b[0]), "by-rule", "SEC-001"))(_base(s, d)),
        "scan_lineage": lambda s, d: T.lineage(_base(s, d)[1]).select("scan_id", "previous_scan", "next_scan", "first_scan", "latest_scan", "position", "total"),
        "scan_roots": lambda s, d: T.scan_roots(_base(s, d)[1]),
        "scan_ancestors": lambda s, d: T.ancestors(_looped(s, d)),
        "scan_cycles": lambda s, d: T.parent_cycles(_looped(s, d)),
        "finding_chronology": lambda s, d: T.finding_chronology(_events(s, d)[2]).select("target", "position", "finding_id", "first_seen", "last_seen", "state"),
        "scan_children": lambda s, d: T.children(_base(s, d)[1]),
        "scan_diff": lambda s, d: (lambda b: T.adjacent_diff(b[1], b[0]).groupBy("target", "n", "change").agg(F.count("*").alias("findings")))(_base(s, d)),
        "rule_diff": lambda s, d: (lambda b: T.rule_diff(T.adjacent_diff(b[1], b[0])))(_base(s, d)),
        "suite_diff": lambda s, d: (
            lambda b: T.suite_diff(b[1], b[0].groupBy("target", "ts", "suite").agg((100 - F.sum("deduction") % 97).alias("score")))
        )(_base(s, d)),
        "timeline": lambda s, d: _points(s, d),
        "finding_lifecycle": lambda s, d: _events(s, d)[2].select(
            "target", "finding_id", "seq", "scan_n", "state", "previous_state", "kind"
        ),
        "finding_states": lambda s, d: T.current_state(_events(s, d)[2]).select("finding_id", "state", "first_seen", "last_seen", "observations"),
        "findings_by_status": lambda s, d: T.current_state(_events(s, d)[2]).filter("state = 'RESOLVED'").select("target", "finding_id"),
        "event_index": lambda s, d: T.event_index(_events(s, d)[2]).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")),
        "open_findings": lambda s, d: (lambda e: T.open_at_scan(e[1], e[2]).select("target", "ts", "open_findings"))(_events(s, d)),
        "finding_diff": lambda s, d: _gate(s, d)[1].groupBy("target", "change", "severity_changed", "evidence_changed").agg(F.count("*").alias("n")),
        "policy_violations": lambda s, d: _gate(s, d)[2].groupBy("target", "effect", "rule", "detail").agg(F.count("*").alias("n")),
        "violation_order": lambda s, d: T.ordered_violations(_gate(s, d)[2]).select("target", "position", "effect", "rule", "detail"),
        "regression_gate": lambda s, d: (lambda g: T.gate_verdicts(g[0], g[2]))(_gate(s, d)),
        "baseline_pointer": lambda s, d: (lambda c: T.latest_per(c.filter("n % 4 = 1").select("target", "n", "scan_id"), ["target"], ["n"]))(_base(s, d)[1]),
        "milestones": lambda s, d: T.milestones(_points(s, d)),
        "trajectory": lambda s, d: T.trajectory(_points(s, d)),
        "streaks": lambda s, d: T.streaks(_points(s, d).withColumn("finding_count", F.when(C("finding_count") < 3, 0).otherwise(C("finding_count")))),
        "finding_rollups": lambda s, d: T.finding_rollups(_events(s, d)[2]),
        "executive_summary": lambda s, d: (lambda e: T.executive_summary(T.timeline(e[1], e[0]), T.open_at_scan(e[1], e[2]), T.gate_verdicts(e[1], _gate(s, d, e)[2])))(_events(s, d)),
        "store_integrity": lambda s, d: T.scan_integrity(*_tampered(s, d)).groupBy("issue").agg(F.count("*").alias("n")),
        "event_integrity": lambda s, d: T.event_integrity(*_bad_events(s, d)).groupBy("issue").agg(F.count("*").alias("n")),
        "clean_event_store": lambda s, d: (lambda e: T.event_integrity(e[2], e[1]))(_events(s, d)),
        "light_compare": lambda s, d: T.light_compare(*_light(s, d)).select("host", "suite", "check", "change"),
        "light_summary": lambda s, d: (lambda p: T.light_summary(T.light_compare(*p), *p))(_light(s, d)),
        "suite_trend": lambda s, d: T.suite_trend(*_light(s, d)),
        "complete_history": lambda s, d: T.complete_history(_records(s, d)).select("host", "ts", "score", "previous_ts", "trend"),
        "latest_complete": lambda s, d: T.latest_complete(_records(s, d)),
    }


def _js(c: str) -> str:
    return f"""concat('"', {c}, '"')"""


ITEM_JSON = (
    "concat('[{\"id\":\"', event_type, '\",\"page\":\"', page, '\",\"section\":\"main\",\"value\":\"', CAST(bucket AS VARCHAR), '\"}]')"
)
LEAF = (
    "sha256(concat('{\"deduction\":', CAST(deduction AS VARCHAR), ',\"evidenceNormalized\":', " + ITEM_JSON + ", ',\"page\":\"', page, "
    "'\",\"ruleId\":\"', rule_id, '\",\"severity\":\"', severity, '\",\"status\":\"', status, '\",\"suite\":\"', suite, '\"}'))"
)


def base_sql() -> str:
    return f"""WITH RECURSIVE f AS MATERIALIZED ({X.scan_findings_sql()}),
heads AS (SELECT target, ts, 100 - (count(*) * 7) % 41 AS overall FROM f GROUP BY target, ts),
leaves AS (SELECT target, ts, d, count(*) AS n FROM (SELECT target, ts, {LEAF} AS d FROM f) GROUP BY ALL),
bk AS (SELECT target, ts, d[1:3] AS b, sha256(string_agg(concat(d, ':', n), ',' ORDER BY concat(d, ':', n))) AS bd, sum(n) AS n FROM leaves GROUP BY ALL),
rt AS (SELECT target, ts, sha256(string_agg(concat(b, '=', bd), ',' ORDER BY concat(b, '=', bd))) AS fd, CAST(sum(n) AS BIGINT) AS finding_count FROM bk GROUP BY target, ts),
rec AS (SELECT heads.target, heads.ts, overall, finding_count, sha256(concat('{{"engine":"2.0","environment":"production","findings":"', fd,
 '","overall":', CAST(overall AS VARCHAR), ',"registry":"1.0","report":"1.0","target":"', heads.target, '","verdict":"NEEDS ATTENTION"}}')) AS fingerprint
 FROM heads JOIN rt ON rt.target = heads.target AND rt.ts = heads.ts),
c AS MATERIALIZED (SELECT *, sha256(concat(fingerprint, '|', ts))[1:32] AS scan_id, row_number() OVER (PARTITION BY target ORDER BY ts) AS n FROM rec),
ch AS MATERIALIZED (SELECT *, CASE WHEN n % 7 <> 1 THEN lag(scan_id) OVER (PARTITION BY target ORDER BY n) END AS parent_scan_id FROM c)"""


DIFF = """, k AS (SELECT DISTINCT f.target, n, concat(rule_id, page, bucket) AS key, rule_id, severity FROM f JOIN c ON c.target = f.target AND c.ts = f.ts),
lastn AS (SELECT target, max(n) AS last FROM c GROUP BY target),
df AS (SELECT coalesce(a.target, b.target) AS target, coalesce(a.n + 1, b.n) AS n, coalesce(b.rule_id, a.rule_id) AS rule_id,
 CASE WHEN a.key IS NULL THEN 'introduced' WHEN b.key IS NULL THEN 'resolved' ELSE 'unchanged' END AS change
 FROM (SELECT k.* FROM k JOIN lastn ON lastn.target = k.target AND k.n < last) a FULL JOIN (SELECT * FROM k WHERE n > 1) b ON a.target = b.target AND a.n + 1 = b.n AND a.key = b.key)"""

POINTS = DIFF + """, dc AS (SELECT target, n, count(*) FILTER (change = 'introduced') AS introduced, count(*) FILTER (change = 'resolved') AS resolved FROM df GROUP BY target, n),
sv AS (SELECT target, ts, count(*) AS finding_count, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
 count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM f GROUP BY target, ts),
pt0 AS (SELECT c.target, c.n, c.n - 1 AS index, scan_id, c.ts, overall, sv.finding_count, critical, high, medium, low, overall - lag(overall) OVER (PARTITION BY c.target ORDER BY c.n) AS delta, introduced, resolved
 FROM c JOIN sv ON sv.target = c.target AND sv.ts = c.ts LEFT JOIN dc ON dc.target = c.target AND dc.n = c.n),
pt AS (SELECT target, index, scan_id, ts, overall, finding_count, critical, high, medium, low, delta, introduced, resolved, CASE WHEN n > 1 THEN 0 END AS changed,
 CASE WHEN n = 1 THEN NULL WHEN (introduced > 0 OR delta < 0) AND (resolved > 0 OR delta > 0) THEN 'mixed' WHEN introduced > 0 OR delta < 0 THEN 'regression'
  WHEN resolved > 0 OR delta > 0 THEN 'improvement' ELSE 'unchanged' END AS classification FROM pt0)"""

# The lifecycle as a step-by-step walk, one observation at a time, unlike the closed form it checks.
LIFE = """, ob AS MATERIALIZED (SELECT f.target, n AS scan_n, f.ts, pos, rule_id, severity, bucket,
 sha256(concat(rule_id, '|', sha256(f.target), '|', concat_ws('#', page, 'main', event_type)))[1:32] AS finding_id FROM f JOIN c ON c.target = f.target AND c.ts = f.ts),
ok AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY target, finding_id ORDER BY scan_n, pos) AS k FROM ob),
w AS (SELECT target, finding_id, k, scan_n, rule_id, severity, bucket, 'OPEN' AS state FROM ok WHERE k = 1
 UNION ALL SELECT ok.target, ok.finding_id, ok.k, ok.scan_n, ok.rule_id, ok.severity, ok.bucket,
  CASE WHEN ok.scan_n - w.scan_n > 1 THEN 'REOPENED' WHEN w.state = 'OPEN' THEN 'CONFIRMED' WHEN w.state = 'ACTIVE' AND ok.bucket <> w.bucket THEN 'UPDATED' ELSE 'ACTIVE' END
  FROM w JOIN ok ON ok.target = w.target AND ok.finding_id = w.finding_id AND ok.k = w.k + 1),
en AS (SELECT w.*, lead(scan_n) OVER (PARTITION BY target, finding_id ORDER BY k) AS nx FROM w),
gone AS (SELECT en.target, finding_id, k, scan_n + 1 AS scan_n, rule_id, severity, bucket, unnest(CASE state WHEN 'OPEN' THEN ['CONFIRMED', 'ACTIVE', 'RESOLVED'] WHEN 'ACTIVE' THEN ['RESOLVED'] ELSE ['ACTIVE', 'RESOLVED'] END) AS state,
  unnest(generate_series(1, CASE state WHEN 'OPEN' THEN 3 WHEN 'ACTIVE' THEN 1 ELSE 2 END)) AS step
  FROM en JOIN (SELECT target, max(n) AS last FROM c GROUP BY target) l ON l.target = en.target WHERE coalesce(nx - scan_n > 1, scan_n < last)),
ev AS MATERIALIZED (SELECT e.*, c.ts, row_number() OVER q - 1 AS seq, lag(state) OVER q AS previous_state FROM (SELECT target, finding_id, k, 0 AS step, scan_n, rule_id, severity, bucket, state FROM w
  UNION ALL SELECT target, finding_id, k, step, scan_n, rule_id, severity, bucket, state FROM gone) e JOIN c ON c.target = e.target AND c.n = e.scan_n WINDOW q AS (PARTITION BY e.target, finding_id ORDER BY k, step)),
cs AS (SELECT target, finding_id, arg_max(state, seq) AS state, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS observations FROM ev GROUP BY target, finding_id)"""

LOOPS = f""", lp AS (SELECT ch.scan_id, CASE WHEN {LOOPED.replace('target', 'ch.target').replace(' n =', ' ch.n =')} THEN t.scan_id ELSE ch.parent_scan_id END AS parent FROM ch LEFT JOIN (SELECT target, scan_id FROM ch WHERE n = 3) t ON t.target = ch.target),
an AS (SELECT l.scan_id AS descendant, l.parent AS ancestor, 1 AS distance FROM lp l JOIN lp p ON p.scan_id = l.parent
 UNION ALL SELECT an.descendant, l.parent, distance + 1 FROM an JOIN lp l ON l.scan_id = an.ancestor JOIN lp p ON p.scan_id = l.parent WHERE distance < 99)"""

OPEN = "state IN ('OPEN', 'CONFIRMED', 'ACTIVE', 'UPDATED', 'REOPENED')"
RANK = "CASE {} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"

GATE = LIFE + f""", pk AS (SELECT target, (max(n) + 2) // 3 AS bn, max(n) AS cn FROM c GROUP BY target),
bs AS (SELECT ev.target, finding_id, arg_max(state, seq) AS now FROM ev JOIN pk ON pk.target = ev.target AND scan_n <= bn GROUP BY ev.target, finding_id),
sa AS (SELECT ob.target, finding_id, arg_max(severity, pos) AS severity, arg_max(bucket, pos) AS bucket, any_value(rule_id) AS rule_id FROM ob JOIN pk ON pk.target = ob.target AND scan_n = bn GROUP BY ob.target, finding_id),
sb AS (SELECT ob.target, finding_id, arg_max(severity, pos) AS severity, arg_max(bucket, pos) AS bucket, any_value(rule_id) AS rule_id FROM ob JOIN pk ON pk.target = ob.target AND scan_n = cn GROUP BY ob.target, finding_id),
fd AS (SELECT coalesce(sa.target, sb.target) AS target, coalesce(sa.finding_id, sb.finding_id) AS finding_id, coalesce(sb.rule_id, sa.rule_id) AS rule_id, sa.severity AS fs, sb.severity AS tsv,
 sa.target IS NOT NULL AND sb.target IS NOT NULL AND sa.severity <> sb.severity AS severity_changed, sa.target IS NOT NULL AND sb.target IS NOT NULL AND sa.bucket <> sb.bucket AS evidence_changed,
 CASE WHEN sb.target IS NULL THEN 'resolved' WHEN sa.target IS NULL THEN CASE WHEN now = 'RESOLVED' THEN 'reopened' ELSE 'created' END WHEN sa.severity <> sb.severity OR sa.bucket <> sb.bucket THEN 'modified' ELSE 'unchanged' END AS change
 FROM sa FULL JOIN sb ON sa.target = sb.target AND sa.finding_id = sb.finding_id LEFT JOIN bs ON bs.target = coalesce(sa.target, sb.target) AND bs.finding_id = coalesce(sa.finding_id, sb.finding_id)),
sd AS (SELECT pk.target, b.overall - a.overall AS delta FROM pk JOIN c a ON a.target = pk.target AND a.n = bn JOIN c b ON b.target = pk.target AND b.n = cn),
vi AS (SELECT target, CASE WHEN tsv IN ('critical', 'high') THEN 'FAIL' ELSE 'WARN' END AS effect, 'new-finding' AS rule, concat('new ', tsv, ' finding ', rule_id) AS detail FROM fd WHERE change = 'created'
 UNION ALL SELECT target, 'FAIL', 'reopened', concat('reopened finding ', rule_id) FROM fd WHERE change = 'reopened'
 UNION ALL SELECT target, 'FAIL', 'severity-escalation', concat(rule_id, ' ', fs, '→', tsv) FROM fd WHERE severity_changed AND {RANK.format('tsv')} > {RANK.format('fs')} AND tsv IN ('critical', 'high')
 UNION ALL SELECT target, CASE WHEN delta <= -10 THEN 'FAIL' ELSE 'WARN' END, 'score-drop', concat('overall dropped ', -delta) FROM sd WHERE delta <= -1),
gv AS (SELECT c.target, count(*) FILTER (effect = 'FAIL') AS fails, count(*) FILTER (effect = 'WARN') AS warns FROM (SELECT DISTINCT target FROM c) c LEFT JOIN vi ON vi.target = c.target GROUP BY c.target)"""


def oracles():
    b = base_sql()
    name, st = LIGHT_NAME, LIGHT_STATUS
    h = X.HISTORY_COLUMNS
    light = f"""WITH r AS (SELECT {h['target']} AS host, {h['ts']} AS ts, {h['suite']} AS suite, {name} AS name, {st} AS status, user_id FROM events),
a AS (SELECT * FROM r WHERE substr(ts, 1, 10) < '2024-01-16'), b AS (SELECT * FROM r WHERE substr(ts, 1, 10) >= '2024-01-16'),
ka AS (SELECT host, suite, regexp_replace(lower(name), '[0-9]+', '#', 'g') AS chk, max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS r FROM a WHERE status <> 'manual' GROUP BY ALL),
kb AS (SELECT host, suite, regexp_replace(lower(name), '[0-9]+', '#', 'g') AS chk, max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS r FROM b WHERE status <> 'manual' GROUP BY ALL),
x AS (SELECT coalesce(ka.host, kb.host) AS host, coalesce(ka.suite, kb.suite) AS suite, coalesce(ka.chk, kb.chk) AS chk, ka.r AS ra, kb.r AS rb,
 CASE WHEN ka.r IS NULL THEN CASE WHEN kb.r > 0 THEN 'new' END WHEN kb.r IS NULL THEN CASE WHEN ka.r > 0 THEN 'resolved' END WHEN kb.r > ka.r THEN 'regressed' WHEN kb.r < ka.r THEN 'fixed' WHEN kb.r > 0 THEN 'persisting' END AS change
 FROM ka FULL JOIN kb ON ka.host = kb.host AND ka.suite = kb.suite AND ka.chk = kb.chk)"""
    kinds = ", ".join(f"count(*) FILTER (change = '{k}') AS {k}" for k in ("regressed", "fixed", "new", "resolved", "persisting"))
    rec = f"WITH f AS ({X.scan_findings_sql()}), r AS (SELECT target AS host, ts, 100 - (count(*) * 7) % 41 AS score, CAST(substr(ts, 9, 2) AS INTEGER) % 6 = 5 AS partial FROM f GROUP BY target, ts)"
    gaps = "SELECT target, index, finding_count, delta, CASE WHEN finding_count < 3 THEN 0 ELSE finding_count END AS fc FROM pt"
    return {
        "scan_records": f"{b} SELECT target, ts, scan_id, fingerprint, finding_count FROM c",
        "scan_append": f"{b} SELECT scan_id, ts FROM c WHERE substr(ts, 9, 2) >= '20'",
        "scan_index": f"""{b} SELECT 'by-target' AS name, sha256(target) AS key, scan_id FROM c UNION ALL SELECT 'by-date', ts[1:10], scan_id FROM c UNION ALL SELECT 'by-project', 'default', scan_id FROM c
 UNION ALL SELECT 'by-engine', '2.0', scan_id FROM c UNION ALL SELECT 'by-fingerprint', fingerprint, scan_id FROM c
 UNION ALL SELECT DISTINCT 'by-rule', rule_id, scan_id FROM c JOIN f ON f.target = c.target AND f.ts = c.ts UNION ALL SELECT DISTINCT 'by-severity', severity, scan_id FROM c JOIN f ON f.target = c.target AND f.ts = c.ts""",
        "scans_by_rule": f"{b} SELECT DISTINCT scan_id FROM c JOIN f ON f.target = c.target AND f.ts = c.ts WHERE rule_id = 'SEC-001'",
        "scan_lineage": f"""{b} SELECT scan_id, lag(scan_id) OVER w AS previous_scan, lead(scan_id) OVER w AS next_scan, first_value(scan_id) OVER w AS first_scan,
 last_value(scan_id) OVER (PARTITION BY target ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest_scan, n - 1 AS position, count(*) OVER (PARTITION BY target) AS total FROM c WINDOW w AS (PARTITION BY target ORDER BY n)""",
        "scan_roots": f"""{b}, rr AS (SELECT scan_id, scan_id AS root, 0 AS depth FROM ch WHERE parent_scan_id IS NULL UNION ALL SELECT ch.scan_id, rr.root, depth + 1 FROM rr JOIN ch ON ch.parent_scan_id = rr.scan_id) SELECT scan_id, root, depth FROM rr""",
        "scan_ancestors": f"{b}{LOOPS} SELECT descendant, ancestor, distance FROM an WHERE descendant NOT IN (SELECT descendant FROM an WHERE distance = 99)",
        "scan_cycles": f"{b}{LOOPS} SELECT descendant AS scan_id, bool_or(ancestor = descendant) AS on_cycle FROM an WHERE descendant IN (SELECT descendant FROM an WHERE distance = 99) GROUP BY descendant",
        "finding_chronology": f"{b}{LIFE} SELECT target, row_number() OVER (PARTITION BY target ORDER BY first_seen, finding_id) - 1 AS position, finding_id, first_seen, last_seen, state FROM cs",
        "scan_children": f"{b} SELECT parent_scan_id AS scan_id, scan_id AS child FROM ch WHERE parent_scan_id IS NOT NULL",
        "scan_diff": f"{b}{DIFF} SELECT target, n, change, count(*) AS findings FROM df GROUP BY ALL",
        "rule_diff": f"{b}{DIFF} SELECT target, n, rule_id, count(*) FILTER (change = 'introduced') AS introduced, count(*) FILTER (change = 'resolved') AS resolved, 0 AS changed FROM df WHERE change <> 'unchanged' GROUP BY target, n, rule_id",
        "suite_diff": f"""{b}, s AS (SELECT f.target, n, suite, 100 - sum(deduction) % 97 AS score FROM f JOIN c ON c.target = f.target AND c.ts = f.ts GROUP BY ALL), l AS (SELECT target, max(n) AS last FROM c GROUP BY target)
SELECT coalesce(p.target, q.target) AS target, coalesce(p.n + 1, q.n) AS n, coalesce(p.suite, q.suite) AS suite, CAST(p.score AS BIGINT) AS from_score, CAST(q.score AS BIGINT) AS to_score, CAST(q.score - p.score AS BIGINT) AS delta
FROM (SELECT s.* FROM s JOIN l ON l.target = s.target AND s.n < last) p FULL JOIN (SELECT * FROM s WHERE n > 1) q ON p.target = q.target AND p.n + 1 = q.n AND p.suite = q.suite""",
        "timeline": f"{b}{POINTS} SELECT * FROM pt",
        "finding_lifecycle": f"{b}{LIFE} SELECT target, finding_id, seq, scan_n, state, previous_state, CASE WHEN state = 'ACTIVE' AND previous_state = 'ACTIVE' THEN 'observation' ELSE 'transition' END AS kind FROM ev",
        "finding_states": f"{b}{LIFE} SELECT finding_id, state, first_seen, last_seen, observations FROM cs",
        "findings_by_status": f"{b}{LIFE} SELECT target, finding_id FROM cs WHERE state = 'RESOLVED'",
        "open_findings": f"""{b}{LIFE}, ss AS (SELECT target, finding_id, scan_n, arg_max(state, seq) AS state FROM ev GROUP BY ALL)
SELECT c.target, c.ts, (SELECT count(*) FROM (SELECT finding_id, arg_max(state, scan_n) AS state FROM ss WHERE ss.target = c.target AND ss.scan_n <= c.n GROUP BY finding_id) WHERE {OPEN}) AS open_findings FROM c""",
        "finding_diff": f"{b}{GATE} SELECT target, change, severity_changed, evidence_changed, count(*) AS n FROM fd GROUP BY ALL",
        "policy_violations": f"{b}{GATE} SELECT target, effect, rule, detail, count(*) AS n FROM vi GROUP BY ALL",
        "violation_order": f"{b}{GATE} SELECT target, row_number() OVER (PARTITION BY target ORDER BY effect, rule, detail) - 1 AS position, effect, rule, detail FROM vi",
        "regression_gate": f"{b}{GATE} SELECT *, CASE WHEN fails > 0 THEN 'FAIL' WHEN warns > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM gv",
        "baseline_pointer": f"{b} SELECT target, max(n) AS n, arg_max(scan_id, n) AS scan_id FROM c WHERE n % 4 = 1 GROUP BY target",
        "milestones": f"""{b}{POINTS} SELECT target, arg_min(scan_id, index) AS first_scan, arg_max(scan_id, index) AS latest_scan, arg_max(scan_id, overall * 100000 - index) AS best_scan, arg_min(scan_id, overall * 100000 + index) AS worst_scan,
 arg_min(scan_id, index) FILTER (finding_count = 0) AS first_clean FROM pt GROUP BY target""",
        "trajectory": f'{b}{POINTS} SELECT target, arg_min(overall, index) AS start, arg_max(overall, index) AS "end", min(overall) AS min, max(overall) AS max, arg_max(overall, index) - arg_min(overall, index) AS net FROM pt GROUP BY target',
        "streaks": f"""{b}{POINTS}, g AS ({gaps}), r AS (SELECT *, sum(CAST(fc > 0 AS INTEGER)) OVER (PARTITION BY target ORDER BY index) AS grp, sum(CAST(coalesce(delta, 0) <= 0 AS INTEGER)) OVER (PARTITION BY target ORDER BY index DESC) AS up,
 sum(CAST(coalesce(delta, 0) >= 0 AS INTEGER)) OVER (PARTITION BY target ORDER BY index DESC) AS dn, sum(CAST(fc > 0 AS INTEGER)) OVER (PARTITION BY target ORDER BY index DESC) AS cl FROM g)
SELECT r.target, count(*) FILTER (up = 0) AS improving, count(*) FILTER (dn = 0) AS regressing, count(*) FILTER (cl = 0) AS clean_run, max(m.longest) AS longest_clean_run
FROM r JOIN (SELECT target, max(len) AS longest FROM (SELECT target, grp, count(*) FILTER (fc = 0) AS len FROM r GROUP BY target, grp) GROUP BY target) m ON m.target = r.target GROUP BY r.target""",
        "finding_rollups": f"""{b}{LIFE}, p AS (SELECT target, finding_id, count(*) FILTER (state = 'REOPENED') AS re, epoch_ms(CAST(max(ts) FILTER ({OPEN}) AS TIMESTAMP)) - epoch_ms(CAST(min(ts) AS TIMESTAMP)) AS ms FROM ev GROUP BY target, finding_id)
SELECT target, count(*) AS findings, first(finding_id ORDER BY ms DESC, finding_id) AS longest_open, max(ms) AS open_ms, max(re) AS most_reopens FROM p GROUP BY target""",
        "executive_summary": f"""{b}{GATE}, ss AS (SELECT target, finding_id, arg_max(state, seq) AS state FROM ev GROUP BY ALL), o AS (SELECT target, count(*) FILTER ({OPEN}) AS open_findings FROM ss GROUP BY target),
t AS (SELECT target, arg_max(overall, n) AS s, arg_max(overall, n) - arg_min(overall, n) AS net FROM c GROUP BY target)
SELECT t.target, s AS current_score, open_findings, CASE WHEN fails > 0 THEN 'FAIL' WHEN warns > 0 THEN 'WARN' ELSE 'PASS' END AS verdict,
 concat(t.target, ': quality ', s, '/100 (', CASE WHEN net > 0 THEN '▲' WHEN net < 0 THEN '▼' ELSE '=' END, ' ', abs(net), ' since first scan), ', open_findings, ' open finding(s)') AS headline FROM t JOIN o ON o.target = t.target JOIN gv ON gv.target = t.target""",
        "store_integrity": f"""{b}, m AS (SELECT scan_id FROM ch WHERE n % 9 <> 2 UNION ALL SELECT scan_id FROM ch WHERE n % 11 = 3), s AS (SELECT * FROM ch WHERE n % 9 <> 4)
SELECT 'duplicate' AS issue, count(*) AS n FROM (SELECT scan_id FROM m GROUP BY scan_id HAVING count(*) > 1) UNION ALL SELECT 'missing', count(DISTINCT scan_id) FROM m WHERE scan_id NOT IN (SELECT scan_id FROM s)
UNION ALL SELECT 'orphan', count(*) FROM s WHERE scan_id NOT IN (SELECT scan_id FROM m) UNION ALL SELECT 'digest-mismatch', count(*) FROM s WHERE n % 9 IN (5, 6)
UNION ALL SELECT 'address-mismatch', count(*) FROM s WHERE n % 9 = 6 UNION ALL SELECT 'broken-chain', count(*) FROM s WHERE parent_scan_id IS NOT NULL AND parent_scan_id NOT IN (SELECT scan_id FROM s)""",
        "event_integrity": f"""{b}{LIFE}, hu AS (SELECT *, CASE WHEN seq = 2 AND rule_id = 'LINK-007' THEN 'OPEN' ELSE state END AS st FROM ev WHERE NOT (seq = 1 AND rule_id = 'SEO-003')),
hl AS (SELECT *, row_number() OVER w - 1 AS r, lag(st) OVER w AS was, lag(seq) OVER w AS pseq FROM hu WINDOW w AS (PARTITION BY target, finding_id ORDER BY seq)),
legal(f, t) AS (VALUES ('', 'OPEN'), ('OPEN', 'CONFIRMED'), ('CONFIRMED', 'ACTIVE'), ('ACTIVE', 'ACTIVE'), ('ACTIVE', 'UPDATED'), ('ACTIVE', 'RESOLVED'), ('ACTIVE', 'DUPLICATE'), ('ACTIVE', 'SUPERSEDED'),
 ('UPDATED', 'ACTIVE'), ('UPDATED', 'RESOLVED'), ('UPDATED', 'DUPLICATE'), ('UPDATED', 'SUPERSEDED'), ('RESOLVED', 'REOPENED'), ('REOPENED', 'ACTIVE')),
iss AS (SELECT 'digest-mismatch' AS issue FROM hl WHERE st <> state UNION ALL SELECT 'address-mismatch' FROM hl WHERE st <> state UNION ALL SELECT 'reorder' FROM hl WHERE seq <> r
 UNION ALL SELECT 'broken-chain' FROM hl WHERE previous_state IS DISTINCT FROM was OR coalesce(pseq, -1) <> seq - 1 UNION ALL SELECT 'invalid-transition' FROM hl WHERE NOT EXISTS (SELECT 1 FROM legal WHERE f = coalesce(was, '') AND t = st)
 UNION ALL SELECT 'orphaned-reference' FROM hl WHERE scan_n = 3)
SELECT issue, count(*) AS n FROM iss GROUP BY issue""",
        "clean_event_store": "SELECT '' AS record_id, '' AS issue WHERE FALSE",
        "light_compare": f'{light} SELECT host, suite, chk AS "check", change FROM x WHERE change IS NOT NULL',
        "light_summary": f"""{light}, fl AS (SELECT host, count(*) FILTER (status = 'fail' AND side = 'a') AS fa, count(*) FILTER (status = 'fail' AND side = 'b') AS fb FROM (SELECT host, status, 'a' AS side FROM a UNION ALL SELECT host, status, 'b' FROM b) GROUP BY host)
SELECT fl.host, coalesce(regressed, 0) AS regressed, coalesce(fixed, 0) AS fixed, coalesce(new, 0) AS new, coalesce(resolved, 0) AS resolved, coalesce(persisting, 0) AS persisting, fb > fa OR coalesce(nf, FALSE) AS worse
FROM fl LEFT JOIN (SELECT host, {kinds}, bool_or(change IN ('regressed', 'new') AND rb = 2) AS nf FROM x GROUP BY host) k ON k.host = fl.host""",
        "suite_trend": f"""{light}, s AS (SELECT host, suite, count(*) FILTER (side = 'b' AND status = 'fail') - count(*) FILTER (side = 'a' AND status = 'fail') AS d_fail, count(*) FILTER (side = 'b' AND status = 'warn') - count(*) FILTER (side = 'a' AND status = 'warn') AS d_warn
 FROM (SELECT *, 'a' AS side FROM a UNION ALL SELECT *, 'b' FROM b) GROUP BY host, suite)
SELECT *, CASE WHEN d_fail > 0 THEN 'regressed' WHEN d_fail < 0 THEN 'improved' WHEN d_warn > 0 THEN 'regressed' WHEN d_warn < 0 THEN 'improved' ELSE 'same' END AS trend FROM s""",
        "complete_history": f"{rec} SELECT host, ts, score, lag(ts) OVER w AS previous_ts, score - lag(score) OVER w AS trend FROM r WHERE NOT partial WINDOW w AS (PARTITION BY host ORDER BY ts)",
        "latest_complete": f"{rec}, m AS (SELECT host, max(ts) FILTER (NOT partial) AS ts FROM r GROUP BY host) SELECT m.host, m.ts, (SELECT count(*) FROM r WHERE r.host = m.host AND partial AND r.ts > m.ts) AS skipped_partials FROM m WHERE m.ts IS NOT NULL",
    }
