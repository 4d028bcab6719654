"""Queries over stored snapshots, verdicts and baselines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagegate.operators import history as T
from pagegate.plans import histories
from pagegate.plans import fixtures as X
from pagegate.session import cut_lineage, ensure_checkpoint_dir
from pagegate.sources import treestore as S

C = F.col
POINT = ("index", "scan_id", "ts", "overall", "finding_count", "critical", "high", "medium", "low", "delta", "introduced", "resolved", "changed", "classification")
FIELDS = ["scan_count", "first_ts", "last_ts", "start", "end", "net"]
KEY = ["index"]
HALF, WHOLE = "2024-01-15T12:00:00.000Z", "2024-02-01T00:00:00.000Z"


def _place(s):
    return f"{ensure_checkpoint_dir(s)}/store-{uuid.uuid4()}"


def _heads(points, at):
    """Head of a snapshot: what the points of a target come to."""
    ends = points.groupBy("target").agg(F.count("*").alias("scan_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    course = T.trajectory(points).select("target", "start", "end", "net")
    return ends.join(course, "target", "left").withColumn("generated_at", F.lit(at))


def _points(s, d):
    f, chrono = histories._base(s, d)
    return cut_lineage(T.timeline(chrono, f).select("target", *POINT))


def _saved(s, d):
    """Snapshots of the first half and of the whole history; the second is saved twice and counts once."""
    points, store = _points(s, d), _place(s)
    early = points.filter(C("ts") < HALF)
    S.save(_heads(early, HALF), early, KEY, store)
    for _ in range(2):
        S.save(_heads(points, WHOLE), points, KEY, store)
    return points, store


def _snapshots(s, d):
    _, store = _saved(s, d)
    return S.part(s, store, "records").select("target", "generated_at", *FIELDS, "fingerprint")


def _latest(s, d):
    _, store = _saved(s, d)
    return S.latest_for(s, store).select("target", "generated_at", "scan_count", "fingerprint")


def _copied(s, store, records=None, leaves=None, manifest=None):
    """The store again with some of its parts damaged."""
    place = _place(s)
    same = lambda df: df
    for name, change, by in (("leaves", leaves, "bucket"), ("nodes", None, "level"), ("records", records, None), ("manifest", manifest, None)):
        w = (change or same)(s.read.parquet(f"{store}/{name}")).write
        (w.partitionBy(by) if by else w).parquet(f"{place}/{name}")
    return place


def _damaged(s, d):
    """One row of one snapshot altered, a head altered, a head lost, and a commit lost."""
    _, store = _saved(s, d)
    of = lambda t, at: (C("target") == t) & (C("generated_at") == at)
    heads = s.read.parquet(f"{store}/records")
    gone = heads.filter(of("site-3", HALF)).select(S.ID)
    hurt = heads.filter(of("site-5", WHOLE)).select(S.ID, F.lit(True).alias("hurt"))

    def leaves(df):
        j = df.join(F.broadcast(hurt), S.ID, "left")  # one row
        return j.withColumn("overall", F.when(C("hurt") & (C("index") == 4), C("overall") + 1).otherwise(C("overall"))).drop("hurt")

    place = _copied(
        s, store,
        records=lambda df: df.filter(~of("site-2", WHOLE)).withColumn("net", F.when(of("site-4", WHOLE), C("net") + 1).otherwise(C("net"))),
        leaves=leaves, manifest=lambda df: df.join(F.broadcast(gone), S.ID, "left_anti"),  # one row
    )
    names = heads.select(S.ID, "target", "generated_at")
    return S.verify(s, place, FIELDS, KEY).join(names, S.ID).select("target", "generated_at", "issue")


DRIFT = "target = 'site-6' AND index IN (3, 7)"


def _drifted(s, d):
    """Snapshots against a history in which two points of one target are another's."""
    points, store = _saved(s, d)
    now = points.withColumn("overall", F.when(F.expr(DRIFT), C("overall") - 1).otherwise(C("overall")))
    told, rows = S.reproduces(s, store, _heads(now, WHOLE), now, KEY)
    n = rows.groupBy("target").agg(F.count_if(C("change") == "changed").alias("changed"), F.count("*").alias("rows"))
    return told.join(n, "target", "left").select("target", "ok", F.coalesce("changed", F.lit(0)).alias("changed"), F.coalesce("rows", F.lit(0)).alias("rows"))


# ---- baselines and verdicts ----------------------------------------------------------------------------

POINTED = "target = 'site-7' OR n % 4 = 1"


def _pointers(chrono):
    """A baseline is set at every fourth scan; one target sets one at each."""
    return chrono.filter(POINTED).select("target", "scan_id", C("ts").alias("set_at"), F.when(C("n") == 1, "first scan").otherwise("accepted").alias("reason"), F.lit("engine").alias("actor"))


def _baselines(s, d):
    return T.baseline_history(_pointers(histories._base(s, d)[1]))


def _gates(s, d):
    f, chrono = histories._base(s, d)
    late = _pointers(chrono).withColumn("set_at", F.concat("set_at", F.lit("+")))  # in force from just after its scan
    return chrono, *T.gate_history(chrono, f, late)


def _verdicts_kept(s, d):
    """The verdict on each target's newest judged scan with its violations, kept twice."""
    _, verdicts, found = _gates(s, d)
    last = verdicts.groupBy("target").agg(F.max("n").alias("n"))
    newest = cut_lineage(verdicts.join(last, ["target", "n"]))
    rows = cut_lineage(found.join(last, ["target", "n"]).drop("n"))
    heads = newest.select("target", F.lit(WHOLE).alias("generated_at"), "n", "baseline_n", "fails", "warns", "verdict")
    store = _place(s)
    kept = [S.save(heads, rows, ["effect", "rule", "detail"], store) for _ in range(2)]
    return store, heads, rows, kept


VERDICT_FIELDS = ["n", "baseline_n", "fails", "warns", "verdict"]


def _verdict_store(s, d):
    """Failed verdicts of the store, and whether each still comes out of the sources."""
    store, heads, rows, kept = _verdicts_kept(s, d)
    told, _ = S.reproduces(s, store, heads, rows.filter("NOT (target = 'site-8' AND effect = 'FAIL')"), ["effect", "rule", "detail"])
    failed = S.latest_for(s, store).filter("verdict = 'FAIL'").select("target", *VERDICT_FIELDS, S.ID)
    return failed.join(told.select(S.ID, "ok"), S.ID).drop(S.ID).withColumn("saved_again", F.lit(kept[1]))


def _verdict_damage(s, d):
    """A verdict turned from FAIL to PASS, and one violation struck out."""
    store, _, rows, _ = _verdicts_kept(s, d)
    fails = rows.filter("effect = 'FAIL'").groupBy("target").agg(F.min(F.struct("rule", "detail")).alias("x"))
    place = _copied(
        s, store, records=lambda df: df.withColumn("verdict", F.when(C("target") == "site-9", "PASS").otherwise(C("verdict"))),
        leaves=lambda df: df.join(fails.filter("target = 'site-10'").select("target", "x.rule", "x.detail", F.lit("FAIL").alias("effect")), ["target", "rule", "detail", "effect"], "left_anti"),
    )
    names = s.read.parquet(f"{store}/records").select(S.ID, "target")
    return S.verify(s, place, VERDICT_FIELDS, ["effect", "rule", "detail"]).join(names, S.ID).select("target", "issue")


def queries():
    return {
        "snapshot_store": _snapshots, "snapshot_latest": _latest, "snapshot_integrity": _damaged, "snapshot_reproduces": _drifted,
        "baseline_history": _baselines, "gate_history": lambda s, d: _gates(s, d)[1].drop("baseline"),
        "verdict_store": _verdict_store, "verdict_integrity": _verdict_damage,
    }


# ---- SQL --------------------------------------------------------------------------------------------------


def _text(c):
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _digest(*columns):
    return "sha256(" + " || ".join(map(_text, columns)) + ")"


def _snapshot_sql():
    """Heads of both saves with their fingerprints, the tree over the points worked out level by level."""
    points = ", ".join(f'"{c}"' for c in POINT)
    q = lambda names: [f'"{c}"' for c in names]
    return f"""{histories.base_sql()}{histories.POINTS},
sn AS (SELECT '{HALF}' AS generated_at, target, {points} FROM pt WHERE ts < '{HALF}' UNION ALL SELECT '{WHOLE}', target, {points} FROM pt),
lf AS (SELECT generated_at, target, {_digest('"index"')} AS k, {_digest(*q(sorted(POINT)))} AS d FROM sn),
n3 AS (SELECT generated_at, target, k[1:3] AS p, sha256(string_agg(k || ':' || d || ':1', ',' ORDER BY k, d)) AS h FROM lf GROUP BY ALL),
n2 AS (SELECT generated_at, target, p[1:2] AS p, sha256(string_agg(p || '=' || h, ',' ORDER BY p)) AS h FROM n3 GROUP BY generated_at, target, p[1:2]),
n1 AS (SELECT generated_at, target, p[1:1] AS p, sha256(string_agg(p || '=' || h, ',' ORDER BY p)) AS h FROM n2 GROUP BY generated_at, target, p[1:1]),
n0 AS (SELECT generated_at, target, sha256(string_agg(p || '=' || h, ',' ORDER BY p)) AS root FROM n1 GROUP BY generated_at, target),
hd AS (SELECT generated_at, target, count(*) AS scan_count, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(overall, index) AS start, arg_max(overall, index) AS "end",
 arg_max(overall, index) - arg_min(overall, index) AS net FROM sn GROUP BY generated_at, target),
rs AS (SELECT hd.*, {_digest("hd.target", *[f'hd."{c}"' for c in sorted(FIELDS)], "root")} AS fingerprint FROM hd JOIN n0 ON n0.target = hd.target AND n0.generated_at = hd.generated_at)"""


JUDGED = f""", ptr AS (SELECT target, n AS bn, concat(ts, '+') AS set_at FROM c WHERE {POINTED}),
pr AS (SELECT c.target, c.n, ptr.bn AS baseline_n, c.overall - b.overall AS delta FROM c ASOF JOIN ptr ON ptr.target = c.target AND c.ts >= ptr.set_at JOIN c b ON b.target = c.target AND b.n = ptr.bn),
o1 AS MATERIALIZED (SELECT target, scan_n, finding_id, arg_max(severity, pos) AS severity, arg_max(bucket, pos) AS bucket, any_value(rule_id) AS rule_id FROM ob GROUP BY ALL),
fs AS (SELECT target, finding_id, min(scan_n) AS first_n FROM ob GROUP BY ALL),
ga AS (SELECT pr.target, pr.n, baseline_n, finding_id, severity, bucket, rule_id FROM pr JOIN o1 ON o1.target = pr.target AND scan_n = baseline_n),
gb AS (SELECT pr.target, pr.n, baseline_n, finding_id, severity, bucket, rule_id FROM pr JOIN o1 ON o1.target = pr.target AND scan_n = pr.n),
gd AS (SELECT gb.target, gb.n, gb.rule_id, ga.severity AS fsv, gb.severity AS tsv, CASE WHEN ga.target IS NULL THEN CASE WHEN first_n < gb.baseline_n THEN 'reopened' ELSE 'created' END END AS change
 FROM gb LEFT JOIN ga ON ga.target = gb.target AND ga.n = gb.n AND ga.finding_id = gb.finding_id JOIN fs ON fs.target = gb.target AND fs.finding_id = gb.finding_id),
gf AS (SELECT target, n, CASE WHEN tsv IN ('critical', 'high') THEN 'FAIL' ELSE 'WARN' END AS effect, 'new-finding' AS rule, concat('new ', tsv, ' finding ', rule_id) AS detail FROM gd WHERE change = 'created'
 UNION ALL SELECT target, n, 'FAIL', 'reopened', concat('reopened finding ', rule_id) FROM gd WHERE change = 'reopened'
 UNION ALL SELECT target, n, 'FAIL', 'severity-escalation', concat(rule_id, ' ', fsv, '→', tsv) FROM gd WHERE fsv <> tsv AND {histories.RANK.format('tsv')} > {histories.RANK.format('fsv')} AND tsv IN ('critical', 'high')
 UNION ALL SELECT target, n, CASE WHEN delta <= -10 THEN 'FAIL' ELSE 'WARN' END, 'score-drop', concat('overall dropped ', -delta) FROM pr WHERE delta <= -1),
gv2 AS (SELECT pr.target, pr.n, baseline_n, count(*) FILTER (effect = 'FAIL') AS fails, count(*) FILTER (effect = 'WARN') AS warns FROM pr LEFT JOIN gf ON gf.target = pr.target AND gf.n = pr.n GROUP BY ALL),
gh AS (SELECT *, CASE WHEN fails > 0 THEN 'FAIL' WHEN warns > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM gv2),
lastv AS (SELECT gh.* FROM gh JOIN (SELECT target, max(n) AS n FROM gh GROUP BY target) m ON m.target = gh.target AND m.n = gh.n)"""


def oracles():
    b, snap = histories.base_sql(), _snapshot_sql()
    gate = f"{b}{histories.LIFE}{JUDGED}"
    fields = ", ".join(f'"{c}"' for c in FIELDS)
    return {
        "snapshot_store": f"{snap} SELECT target, generated_at, {fields}, fingerprint FROM rs",
        "snapshot_latest": f"{snap} SELECT target, generated_at, scan_count, fingerprint FROM rs WHERE generated_at = '{WHOLE}'",
        "snapshot_integrity": f"""{snap} SELECT target, generated_at, CASE target WHEN 'site-2' THEN 'missing' WHEN 'site-3' THEN 'orphan' WHEN 'site-4' THEN 'digest-mismatch' ELSE 'tree-mismatch' END AS issue FROM rs
 WHERE (target IN ('site-2', 'site-4', 'site-5') AND generated_at = '{WHOLE}') OR (target = 'site-3' AND generated_at = '{HALF}')""",
        "snapshot_reproduces": f"{b}{histories.POINTS} SELECT target, count(*) FILTER ({DRIFT}) = 0 AS ok, count(*) FILTER ({DRIFT}) AS changed, count(*) FILTER ({DRIFT}) AS rows FROM pt GROUP BY target",
        "baseline_history": f"""{b} SELECT target, scan_id, ts AS valid_from, lead(ts) OVER w AS valid_to, CASE WHEN n = 1 THEN 'first scan' ELSE 'accepted' END AS reason, 'engine' AS actor, row_number() OVER w - 1 AS position
 FROM c WHERE {POINTED} WINDOW w AS (PARTITION BY target ORDER BY n)""",
        "gate_history": f"{gate} SELECT target, n, baseline_n, fails, warns, verdict FROM gh",
        "verdict_store": f"{gate} SELECT target, n, baseline_n, fails, warns, verdict, target <> 'site-8' AS ok, 0 AS saved_again FROM lastv WHERE verdict = 'FAIL'",
        "verdict_integrity": f"{gate} SELECT target, 'digest-mismatch' AS issue FROM lastv WHERE target = 'site-9' AND verdict <> 'PASS' UNION ALL SELECT target, 'tree-mismatch' FROM lastv WHERE target = 'site-10' AND fails > 0",
    }
