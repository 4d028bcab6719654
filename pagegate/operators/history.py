"""Scan history: content-addressed records, diffs, finding lifecycles, timelines, regression gates.

Tables
  scan(target, scan_id, ts, overall, verdict, project, engine, parent_scan_id, ...)
  scan_finding(target, scan_id, pos, rule_id, suite, status, severity, deduction, page, items)

`ts` is ISO text and sorts as time does. Order inside a target comes from `prefix`, so one target may
own most scans. A finding's own life is read in one task, with windows that spill, up to LONG_LIFE observations; longer ones
come from `prefix` too. The stored events of one finding are judged in one task whatever their number.
"""

from __future__ import annotations

from functools import reduce

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegate.functions.digest import canonical_json, json_string, sha256
from pagegate.functions.grades import severity_rank, status_rank
from pagegate.functions.text import norm_check_name
from pagegate.operators.prefix import rank_within, running_max, running_sum, with_previous
from pagegate.session import cut_lineage

C = F.col
OPEN_STATES = ("OPEN", "CONFIRMED", "ACTIVE", "UPDATED", "REOPENED")
CLOSED_STATES = ("RESOLVED", "DUPLICATE", "SUPERSEDED")

LONG_LIFE = 1_000_000

# States a finding may move between.
TRANSITIONS = {
    "": "OPEN",
    "OPEN": "CONFIRMED",
    "CONFIRMED": "ACTIVE",
    "ACTIVE": "ACTIVE UPDATED RESOLVED DUPLICATE SUPERSEDED",
    "UPDATED": "ACTIVE RESOLVED DUPLICATE SUPERSEDED",
    "RESOLVED": "REOPENED",
    "REOPENED": "ACTIVE",
}


# ---- identities ----------------------------------------------------------------------------


def sorted_items(items: Column) -> Column:
    """Items in their canonical order: page, section, id and value as one text."""
    return F.array_sort(
        F.transform(
            items,
            lambda i: F.struct(
                F.concat(i["page"], i["section"], i["id"], i["value"]).alias("k"), i["page"].alias("page"),
                i["section"].alias("section"), i["id"].alias("id"), i["value"].alias("value"),
            ),
        )
    )


def location_key(page: Column, items: Column) -> Column:
    """Where a finding stands: its items without their values, or its page when it has none."""
    places = F.transform(sorted_items(items), lambda i: F.concat_ws("#", i["page"], i["section"], i["id"]))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(places, "|")).otherwise(F.coalesce(page, F.lit("")))


def finding_identity(rule_id: Column, target: Column, page: Column, items: Column) -> Column:
    return F.substring(sha256(F.concat_ws("|", rule_id, sha256(target), location_key(page, items))), 1, 32)


def evidence_json(items: Column) -> Column:
    """Canonical JSON of the sorted evidence items."""
    one = lambda i: canonical_json(
        page=json_string(i["page"]), section=json_string(i["section"]), id=json_string(i["id"]), value=json_string(i["value"])
    )
    return F.concat(F.lit("["), F.array_join(F.transform(sorted_items(items), one), ","), F.lit("]"))


def diff_key(rule_id: Column, page: Column, items: Column) -> Column:
    """Identity inside one scan diff: rule, page and the full evidence."""
    ev = F.array_join(
        F.transform(items, lambda i: F.concat_ws("#", i["page"], i["section"], i["id"], i["value"])), "|"
    )
    return F.concat_ws("::", F.coalesce(rule_id, F.lit("")), F.coalesce(page, F.lit("")), F.coalesce(ev, F.lit("")))


# ---- records -------------------------------------------------------------------------------


def finding_digest() -> Column:
    """Digest of one finding's content, its fields as canonical JSON."""
    return sha256(
        canonical_json(
            ruleId=json_string(C("rule_id")), suite=json_string(C("suite")), status=json_string(C("status")),
            severity=json_string(C("severity")), deduction=C("deduction").cast("string"), page=json_string(C("page")),
            evidenceNormalized=evidence_json(C("items")),
        )
    )


def scan_records(scan: DataFrame, scan_finding: DataFrame) -> DataFrame:
    """Content-addressed scan records.

    The fingerprint of a scan is a hash tree over its findings: equal findings are counted, their
    digests fall into 4096 buckets by their first digits, each bucket is hashed in order and the
    buckets are hashed with the scan's own fields. A scan of any number of findings is never one row.
    """
    keys = ["target", "ts"]
    leaves = scan_finding.select(*keys, finding_digest().alias("d")).groupBy(*keys, "d").agg(F.count("*").alias("n"))
    buckets = leaves.groupBy(*keys, F.substring("d", 1, 3).alias("b")).agg(
        sha256(F.array_join(F.array_sort(F.collect_list(F.concat("d", F.lit(":"), "n"))), ",")).alias("bd"),
        F.sum("n").alias("n"),
    )
    roots = buckets.groupBy(*keys).agg(
        sha256(F.array_join(F.array_sort(F.collect_list(F.concat("b", F.lit("="), "bd"))), ",")).alias("findings_digest"),
        F.sum("n").alias("finding_count"),
    )
    j = scan.join(roots, keys, "left")
    content = canonical_json(
        target=json_string(C("target")), environment=json_string(C("environment")), engine=json_string(C("engine")),
        registry=json_string(C("registry")), report=json_string(C("report")), verdict=json_string(C("verdict")),
        overall=C("overall").cast("string"), findings=json_string(C("findings_digest")),
    )
    fp = j.withColumn("fingerprint", sha256(content))
    ids = fp.withColumn("scan_id", F.substring(sha256(F.concat_ws("|", "fingerprint", "ts")), 1, 32))
    return ids.withColumn("target_digest", sha256(C("target"))).withColumn("digest", record_digest())


def record_digest() -> Column:
    return sha256(
        canonical_json(
            scanId=json_string(C("scan_id")), fingerprint=json_string(C("fingerprint")), timestamp=json_string(C("ts")),
            target=json_string(C("target")), project=json_string(C("project")), parentScanId=json_string(C("parent_scan_id")),
            verdict=json_string(C("verdict")), overall=C("overall").cast("string"),
        )
    )


def new_rows(incoming: DataFrame, stored: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows to append to a content-addressed table: a known key is a no-op, a repeated one counts once."""
    keys = [key] if isinstance(key, str) else key
    known = stored.select(*[C(k).alias(f"known_{k}") for k in keys])
    once = incoming.dropDuplicates(keys)
    return once.join(known, reduce(lambda a, b: a & b, [once[k].eqNullSafe(known[f"known_{k}"]) for k in keys]), "left_anti")


def scan_index(records: DataFrame, scan_finding: DataFrame) -> DataFrame:
    """Secondary index rows (name, key, scan_id); rules and severities of a scan once each."""
    pair = lambda name, key: F.struct(F.lit(name).alias("name"), key.cast("string").alias("key"))
    own = records.select(
        "scan_id",
        F.inline(
            F.array(
                pair("by-target", C("target_digest")), pair("by-date", F.substring("ts", 1, 10)), pair("by-project", C("project")),
                pair("by-engine", F.coalesce("engine", F.lit("unknown"))), pair("by-digest", C("digest")),
                pair("by-fingerprint", C("fingerprint")),
            )
        ),
    )
    facts = scan_finding.join(records.select("target", "ts", "scan_id"), ["target", "ts"])
    from_findings = facts.select(
        "scan_id", F.inline(F.array(pair("by-rule", C("rule_id")), pair("by-severity", C("severity"))))
    ).filter("key IS NOT NULL").distinct()
    return own.unionByName(from_findings)


def index_lookup(index: DataFrame, name: str, key: str) -> DataFrame:
    """Scans under one key; the table is partitioned by name, so only that part is read."""
    return index.filter((C("name") == name) & (C("key") == key)).select("scan_id")


def event_index(events: DataFrame) -> DataFrame:
    pair = lambda name, key: F.struct(F.lit(name).alias("name"), key.cast("string").alias("key"))
    return events.select(
        "record_id",
        F.inline(
            F.array(
                pair("by-finding", C("finding_id")), pair("by-rule", C("rule_id")), pair("by-target", sha256(C("target"))),
                pair("by-severity", F.coalesce("severity", F.lit("none"))), pair("by-status", C("state")),
                pair("by-scan", F.coalesce("scan_id", F.lit("none"))), pair("by-fingerprint", C("fingerprint")),
                pair("by-digest", C("digest")), pair("by-date", F.substring("ts", 1, 10)),
            )
        ),
    )


# ---- chronology ----------------------------------------------------------------------------


def chronology(scan: DataFrame) -> DataFrame:
    """Scans with their position per target, oldest first."""
    return rank_within(scan, ["target"], ["ts", "scan_id"], "n")


def lineage(chrono: DataFrame) -> DataFrame:
    """Previous, next, first and latest scan of each scan, with position and total."""
    ends = chrono.groupBy("target").agg(
        F.min_by("scan_id", "n").alias("first_scan"), F.max_by("scan_id", "n").alias("latest_scan"), F.count("*").alias("total")
    )
    out = with_previous(chrono, ["target"], "n", {"scan_id": "previous_scan"})
    out = with_previous(out.select("target", "n", "scan_id", "ts", "previous_scan"), ["target"], "n", {"scan_id": "next_scan"}, -1)
    return out.join(ends, "target").withColumn("position", C("n") - 1)


def _links(scan: DataFrame) -> DataFrame:
    """Each scan with its parent, where that exists."""
    ids = scan.select(C("scan_id").alias("up")).distinct()
    return scan.select("scan_id", C("parent_scan_id").alias("up")).join(ids, "up", "left_semi").select("scan_id", "up")


def _doubled(scan: DataFrame) -> list[DataFrame]:
    """(scan_id, up): the ancestor 1, 2, 4, ... links away, until none is left or the distance is at least the number of
    scans. What is left then leads into a cycle, for no path without one is that long."""
    at = cut_lineage(_links(scan))
    n, out = scan.count(), []
    while not at.isEmpty():
        out.append(at)
        if 1 << (len(out) - 1) >= n:
            break
        at = cut_lineage(at.join(at.select(C("scan_id").alias("up"), C("up").alias("further")), "up").select("scan_id", C("further").alias("up")))
    return out


def parent_cycles(scan: DataFrame) -> DataFrame:
    """scan_id, on_cycle: scans whose parent links come to no end, and whether they are on the cycle or only lead into it."""
    steps, n = _doubled(scan), scan.count()
    if not steps or 1 << (len(steps) - 1) < n:
        return scan.select("scan_id", F.lit(True).alias("on_cycle")).limit(0)
    last = steps[-1]
    # after so many links everyone stands on a cycle, and each of its scans is reached
    return last.select("scan_id").join(last.select(C("up").alias("scan_id"), F.lit(True).alias("c")).distinct(), "scan_id", "left").select("scan_id", F.coalesce("c", F.lit(False)).alias("on_cycle"))


def ancestors(scan: DataFrame) -> DataFrame:
    """descendant, ancestor, distance of every pair along parent links, for scans that lead into no cycle.

    Pairs up to distance 2**r, and the one ancestor exactly 2**r away, make all pairs up to 2**(r + 1); each pair arises once."""
    lost = parent_cycles(scan).select("scan_id")
    sound = cut_lineage(scan.select("scan_id", "parent_scan_id").join(lost, "scan_id", "left_anti"))
    jump = cut_lineage(_links(sound))
    pairs = jump.select(C("scan_id").alias("descendant"), C("up").alias("ancestor"), F.lit(1).cast("long").alias("distance"))
    reach = 1
    while not jump.isEmpty():
        far = jump.withColumnsRenamed({"scan_id": "from_id", "up": "descendant"}).join(pairs, "descendant")
        more = cut_lineage(far.select(C("from_id").alias("descendant"), "ancestor", (C("distance") + reach).alias("distance")))
        jump = more.filter(C("distance") == 2 * reach).select(C("descendant").alias("scan_id"), C("ancestor").alias("up"))
        pairs, reach = pairs.unionByName(more), 2 * reach
    return pairs


def scan_roots(scan: DataFrame) -> DataFrame:
    """Root and depth of every scan that leads into no cycle, by doubling: a chain of length n takes log2(n) joins. A broken parent link
    ends a chain; scans of cycles are `parent_cycles`."""
    lost = parent_cycles(scan).select("scan_id")
    known = scan.join(lost, "scan_id", "left_anti").select("scan_id").join(_links(scan), "scan_id", "left")
    at = cut_lineage(known.select("scan_id", "up", F.coalesce("up", "scan_id").alias("root"), F.when(C("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth")))
    while not at.filter("up IS NOT NULL").isEmpty():
        hop = at.select(C("scan_id").alias("up"), C("up").alias("up2"), C("root").alias("root2"), C("depth").alias("depth2"))
        at = cut_lineage(
            at.join(hop, "up", "left").select(
                "scan_id", C("up2").alias("up"), F.coalesce("root2", "root").alias("root"),
                (C("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            )
        )
    return at.select("scan_id", "root", "depth")


def finding_chronology(events: DataFrame) -> DataFrame:
    """Findings of each target in the order in which they were first seen: position from 0, first and last seen, state, events."""
    return rank_within(current_state(events), ["target"], ["first_seen", "finding_id"], "r").withColumn("position", C("r") - 1).drop("r")


def children(scan: DataFrame) -> DataFrame:
    return scan.filter("parent_scan_id IS NOT NULL").select(C("parent_scan_id").alias("scan_id"), C("scan_id").alias("child"))


# ---- diffs ---------------------------------------------------------------------------------


def _sides(chrono: DataFrame, scan_finding: DataFrame, key: Column, rep: Iterable[str]) -> DataFrame:
    """Each finding as part of its own scan and as the past of the next one, last of equal keys kept."""
    pos = chrono.select("target", "ts", "n", "scan_id")
    f = scan_finding.join(pos, ["target", "ts"]).withColumn("key", key)
    return f.groupBy("target", "n", "key").agg(F.max_by(F.struct(*rep), "pos").alias("f"))


def adjacent_diff(chrono: DataFrame, scan_finding: DataFrame) -> DataFrame:
    """Findings introduced, resolved, changed or unchanged between each scan and the one before."""
    rep = ("rule_id", "page", "severity", "status", "deduction")
    side = _sides(chrono, scan_finding, sha256(diff_key(C("rule_id"), C("page"), C("items"))), rep)
    now = side.filter("n > 1").select("target", "n", "key", C("f").alias("b"))
    last = chrono.groupBy("target").agg(F.max("n").alias("last"))
    past = side.select("target", (C("n") + 1).alias("n"), "key", C("f").alias("a")).join(last, "target").filter("n <= last").drop("last")
    j = past.join(now, ["target", "n", "key"], "full_outer")
    same = (
        C("a.severity").eqNullSafe(C("b.severity")) & C("a.status").eqNullSafe(C("b.status"))
        & C("a.deduction").eqNullSafe(C("b.deduction"))
    )
    change = F.when(C("a").isNull(), "introduced").when(C("b").isNull(), "resolved").when(same, "unchanged").otherwise("changed")
    return j.select(
        "target", "n", "key", change.alias("change"), F.coalesce("b.rule_id", "a.rule_id").alias("rule_id"),
        C("a.severity").alias("from_severity"), C("b.severity").alias("to_severity"),
    )


def rule_diff(diff: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(C("change") == c).alias(c)
    return diff.filter("rule_id IS NOT NULL AND change <> 'unchanged'").groupBy("target", "n", "rule_id").agg(
        n("introduced"), n("resolved"), n("changed")
    )


def suite_diff(chrono: DataFrame, suite_score: DataFrame) -> DataFrame:
    """Score change per suite against the scan before. `suite_score(target, ts, suite, score)`."""
    s = suite_score.join(chrono.select("target", "ts", "n"), ["target", "ts"])
    last = chrono.groupBy("target").agg(F.max("n").alias("last"))
    past = s.select("target", (C("n") + 1).alias("n"), "suite", C("score").alias("from_score")).join(last, "target").filter("n <= last").drop("last")
    now = s.filter("n > 1").select("target", "n", "suite", C("score").alias("to_score"))
    return past.join(now, ["target", "n", "suite"], "full_outer").withColumn("delta", C("to_score") - C("from_score"))


def timeline(chrono: DataFrame, scan_finding: DataFrame) -> DataFrame:
    """One point per scan: score, findings by severity, and what changed since the scan before."""
    sev = [F.count_if(C("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    counts = scan_finding.groupBy("target", "ts").agg(F.count("*").alias("finding_count"), *sev)
    d = adjacent_diff(chrono, scan_finding)
    up = (C("change") == "changed") & (severity_rank(C("to_severity")) > severity_rank(C("from_severity")))
    down = (C("change") == "changed") & (severity_rank(C("to_severity")) < severity_rank(C("from_severity")))
    changes = d.groupBy("target", "n").agg(
        *[F.count_if(C("change") == c).alias(c) for c in ("introduced", "resolved", "changed", "unchanged")],
        F.bool_or(up).alias("worse"), F.bool_or(down).alias("better"),
    )
    base = with_previous(chrono.select("target", "n", "scan_id", "ts", "overall"), ["target"], "n", {"overall": "before"})
    p = base.join(counts, ["target", "ts"], "left").join(changes, ["target", "n"], "left")
    p = p.fillna(0, ["finding_count", "critical", "high", "medium", "low"]).withColumn("delta", C("overall") - C("before"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    worse = (zero(C("introduced")) > 0) | F.coalesce("worse", F.lit(False)) | F.coalesce(C("delta") < 0, F.lit(False))
    better = (zero(C("resolved")) > 0) | F.coalesce("better", F.lit(False)) | F.coalesce(C("delta") > 0, F.lit(False))
    cls = F.when(worse & better, "mixed").when(worse, "regression").when(better, "improvement").otherwise("unchanged")
    first = C("n") == 1
    return p.select(
        "target", (C("n") - 1).alias("index"), "scan_id", "ts", "overall", "finding_count", "critical", "high", "medium", "low",
        "delta", *[F.when(~first, zero(C(c))).alias(c) for c in ("introduced", "resolved", "changed")],
        F.when(~first, cls).alias("classification"),
    )


# ---- finding lifecycle ---------------------------------------------------------------------


def observations(chrono: DataFrame, scan_finding: DataFrame) -> DataFrame:
    """Findings with their identity and the digest of their evidence, in scan order."""
    pos = chrono.select("target", "ts", C("n").alias("scan_n"), "scan_id")
    return scan_finding.filter("rule_id IS NOT NULL").join(pos, ["target", "ts"]).select(
        "target", "scan_n", "scan_id", "ts", "pos", "rule_id", "severity", "page",
        finding_identity(C("rule_id"), C("target"), C("page"), C("items")).alias("finding_id"),
        sha256(evidence_json(C("items"))).alias("evidence"),
    )


def lifecycle_events(chrono: DataFrame, obs: DataFrame) -> DataFrame:
    """Every lifecycle event of every finding.

    A finding's life splits into episodes of consecutive scans. An episode opens OPEN, CONFIRMED,
    ACTIVE the first time and REOPENED, ACTIVE later on. After that an observation is UPDATED when its
    evidence changed while ACTIVE, and ACTIVE otherwise; so inside a run of changes the states
    alternate, and the parity of the place in the run decides. When the next scan lacks the finding it
    walks the legal path to RESOLVED.

    Findings are dealt by their key once; only one with more than `LONG_LIFE` observations is cut into blocks.
    """
    key = ["target", "finding_id"]
    o = cut_lineage(obs.select(*key, "scan_n", "scan_id", "ts", "pos", "rule_id", "severity", "evidence"))
    long = cut_lineage(o.groupBy(*key).agg(F.count("*").alias("n")).filter(C("n") > LONG_LIFE).select(*key))
    if long.isEmpty():
        return _lives(chrono, o)
    out = _lives(chrono, o.join(long, key, "left_anti"))
    return out.unionByName(_long_lives(chrono, o.join(long, key, "left_semi")).select(*out.columns))


def _record_id(seq: Column, state: Column, evidence: Column, ts: Column) -> Column:
    return F.substring(sha256(F.concat_ws("|", "finding_id", seq.cast("string"), state, evidence, ts)), 1, 32)


def _lives(chrono: DataFrame, obs: DataFrame) -> DataFrame:
    """One pass over each finding's observations in order: all windows share one exchange and one sort. The walk to RESOLVED
    hangs on an episode's last observation, and each event's parent is named from what that row knows."""
    key = ["target", "finding_id"]
    w = Window.partitionBy(*key).orderBy("scan_n", "pos")
    upto, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    last = chrono.groupBy("target").agg(F.max("n").alias("last_n"))
    o = obs.select(*key, "scan_n", "pos", "rule_id", "severity", "evidence").join(last, "target")
    o = o.select(
        "*", F.row_number().over(w).cast("long").alias("k"), F.lag("scan_n").over(w).alias("prev_scan"),
        F.lag("evidence").over(w).alias("prev_evidence"), F.lead("scan_n").over(w).alias("next_scan"),
    )
    starts = F.when(C("prev_scan").isNull() | (C("scan_n") - C("prev_scan") > 1), C("k"))
    o = o.withColumn("episode", F.max(starts).over(upto)).withColumn("place", C("k") - C("episode") + 1)
    o = o.withColumn("settled", C("place") > F.when(C("episode") == 1, 3).otherwise(2))
    o = o.withColumn("moved", C("settled") & (C("evidence") != C("prev_evidence")))
    o = o.withColumn("last_calm", F.max(F.when(~C("moved"), C("k"))).over(upto))
    state = (
        F.when(C("settled"), F.when(C("moved") & ((C("k") - C("last_calm")) % 2 == 1), "UPDATED").otherwise("ACTIVE"))
        .when((C("episode") == 1) & (C("place") == 1), "OPEN")
        .when((C("episode") == 1) & (C("place") == 2), "CONFIRMED")
        .when(C("place") == 1, "REOPENED")
        .otherwise("ACTIVE")
    )
    # the scan after an episode's last observation, where the finding is first missing
    ended = (C("next_scan").isNull() | (C("next_scan") - C("scan_n") > 1)) & (C("scan_n") < C("last_n"))
    steps = F.when(~C("ended"), 0).when(C("state") == "OPEN", 3).when(C("state") == "ACTIVE", 1).otherwise(2)
    o = o.withColumn("state", state).withColumn("ended", ended).withColumn("steps", steps)
    o = o.select(
        "*", (C("k") - 1 + F.coalesce(F.sum("steps").over(above), F.lit(0))).alias("first_seq"),
        F.lag("state").over(w).alias("prev_state"), F.lag("ended").over(w).alias("prev_ended"),
    )

    def event(step: int, state: Column, was: Column, n: Column, parent_n: Column, parent_evidence: Column) -> Column:
        return F.struct(
            F.lit(step).alias("step"), state.alias("state"), was.alias("previous_state"), n.alias("scan_n"), parent_n.alias("parent_n"), parent_evidence.alias("parent_evidence"),
        )

    gone = C("scan_n") + 1

    def walk(*states: str) -> list[Column]:
        was = [C("state"), *map(F.lit, states)]
        return [event(i + 1, F.lit(x), was[i], gone, gone if i else C("scan_n"), C("evidence")) for i, x in enumerate(states)]

    was = F.when(C("prev_ended"), "RESOLVED").otherwise(C("prev_state"))
    seen = event(0, C("state"), was, C("scan_n"), C("prev_scan") + F.when(C("prev_ended"), 1).otherwise(0), C("prev_evidence"))
    events = (
        F.when(C("steps") == 0, F.array(seen))
        .when(C("steps") == 3, F.array(seen, *walk("CONFIRMED", "ACTIVE", "RESOLVED")))
        .when(C("steps") == 1, F.array(seen, *walk("RESOLVED")))
        .otherwise(F.array(seen, *walk("ACTIVE", "RESOLVED")))
    )
    e = o.select(*key, "k", "rule_id", "severity", "evidence", "first_seq", F.inline(events)).withColumn("seq", C("first_seq") + C("step"))
    e = e.join(chrono.select("target", C("n").alias("scan_n"), "scan_id", "ts"), ["target", "scan_n"])
    e = e.join(chrono.select("target", C("n").alias("parent_n"), C("ts").alias("parent_ts")), ["target", "parent_n"], "left")
    e = e.withColumn("record_id", _record_id(C("seq"), C("state"), C("evidence"), C("ts")))
    parent = F.when(C("seq") > 0, _record_id(C("seq") - 1, C("previous_state"), C("parent_evidence"), C("parent_ts")))
    e = e.withColumn("parent_record_id", parent).withColumn(
        "kind", F.when((C("state") == "ACTIVE") & (C("previous_state") == "ACTIVE"), "observation").otherwise("transition")
    ).withColumn("fingerprint", event_fingerprint()).withColumn("digest", event_digest())
    return e.drop("first_seq", "parent_n", "parent_ts", "parent_evidence")


def _long_lives(chrono: DataFrame, obs: DataFrame) -> DataFrame:
    """The events of `_lives` for findings of any number of observations: positions and maxima come from blocks of even size."""
    key = ["target", "finding_id"]
    o = rank_within(obs, key, ["scan_n", "pos"], "k")
    o = with_previous(o, key, "k", {"scan_n": "prev_scan", "evidence": "prev_evidence"})
    o = o.withColumn("starts", F.when(C("prev_scan").isNull() | (C("scan_n") - C("prev_scan") > 1), C("k")))
    # each step reads its input twice, so it is written in between instead of being worked out again
    o = cut_lineage(running_max(o, key, "k", "starts", "episode"))
    settle = F.when(C("episode") == 1, 3).otherwise(2)
    place = C("k") - C("episode") + 1
    o = o.withColumn("place", place).withColumn("settled", C("place") > settle)
    o = o.withColumn("moved", C("settled") & (C("evidence") != C("prev_evidence")))
    o = o.withColumn("calm", F.when(~C("moved"), C("k")))
    o = running_max(o, key, "k", "calm", "last_calm")
    state = (
        F.when(C("settled"), F.when(C("moved") & ((C("k") - C("last_calm")) % 2 == 1), "UPDATED").otherwise("ACTIVE"))
        .when((C("episode") == 1) & (C("place") == 1), "OPEN")
        .when((C("episode") == 1) & (C("place") == 2), "CONFIRMED")
        .when(C("place") == 1, "REOPENED")
        .otherwise("ACTIVE")
    )
    o = cut_lineage(o.withColumn("state", state))
    nxt = with_previous(
        o.select(*key, "k", "scan_n", "scan_id", "ts", "rule_id", "severity", "evidence", "state"), key, "k", {"scan_n": "next_scan_n"}, -1
    )
    seen = nxt.select(*key, "k", F.lit(0).alias("step"), "scan_n", "scan_id", "ts", "rule_id", "severity", "evidence", "state")
    # the scan after an episode's last observation, where the finding is first missing
    after = chrono.select("target", C("n").alias("gone_n"), C("scan_id").alias("gone_scan"), C("ts").alias("gone_ts"))
    ends = nxt.filter("next_scan_n IS NULL OR next_scan_n - scan_n > 1").withColumn("gone_n", C("scan_n") + 1)
    walk = (
        F.when(C("state") == "OPEN", F.array(F.lit("CONFIRMED"), F.lit("ACTIVE"), F.lit("RESOLVED")))
        .when(C("state") == "ACTIVE", F.array(F.lit("RESOLVED")))
        .otherwise(F.array(F.lit("ACTIVE"), F.lit("RESOLVED")))
    )
    gone = ends.join(after, ["target", "gone_n"]).select(
        *key, "k", F.posexplode(walk).alias("step", "state"), C("gone_n").alias("scan_n"), C("gone_scan").alias("scan_id"),
        C("gone_ts").alias("ts"), "rule_id", "severity", "evidence",
    ).withColumn("step", C("step") + 1)
    events = rank_within(seen.unionByName(gone), key, ["k", "step"], "seq")
    events = events.withColumn("seq", C("seq") - 1)
    events = events.withColumn(
        "record_id",
        F.substring(sha256(F.concat_ws("|", "finding_id", C("seq").cast("string"), "state", "evidence", "ts")), 1, 32),
    )
    out = with_previous(events, key, "seq", {"state": "previous_state", "record_id": "parent_record_id"})
    return out.withColumn(
        "kind", F.when((C("state") == "ACTIVE") & (C("previous_state") == "ACTIVE"), "observation").otherwise("transition")
    ).withColumn("fingerprint", event_fingerprint()).withColumn("digest", event_digest())


def apply_decisions(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events (with `at`, their time) and what persons decided: (target, finding_id, at, state).

    A decision is judged by the finding's state at its time, which a running maximum over both kinds of rows finds, so one
    finding may own most rows. The first legal one (DUPLICATE or SUPERSEDED of an ACTIVE or UPDATED finding) ends the chain:
    events after it fall away. All others are `rejected`.
    """
    key = ["target", "finding_id"]
    both = events.select(*key, "at", F.lit(0).alias("late"), "seq", "state").unionByName(decisions.select(*key, "at", F.lit(1).alias("late"), F.lit(None).cast("long").alias("seq"), "state").distinct())
    placed = cut_lineage(rank_within(both, key, ["at", "late", "seq", "state"], "k"))
    asof = running_max(placed, key, "k", "seq", "last_seq")
    chain = events.select(*key, C("seq").alias("last_seq"), C("state").alias("now"))
    judged = cut_lineage(asof.filter("late = 1").drop("seq").join(chain, [*key, "last_seq"], "left"))
    legal = C("now").isin("ACTIVE", "UPDATED") & C("state").isin("DUPLICATE", "SUPERSEDED")
    first = judged.filter(legal).groupBy(*key).agg(F.min(F.struct("k", "at", "state", "last_seq")).alias("end"))
    met = judged.join(first, key, "left")
    ended = C("end").isNotNull()
    taken = ended & (C("k") == C("end.k"))
    after = ended & (C("k") > C("end.k"))
    decided = met.select(
        *key, F.when(taken | after, C("end.last_seq") + 1).otherwise(C("last_seq")).alias("seq"), "at", "state",
        F.when(after, C("end.state")).otherwise(C("now")).alias("previous_state"), F.when(taken, "decision").otherwise("rejected").alias("kind"),
    )
    # one row for each decided finding; events beyond its end go
    rest = events.join(first.select(*key, C("end.at").alias("end_at")), key, "left").filter("end_at IS NULL OR at <= end_at")
    return rest.select(*key, "seq", "at", "state", "previous_state", "kind").unionByName(decided)


def event_fingerprint() -> Column:
    return sha256(
        canonical_json(
            findingId=json_string(C("finding_id")), ruleId=json_string(C("rule_id")), severity=json_string(C("severity")),
            newState=json_string(C("state")), evidenceDigest=json_string(C("evidence")), scanId=json_string(C("scan_id")),
        )
    )


def event_digest() -> Column:
    return sha256(
        canonical_json(
            recordId=json_string(C("record_id")), fingerprint=json_string(C("fingerprint")), seq=C("seq").cast("string"),
            previousState=json_string(C("previous_state")), newState=json_string(C("state")), timestamp=json_string(C("ts")),
            parentRecordId=json_string(C("parent_record_id")),
        )
    )


def current_state(events: DataFrame) -> DataFrame:
    return events.groupBy("target", "finding_id").agg(
        F.max_by(F.struct("state", "rule_id", "severity", "record_id"), "seq").alias("c"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"), F.count("*").alias("observations"),
    ).select("target", "finding_id", "c.*", "first_seen", "last_seen", "observations")


def open_at_scan(chrono: DataFrame, events: DataFrame) -> DataFrame:
    """Findings open after each scan: openings less closings up to it, counted once per finding and scan."""
    per_scan = events.groupBy("target", "finding_id", "scan_n").agg(F.max_by("state", "seq").alias("state"))
    prev = per_scan.withColumn("before", F.lag("state").over(Window.partitionBy("target", "finding_id").orderBy("scan_n")))
    is_open = C("state").isin(*OPEN_STATES).cast("int")
    was_open = F.coalesce(C("before").isin(*OPEN_STATES), F.lit(False)).cast("int")
    moves = prev.groupBy("target", C("scan_n").alias("n")).agg(F.sum(is_open - was_open).alias("net"))
    scans = chrono.select("target", "n", "scan_id", "ts").join(moves, ["target", "n"], "left").fillna(0, ["net"])
    return running_sum(scans, ["target"], "n", "net", "open_findings").drop("net")


def finding_diff(chrono: DataFrame, scan_finding: DataFrame, states: DataFrame | None, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Created, unchanged, modified, resolved or reopened findings between chosen scan pairs.

    `baseline(target, n)` and `candidate(target, n)` pick one scan per target; `states` is the
    current state a finding absent from the baseline may be reopened from.
    """
    o = observations(chrono, scan_finding)
    rep = F.struct("rule_id", "severity", "evidence")

    def side(pick: DataFrame, name: str) -> DataFrame:
        chosen = o.join(pick.select("target", C("n").alias("scan_n")), ["target", "scan_n"])
        return chosen.groupBy("target", "finding_id").agg(F.max_by(rep, "pos").alias(name))

    j = side(baseline, "a").join(side(candidate, "b"), ["target", "finding_id"], "full_outer")
    if states is not None:
        j = j.join(states.select("target", "finding_id", C("state").alias("now")), ["target", "finding_id"], "left")
    else:
        j = j.withColumn("now", F.lit(None).cast("string"))
    sev = ~C("a.severity").eqNullSafe(C("b.severity"))
    ev = C("a.evidence") != C("b.evidence")
    change = (
        F.when(C("b").isNull(), "resolved")
        .when(C("a").isNull(), F.when(C("now") == "RESOLVED", "reopened").otherwise("created"))
        .when(sev | ev, "modified")
        .otherwise("unchanged")
    )
    both = C("a").isNotNull() & C("b").isNotNull()
    return j.select(
        "target", "finding_id", change.alias("change"), F.coalesce("b.rule_id", "a.rule_id").alias("rule_id"),
        C("a.severity").alias("from_severity"), C("b.severity").alias("to_severity"),
        (both & sev).alias("severity_changed"), (both & ev).alias("evidence_changed"),
    )


# ---- regression gate -----------------------------------------------------------------------

# The default policy.
POLICY = {
    "fail_new": ("critical", "high"), "warn_new": ("medium", "low"), "fail_reopen": True,
    "fail_escalation": ("critical", "high"), "fail_drop": 10, "warn_drop": 1,
}


def violations(diff: DataFrame, score_delta: DataFrame, policy: dict | None = None, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """What a policy objects to. `score_delta(keys, delta)` is candidate less baseline; `keys` name a comparison."""
    p = {**POLICY, **(policy or {})}
    sev = C("to_severity")
    new = C("change") == "created"
    effect = (
        F.when(new & sev.isin(*p["fail_new"]), "FAIL")
        .when(new & sev.isin(*p["warn_new"]), "WARN")
        .when((C("change") == "reopened") & F.lit(p["fail_reopen"]), "FAIL")
        .when(
            C("severity_changed") & (severity_rank(sev) > severity_rank(C("from_severity"))) & sev.isin(*p["fail_escalation"]),
            "FAIL",
        )
    )
    rule = F.when(new, "new-finding").when(C("change") == "reopened", "reopened").otherwise("severity-escalation")
    detail = (
        F.when(new, F.concat(F.lit("new "), sev, F.lit(" finding "), C("rule_id")))
        .when(C("change") == "reopened", F.concat(F.lit("reopened finding "), C("rule_id")))
        .otherwise(F.concat(C("rule_id"), F.lit(" "), C("from_severity"), F.lit("→"), sev))
    )
    found = diff.select(*keys, effect.alias("effect"), rule.alias("rule"), detail.alias("detail")).filter("effect IS NOT NULL")
    drop = -C("delta")
    drops = score_delta.select(
        *keys, F.when(drop >= p["fail_drop"], "FAIL").when(drop >= p["warn_drop"], "WARN").alias("effect"),
        F.lit("score-drop").alias("rule"), F.concat(F.lit("overall dropped "), drop).alias("detail"),
    ).filter("effect IS NOT NULL")
    return found.unionByName(drops)


def gate_verdicts(targets: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    v = found.groupBy(*keys).agg(
        F.count_if(C("effect") == "FAIL").alias("fails"), F.count_if(C("effect") == "WARN").alias("warns")
    )
    j = targets.select(*keys).distinct().join(v, list(keys), "left").fillna(0, ["fails", "warns"])
    return j.withColumn("verdict", F.when(C("fails") > 0, "FAIL").when(C("warns") > 0, "WARN").otherwise("PASS"))


def ordered_violations(found: DataFrame, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """Violations with their place in the report, from 0: failures first, then by rule and detail (bytewise)."""
    ranked = rank_within(found, list(keys), ["effect", "rule", "detail"], "r")  # FAIL sorts before WARN
    return ranked.withColumn("position", C("r") - 1).drop("r")


def baseline_history(pointers: DataFrame) -> DataFrame:
    """Baseline pointers (target, scan_id, set_at, ...) with the time in which each is in force: from its own to the next one's;
    `position` from 0. Pointers set at one time follow each other by scan."""
    ranked = rank_within(pointers, ["target"], ["set_at", "scan_id"], "r")
    out = with_previous(ranked, ["target"], "r", {"set_at": "valid_to"}, -1)
    return out.withColumn("position", C("r") - 1).withColumnRenamed("set_at", "valid_from").drop("r")


def baseline_in_force(chrono: DataFrame, pointers: DataFrame) -> DataFrame:
    """target, n, baseline (scan id) of every scan: the pointer that was set last before the scan or at its time.

    An as-of join by a running maximum over scans and pointers in one order, so a target may own most of either."""
    marks = rank_within(pointers.select("target", "set_at", "scan_id").distinct(), ["target"], ["set_at", "scan_id"], "p")
    both = marks.select("target", C("set_at").alias("at"), F.lit(0).alias("kind"), "p", F.lit(None).cast("long").alias("n")).unionByName(
        chrono.select("target", C("ts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("p"), "n")
    )
    placed = cut_lineage(rank_within(both, ["target"], ["at", "kind", "p", "n"], "k"))
    asof = running_max(placed, ["target"], "k", "p", "in_force").filter("kind = 1 AND in_force IS NOT NULL").select("target", "n", C("in_force").alias("p"))
    return asof.join(marks.select("target", "p", C("scan_id").alias("baseline")), ["target", "p"]).drop("p")


def gate_history(chrono: DataFrame, scan_finding: DataFrame, pointers: DataFrame, policy: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Every scan judged against the baseline in force at its time: (target, n, baseline, baseline_n, fails, warns, verdict) and
    the violations (target, n, effect, rule, detail). A scan before the first pointer is not judged.

    A finding that the baseline lacks was resolved by then exactly when an earlier scan had it."""
    held = baseline_in_force(chrono, pointers)
    pairs = cut_lineage(held.join(chrono.select("target", C("scan_id").alias("baseline"), C("n").alias("baseline_n"), C("overall").alias("was")), ["target", "baseline"]).join(chrono.select("target", "n", C("overall").alias("is")), ["target", "n"]))
    o = cut_lineage(observations(chrono, scan_finding))
    seen = o.groupBy("target", "finding_id").agg(F.min("scan_n").alias("first_n"))
    once = o.groupBy("target", "scan_n", "finding_id").agg(F.max_by(F.struct("rule_id", "severity", "evidence"), "pos").alias("f"))

    def side(n: str, name: str) -> DataFrame:
        return once.withColumnRenamed("scan_n", n).join(pairs.select("target", "n", "baseline_n"), ["target", n]).select("target", "n", "baseline_n", "finding_id", C("f").alias(name))

    j = side("baseline_n", "a").join(side("n", "b"), ["target", "n", "baseline_n", "finding_id"], "full_outer").join(seen, ["target", "finding_id"])
    sev, both = ~C("a.severity").eqNullSafe(C("b.severity")), C("a").isNotNull() & C("b").isNotNull()
    change = (
        F.when(C("b").isNull(), "resolved")
        .when(C("a").isNull(), F.when(C("first_n") < C("baseline_n"), "reopened").otherwise("created"))
        .when(sev | (C("a.evidence") != C("b.evidence")), "modified")
        .otherwise("unchanged")
    )
    diff = j.select("target", "n", change.alias("change"), F.coalesce("b.rule_id", "a.rule_id").alias("rule_id"), C("a.severity").alias("from_severity"), C("b.severity").alias("to_severity"), (both & sev).alias("severity_changed"))
    keys = ("target", "n")
    found = violations(diff, pairs.select(*keys, (C("is") - C("was")).alias("delta")), policy, keys)
    return pairs.select(*keys, "baseline", "baseline_n").join(gate_verdicts(pairs, found, keys), list(keys)), found


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key: the current baseline, the latest snapshot, the latest verdict."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


# ---- timeline aggregates -------------------------------------------------------------------


def milestones(points: DataFrame) -> DataFrame:
    """First, latest, best, worst and first clean scan; earliest wins a tie."""
    scored = C("overall").isNotNull()
    return points.groupBy("target").agg(
        F.min_by("scan_id", "index").alias("first_scan"), F.max_by("scan_id", "index").alias("latest_scan"),
        F.max_by("scan_id", F.when(scored, F.struct("overall", -C("index")))).alias("best_scan"),
        F.min_by("scan_id", F.when(scored, F.struct("overall", "index"))).alias("worst_scan"),
        F.min_by("scan_id", F.when(C("finding_count") == 0, C("index"))).alias("first_clean"),
    )


def trajectory(points: DataFrame) -> DataFrame:
    scored = points.filter("overall IS NOT NULL")
    t = scored.groupBy("target").agg(
        F.min_by("overall", "index").alias("start"), F.max_by("overall", "index").alias("end"),
        F.min("overall").alias("min"), F.max("overall").alias("max"),
    )
    return t.withColumn("net", C("end") - C("start"))


def streaks(points: DataFrame) -> DataFrame:
    """Trailing runs of better or worse scores, and runs without findings.

    A run ends where its condition last failed, so trailing lengths come from the last failing
    position, and the longest clean run from the gaps between scans that had findings.
    """
    last = points.groupBy("target").agg(
        F.max("index").alias("last"),
        F.max(F.when(~F.coalesce(C("delta") > 0, F.lit(False)), C("index"))).alias("not_up"),
        F.max(F.when(~F.coalesce(C("delta") < 0, F.lit(False)), C("index"))).alias("not_down"),
        F.max(F.when(C("finding_count") > 0, C("index"))).alias("last_dirty"),
    )
    dirty = rank_within(points.filter("finding_count > 0").select("target", "index"), ["target"], ["index"], "r")
    gaps = with_previous(dirty, ["target"], "r", {"index": "before"}).select(
        "target", (C("index") - F.coalesce("before", F.lit(-1)) - 1).alias("gap")
    )
    longest = gaps.groupBy("target").agg(F.max("gap").alias("gap"))
    current = C("last") - F.coalesce("last_dirty", F.lit(-1))
    return last.join(longest, "target", "left").select(
        "target", (C("last") - F.coalesce("not_up", F.lit(-1))).alias("improving"),
        (C("last") - F.coalesce("not_down", F.lit(-1))).alias("regressing"), current.alias("clean_run"),
        F.greatest(current, F.coalesce("gap", F.lit(0))).alias("longest_clean_run"),
    )


def finding_rollups(events: DataFrame) -> DataFrame:
    """Longest open and most often reopened finding of each target."""
    per = events.groupBy("target", "finding_id").agg(
        F.min_by("rule_id", "seq").alias("rule_id"), F.min("ts").alias("first_seen"), F.count_if(C("state") == "REOPENED").alias("reopens"),
        F.max(F.when(~C("state").isin(*CLOSED_STATES), C("ts"))).alias("last_open"),
    )
    ms = F.unix_millis(F.to_timestamp("last_open")) - F.unix_millis(F.to_timestamp("first_seen"))
    per = per.withColumn("open_ms", F.coalesce(ms, F.lit(0)))
    return per.groupBy("target").agg(
        F.count("*").alias("findings"),
        F.min_by(F.struct("finding_id", "open_ms"), F.struct(-C("open_ms"), C("finding_id"))).alias("longest"),
        F.max("reopens").alias("most_reopens"),
    ).select("target", "findings", C("longest.finding_id").alias("longest_open"), C("longest.open_ms").alias("open_ms"), "most_reopens")


def executive_summary(points: DataFrame, open_counts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One line per target: current score, trend since the first scan, open findings, gate verdict."""
    now = latest_per(points.select("target", "index", "overall"), ["target"], ["index"])
    opened = latest_per(open_counts.select("target", "n", "open_findings"), ["target"], ["n"])
    t = trajectory(points).select("target", "net")
    j = now.join(opened.select("target", "open_findings"), "target").join(t, "target", "left").join(verdicts.select("target", "verdict"), "target", "left")
    arrow = F.when(C("net") > 0, "▲").when(C("net") < 0, "▼").otherwise("=")
    trend = F.when(C("net").isNull(), "—").otherwise(F.concat(arrow, F.lit(" "), F.abs("net"), F.lit(" since first scan")))
    return j.select(
        "target", C("overall").alias("current_score"), "open_findings", "verdict",
        F.concat(C("target"), F.lit(": quality "), C("overall"), F.lit("/100 ("), trend, F.lit("), "), C("open_findings"), F.lit(" open finding(s)")).alias("headline"),
    )


# ---- integrity -----------------------------------------------------------------------------


def scan_integrity(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """Problems of a scan store: duplicate, missing, orphan, digest and address mismatch, broken chain."""
    issue = lambda df, kind: df.select("scan_id", F.lit(kind).alias("issue"))
    dup = manifest.groupBy("scan_id").count().filter("count > 1")
    missing = manifest.select("scan_id").distinct().join(stored.select("scan_id"), "scan_id", "left_anti")
    orphan = stored.select("scan_id").distinct().join(manifest.select("scan_id"), "scan_id", "left_anti")
    forged = stored.filter(C("digest") != record_digest())
    moved = stored.filter(C("scan_id") != F.substring(sha256(F.concat_ws("|", "fingerprint", "ts")), 1, 32))
    parents = stored.select(C("scan_id").alias("parent_scan_id")).distinct()
    broken = stored.filter("parent_scan_id IS NOT NULL").join(parents, "parent_scan_id", "left_anti")
    out = issue(dup, "duplicate")
    for df, kind in ((missing, "missing"), (orphan, "orphan"), (forged, "digest-mismatch"), (moved, "address-mismatch"), (broken, "broken-chain")):
        out = out.unionByName(issue(df, kind))
    return out


def event_integrity(events: DataFrame, scans: DataFrame) -> DataFrame:
    """Problems of a finding-event store: content, addresses, order, links, transitions, lost scans.

    Rows are judged in one pass over each finding's events in order; what their hashes say is worked out before they move."""
    w = Window.partitionBy("target", "finding_id").orderBy("seq", "record_id")
    expected = _record_id(C("seq"), C("state"), C("evidence"), C("ts"))
    own = events.select(
        "target", "finding_id", "seq", "record_id", "state", "previous_state", "parent_record_id", "scan_id",
        (C("digest") != event_digest()).alias("forged"), (C("record_id") != expected).alias("misplaced"),
    )
    chain = own.select("*", F.row_number().over(w).alias("r"), F.lag("state").over(w).alias("was"), F.lag("record_id").over(w).alias("parent"))
    rows = [(a, b) for a, bs in TRANSITIONS.items() for b in bs.split()]
    legal = F.broadcast(events.sparkSession.createDataFrame(rows, "f string, state string").withColumn("legal", F.lit(True)))
    known = scans.select("scan_id").distinct().withColumn("known", F.lit(True))
    judged = chain.withColumn("f", F.coalesce("was", F.lit(""))).join(legal, ["f", "state"], "left").join(known, "scan_id", "left")
    kinds = (
        (C("forged"), "digest-mismatch"),
        (C("misplaced"), "address-mismatch"),
        (C("seq") != C("r") - 1, "reorder"),
        (~C("previous_state").eqNullSafe(C("was")) | ~C("parent_record_id").eqNullSafe(C("parent")), "broken-chain"),
        (C("legal").isNull(), "invalid-transition"),
        (C("scan_id").isNotNull() & C("known").isNull(), "orphaned-reference"),
    )
    found = judged.select("record_id", F.explode(F.array_compact(F.array(*[F.when(c, k) for c, k in kinds]))).alias("issue"))
    conflict = events.groupBy("finding_id", "seq").agg(F.min("record_id").alias("low"), F.max("record_id").alias("record_id")).filter("low <> record_id")
    return found.unionByName(conflict.select("record_id", F.lit("identity-conflict").alias("issue")))


# ---- light scan comparison -----------------------------------------------------------------


def complete_history(records: DataFrame) -> DataFrame:
    """Complete scans of each host with the complete scan before. Partial scans are stepped over."""
    whole = rank_within(records.filter("NOT partial"), ["host"], ["ts"], "n")
    return with_previous(whole, ["host"], "n", {"ts": "previous_ts", "score": "previous_score"}).withColumn(
        "trend", C("score") - C("previous_score")
    )


def latest_complete(records: DataFrame) -> DataFrame:
    """Latest complete scan of each host and how many partial ones are newer."""
    best = records.groupBy("host").agg(F.max(F.when(~C("partial"), C("ts"))).alias("ts"))
    skipped = records.join(best.select("host", C("ts").alias("chosen")), "host").groupBy("host").agg(
        F.count_if(C("partial") & (C("ts") > C("chosen"))).alias("skipped_partials")
    )
    return best.filter("ts IS NOT NULL").join(skipped, "host")


def light_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Checks of two scans per host matched by suite and digit-free name; worst status per check.
    Rows carry (host, suite, name, status)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        k = df.filter("status <> 'manual'").select("host", "suite", norm_check_name(C("name")).alias("check"), status_rank(C("status")).alias("r"))
        return k.groupBy("host", "suite", "check").agg(F.max("r").alias(name))

    j = side(a, "ra").join(side(b, "rb"), ["host", "suite", "check"], "full_outer")
    change = (
        F.when(C("ra").isNull(), F.when(C("rb") > 0, "new"))
        .when(C("rb").isNull(), F.when(C("ra") > 0, "resolved"))
        .when(C("rb") > C("ra"), "regressed")
        .when(C("rb") < C("ra"), "fixed")
        .when(C("rb") > 0, "persisting")
    )
    return j.withColumn("change", change).filter("change IS NOT NULL")


def light_summary(changes: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts per kind of change, and whether the newer scan is worse."""
    n = lambda c: F.count_if(C("change") == c).alias(c)
    c = changes.groupBy("host").agg(
        *[n(k) for k in ("regressed", "fixed", "new", "resolved", "persisting")],
        F.bool_or(C("change").isin("regressed", "new") & (C("rb") == 2)).alias("newly_failing"),
    )
    fails = lambda df, name: df.groupBy("host").agg(F.count_if(C("status") == "fail").alias(name))
    j = fails(a, "fa").join(fails(b, "fb"), "host", "full_outer").join(c, "host", "left").fillna(0)
    return j.select(
        "host", *[C(k) for k in ("regressed", "fixed", "new", "resolved", "persisting")],
        ((C("fb") > C("fa")) | F.coalesce("newly_failing", F.lit(False))).alias("worse"),
    )


def suite_trend(a: DataFrame, b: DataFrame) -> DataFrame:
    """Change of failures, then of warnings, per suite."""
    side = lambda df, x: df.groupBy("host", "suite").agg(
        F.count_if(C("status") == "fail").alias("f" + x), F.count_if(C("status") == "warn").alias("w" + x)
    )
    j = side(a, "a").join(side(b, "b"), ["host", "suite"], "full_outer").fillna(0)
    df_, dw = C("fb") - C("fa"), C("wb") - C("wa")
    trend = F.when(df_ > 0, "regressed").when(df_ < 0, "improved").when(dw > 0, "regressed").when(dw < 0, "improved").otherwise("same")
    return j.select("host", "suite", df_.alias("d_fail"), dw.alias("d_warn"), trend.alias("trend"))
