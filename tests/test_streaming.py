"""Streams must give what the batch jobs give on the same input."""

import pandas as pd
from pyspark.sql import functions as F

from pagegate.operators import history as T
from pagegate.plans import streams
from pagegate.streaming import ingest, lifecycle


def _scan_findings(spark):
    """Four findings over six scans: steady, flapping, changing, and seen twice in one scan."""
    rows = []
    for n in range(1, 7):
        ts = f"2024-01-0{n}"
        rows.append(("t", ts, 1, "SEO-001", "/a", "x"))
        if n in (1, 2, 4, 6):
            rows.append(("t", ts, 2, "SEO-002", "/b", "x"))
        rows.append(("t", ts, 3, "SEO-003", "/c", str(n if n != 5 else 4)))
        if n == 3:
            rows += [("t", ts, 4, "SEO-004", "/d", "1"), ("t", ts, 5, "SEO-004", "/d", "2")]
    df = spark.createDataFrame(rows, "target string, ts string, pos long, rule_id string, page string, value string")
    return df.select(
        "target", "ts", "pos", "rule_id", "page", F.lit("seo").alias("suite"), F.lit("warn").alias("status"), F.lit("low").alias("severity"),
        F.lit(1).alias("deduction"), F.array(F.struct("page", F.lit("main").alias("section"), F.lit("i").alias("id"), "value")).alias("items"),
    )


def _batch(spark):
    f = _scan_findings(spark)
    heads = f.select("target", "ts").distinct().withColumn("scan_id", F.col("ts"))
    chrono = T.chronology(heads)
    obs = T.observations(chrono, f)
    return chrono, obs, T.lifecycle_events(chrono, obs)


def _deliver(spark, out, deliveries, **options):
    """Runs the stream to its end after each delivery, as a job that is started anew each time."""
    schema = deliveries[0].schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{out}/in")
        life = lifecycle.lifecycle_stream(spark.readStream.schema(schema).parquet(f"{out}/in"), **options)
        q = life.writeStream.format("parquet").option("path", f"{out}/events").option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{out}/events")


def _inputs(spark, obs, heads, decisions=None):
    at = F.to_timestamp("ts").alias("at")
    ticks = spark.createDataFrame([("2100-01-01",)], "ts string").select(at)
    rows = lifecycle.inputs(obs.select("target", at, "pos", "finding_id", "evidence"), heads.select("target", at), decisions, buckets=2)
    return rows, lifecycle.inputs(obs.limit(0).select("target", at, "pos", "finding_id", "evidence"), heads.limit(0).select("target", at), None, ticks, 2)


def test_lifecycle_stream_of_split_and_interleaved_scans_equals_batch(spark, out):
    chrono, obs, events = _batch(spark)
    rows, end = _inputs(spark, obs, chrono)
    third = F.pmod(F.xxhash64("finding_id", "kind", "bucket", "value"), F.lit(3)) + F.dayofmonth("at")
    dealt = rows.withColumn("d", third).cache()
    # delivery d holds the first part of day d, the second of day d - 1, the third of day d - 2
    parts = [dealt.filter(F.col("d") == d).drop("d") for d in range(1, 9)]
    assert dealt.groupBy("at").agg(F.count_distinct("d").alias("n")).filter("n < 2").isEmpty()
    got = _deliver(spark, out, [*parts, end], late="3 days")
    cols = ("finding_id", "seq", "state", "previous_state", "kind")
    mine = sorted(map(tuple, got.select(*cols, F.date_format("at", "yyyy-MM-dd")).collect()), key=str)
    want = sorted(map(tuple, events.select(*cols, "ts").collect()), key=str)
    assert mine == want and len(want) > 20


def test_decisions_of_a_person_end_a_finding(spark, out):
    chrono, obs, events = _batch(spark)
    ids = {r.rule_id: r.finding_id for r in obs.select("rule_id", "finding_id").distinct().collect()}
    asked = [
        (ids["SEO-001"], "DUPLICATE", "2024-01-02T12"), (ids["SEO-001"], "SUPERSEDED", "2024-01-03T12"), (ids["SEO-001"], "DUPLICATE", "2024-01-04T12"),
        (ids["SEO-002"], "DUPLICATE", "2024-01-03T12"), (ids["SEO-003"], "RESOLVED", "2024-01-04T12"), ("nothing", "DUPLICATE", "2024-01-04T12"),
    ]
    decisions = spark.createDataFrame(asked, "finding_id string, state string, at string").select(F.lit("t").alias("target"), F.to_timestamp("at", "yyyy-MM-dd'T'HH").alias("at"), "finding_id", "state")
    rows, end = _inputs(spark, obs, chrono, decisions)
    got = _deliver(spark, out, [rows, end])
    known = {v: k for k, v in ids.items()}
    said = {(known.get(r.finding_id), r.state, r.kind, r.previous_state) for r in got.filter("kind IN ('decision', 'rejected')").collect()}
    assert said == {
        ("SEO-001", "DUPLICATE", "rejected", "CONFIRMED"), ("SEO-001", "SUPERSEDED", "decision", "ACTIVE"), ("SEO-001", "DUPLICATE", "rejected", "SUPERSEDED"),
        ("SEO-002", "DUPLICATE", "rejected", "RESOLVED"), ("SEO-003", "RESOLVED", "rejected", "UPDATED"), (None, "DUPLICATE", "rejected", None),
    }
    assert got.filter((F.col("finding_id") == ids["SEO-001"]) & (F.col("kind") != "rejected")).count() == 4
    batch = T.apply_decisions(events.withColumn("at", F.to_timestamp("ts")), decisions)
    cols = ("finding_id", "seq", "state", "previous_state", "kind", "at")
    assert sorted(map(str, batch.select(*cols).collect())) == sorted(map(str, got.select(*cols).collect()))


def test_resolved_findings_are_forgotten_after_their_time(spark, out):
    """SEO-002 is resolved on day 3 and comes again on day 4; resolved on day 5, again on day 6."""
    chrono, obs, _ = _batch(spark)
    rows, end = _inputs(spark, obs, chrono)
    for name, keep, again in (("short", 12 * 3_600_000, "OPEN"), ("long", 48 * 3_600_000, "REOPENED")):
        got = _deliver(spark, f"{out}/{name}", [rows, end], keep_resolved_ms=keep)
        finding = obs.filter("rule_id = 'SEO-002'").first().finding_id
        states = {r.at.day: r.state for r in got.filter(F.col("finding_id") == finding).orderBy("seq").collect() if r.at.day in (4, 6)}
        assert set(states.values()) == {again}


class _State:
    """Value and map states in memory that count their calls."""

    calls = 0

    def __init__(self):
        self.values = {}

    def __getattr__(self, name):
        do = {
            "get": lambda: self.values.get(None), "exists": lambda: None in self.values, "update": lambda v: self.values.update({None: v}),
            "getValue": self.values.get, "containsKey": self.values.__contains__, "updateValue": lambda k, v: self.values.update({k: v}), "removeKey": self.values.pop,
        }[name]

        def call(*args):
            _State.calls += 1
            return do(*args)

        return call


class _Handle:
    def __init__(self):
        self.timers = set()

    getMapState = getValueState = getListState = lambda self, *_: _State()

    def registerTimer(self, at):
        self.timers.add(at)


class _Fired:
    def __init__(self, at):
        self.getExpiryTimeInMs = lambda: at


def test_calls_to_the_state_do_not_grow_with_findings():
    """Ten thousand findings come in, half of them go, all come again: the events are those of the walk, in few calls."""
    n, days = 10_000, pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03"])
    p, handle = lifecycle.LifecycleProcessor(), _Handle()
    p.init(handle)
    _State.calls = 0
    rows = [(day, 0, k, f"f{k}", "e") for d, day in enumerate(days) for k in range(n) if d != 1 or k % 2]
    p.handleInputRows(("t", 0), iter([pd.DataFrame(rows, columns=["at", "kind", "pos", "finding_id", "value"])]), None)
    got = pd.concat([e for t in sorted(handle.timers) for e in p.handleExpiredTimer(("t", 0), None, _Fired(t))])
    assert _State.calls < n / 4
    walks = got.sort_values("seq").groupby("finding_id").state.agg(tuple)
    assert walks["f0"] == ("OPEN", "CONFIRMED", "ACTIVE", "RESOLVED", "REOPENED") and walks["f1"] == ("OPEN", "CONFIRMED", "ACTIVE")
    assert walks.value_counts().to_dict() == {walks["f0"]: n // 2, walks["f1"]: n // 2}


def test_scan_append_skips_known_ids(spark, out):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "scan_id string, v int")
    rows.coalesce(1).write.parquet(f"{out}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{out}/in")
    for cp in ("cp1", "cp2"):  # the second run replays the whole input
        ingest.append_scans(stream(), f"{out}/store", f"{out}/{cp}").awaitTermination()
    assert sorted(r.scan_id for r in spark.read.parquet(f"{out}/store").collect()) == ["a", "b"]


def test_progress_counts(spark, out):
    rows = spark.createDataFrame([("s1", "finding.created")] * 3 + [("s1", "scan.completed"), ("s2", "finding.created")], "scan_id string, kind string")
    rows.write.parquet(f"{out}/in")
    q = ingest.progress(spark.readStream.schema(rows.schema).parquet(f"{out}/in")).writeStream.format("memory").queryName("prog").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.scan_id, r.kind): r.n for r in spark.table("prog").collect()} == {("s1", "finding.created"): 3, ("s1", "scan.completed"): 1, ("s2", "finding.created"): 1}


def test_long_lives_equal_one_pass(spark, monkeypatch):
    """Both ways give the same events in every column, and one pass moves the observations once."""
    f = streams.X.scan_finding(spark, "/root/testdata/sf0.001")
    chrono = T.chronology(f.select("target", "ts").distinct().withColumn("scan_id", F.concat("target", "ts"))).localCheckpoint()
    obs = T.observations(chrono, f)
    once = T.lifecycle_events(chrono, obs)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning(target" in line and "finding_id" in line for line in plan.splitlines()) == 1, plan
    monkeypatch.setattr(T, "LONG_LIFE", 3)
    split = T.lifecycle_events(chrono, obs)
    columns = sorted(once.columns)
    assert sorted(split.columns) == columns
    a, b = (sorted(map(tuple, df.select(*columns).collect()), key=str) for df in (once, split))
    assert len(a) > 1000 and a == b
