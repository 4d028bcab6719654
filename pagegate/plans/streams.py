"""Stream queries, run to the end of their input and read back from the table they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagegate.operators import history as T
from pagegate.plans import fixtures as X
from pagegate.plans import histories
from pagegate.session import cut_lineage, ensure_checkpoint_dir
from pagegate.sources import versioned
from pagegate.streaming import ingest, lifecycle

C = F.col

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = "CASE event_type WHEN 'signup' THEN 'scan.started' WHEN 'error' THEN 'finding.created' WHEN 'purchase' THEN 'scan.completed' WHEN 'view' THEN 'page.started' ELSE 'page.completed' END"
SCAN_ID = "concat('site-', CAST(user_id % 20 AS VARCHAR(20)), '/', substr(CAST(ts AS VARCHAR(40)), 1, 10))"


def _source(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    e = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(F.expr(SCAN_ID.replace("VARCHAR(20)", "STRING").replace("VARCHAR(40)", "STRING")).alias("scan_id"), F.expr(KINDS).alias("kind"))


def _place(s):
    return f"{ensure_checkpoint_dir(s)}/stream-{uuid.uuid4()}"


COUNTS = "scan_id string, kind string, n bigint"


def _progress(s, d):
    place = _place(s)
    ingest.keep_progress(_source(s, d), f"{place}/out", f"{place}/cp").awaitTermination()
    return versioned.latest(s, f"{place}/out", ["scan_id", "kind"], COUNTS)


def _append(s, d):
    place = _place(s)
    ingest.append_scans(_source(s, d).select("scan_id"), f"{place}/out", f"{place}/cp").awaitTermination()
    return s.read.parquet(f"{place}/out")


# ---- finding lifecycle ---------------------------------------------------------------------------

PARTS, SPAN = 3, 7
ASKED = "pos % 17 = 3"
ASKED_STATE = "CASE WHEN pos % 2 = 0 THEN 'DUPLICATE' ELSE 'SUPERSEDED' END"


def _decisions(obs):
    """Half a day after some observations a person calls the finding a duplicate or superseded."""
    return obs.filter(ASKED).select("target", (F.to_timestamp("ts") + F.expr("INTERVAL 12 HOURS")).alias("at"), "finding_id", F.expr(ASKED_STATE).alias("state")).distinct()


def _rocks(s):
    """State of the lifecycle stream is kept in RocksDB, in as many partitions as the cluster has cores, since each is opened and
    written in every batch; other streams of the session stay as they were."""
    mine = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(s.sparkContext.defaultParallelism)}
    before = {k: s.conf.get(k) for k in mine}
    for k, v in mine.items():
        s.conf.set(k, v)
    return lambda: [s.conf.set(k, v) for k, v in before.items()]


def _lifecycle(s, d):
    """Scans of a span of days come in three deliveries, with parts of the spans before and after between them. After each
    delivery the stream runs to its end and is started anew from its checkpoint."""
    f = X.scan_finding(s, d)
    chrono = cut_lineage(T.chronology(f.select("target", "ts").distinct().withColumn("scan_id", C("ts"))))
    obs = cut_lineage(T.observations(chrono, f))
    at = F.to_timestamp("ts").alias("at")
    rows = lifecycle.inputs(obs.select("target", at, "pos", "finding_id", "evidence"), chrono.select("target", at), _decisions(obs), buckets=4)
    first = F.floor((F.dayofmonth("at") - 1) / SPAN) + F.pmod(F.xxhash64("finding_id", "kind", "bucket", "pos"), F.lit(PARTS))
    place = _place(s)
    rows.withColumn("delivery", first).write.partitionBy("delivery").parquet(f"{place}/all")
    end = s.range(1).select(F.to_timestamp(F.lit("2100-01-01")).alias("at"))
    none = obs.limit(0)
    tick = lifecycle.inputs(none.select("target", at, "pos", "finding_id", "evidence"), none.select("target", at), None, end, 4)
    back = _rocks(s)
    try:
        for k in (*range(30 // SPAN + PARTS), None):
            piece = tick if k is None else s.read.parquet(f"{place}/all").filter(C("delivery") == k).drop("delivery")
            piece.write.mode("append").parquet(f"{place}/in")
            life = lifecycle.lifecycle_stream(s.readStream.schema(rows.schema).parquet(f"{place}/in"), late=f"{SPAN * (PARTS - 1)} days")
            life.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        back()
    return s.read.parquet(f"{place}/out").select("target", "finding_id", "seq", F.date_format("at", "yyyy-MM-dd HH").alias("at"), "state", "previous_state", "kind")


def _decided(s, d):
    """The same from batch jobs."""
    f = cut_lineage(X.scan_finding(s, d))
    chrono = cut_lineage(T.chronology(f.select("target", "ts").distinct().withColumn("scan_id", C("ts"))))
    obs = cut_lineage(T.observations(chrono, f))
    events = T.lifecycle_events(chrono, obs).select("target", "finding_id", "seq", F.to_timestamp("ts").alias("at"), "state", "previous_state", "kind")
    events = cut_lineage(events)
    out = T.apply_decisions(events, _decisions(obs))
    return out.select("target", "finding_id", "seq", F.date_format("at", "yyyy-MM-dd HH").alias("at"), "state", "previous_state", "kind")


def queries():
    return {"stream_progress": _progress, "stream_scan_append": _append, "stream_lifecycle": _lifecycle, "decided_lifecycle": _decided}


def _decided_sql():
    """Events step by step, and each decision judged after those before it."""
    return f"""{histories.base_sql()}{histories.LIFE},
rq AS (SELECT DISTINCT target, finding_id, CAST(ts AS TIMESTAMP) + INTERVAL 12 HOUR AS "at", {ASKED_STATE} AS state FROM ob WHERE {ASKED}),
e2 AS (SELECT target, finding_id, seq, CAST(ts AS TIMESTAMP) AS "at", state, previous_state FROM ev),
nw AS (SELECT rq.*, e.state AS now, e.seq AS last_seq FROM rq ASOF JOIN (SELECT target, finding_id, "at", arg_max(state, seq) AS state, max(seq) AS seq FROM e2 GROUP BY ALL) e
  ON e.target = rq.target AND e.finding_id = rq.finding_id AND rq."at" >= e."at"),
ok2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, finding_id ORDER BY "at", state) AS r FROM nw WHERE now IN ('ACTIVE', 'UPDATED')) WHERE r = 1),
res AS (SELECT e2.*, CASE WHEN e2.state = 'ACTIVE' AND previous_state = 'ACTIVE' THEN 'observation' ELSE 'transition' END AS kind
  FROM e2 LEFT JOIN ok2 ON ok2.target = e2.target AND ok2.finding_id = e2.finding_id WHERE ok2."at" IS NULL OR e2."at" <= ok2."at"
 UNION ALL SELECT target, finding_id, last_seq + 1, "at", state, now, 'decision' FROM ok2
 UNION ALL SELECT nw.target, nw.finding_id, CASE WHEN ok2."at" IS NOT NULL AND (nw."at", nw.state) > (ok2."at", ok2.state) THEN ok2.last_seq + 1 ELSE nw.last_seq END, nw."at", nw.state,
  CASE WHEN ok2."at" IS NOT NULL AND (nw."at", nw.state) > (ok2."at", ok2.state) THEN ok2.state ELSE nw.now END, 'rejected'
  FROM nw LEFT JOIN ok2 ON ok2.target = nw.target AND ok2.finding_id = nw.finding_id WHERE NOT coalesce((nw."at", nw.state) = (ok2."at", ok2.state), FALSE))
SELECT target, finding_id, seq, strftime("at", '%Y-%m-%d %H') AS "at", state, previous_state, kind FROM res"""


def oracles():
    return {
        "stream_progress": f"SELECT {SCAN_ID} AS scan_id, {KINDS} AS kind, count(*) AS n FROM events GROUP BY 1, 2",
        "stream_scan_append": f"SELECT DISTINCT {SCAN_ID} AS scan_id FROM events",
        "stream_lifecycle": _decided_sql(),
        "decided_lifecycle": _decided_sql(),
    }
