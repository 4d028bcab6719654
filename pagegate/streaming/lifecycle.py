"""Finding lifecycles as scans arrive, in pieces and out of order.

Rows of four kinds come in one stream: observations of findings, heads (a scan took place), decisions that a person took on
a finding, and ticks, which only move time on. Every row carries `at`, the time of its scan or decision.

State is kept per (target, bucket of finding ids); heads are repeated once per bucket, so every bucket learns which findings a
scan no longer has, and a target with very many findings is spread over all buckets. Rows wait in the state until an
event-time timer fires: the watermark has then passed their time, so the scan is whole, however many micro-batches it was
spread over and whatever other scans came in between. What is due is applied in the order of time; at one time the scan comes
before decisions. A scan looks at its own findings and at those of the scan before, and else only at the slots of the known ones
(SLOTS in a bucket) in which these lie.

A decision moves an ACTIVE or UPDATED finding to DUPLICATE or SUPERSEDED, where it stays: later observations of it give no event.
Any other decision is passed on as `rejected` and changes nothing. With `keep_resolved`, a finding that was resolved
so long ago is forgotten by a second timer, and would be OPEN when it came again; without it nothing is forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

BUCKETS, SLOTS = 32, 64
LATE = "1 day"
OUT = "target string, bucket long, finding_id string, seq long, at timestamp, state string, previous_state string, kind string"
OBSERVATION, HEAD, DECISION, TICK = 0, 1, 2, 3
DECIDED = ("DUPLICATE", "SUPERSEDED")
CLOSED = ("RESOLVED", *DECIDED)
C = F.col


def next_state(state: str | None, changed: bool) -> str:
    """State after one more observation."""
    if state == "ACTIVE":
        return "UPDATED" if changed else "ACTIVE"
    return {None: "OPEN", "OPEN": "CONFIRMED", "RESOLVED": "REOPENED"}.get(state, "ACTIVE")


def walk_to_resolved(state: str) -> list[str]:
    """Legal path from an open state to RESOLVED."""
    return {"OPEN": ["CONFIRMED", "ACTIVE", "RESOLVED"], "ACTIVE": ["RESOLVED"]}.get(state, ["ACTIVE", "RESOLVED"])


class LifecycleProcessor(StatefulProcessor):
    """One (target, bucket). A call to the state costs more than a row's work, so rows and findings lie in the state by the many, as JSON.

    waiting: rows of one time that came together; times: time -> how many such pieces wait. seen: what is known of the findings of
    the last scan; known: of all others, by slot. What is known of one: state, seq, evidence, time of the last event. fading: time ->
    findings resolved then, while `keep_resolved` is set.
    """

    def __init__(self, keep_resolved_ms: int | None = None):
        self.keep = keep_resolved_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, part long", "rows string")
        self.times = handle.getValueState("times", "parts string")
        self.seen = handle.getValueState("seen", "findings string")
        self.known = handle.getMapState("known", "slot long", "findings string")
        self.fading = handle.getMapState("fading", "at long", "findings string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, new = _value(self.times, {}), set()
        for part in rows:
            part = part[part["kind"] != TICK]
            if not len(part):
                continue
            at = part["at"].astype("datetime64[ms]").astype("int64")
            text = {c: pd.Series([None if v is None or pd.isna(v) else v for v in part[c]], part.index, dtype=object) for c in ("finding_id", "value")}
            own = pd.DataFrame({"at": at, "kind": part["kind"], "pos": part["pos"], **text})
            for t, group in own.groupby("at", sort=False):
                t = int(t)
                n = times.get(str(t), 0)
                columns = [group[c].tolist() for c in ("kind", "pos", "finding_id", "value")]
                self.waiting.updateValue((t, n), (json.dumps(columns),))
                times[str(t)] = n + 1
                new.add(t)
        if new:
            self.times.update((json.dumps(times),))
        for t in new:
            self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self._forget(now)
        times = _value(self.times, {})
        due = sorted(t for t in map(int, times) if t <= now)
        if not due:
            return
        out: list[tuple] = []
        for t in due:
            rows: list[tuple] = []
            for n in range(times.pop(str(t))):
                rows += zip(*json.loads(self.waiting.getValue((t, n))[0]), strict=True)
                self.waiting.removeKey((t, n))
            rows.sort(key=lambda r: (r[0] == DECISION, r[1], r[2] or "", r[3] or ""))
            scan = [r for r in rows if r[0] != DECISION]
            if scan:
                self._scan(t, scan, out)
            if len(scan) < len(rows):
                self._decide(t, rows[len(scan) :], out)
        self.times.update((json.dumps(times),))
        if not out:
            return
        finding, seq, at, state, was, kind = zip(*out, strict=True)
        yield pd.DataFrame({
            "target": [key[0]] * len(out), "bucket": [key[1]] * len(out), "finding_id": finding, "seq": seq,
            "at": pd.to_datetime(pd.Series(at, dtype="int64"), unit="ms"), "state": state, "previous_state": was, "kind": kind,
        })

    def _slots(self, findings: Iterable[str]) -> dict[int, dict[str, list]]:
        """The slots in which findings lie or would lie, with all that is known there."""
        return {slot: json.loads(had[0]) if (had := self.known.getValue((slot,))) else {} for slot in {_slot(f) for f in findings}}

    def _live(self, had: list | None, t: int) -> list | None:
        """What is known of a finding at a time. One resolved too long before counts as forgotten, whenever its timer fires."""
        old = had is not None and self.keep is not None and had[0] == "RESOLVED" and t - had[3] > self.keep
        return None if old else had

    def _scan(self, t: int, rows: list[tuple], out: list[tuple]) -> None:
        """One whole scan: its observations in order, then the findings of the scan before that it lacks."""
        seen = _value(self.seen, {})
        slots = self._slots([r[2] for r in rows if r[0] == OBSERVATION and r[2] not in seen])
        now: dict[str, list] = {}
        for kind, _, finding, evidence in rows:
            if kind != OBSERVATION:
                continue
            had = now.get(finding)
            if had is None:
                had = self._live(seen.pop(finding, None) or slots.get(_slot(finding), {}).pop(finding, None), t)
            was, seq = (had[0], had[1]) if had else (None, -1)
            if was in DECIDED:
                now[finding] = had
                continue
            state = next_state(was, bool(had) and had[2] != evidence)
            out.append((finding, seq + 1, t, state, was, "observation" if state == was == "ACTIVE" else "transition"))
            now[finding] = [state, seq + 1, evidence, t]
        gone = []
        slots |= self._slots(f for f in seen if _slot(f) not in slots)
        for finding, had in seen.items():
            if had[0] not in CLOSED:
                was, seq = had[0], had[1]
                for state in walk_to_resolved(was):
                    seq += 1
                    out.append((finding, seq, t, state, was, "transition"))
                    was = state
                had = [was, seq, had[2], t]
                gone.append(finding)
            slots[_slot(finding)][finding] = had
        self._keep(slots)
        self.seen.update((json.dumps(now),))
        if gone and self.keep is not None:
            self.fading.updateValue((t,), (json.dumps(gone),))
            self.handle.registerTimer(t + self.keep + 1)

    def _keep(self, slots: dict[int, dict[str, list]]) -> None:
        for slot, findings in slots.items():
            self.known.updateValue((slot,), (json.dumps(findings),))

    def _decide(self, t: int, rows: list[tuple], out: list[tuple]) -> None:
        seen = _value(self.seen, {})
        slots = self._slots(r[2] for r in rows if r[2] not in seen)
        for _, _, finding, state in rows:
            where = seen if finding in seen else slots[_slot(finding)]
            had = self._live(where.get(finding), t)
            was, seq = (had[0], had[1]) if had else (None, None)
            if was not in ("ACTIVE", "UPDATED") or state not in DECIDED:
                out.append((finding, seq, t, state, was, "rejected"))
                continue
            out.append((finding, seq + 1, t, state, was, "decision"))
            where[finding] = [state, seq + 1, had[2], t]
        self.seen.update((json.dumps(seen),))
        self._keep(slots)

    def _forget(self, now: int) -> None:
        """Drops what was resolved `keep` before a timer's time and has not come again."""
        t = None if self.keep is None else now - self.keep - 1
        if t is None or not self.fading.containsKey((t,)):
            return
        findings = json.loads(self.fading.getValue((t,))[0])
        slots = self._slots(findings)
        for finding in findings:
            had = slots[_slot(finding)].get(finding)
            if had and had[0] == "RESOLVED" and had[3] == t:
                del slots[_slot(finding)][finding]
        self._keep(slots)
        self.fading.removeKey((t,))

    def close(self) -> None:
        pass


def _value(state, default):
    """What a JSON value of the state says."""
    return json.loads(state.get()[0]) if state.exists() else default


def _slot(finding: str) -> int:
    return crc32(finding.encode()) % SLOTS


def inputs(observations: DataFrame, heads: DataFrame, decisions: DataFrame | None = None, ticks: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One stream of observations (target, at, pos, finding_id, evidence), heads (target, at), decisions (target, at,
    finding_id, state) and ticks (at)."""
    none = F.lit(None).cast("string")
    bucket = F.pmod(F.xxhash64("finding_id"), F.lit(buckets))

    def row(df: DataFrame, kind: int, target, where, pos, finding, value) -> DataFrame:
        return df.select(target.alias("target"), where.cast("long").alias("bucket"), "at", F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), finding.alias("finding_id"), value.alias("value"))

    spread = heads.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    out = row(observations, OBSERVATION, C("target"), bucket, C("pos"), C("finding_id"), C("evidence"))
    out = out.unionByName(row(spread, HEAD, C("target"), C("bucket"), F.lit(0), none, none))
    if decisions is not None:
        out = out.unionByName(row(decisions, DECISION, C("target"), bucket, F.lit(0), C("finding_id"), C("state")))
    if ticks is not None:
        out = out.unionByName(row(ticks, TICK, none, F.lit(-1), F.lit(0), none, none))
    return out


def lifecycle_stream(rows: DataFrame, late: str = LATE, keep_resolved_ms: int | None = None) -> DataFrame:
    """Events of a stream of `inputs` rows. `late` is how far behind the newest row a scan's rows may still come in."""
    return rows.withWatermark("at", late).groupBy("target", "bucket").transformWithStateInPandas(
        statefulProcessor=LifecycleProcessor(keep_resolved_ms), outputStructType=StructType.fromDDL(OUT), outputMode="Append", timeMode="EventTime"
    )
