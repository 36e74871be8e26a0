"""The live paths as Structured Streaming: the same projections as in batch, with watermarks where state must end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.correlate import trace_sessions, with_all
from ..operators.findings import findings_from_matches
from ..sources.readers import http_matches


def stream_dedupe(findings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One row per id among the rows that come within `delay` of each other; in a finished table one row per id."""
    if not findings.isStreaming:
        return findings.dropDuplicates(["id"])
    return findings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def stream_rate(requests: DataFrame, window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Requests per origin and window, tumbling or sliding."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return requests.withWatermark("ts", delay).groupBy("origin", span).agg(F.count("*").alias("n")).select("origin", F.unix_micros(F.col("window.start").cast("timestamp")).alias("start"), "n")


def stream_session_window(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Events of one session key with less than `gap` between neighbours."""
    return events.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("session_id", F.unix_micros(F.col("session_window.start").cast("timestamp")).alias("start"), "n")


def stream_pairs(sends: DataFrame, receives: DataFrame, bound: str, delay: str = "10 minutes") -> DataFrame:
    """Sends with the receive of their id within the bound; without one they are incomplete, never refuted."""
    s = sends.withWatermark("ts", delay).select("id", F.col("ts").alias("sent"))
    r = receives.withWatermark("ts", delay).select(F.col("id").alias("rid"), F.col("ts").alias("received"))
    on = F.expr(f"id = rid AND received >= sent AND received <= sent + INTERVAL {bound}")
    return s.join(r, on, "left_outer").select("id", F.when(F.col("rid").isNull(), "incomplete").otherwise("joined").alias("state"))


def stream_findings(lines: DataFrame, job_id: int, jobs: DataFrame, points: DataFrame) -> DataFrame:
    """Findings of a stream of NDJSON lines (value) of one job, by the projection that batches use; what does not parse is left out."""
    matches = http_matches(lines)[0]
    return findings_from_matches(matches.select(F.lit(job_id).cast("long").alias("job_id"), "url", "status", "length", F.transform_values("input", lambda _, v: F.decode(v, "UTF-8")).alias("input")), jobs, points)


def stream_spans(starts: DataFrame, stops: DataFrame, bound: str, delay: str = "10 minutes") -> DataFrame:
    """Spans (context, started, micros, outcome) of starts (context, ts) and stops (context, ts, outcome) within the bound; a span that never stops is incomplete."""
    a = starts.withWatermark("ts", delay).select("context", F.col("ts").alias("started"))
    b = stops.withWatermark("ts", delay).select(F.col("context").alias("other"), F.col("ts").alias("stopped"), "outcome")
    on = F.expr(f"context = other AND stopped >= started AND stopped <= started + INTERVAL {bound}")
    took = F.unix_micros(F.col("stopped").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return a.join(b, on, "left_outer").select("context", "started", took.alias("micros"), F.coalesce("outcome", F.lit("incomplete")).alias("outcome"))


#: State needs the provider that keeps it on disk and in versions.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State stores on disk with a log of changes a batch, unless the session names its own."""
    for key, usual, own in (("providerClass", "HDFSBackedStateStoreProvider", ROCKS), ("rocksdb.changelogCheckpointing.enabled", "false", "true")):
        name = f"spark.sql.streaming.stateStore.{key}"
        if spark.conf.get(name, usual).endswith(usual):
            spark.conf.set(name, own)


def _verdict(hits: int, failures: list[str], done: bool) -> tuple[str, str]:
    envelope = "intact" if done and not failures else "incomplete"
    return envelope, "inconclusive" if envelope == "incomplete" else "confirmed" if hits else "refuted"


class TraceSessions(StatefulProcessor):
    """A session's numbers, its distinct matched positions and its limit failures, and one timer."""

    def __init__(self, most_events: int, gap_ms: int) -> None:
        self.most, self.gap = most_events, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "count long, hits long, state string, timer long")
        self.positions = handle.getMapState("positions", "position int", "seen boolean")
        self.failures = handle.getMapState("failures", "failure string", "seen boolean")

    def _earliest(self, rows: Iterator[pd.DataFrame], room: int) -> tuple[pd.DataFrame | None, int, bool]:
        """The first `room` events of a batch in their order, the newest time and whether the session ended; no more are held, whatever comes."""
        held, newest, done = None, 0, False
        for part in rows:
            newest, done = max(newest, int(part["ms"].max())), done or bool(part["last"].any())
            held = part if held is None else pd.concat([held, part])
            held = held.sort_values(["at", "event_id"]).head(room)
        return held, newest, done

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 the interface's names
        count, hits, state, old = self.numbers.get() if self.numbers.exists() else (0, 0, "open", -1)
        calls, newest, done = self._earliest(rows, self.most + 1 - min(count, self.most + 1))
        if state == "open" and calls is not None:
            for hit, positions, failure in zip(calls["hit"], calls["positions"], calls["failure"], strict=True):
                count += 1
                failed = "event_limit" if count > self.most else failure
                if failed is not None:  # nothing behind a limit is looked at
                    self.failures.updateValue((failed,), (True,))
                    state = "stopped"
                    break
                hits += bool(hit)
                for p in positions if hit and positions is not None else ():
                    self.positions.updateValue((int(p),), (True,))
        if done and state != "closed":
            yield self._told(key, count, hits, True)
            state = "closed"
        due = max(newest + self.gap, timerValues.getCurrentWatermarkInMs() + 1, old)
        if old != due:
            if old >= 0:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        self.numbers.update((count, hits, state, due))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count, hits, state, _ = self.numbers.get()
        if state != "closed":
            yield self._told(key, count, hits, False)
        self.numbers.clear()
        self.positions.clear()
        self.failures.clear()

    def _told(self, key: tuple, count: int, hits: int, done: bool) -> pd.DataFrame:
        failures = sorted(k[0] for k in self.failures.keys())
        envelope, verdict = _verdict(hits, failures, done)
        told = {"session_id": [key[0]], "events": [count], "hits": [hits], "positions": [sorted(k[0] for k in self.positions.keys())], "failures": [failures], "envelope": [envelope], "verdict": [verdict]}
        self.positions.clear()
        self.failures.clear()
        return pd.DataFrame(told)

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, most: int, gap_ms: int, delay: str = "10 minutes") -> DataFrame:
    """One verdict per session of events (session_id, ts, hit, last and, if given, event_id, positions, failure), as `trace_sessions` gives it: at the session's last event, or when none has come for gap_ms of event time.

    The state of a session is three numbers, its distinct matched positions and its failures. A
    session stops looking at its first failure or at event `most` + 1. Only one that ended by
    itself without a failure is decided. Rows after the end are ignored until gap_ms has passed.
    Within a batch events count in their order, and batches in theirs. A null session is left out.
    In a finished table it is `trace_sessions`.
    """
    if not events.isStreaming:
        return trace_sessions(events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), most)
    keep_state_on_disk(events.sparkSession)
    rows = with_all(events.where(F.col("session_id").isNotNull()).withWatermark("ts", delay))
    moment = F.col("ts").cast("timestamp")
    rows = rows.select("session_id", "event_id", F.unix_micros(moment).alias("at"), F.unix_millis(moment).alias("ms"), "hit", "positions", "failure", "last", "ts")
    kind = events.schema["session_id"].dataType.simpleString()
    schema = f"session_id {kind}, events long, hits long, positions array<int>, failures array<string>, envelope string, verdict string"
    return rows.groupBy("session_id").transformWithStateInPandas(TraceSessions(most, gap_ms), schema, "Append", "EventTime")


#: Parts that events are dealt to where their lateness is looked at.
DEALT = 200


def mark_late(events: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """A stream of events with late (boolean): whether they are behind the watermark of the query itself, as a stateful operator would drop them.

    The watermark is what earlier batches made of it, and is kept in the checkpoint, so a
    restarted query goes on with it. No state is kept. A null time is not late.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("late", T.BooleanType())])
    given = events.columns

    def part(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        border = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            yield batch[given].assign(late=(batch["_micros"] < border).fillna(False).astype(bool))

    marked = events.withWatermark(ts, delay).withColumn("_micros", F.unix_micros(F.col(ts).cast("timestamp")))
    dealt = marked.withColumn("_dealt", F.pmod(F.xxhash64(*given), F.lit(DEALT)))
    return dealt.groupBy("_dealt").applyInPandasWithState(part, schema, "n long", "append", "NoTimeout")


def late_events(events: DataFrame, path: str, checkpoint: str, delay_micros: int):  # noqa: ANN201
    """Parts a stream of events (ts, ...) into on_time and late ones below a folder, by the watermark of the query. A batch that is repeated replaces its own folders."""

    def part(batch: DataFrame, number: int) -> None:
        batch.persist(StorageLevel.DISK_ONLY)
        for name, late in (("on_time", False), ("late", True)):
            batch.where(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return mark_late(events, f"{delay_micros} microseconds").writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mark_losses(verdicts: DataFrame, late: DataFrame) -> DataFrame:
    """verdicts (session_id, envelope, verdict, ...) with those inconclusive that lost a row of late (session_id)."""
    lost = late.select(F.col("session_id").cast("string").alias("session_id"), F.lit(True).alias("_lost")).distinct()
    out = verdicts.join(lost, "session_id", "left")
    changed = {"envelope": "incomplete", "verdict": "inconclusive"}
    return out.withColumns({c: F.when(F.col("_lost"), text).otherwise(F.col(c)) for c, text in changed.items()}).select(*verdicts.columns)


def sink_findings(findings: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Delivers each finding id once below a folder, a subfolder a batch.

    The ids that were delivered are the state of the stream: a store on disk, cut into parts by
    the id's hash, that a batch asks for its own ids only, so a batch costs what it holds and not
    what came before. Its versions go with the checkpoint: a batch that is repeated sees the ids of the
    batches before it and replaces its own folder. `_delivered/batch=n` says that n is whole.
    Null ids are one id.
    """
    keep_state_on_disk(findings.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        told = batch.sparkSession.createDataFrame([(number,)], "number long")
        told.coalesce(1).write.mode("overwrite").json(f"{path}/_delivered/batch={number}")

    return findings.dropDuplicates(["id"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
