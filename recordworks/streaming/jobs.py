"""Streaming forms of the jobs: ingest, dedup, walk verdicts, stuck runs, alerts, clock guard, usage.

The DataFrame functions are the batch ones; state lives in Spark's state store.  Checkpoint locations come from the caller.
"""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from ..operators import records as R
from ..plans.normalise import Context, accepted, normalise_records, quarantined
from ..session import read_or_empty
from ..templates import Template


# ------------------------------------------------------------------------------------------------------------------ ingest
LEDGER = "batch long, rows long, bad long, base_upto long"


@dataclass(frozen=True)
class RecordLog:
    """A record table as a log of keyed deltas: each micro-batch adds its own small files, reading merges them, and compaction writes a new
    base from time to time.  What a ledger row doesn't vouch for (a batch or base cut off while it was written) is not read.

    Layout below `path`: delta/batch=<n>, quarantine/batch=<n>, base/upto=<n>/bucket=<b>, ledger."""

    path: str
    buckets: int = 64

    def ledger(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.path}/ledger", LEDGER)

    def has(self, spark: SparkSession, batch_id: int) -> bool:
        return self.ledger(spark).filter((F.col("batch") == batch_id) & F.col("base_upto").isNull()).limit(1).count() > 0

    def append(self, rows: DataFrame, bad: DataFrame, batch_id: int) -> None:
        """Store a batch once: its files replace what an attempt that failed has left, and a batch in the ledger isn't stored again."""
        spark = rows.sparkSession
        if self.has(spark, batch_id):
            return
        rows.withColumn("bucket", self._bucket()).hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch_id}")
        bad.hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/quarantine/batch={batch_id}")
        counts = [spark.read.schema(df.schema).parquet(f"{self.path}/{name}/batch={batch_id}").count() for name, df in (("delta", rows), ("quarantine", bad))]
        self._note(spark, batch_id, *counts, None)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the last batch in the ledger: of a key's rows the newest counts, with the first time it was seen.  Newest rows and first
        times combine before the shuffle, so a key of very many versions sends one row a task."""
        found = self._since(spark)
        if found is None:
            raise ValueError(f"no batch in {self.path}")
        rows = [c for c in found.columns if c not in ("batch", "bucket")]
        newest = found.groupBy("bucket", *R.RECORD_KEY).agg(F.max_by(F.struct(*rows), F.struct("batch", "seq")).alias("r"), F.min("first_seen").alias("first"))
        return newest.select(*[F.col("first").alias(c) if c == "first_seen" else F.col(f"r.{c}").alias(c) for c in rows if c != "seq"])

    def quarantined(self, spark: SparkSession) -> DataFrame:
        done = self.ledger(spark).filter("base_upto IS NULL").select("batch")
        return spark.read.parquet(f"{self.path}/quarantine").join(done, "batch", "left_semi")

    def compact(self, spark: SparkSession) -> None:
        """A new base of all batches so far.  Readers keep the old one until the ledger names the new."""
        upto = self.ledger(spark).agg(F.max("batch")).first()[0]
        if upto is None or upto == self._base(spark):
            return
        table = self.read(spark).withColumns({"bucket": self._bucket(), "seq": F.lit(-1).cast("long")})
        table.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/upto={upto}")
        self._note(spark, upto, 0, 0, upto)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(self.buckets)).cast("int")

    def _base(self, spark: SparkSession) -> int | None:
        return self.ledger(spark).agg(F.max("base_upto")).first()[0]

    def _since(self, spark: SparkSession) -> DataFrame | None:
        base = self._base(spark)
        done = self.ledger(spark).filter("base_upto IS NULL").select("batch")
        fresh = done if base is None else done.filter(F.col("batch") > base)
        parts = []
        if base is not None:
            parts.append(spark.read.parquet(f"{self.path}/base/upto={base}").withColumn("batch", F.lit(-1).cast("long")))
        if fresh.limit(1).count():
            delta = spark.read.parquet(f"{self.path}/delta")
            parts.append(delta.withColumn("batch", F.col("batch").cast("long")).join(fresh, "batch", "left_semi"))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _note(self, spark: SparkSession, batch: int, rows: int, bad: int, base: int | None) -> None:
        spark.createDataFrame([(batch, rows, bad, base)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")


def ingest_batch(batch: DataFrame, batch_id: int, template: Template, ctx: Context, log: RecordLog, project: str, gazetteer: DataFrame | None = None, fx: DataFrame | None = None) -> None:
    """Normalise one micro-batch of raw(source, run_id, raw) and add it to the log.  Nothing stored before is read or rewritten; repeating a batch
    changes nothing."""
    if log.has(batch.sparkSession, batch_id):
        return
    now = F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp")
    # a batch of compact files is read by few tasks, but every row takes long to parse: its rows are dealt over all partitions first
    dealt = batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    checked = normalise_records(dealt, template, ctx, gazetteer, fx).persist()
    try:
        # the last row of a batch wins; without a `seq` column the order is by content, which a repeated batch reproduces
        seq = (F.col("seq").cast("long") if "seq" in batch.columns else F.xxhash64("raw")).alias("seq")
        fresh = accepted(checked).withColumns({"project": F.lit(project), "first_seen": now, "last_seen": now})
        fresh = fresh.select(*[c for c in fresh.columns if c not in ("raw", "seq")], seq)
        bad = R.quarantine_rows(quarantined(checked).withColumn("project", F.lit(project)), now)
        log.append(R.latest_per_key(fresh, R.RECORD_KEY, [F.col("seq")]), bad, batch_id)
    finally:
        checked.unpersist()


def stream_ingest(raw: DataFrame, checkpoint: str, **job: Any):
    """Start the ingest of a stream of raw rows."""
    return (raw.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, **job)).start())


# ------------------------------------------------------------------------------------------------------- dedup, clock, usage
def stream_dedup(rows: DataFrame, event_time: str = "ts", expiry: str = "1 hour") -> DataFrame:
    """Rows of a walk once per key; keys are forgotten `expiry` after their last sighting."""
    return rows.withWatermark(event_time, expiry).dropDuplicatesWithinWatermark(["run_id", "key"])


def clock_guard(events: DataFrame, received: Column, event_time: str = "ts", delay: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """(steady, ahead): events stamped more than five minutes after they were received are diverted; the others get a
    watermark, and Spark counts what arrives later than that (`late_rows`)."""
    ahead = F.unix_seconds(F.col(event_time)) > F.unix_seconds(received) + K.SKEW_SECONDS
    return events.filter(~ahead).withWatermark(event_time, delay), events.filter(ahead)


def late_rows(query) -> int:
    """Rows a query dropped because they were older than the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def stream_usage(requests: DataFrame, daily_requests: int, event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Daily usage per source with a budget flag (UTC days)."""
    day = F.window(event_time, "1 day")
    used = (requests.withWatermark(event_time, delay).groupBy(day.alias("w"), "source")
            .agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes")))
    return used.select(F.to_date("w.start").alias("day"), "source", "requests", "bytes", (F.col("requests") >= daily_requests).alias("over_budget"))


# ------------------------------------------------------------------------------------------------------------ walk verdicts
STATE_TTL_MS = 7 * 86_400_000  # how long state that no row touches is kept
WALK_SCHEMA = "run_id string, stopped string, complete boolean, pages int, rows long, page_errors int, http_failures int"
_WALK_STATE = "dry int, errors int, http_failures int, rows long, pages int, stopped boolean"


def _in_order(frames: Iterator[pd.DataFrame], *by: str) -> Iterator[Any]:
    """The rows of a key in order.  Frames come one after the other and are merged as they are; only their rows are kept, sorted frame by frame."""
    return heapq.merge(*[list(frame.sort_values(list(by), kind="stable").itertuples(index=False)) for frame in frames], key=lambda row: tuple(getattr(row, c) for c in by))


class WalkVerdict(StatefulProcessor):
    """Follows the pages of a run and emits one verdict when it stops.  The state is six numbers per run while it walks; of a run that has stopped only
    that is kept, for STATE_TTL_MS, so that its late pages don't start it again.  A run without pages for that long is forgotten."""

    def __init__(self, max_pages: int, max_rows: int, expires: bool) -> None:
        self.max_pages, self.max_rows, self.expires = max_pages, max_rows, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("walk", _WALK_STATE, STATE_TTL_MS) if self.expires else handle.getValueState("walk", _WALK_STATE)

    def _stop(self, dry: int, errors: int, rows: int, page: Any) -> tuple[str | None, int, int, int]:
        if isinstance(page.error, str):
            errors += 1
            return ("errors" if errors >= K.MAX_PAGE_ERRORS else None), dry, errors, rows
        rows = min(self.max_rows, rows + int(page.fresh_count))
        if page.done:
            return "done", dry, errors, rows
        if page.raw_count == 0:
            return ("fetch_failed" if page.http_failed else "empty_page"), dry, errors, rows
        dry = dry + 1 if page.fresh_count == 0 else 0
        if dry >= K.MAX_DRY_PAGES:
            return "repeating", dry, errors, rows
        return ("max_rows" if rows >= self.max_rows else None), dry, errors, rows

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        dry, errors, failures, total, last, stopped = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, False)
        if stopped:
            return
        verdict = None
        for page in _in_order(rows, "page"):
            last = int(page.page)
            failures += int(page.http_failed)
            reason, dry, errors, total = self._stop(dry, errors, total, page)
            if reason is None and last >= self.max_pages:
                reason = "max_pages"
            if reason:
                complete = reason in ("done", "empty_page", "repeating") and errors == 0 and failures == 0
                verdict = pd.DataFrame([[key[0], reason, complete, last, total, errors, failures]],
                                       columns=[c.split()[0] for c in WALK_SCHEMA.split(", ")])
                dry, errors, failures, total, last, stopped = 0, 0, 0, 0, 0, True
                break
        self.state.update((dry, errors, failures, total, last, stopped))
        if verdict is not None:
            yield verdict

    def close(self) -> None:
        pass


def stream_walk_verdict(pages: DataFrame, max_pages: int, max_rows: int, expires: bool = True) -> DataFrame:
    """pages(run_id, page, raw_count, fresh_count, error, http_failed, done) -> verdicts as walks stop.  State that expires needs the cluster's clock, with
    which an available-now stream never ends; such a stream runs without."""
    return pages.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=WalkVerdict(max_pages, max_rows, expires), outputStructType=WALK_SCHEMA, outputMode="Append", timeMode="ProcessingTime" if expires else "None")


# --------------------------------------------------------------------------------------------------------------- stuck runs
STUCK_SCHEMA = "run_id string, source string, last_heartbeat_ms long"


class StuckRuns(StatefulProcessor):
    """A timer per running run; a heartbeat moves it, the end of the run removes it, silence lets it fire.  The clock is the cluster's, or with `event_time`
    the stream's own (its watermark), which a replay reproduces.  The newest event time and the end are kept, with the cluster's clock for STATE_TTL_MS, else
    by a timer of that length, so that a late heartbeat doesn't start an ended run again."""

    def __init__(self, shortest_s: int, event_time: bool) -> None:
        self.shortest_s, self.event_time = shortest_s, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "source string, at long, seen double, ended boolean"
        self.state = handle.getValueState("beat", schema) if self.event_time else handle.getValueState("beat", schema, STATE_TTL_MS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        source, at, seen, ended = self.state.get() if self.state.exists() else ("", 0, float("-inf"), False)
        newest = None
        for frame in rows:  # of heartbeats of the same time the end of the run counts
            best = frame.assign(over=frame["status"] != "running").sort_values(["ts", "over"]).iloc[-1]
            if newest is None or (best["ts"], best["over"]) > (newest["ts"], newest["over"]):
                newest = best
        ts = pd.Timestamp(newest["ts"]).timestamp()
        if ended or ts < seen:
            return iter([])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = int(ts * 1000) if self.event_time else int(timerValues.getCurrentProcessingTimeInMs())
        if newest["over"]:
            self.state.update((newest["source"], int(at), ts, True))
            if self.event_time:
                self.handle.registerTimer(now + STATE_TTL_MS)
        else:
            silence = max(2 * int(newest["time_budget_s"]), self.shortest_s) * 1000
            self.state.update((newest["source"], now, ts, False))
            self.handle.registerTimer(now + silence)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        source, at, _, ended = self.state.get() if self.state.exists() else ("", 0, 0.0, True)
        self.state.clear()
        if not ended:
            yield pd.DataFrame([[key[0], source, at]], columns=["run_id", "source", "last_heartbeat_ms"])

    def close(self) -> None:
        pass


def stream_stuck(heartbeats: DataFrame, shortest_s: int = K.STUCK_MIN_SECONDS, delay: str | None = None) -> DataFrame:
    """heartbeats(run_id, source, status, time_budget_s, ts) -> runs silent for twice their budget (at least `shortest_s`), by the cluster's clock, or with a
    `delay` by the stream's own time, which runs that far behind the newest heartbeat."""
    timed = heartbeats if delay is None else heartbeats.withWatermark("ts", delay)
    return timed.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=StuckRuns(shortest_s, delay is not None), outputStructType=STUCK_SCHEMA, outputMode="Append", timeMode="ProcessingTime" if delay is None else "EventTime")


# ------------------------------------------------------------------------------------------------------------------- alerts
ALERT_SCHEMA = "source string, kind string, at timestamp"


class Incidents(StatefulProcessor):
    """One alert per source, kind and incident: again after a day, or after a healthy run has ended the incident.  Of events of the same time healthy
    runs come first.  The last alerts and the last healthy run are kept for STATE_TTL_MS, much longer than the day for which they matter."""

    def __init__(self, expires: bool) -> None:
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = (STATE_TTL_MS,) if self.expires else ()
        self.last = handle.getMapState("last_alert", "kind string", "at double", *kept)
        self.healthy = handle.getValueState("healthy", "at double", *kept)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = sorted((at, kind != "healthy", kind) for frame in rows
                        for at, kind in zip(frame["at"].to_numpy("datetime64[us]").astype("int64").tolist(), frame["kind"].tolist()))
        # each call of a state is a message to the JVM and back: it is read once for all events of a batch, and what changed is written once
        stored = {kind: self.last.getValue((kind,)) for kind in {kind for _, finding, kind in events if finding}}
        last = {kind: value[0] for kind, value in stored.items() if value is not None}
        healthy = self.healthy.get()
        known, well = dict(last), healthy[0] if healthy is not None else None
        out = []
        for micros, _, kind in events:
            at = micros / 1e6
            if kind == "healthy":
                well = at if well is None else max(at, well)
                continue
            before = last.get(kind)
            over = kind in _INCIDENTS and before is not None and well is not None and well > before
            if before is None or over or at - before >= K.REALERT_HOURS * 3600:
                last[kind] = at
                out.append((key[0], kind, pd.Timestamp(micros, unit="us")))
        for kind, at in last.items():
            if known.get(kind) != at:
                self.last.updateValue((kind,), (at,))
        if not all(finding for _, finding, _ in events):
            self.healthy.update((well,))
        if out:
            yield pd.DataFrame(out, columns=["source", "kind", "at"])

    def close(self) -> None:
        pass


_INCIDENTS = frozenset(K.INCIDENT_KINDS)


def stream_alerts(events: DataFrame, expires: bool = True) -> DataFrame:
    """events(source, kind, at): findings, and `healthy` for a healthy run -> the alerts to raise.  `expires` as for walks."""
    return events.groupBy("source").transformWithStateInPandas(
        statefulProcessor=Incidents(expires), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="ProcessingTime" if expires else "None")


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain an available-now stream into an in-memory table (tests and small checks)."""
    query = (df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return df.sparkSession.table(name)


