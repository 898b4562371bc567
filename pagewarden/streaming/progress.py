"""Progress events of audit jobs, as a stream and as a table.

Events have the columns ``job_id, ts, event_id, type, payload``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.operators import extract, findings, site
from pagewarden.operators.ranking import first_by, top_k
from pagewarden.operators.rows import unnest
from pagewarden.streaming.partials import Partials

EVENTS = "job_id BIGINT, ts TIMESTAMP, event_id BIGINT, type STRING, payload STRING"
# fixed values: event types that begin and end a job
STARTED, COMPLETED, FAILED = "stage", "result", "error"


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def typed(events: DataFrame) -> DataFrame:
    """Events without a type are log events."""
    return events.withColumn("type", F.coalesce("type", F.lit("log")))


def elapsed(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Seconds since the start of the job; ``jobs`` has ``job_id, started_at``.

    The job table is static, so the stream keeps no state for it.
    """
    seconds = F.unix_micros("ts") - F.unix_micros("started_at")
    return typed(events).join(jobs.select("job_id", "started_at"), "job_id", "left").withColumn(
        "elapsed_seconds", N.round_half_even(seconds / 1e6, 2)
    ).drop("started_at")


def recent(events: DataFrame, limit: int = C.RECENT_EVENTS) -> DataFrame:
    """Last events of each job, newest first (table form)."""
    return top_k(typed(events), ["job_id"], [F.desc("ts"), F.desc("event_id")], limit)


def latest(events: DataFrame) -> DataFrame:
    return first_by(typed(events), ["job_id"], ["ts", "event_id"], ["ts", "event_id", "type"], latest=True)


def job_status(
    events: DataFrame, started: str = STARTED, completed: str = COMPLETED, failed: str = FAILED,
    watermark: str | None = None, window: str = "1 day",
) -> DataFrame:
    """Status, start and end of each job. One combining aggregate, for tables and streams.

    A stream keeps every job for ever unless ``watermark`` is given: then events are
    grouped by job and ``window`` of event time, and windows older than the watermark are
    dropped from the state.
    """
    kind = F.col("type")
    last = F.struct("ts", "event_id")
    rows = typed(events)
    keys = [F.col("job_id")]
    if watermark:
        rows = rows.withWatermark("ts", watermark)
        keys.append(F.window("ts", window).alias("window"))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("created_at"),
        F.min(F.when(kind == started, F.col("ts"))).alias("started_at"),
        F.max(F.when(kind.isin(completed, failed), last)).alias("_end"),
        F.max_by(F.when(kind.isin(completed, failed), kind), F.when(kind.isin(completed, failed), last)).alias("_how"),
    )
    return agg.select(
        "job_id", *(["window"] if watermark else []), "events", "created_at", "started_at", F.col("_end.ts").alias("finished_at"),
        F.when(F.col("_how") == completed, "completed").when(F.col("_how") == failed, "failed")
        .when(F.col("started_at").isNotNull(), "running").otherwise("queued").alias("status"),
    )


_RECENT = "job_id BIGINT, seen BIGINT, latest_type STRING, latest_event BIGINT, recent ARRAY<BIGINT>"
_KEPT = "ts BIGINT, id BIGINT, type STRING"


class _Recent(StatefulProcessor):
    """Per job the last ``limit`` events as list state and the number seen as value state.

    With ``idle`` a timer forgets a job when the watermark has passed its last event by that
    many milliseconds.
    """

    def __init__(self, limit: int, idle: int | None):
        self.limit, self.idle = limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", _KEPT)
        self.seen = handle.getValueState("seen", "n BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        kept = list(self.kept.get()) if self.kept.exists() else []
        for batch in rows:
            n += len(batch)
            # only the newest of a batch can enter the list, so the list stays short
            newest = batch.sort_values(["ts", "event_id"]).tail(self.limit)
            times = newest["ts"].astype("datetime64[us]").astype("int64")
            kept = sorted([tuple(k) for k in kept] + list(zip(times.tolist(), newest["event_id"].tolist(), newest["type"].tolist(), strict=True)))[-self.limit :]
        self.kept.put(kept)
        self.seen.update((n,))
        if self.idle is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(kept[-1][0] // 1000 + self.idle)
        yield pd.DataFrame({"job_id": [key[0]], "seen": [n], "latest_type": [kept[-1][2]], "latest_event": [kept[-1][1]], "recent": [[k[1] for k in reversed(kept)]]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def recent_state(events: DataFrame, limit: int = C.RECENT_EVENTS, watermark: str | None = None, idle_seconds: int | None = None) -> DataFrame:
    """Streaming form of ``recent``: a list of at most ``limit`` events as state per job.

    Batches are merged by event time, so the order in which files arrive is no matter. With
    ``watermark`` and ``idle_seconds`` a job whose last event is that much older than the
    watermark is forgotten, so the state follows the jobs that are running and not all that
    ever ran. The session needs the RocksDB state store.
    """
    if (watermark is None) != (idle_seconds is None):
        raise ValueError("watermark and idle_seconds go together")
    rows = typed(events).select("job_id", "ts", "event_id", "type")
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    processor = _Recent(limit, None if idle_seconds is None else idle_seconds * 1000)
    mode = "EventTime" if watermark else "None"
    return rows.groupBy("job_id").transformWithStateInPandas(processor, _RECENT, "Update", mode)


def elapsed_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Seconds of each event since its job's first ``STARTED`` event, both from one stream.

    The start is joined by job within the watermark, so the state holds the events and starts
    of a bounded time. Events that precede their job's start are left out.
    """
    rows = typed(events).withWatermark("ts", watermark)
    starts = rows.filter(F.col("type") == STARTED).select(F.col("job_id").alias("of_job"), F.col("ts").alias("started_at"), F.col("event_id").alias("start_id"))
    spent = (F.unix_micros("ts") - F.unix_micros("started_at")) / 1e6
    within = (F.col("job_id") == F.col("of_job")) & (F.col("ts") >= F.col("started_at")) & (F.col("ts") <= F.col("started_at") + F.expr("INTERVAL 1 DAY"))
    joined = rows.join(starts, within)
    return joined.withColumn("elapsed_seconds", N.round_half_even(spent, 2)).drop("of_job", "started_at")


def _dealt(batch: DataFrame) -> DataFrame:
    """The pages of a batch over all cores: a file of one row group is read by a single task,
    which would extract the whole batch by itself."""
    return batch.repartition(2 * batch.sparkSession.sparkContext.defaultParallelism, "page_id", "url")


def _merged_urls(parts: DataFrame) -> DataFrame:
    return parts.groupBy("site", "link").agg(F.sum("pages").alias("pages"))


def count_arrivals(pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep what ``page_counters`` needs as pages arrive: the urls of each batch, once each,
    merged level by level."""

    def run(batch: DataFrame, batch_id: int) -> None:
        features = extract.page_features(_dealt(batch))
        found = unnest(features, F.array_prepend(F.col("internal_links"), F.col("url")), "link", ["site"], "i")
        urls = found.groupBy("site", "link").agg(F.count_if(F.col("i") == 0).alias("pages"))
        Partials(batch.sparkSession, f"{folder}/urls", _merged_urls).add(batch_id, urls)

    return (
        pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def page_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Pages analysed and distinct urls discovered per site, exactly, over all batches."""
    return Partials(spark, f"{folder}/urls", _merged_urls).read().groupBy("site").agg(
        F.sum("pages").alias("analyzed_pages"), F.count(F.lit(1)).alias("discovered_internal_pages")
    )


def audit_arrivals(pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Audit pages as they arrive.

    Every batch is extracted once, written to its own partition, and judged from there.
    A batch that is run again overwrites that partition, so nothing is counted twice. The
    title counts that coverage needs are merged level by level.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = f"{folder}/features/batch_id={batch_id}"
        extract.page_features(_dealt(batch)).write.mode("overwrite").parquet(place)
        features = spark.read.parquet(place)
        long = findings.findings(findings.page_audit(features))
        long.write.mode("overwrite").parquet(f"{folder}/findings/batch_id={batch_id}")
        Partials(spark, f"{folder}/title_counts", site.merged_title_counts).add(batch_id, site.title_counts(features))

    return (
        pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def site_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Site coverage over all batches that have been audited, from the counts that the
    batches have left; no page is read again."""
    return site.coverage_of(Partials(spark, f"{folder}/title_counts", site.merged_title_counts).read())


def event_lines(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The event stream as JSON lines."""
    lines = events.select(F.to_json(F.struct("*")).alias("value"))
    return (
        lines.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def append_snapshots(snapshots: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Health snapshots as an append-only series."""
    return (
        snapshots.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
