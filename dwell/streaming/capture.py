"""The assembled capture pipeline: samples to labelled events in one store.

samples and tab snapshots -> J4 (``stream_tab_override``) -> URLs sanitized (F15) ->
W1 sessions or W2 segments -> P3 -> engine labels (F7) -> committed tables, notices (R7).

Micro-batches are sessionized by the batch operators: rows are reduced per
(device, time bucket) to change points, hot buckets are split, and only bucket summaries
and one carry row per device (its open run and last row) cross batches. So a device
that sends half of all rows is spread over its hours, and no group of a whole
device is ever built. Carry, events, labels, late rows and notices of a batch are one
commit: a retry finds all of it or nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.functions.urls import sanitize_urls
from dwell.operators import labels as L
from dwell.operators import ordered as O
from dwell.operators.sessionize import not_glitch
from dwell.streaming.asof import epoch_micros, state_on_disk, stream_tab_override
from dwell.streaming.store import Classifier, Store, label_rows

CARRY = (
    "device_id string, last_ts timestamp_ntz, last_seq long, open boolean, start_ts timestamp_ntz, start_seq long, app string, title string, url string, is_idle boolean"
)
ROW = ["device_id", "ts", "seq", "app", "title", "url", "is_idle"]
NO_DEVICE = "\u0000none"


def prepared(samples: DataFrame, variant: str, sanitize: bool) -> DataFrame:
    """The samples that count, as rows of ``ROW``: glitches dropped (P4), idle polls
    as the one idle row they mean (P7), URLs sanitized (F15)."""
    s = samples.withColumn("device_id", F.coalesce("device_id", F.lit(NO_DEVICE)))
    if "is_idle" not in s.columns:
        s = s.withColumn("is_idle", F.lit(False))
    idle = F.coalesce("is_idle", F.lit(False))
    s = s.where(idle | not_glitch(legacy=variant == "legacy")).withColumn("is_idle", idle)
    if sanitize:
        s = sanitize_urls(s, on_error="keep").withColumn("url", F.when(F.col("url").isNotNull(), F.col("sanitized_url")))
    if variant == "legacy":
        s = s.withColumns({c: F.when(idle, F.lit(v)).otherwise(F.col(c)) for c, v in (("app", "Idle"), ("title", "Idle"), ("url", None))})
    else:
        s = s.withColumn("url", F.coalesce("url", F.lit("")))
    return s.select(*ROW)


def _key(variant: str):
    """Run identity: legacy all fields; segments: idle rows alike, a title only without a URL."""
    if variant == "legacy":
        return F.struct("app", "title", "url")
    on = ~F.col("is_idle")
    return F.struct("is_idle", F.when(on, F.col("app")).alias("a"), F.when(on, F.col("url")).alias("u"), F.when(on & (F.col("url") == ""), F.col("title")).alias("t"))


def advance(
    rows: DataFrame, carry: DataFrame, variant: str, bucket_seconds: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs that ended, next carry, late rows) of a batch of ``ROW`` rows. A run
    ends at the next run's first row; rows at or before their device's last one,
    and rows without a time, are late. ``keep`` may persist the change points, which
    the first two results share."""
    c = carry.select("device_id", "last_ts", "last_seq")
    j = rows.join(c, "device_id", "left")
    late = F.col("ts").isNull() | F.coalesce(F.struct("ts", "seq") <= F.struct("last_ts", "last_seq"), F.lit(False))
    late = late & (F.col("ts").isNull() | F.col("last_ts").isNotNull())
    on_time, behind = j.where(~late).select(*ROW), j.where(late).select(*ROW)
    heads = carry.where("open").select("device_id", F.col("start_ts").alias("ts"), F.col("start_seq").alias("seq"), "app", "title", "url", "is_idle")
    points = keep(O.change_points(heads.unionByName(on_time), ["device_id"], ["ts", "seq"], _key(variant), bucket_seconds))
    last = on_time.groupBy("device_id").agg(F.max(F.struct("ts", "seq")).alias("l")).select("device_id", F.col("l.ts").alias("last_ts"), F.col("l.seq").alias("last_seq"))
    last = c.unionByName(last).groupBy("device_id").agg(F.max(F.struct("last_ts", "last_seq")).alias("l")).select("device_id", "l.*")
    still = points.where(F.col("_next_start").isNull()).select(
        "device_id", F.lit(True).alias("open"), F.col("ts").alias("start_ts"), F.col("seq").alias("start_seq"), "app", "title", "url", "is_idle"
    )
    after = last.join(still, "device_id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    ended = points.where(F.col("_next_start").isNotNull()).select("device_id", F.col("ts").alias("start_time"), F.col("_next_start").alias("end_time"), "app", "title", "url", "is_idle")
    return ended, after, behind


def as_events(ended: DataFrame, variant: str, stream: str) -> DataFrame:
    """Ended runs as events (P3 holds: a run never ends before its start); the holes that idleness leaves are none."""
    e = ended.where(F.col("app").isNotNull()) if variant == "legacy" else ended.where(~F.col("is_idle"))
    e = e.select(
        "device_id", (epoch_micros(F.col("start_time")) / 1e6).alias("start_ts"), (epoch_micros(F.col("end_time")) / 1e6).alias("end_ts"),
        "app", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"),
    )
    ids = L.content_id("device_id", "start_ts", "app", "title", "url")
    return L.valid_events(e).select(
        ids.alias("id"), "device_id", "start_ts", "end_ts", "app", "title", "url", F.lit(None).cast("string").alias("content_hash"),
        F.current_timestamp().alias("created_at"), F.lit(stream).alias("stream_id"),
    )


def run_of(batch: DataFrame) -> str:
    """The run that a micro-batch belongs to: Spark's id of the query, kept in its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def capture_writer(
    store: Store,
    stream: str,
    engine: Classifier,
    variant: str = "segments",
    sanitize: bool = True,
    bucket_seconds: int | None = None,
    on_failure: Callable[[str, int, Exception], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """R6 ``foreachBatch`` writer of samples (device_id, ts, seq, app, title, url,
    optionally is_idle). Events whose classification fails are stored without a
    label (``Store.unlabelled``, ``Store.relabel``) and reported to ``on_failure``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch)
        if store.is_committed(stream, run, batch_id):
            return
        carry = store.last(stream, run, "carry", CARRY)
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            # a watermark that jumps brings a stream's whole past in one batch: none of it stays on the heap
            kept.append(df.persist(StorageLevel.DISK_ONLY))
            return kept[-1]

        try:
            # J4's state leaves a device's rows in one task: spread, before their URLs are sanitized
            rows = keep(prepared(batch.repartition("device_id", "ts", "seq"), variant, sanitize))
            # counted in a job of its own, as the writes below start several at once on the rows
            if not rows.count():
                # nothing ends, and nothing is late
                store.commit(stream, run, batch_id, {"carry": carry})
                return
            ended, after, late = advance(rows, carry, variant, bucket_seconds, keep)
            events = as_events(ended, variant, stream)
            if store.other_runs(stream, run):
                # this checkpoint started over: what the stream sent before is known by its id
                known = store.log("events").where(F.col("stream_id") == stream).select("id")
                events = events.join(known, "id", "left_anti").select(*events.columns)
            events = keep(events)
            tables = {"events": events, "carry": after, "late": late}
            recorded = events.select(F.lit("event_recorded").alias("kind"), F.lit(0).alias("kind_ord"), F.col("id").alias("event_id"), F.col("id").alias("seq"))
            labelled = F.lit("label_updated").alias("kind"), F.lit(1).alias("kind_ord"), "event_id", "seq"
            try:
                labels = label_rows(engine, events)
                store.commit(stream, run, batch_id, {**tables, "engine_classifications": labels, "notices": recorded.unionByName(labels.select(*labelled))})
            except Exception as e:
                if on_failure is not None:
                    on_failure(stream, batch_id, e)
                store.commit(stream, run, batch_id, {**tables, "notices": recorded})
        finally:
            for df in kept:
                df.unpersist()

    return write


def capture_stream(samples: DataFrame, snapshots: DataFrame, store: Store, stream: str, engine: Classifier, checkpoint: str, delay: str = "10 minutes", variant: str = "segments", **options):
    """Start the whole pipeline on two streams; returns Spark's query. Rows that J4
    found late come to the store's ``late`` table with those that are late here."""
    from pyspark.sql.streaming import DataStreamWriter

    joined = stream_tab_override(samples, snapshots, delay, "newer" if variant == "segments" else "legacy")
    idle = F.col("is_idle") if "is_idle" in joined.columns else F.lit(False)
    # a row that is late in J4 has lost its place: without a time it is late below, too
    rows = joined.where("NOT is_snapshot").select(
        "device_id", F.when(~F.col("is_late"), F.col("ts")).alias("ts"), "seq", "app", "title", "url", idle.alias("is_idle")
    )
    out: DataStreamWriter = rows.writeStream.foreachBatch(capture_writer(store, stream, engine, variant, **options))
    with state_on_disk(rows):
        return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capture(samples: DataFrame, snapshots: DataFrame, engine: Classifier, variant: str = "segments", sanitize: bool = True, bucket_seconds: int | None = None) -> DataFrame:
    """The same pipeline over stored tables: labelled events (id, device_id, start_ts,
    end_ts, app, title, url, category_id, confidence, rule_id, meta_json)."""
    from dwell.operators.asof import apply_tab_override

    joined = O.drop_bucket(apply_tab_override(samples, snapshots, variant="newer" if variant == "segments" else "legacy", bucket_seconds=bucket_seconds))
    empty = samples.sparkSession.createDataFrame([], CARRY)
    ended, _, _ = advance(prepared(joined, variant, sanitize), empty, variant, bucket_seconds)
    events = as_events(ended, variant, "table")
    kept = ["id", "device_id", "start_ts", "end_ts", "app", "title", "url"]
    labels = engine.classify(events.select(*kept))
    return events.select(*kept).join(labels.withColumnRenamed("event_id", "id"), "id", "left")
