"""Label store as append-only logs + latest-wins views.

Writes never update in place: events, engine classifications and override
operations are appended (idempotently, keyed by batch); current state is a
view computed with partial aggregates (``max_by``), which hash-partition by the
key and never sort a whole key group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def valid_events(events: DataFrame) -> DataFrame:
    """Keep events with an end not before their start (zero length kept)."""
    return events.where(F.col("end_ts").isNotNull() & (F.col("end_ts") >= F.col("start_ts")))


def content_id(*cols: str):
    """Deterministic 64-bit id of an event's content (no shuffle, no driver)."""
    return F.xxhash64(*[F.col(c) for c in cols])


def sequential_ids(df: DataFrame, order: Sequence[str], id_col: str = "id", num_partitions: int | None = None) -> DataFrame:
    """W8 batch parity: ids 1..n in ``order`` without a single-task global window.

    Range-partition on ``order`` (balanced even when one value range is hot),
    sort inside partitions, count rows per partition (a tiny aggregate), turn the
    counts into offsets and add each row's position inside its partition."""
    from dwell.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # The range bounds come from a sample of the input; a recomputed input may
    # arrive in another order and sample other bounds, so the partitioned rows
    # are checkpointed (reliably, under spark.checkpoint.dir) and both the row
    # branch and the count branch read that one copy.
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    d = d.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_pid", "_off")
    out = d.join(F.broadcast(offsets), "_pid")  # at most num_partitions rows
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return out.withColumn(id_col, F.col("_off") + pos + 1).drop("_pid", "_mid", "_off")


def latest_classification(log: DataFrame, engine_version: str | None = None) -> DataFrame:
    """W6 upsert semantics: one row per (event_id, engine_version), the latest
    by (created_at, seq). A partial aggregate (sort-based, as the value is a struct), skew-safe."""
    if engine_version is not None:
        log = log.where(F.col("engine_version") == engine_version)
    keys = ["event_id"] if engine_version is not None else ["event_id", "engine_version"]
    cols = [c for c in ("engine_version", "category_id", "confidence", "rule_id", "meta_json", "created_at") if c not in keys]
    g = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("created_at", "seq")).alias("l"))
    return g.select(*keys, "l.*")


def current_overrides(ops: DataFrame) -> DataFrame:
    """The last operation per event wins; 'clear' removes the override."""
    g = ops.groupBy("event_id").agg(F.max_by(F.struct("op", "category_id", "note", "seq"), F.col("seq")).alias("l"))
    return g.where(F.col("l.op") == "set").select("event_id", "l.category_id", "l.note", F.col("l.seq").alias("seq"))


def without_deleted(rows: DataFrame, deleted: DataFrame, id_col: str = "event_id") -> DataFrame:
    """J6 cascade: rows whose event has no tombstone (``deleted.event_id``)."""
    return rows.join(deleted.select(F.col("event_id").alias(id_col)), id_col, "left_anti").select(*rows.columns)


def effective_labels(
    events: DataFrame, classifications: DataFrame, overrides: DataFrame, engine_version: str, deleted: DataFrame | None = None
) -> DataFrame:
    """User override > engine label of ``engine_version``; ``label_source``
    says which. Both label views are already hash-partitioned by event_id, so
    the joins shuffle only the events side. ``deleted`` (event_id) are the
    tombstones of J6: their events leave before the joins, and nothing else joins them."""
    if deleted is not None:
        events = without_deleted(events, deleted, "id")
    eng = latest_classification(classifications, engine_version).select(
        F.col("event_id").alias("id"), F.col("category_id").alias("engine_category")
    )
    ovr = current_overrides(overrides).select(F.col("event_id").alias("id"), F.col("category_id").alias("override_category"))
    j = events.select("id").join(eng, "id", "left").join(ovr, "id", "left")
    return j.select(
        "id",
        F.coalesce("override_category", "engine_category").alias("category_id"),
        F.when(F.col("override_category").isNotNull(), F.lit("override"))
        .when(F.col("engine_category").isNotNull(), F.lit("engine"))
        .alias("label_source"),
        "engine_category",
        "override_category",
    )


def orphan_labels(events: DataFrame, classifications: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Label rows whose event does not exist (what the foreign key forbids)."""
    ids = events.select(F.col("id").alias("event_id"))
    out = classifications.select("event_id", F.lit("classification").alias("kind"), "seq").join(ids, "event_id", "left_anti")
    if overrides is not None:
        out = out.unionByName(
            overrides.select("event_id", F.lit("override").alias("kind"), "seq").join(ids, "event_id", "left_anti")
        )
    return out


def keep_referenced(labels: DataFrame, events: DataFrame) -> DataFrame:
    """J6 on write: only labels of existing events (left semi join)."""
    return labels.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def change_feed(events: DataFrame, classifications: DataFrame, overrides: DataFrame) -> DataFrame:
    """event_recorded, label_updated and override_updated notices with the
    event id; per event they sort in that order."""
    return (
        events.select(F.lit("event_recorded").alias("kind"), F.lit(0).alias("kind_ord"), F.col("id").alias("event_id"), F.col("id").alias("seq"))
        .unionByName(classifications.select(F.lit("label_updated").alias("kind"), F.lit(1).alias("kind_ord"), "event_id", "seq"))
        .unionByName(overrides.select(F.lit("override_updated").alias("kind"), F.lit(2).alias("kind_ord"), "event_id", "seq"))
    )


def store_counts(events: DataFrame, classifications: DataFrame, overrides: DataFrame) -> DataFrame:
    """A4: row counts of the three stores (current state), as one metrics table."""
    c1 = events.agg(F.count(F.lit(1)).alias("n")).select(F.lit("events").alias("table_name"), "n")
    c2 = latest_classification(classifications).agg(F.count(F.lit(1)).alias("n")).select(F.lit("engine_classifications").alias("table_name"), "n")
    c3 = current_overrides(overrides).agg(F.count(F.lit(1)).alias("n")).select(F.lit("user_overrides").alias("table_name"), "n")
    return c1.unionByName(c2).unionByName(c3)


def latest_events(events: DataFrame, n: int = 5) -> DataFrame:
    """The latest ``n`` events by id with their duration (top-k, map-side)."""
    return events.orderBy(F.desc("id")).limit(n).select(
        "id", "app", "title", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration_sec")
    )


def compact_label_store(spark, root: str, version: str) -> dict[str, str]:
    """S10 ``compact()``: rewrite the append-only logs under ``root`` into
    current-state tables (W6 latest classification per (event, engine), W7
    current overrides, only for existing events: J6) under
    ``root/compacted/<version>``. Each table is written whole to a new
    version folder, so readers of an older version are never disturbed and a
    failed run leaves nothing half-written behind the last good version."""
    ev = spark.read.parquet(f"{root}/events")
    from dwell.session import path_exists

    out = {}
    cl_path = f"{root}/engine_classifications"
    ov_path = f"{root}/user_overrides"
    base = f"{root.rstrip('/')}/compacted/{version}"
    ev.drop("batch_id").write.mode("overwrite").parquet(f"{base}/events")
    out["events"] = f"{base}/events"
    if path_exists(spark, cl_path):
        log = spark.read.parquet(cl_path).drop("batch_id")
        rest = [c for c in log.columns if c not in ("event_id", "engine_version")]
        latest = log.groupBy("event_id", "engine_version").agg(F.max_by(F.struct(*rest), F.struct("created_at", "seq")).alias("l")).select("event_id", "engine_version", "l.*")
        keep_referenced(latest, ev).write.mode("overwrite").parquet(f"{base}/engine_classifications")
        out["engine_classifications"] = f"{base}/engine_classifications"
    if path_exists(spark, ov_path):
        cur = current_overrides(spark.read.parquet(ov_path).drop("batch_id"))
        keep_referenced(cur, ev).write.mode("overwrite").parquet(f"{base}/user_overrides")
        out["user_overrides"] = f"{base}/user_overrides"
    return out
