"""Backward as-of enrichment of samples with the latest browser tab snapshot.

Samples and snapshots are unioned per device and ordered by time (snapshots
first on ties); the latest non-null snapshot at or before each sample is found
with the bucketed last-non-null scan — no per-device task, no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.operators import ordered as O
from dwell.operators.sessionize import seconds_between


def firefox_app(app: Column, variant: str = "legacy") -> Column:
    """Which samples the override applies to: legacy = app without spaces,
    lower-cased, starts with 'firefox'; newer = app exactly 'Firefox'."""
    if variant == "legacy":
        return F.lower(F.regexp_replace(F.coalesce(app, F.lit("")), " ", "")).startswith("firefox")
    return app == "Firefox"


def apply_tab_override(
    samples: DataFrame,
    snapshots: DataFrame,
    device: str = "device_id",
    ts: str = "ts",
    seq: str = "seq",
    variant: str = "legacy",
    max_age_seconds: float | None = None,
    bucket_seconds: int | None = O.DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Replace title / url of the overridden app's samples by the latest
    snapshot's non-empty values (no staleness limit unless ``max_age_seconds``)."""
    cols = samples.columns
    s = samples.withColumn("_kind", F.lit(1)).withColumn("_snap", F.lit(None).cast("struct<t:string,u:string,ts:timestamp_ntz>"))
    p = snapshots.select(
        F.col(device),
        F.col(ts),
        F.col(seq),
        F.lit(0).alias("_kind"),
        F.struct(F.col("title").alias("t"), F.col("url").alias("u"), F.col(ts).cast("timestamp_ntz").alias("ts")).alias("_snap"),
    )
    u = s.unionByName(p, allowMissingColumns=True)
    u = O.with_last_non_null(u, [device], [ts, "_kind", seq], "_snap", "_latest", bucket_seconds)
    out = u.where(F.col("_kind") == 1)
    snap = F.col("_latest")
    fresh = snap.isNotNull()
    if max_age_seconds is not None:
        fresh = fresh & (seconds_between(snap.getField("ts"), F.col(ts)) <= max_age_seconds)
    applies = firefox_app(F.col("app"), variant) & fresh
    if variant != "legacy":
        # the newer override yields nothing when both fields are empty
        applies = applies & ~((F.coalesce(snap.getField("t"), F.lit("")) == "") & (F.coalesce(snap.getField("u"), F.lit("")) == ""))
    new_title = F.when(applies & (F.coalesce(snap.getField("t"), F.lit("")) != ""), snap.getField("t")).otherwise(F.col("title"))
    new_url = F.when(applies & (F.coalesce(snap.getField("u"), F.lit("")) != ""), snap.getField("u")).otherwise(F.col("url"))
    return out.withColumns({"title": new_title, "url": new_url, "overridden": applies}).select(*cols, "overridden", O.BUCKET)
