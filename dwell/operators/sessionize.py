"""Sample -> session operators (W1-W4) and the sample filters before them.

All are change-point scans per device in (ts, seq) order, built on the
skew-safe bucketed scans of ``dwell.operators.ordered``: one shuffle of the
samples on (device, time bucket), never a whole device in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.operators import ordered as O

SESSION_COLUMNS = [
    "start_time", "end_time", "duration_sec", "app", "title", "url", "category", "is_productive", "device_id",
]


def micros_between(start: Column | str, end: Column | str) -> Column:
    """D5 exact microseconds between two timestamps (bigint)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    # wall-clock difference of timestamp_ntz values (naive datetimes): no time
    # zone, so no DST shift and the same under any spark.sql.session.timeZone
    return F.timestamp_diff("MICROSECOND", s, e)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(1e6)


def _change_points(
    df: DataFrame,
    key: Column,
    device: str,
    ts: str,
    seq: str,
    close_ts: Column | None,
    bucket_seconds: int,
) -> DataFrame:
    """Keep the first sample of every run of equal ``key`` (null-safe) and give
    it ``end_time`` = ts of the next run's first sample (or ``close_ts``)."""
    b = O.change_points(df, [device], [ts, seq], key, bucket_seconds)
    end = F.col("_next_start")
    if close_ts is not None:
        end = F.coalesce(end, close_ts)
    return b.withColumn("_end", end).where(F.col("_end").isNotNull()).drop("_next_start")


def sessionize(
    samples: DataFrame,
    device: str = "device_id",
    ts: str = "ts",
    seq: str = "seq",
    close_ts: Column | str | None = None,
    bucket_seconds: int | None = O.DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """W1 change-based sessions.

    Consecutive samples of a device with the same (app, title, url) — compared
    null-safely, so null url differs from '' — form one session that ends at the
    timestamp of the next different sample. The last run stays open (dropped)
    unless ``close_ts`` closes it. Runs with a null app end the previous session
    but are not emitted. Keeps the first sample's ``category``/``is_productive``
    when the input has them (null when absent); see ``label_sessions``.
    """
    if isinstance(close_ts, str):
        close_ts = F.lit(close_ts).cast("timestamp_ntz")
    key = F.struct("app", "title", "url")
    has_labels = "category" in samples.columns and "is_productive" in samples.columns
    keep = [device, ts, seq, "app", "title", "url"] + (["category", "is_productive"] if has_labels else [])
    keep += [O.BUCKET] if O.BUCKET in samples.columns else []
    out = _change_points(samples.select(*keep), key, device, ts, seq, close_ts, bucket_seconds)
    out = out.where(F.col("app").isNotNull())
    return out.select(
        F.col(ts).alias("start_time"),
        F.col("_end").alias("end_time"),
        seconds_between(F.col(ts), F.col("_end")).alias("duration_sec"),
        "app",
        "title",
        "url",
        (F.col("category") if has_labels else F.lit(None).cast("string")).alias("category"),
        (F.col("is_productive") if has_labels else F.lit(None).cast("boolean")).alias("is_productive"),
        F.col(device).alias("device_id"),
        O.BUCKET,
    )


def sessionize_silent(
    samples: DataFrame,
    silence_seconds: float,
    device: str = "device_id",
    ts: str = "ts",
    seq: str = "seq",
    bucket_seconds: int | None = O.DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """W1 sessions of devices that may fall silent (R4 without markers): a run that
    no sample follows within ``silence_seconds`` ends that long after its last
    sample, and the next sample opens a new session, be it equal or not. Nothing
    stays open at the end."""
    cols = [device, ts, seq, "app", "title", "url"]
    s = O.with_next(samples.select(*cols), [device], [ts, seq], [ts], bucket_seconds)
    after = F.timestamp_add("MICROSECOND", F.lit(round(silence_seconds * 1_000_000)), F.col(ts))
    quiet = F.col(f"next_{ts}").isNull() | (seconds_between(F.col(ts), F.col(f"next_{ts}")) > silence_seconds)
    # every sample brings its own closing row along, where one is due: no second scan
    here = F.struct(F.col(ts).alias(ts), F.col(seq).alias(seq), F.lit(False).alias("_closing"))
    mark = F.struct(after.alias(ts), F.lit(2**62).alias(seq), F.lit(True).alias("_closing"))
    both = s.withColumn("_r", F.explode(F.when(quiet, F.array(here, mark)).otherwise(F.array(here)))).select(
        device, "_r.*", *[F.when(~F.col("_r._closing"), F.col(c)).alias(c) for c in ("app", "title", "url")]
    )
    out = _change_points(both, F.struct("_closing", "app", "title", "url"), device, ts, seq, None, bucket_seconds)
    out = out.where(~F.col("_closing") & F.col("app").isNotNull())
    return out.select(
        F.col(ts).alias("start_time"), F.col("_end").alias("end_time"), seconds_between(F.col(ts), F.col("_end")).alias("duration_sec"),
        "app", "title", "url", F.col(device).alias("device_id"),
    )


def label_sessions(sessions: DataFrame, classifier) -> DataFrame:
    """Keep a session's label when both fields are set, else classify it
    (``classifier(df) -> df`` adding ``category``/``is_productive``)."""
    keep = F.col("_c0").isNotNull() & F.col("_p0").isNotNull()
    labelled = classifier(sessions.withColumnsRenamed({"category": "_c0", "is_productive": "_p0"}))
    return labelled.withColumns(
        {
            "category": F.when(keep, F.col("_c0")).otherwise(F.col("category")),
            "is_productive": F.when(keep, F.col("_p0")).otherwise(F.col("is_productive")),
        }
    ).drop("_c0", "_p0")


def segments(
    samples: DataFrame,
    device: str = "device_id",
    ts: str = "ts",
    seq: str = "seq",
    idle: Column | None = None,
    close_ts: Column | str | None = None,
    bucket_seconds: int | None = O.DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """W2 segments of the newer capture loop.

    Like W1, but a title change with the same app and the same non-empty URL
    does not break the segment (the first title is kept), url is '' when
    missing, and idle samples (``idle`` true) close the open segment and leave
    a hole, whatever their app or title. Other samples without an app or titled
    'frontProcess Error' are skipped (P4) and do not close anything. Output: Event rows in epoch seconds.
    """
    if isinstance(close_ts, str):
        close_ts = F.lit(close_ts).cast("timestamp_ntz")
    is_idle = F.coalesce(idle, F.lit(False)) if idle is not None else F.lit(False)
    d = samples.withColumn("_idle", is_idle).where(F.col("_idle") | not_glitch(legacy=False))
    d = d.withColumn("url", F.coalesce(F.col("url"), F.lit("")))
    key = F.when(F.col("_idle"), F.struct(F.lit(True).alias("i"), F.lit(None).cast("string").alias("a"),
                                          F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("t"))).otherwise(
        F.struct(
            F.lit(False).alias("i"),
            F.col("app").alias("a"),
            F.col("url").alias("u"),
            F.when(F.col("url") == "", F.col("title")).alias("t"),
        )
    )
    d = d.select(device, ts, seq, "app", "title", "url", "_idle")
    out = _change_points(d, key, device, ts, seq, close_ts, bucket_seconds).where(~F.col("_idle"))
    from dwell.sources.samples import epoch_seconds

    return out.select(
        F.col(device).alias("device_id"),
        epoch_seconds(ts).alias("start_ts"),
        epoch_seconds("_end").alias("end_ts"),
        "app",
        F.coalesce("title", F.lit("")).alias("title"),
        "url",
        F.lit(None).cast("string").alias("content_hash"),
        O.BUCKET,
    )


def stitch(
    sessions: DataFrame,
    gap_seconds: float = 60,
    device: str = "device_id",
    bucket_seconds: int | None = O.DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """W3 stitch adjacent sessions of a device: merge when app and title are
    equal, url equal with '' = null, and 0 <= start - previous end <= gap.
    The merged row keeps the earliest session's fields and label, ends at the
    last merged end; chains merge transitively (islands)."""
    ident = ["app", "title", "_u", "start_time", "end_time"]
    # sessions straight from ``sessionize`` keep their (device, start-time) bucket
    # and partitioning: the scan below then needs no new shuffle
    d = sessions.withColumn("_u", F.nullif(F.col("url"), F.lit("")))
    d = d.withColumn("_sk", F.struct("start_time", "end_time"))

    def same(cur, prev):
        gap = seconds_between(prev["end_time"], cur["start_time"])
        return (
            cur["app"].eqNullSafe(prev["app"])
            & cur["title"].eqNullSafe(prev["title"])
            & cur["_u"].eqNullSafe(prev["_u"])
            & (gap >= 0)
            & (gap <= gap_seconds)
        )

    d = O.islands(d, [device], ["start_time", "_sk"], ident, same, "_island", bucket_seconds)
    first = F.min_by(F.struct("start_time", "app", "title", "url", "category", "is_productive"), F.col("_sk"))
    g = d.groupBy(device, "_island").agg(first.alias("f"), F.max_by("end_time", "_sk").alias("end_time"))
    return g.select(
        F.col("f.start_time").alias("start_time"),
        "end_time",
        seconds_between("f.start_time", "end_time").alias("duration_sec"),
        "f.app",
        "f.title",
        "f.url",
        "f.category",
        "f.is_productive",
        F.col(device).alias("device_id"),
    )


def gap_fill(sessions: DataFrame, gap_seconds: float = 60, device: str = "device_id",
             bucket_seconds: int | None = O.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """W4 short-gap resume in batch form: when the next session of the device
    starts 0..gap seconds after this one ends, the downtime is credited to this
    session (end := next start)."""
    d = sessions.withColumn("_sk", F.struct("start_time", "end_time"))
    d = O.with_next(d, [device], ["start_time", "_sk"], ["start_time"], bucket_seconds, prefix="_n")
    gap = seconds_between(F.col("end_time"), F.col("_nstart_time"))
    fill = F.coalesce((gap >= 0) & (gap <= gap_seconds), F.lit(False))
    end = F.when(fill, F.col("_nstart_time")).otherwise(F.col("end_time"))
    return d.select(
        "start_time",
        end.alias("end_time"),
        seconds_between(F.col("start_time"), end).alias("duration_sec"),
        "app", "title", "url", "category", "is_productive", "device_id",
        fill.alias("resumed"),
    )


def resume_seed(sessions: DataFrame, now: Column | str, gap_seconds: float = 60, device: str = "device_id") -> DataFrame:
    """W4 incremental form: per device, the last stored session (by end time)
    if it ended at most ``gap_seconds`` before ``now``; it is reopened at its end
    time with its label. A partial aggregate (max_by), no sort of the device."""
    if isinstance(now, str):
        now = F.lit(now).cast("timestamp_ntz")
    last = sessions.groupBy(device).agg(
        F.max_by(F.struct("end_time", "app", "title", "url", "category", "is_productive"), F.col("end_time")).alias("l")
    )
    gap = seconds_between(F.col("l.end_time"), now)
    return last.where((gap >= 0) & (gap <= gap_seconds)).select(
        F.col(device).alias("device_id"),
        F.col("l.end_time").alias("start_time"),
        "l.app", "l.title", "l.url", "l.category", "l.is_productive",
    )


# ---------------------------------------------------------------- sample filters


def not_glitch(legacy: bool = True) -> Column:
    """The sample has an app (legacy: even an empty one) and isn't titled
    'frontProcess Error'."""
    cond = F.col("app").isNotNull()
    if not legacy:
        cond = cond & (F.col("app") != "")
    return cond & ~F.coalesce(F.col("title") == "frontProcess Error", F.lit(False))


def drop_glitches(samples: DataFrame, legacy: bool = True) -> DataFrame:
    """P4 as a filter."""
    return samples.where(not_glitch(legacy))


def is_idle(idle_seconds: Column | str, threshold: Column | float) -> Column:
    """P5: idle when idle seconds >= threshold; unknown idle time is not idle."""
    c = F.col(idle_seconds) if isinstance(idle_seconds, str) else idle_seconds
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(c >= t, F.lit(False))


def idle_threshold(settings: DataFrame, user_idle_seconds: int = 300, device: str = "device_id") -> DataFrame:
    """Effective idle threshold per device = min(user value, positive
    display/system sleep minutes -> max(1, m*60-1), positive screensaver
    seconds); unparsable values are ignored. One partial aggregate."""
    v = F.expr("try_cast(value AS INT)")
    cand = (
        F.when(F.col("key").isin("displaysleep", "sleep") & (v > 0), F.greatest(F.lit(1), v * 60 - 1))
        .when((F.col("key") == "screensaver") & (v > 0), v)
    )
    return settings.groupBy(device).agg(
        F.least(F.lit(user_idle_seconds), F.coalesce(F.min(cand), F.lit(user_idle_seconds))).alias("idle_threshold")
    )


def collapse_idle(
    samples: DataFrame,
    idle: Column,
    device: str = "device_id",
    ts: str = "ts",
    seq: str = "seq",
    bucket_seconds: int | None = O.DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """P7 (legacy capture): the first idle poll becomes one 'Idle'/'Idle'/null
    sample at that poll's time; following idle polls are swallowed until the
    device is active again."""
    d = samples.withColumn("_idle", idle)
    d = O.with_prev(d, [device], [ts, seq], ["_idle"], bucket_seconds, prefix="_p", has_prev="_hp")
    keep = ~F.col("_idle") | ~F.coalesce(F.col("_p_idle"), F.lit(False))
    cols = [c for c in samples.columns]
    repl = {
        "app": F.when(F.col("_idle"), F.lit("Idle")).otherwise(F.col("app")),
        "title": F.when(F.col("_idle"), F.lit("Idle")).otherwise(F.col("title")),
        "url": F.when(F.col("_idle"), F.lit(None).cast("string")).otherwise(F.col("url")),
    }
    out = d.where(keep).withColumns({k: v for k, v in repl.items() if k in cols})
    return out.select(*cols, "_idle", O.BUCKET).withColumnRenamed("_idle", "is_idle")


def session_columns(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """P1 canonical projection (absent columns -> null)."""
    types = {
        "start_time": "timestamp_ntz", "end_time": "timestamp_ntz", "duration_sec": "double", "app": "string",
        "title": "string", "url": "string", "category": "string", "is_productive": "boolean", "device_id": "string",
    }
    cols = [F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in SESSION_COLUMNS]
    return df.select(*cols, *extra)
