"""Streaming sessionization (R2-R5) and micro-batch sinks.

``stream_sessions`` carries the open session of every device across
micro-batches in Spark's state store (``applyInPandasWithState``), so the
stream emits exactly the sessions the batch ``sessionize`` returns for the same
samples. Within a micro-batch the rows of a device are sorted by (ts, seq);
rows not after the state's last (ts, seq), or without a ts, are late: they open and
close nothing and come out marked ``is_late`` (see ``late_rows``), an explicit rule
the capture loop never needed. Each close marker (``is_close`` true, ``ts`` = close
time) closes the open session of its device at its place in that order (R4), and
the rows after it go on, so micro-batch borders don't bear on the result; restarts resume from the checkpointed state (R5).

With ``silence_seconds`` a device needs no marker: an open session, or an idle hole, that
no row follows within that time is closed at the last row's time plus it, by an event-time
timer once the watermark is there (``sessionize.sessionize_silent`` is the batch form).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dwell.operators.sessionize import not_glitch

SESSION_OUT_SCHEMA = (
    "start_time timestamp_ntz, end_time timestamp_ntz, duration_sec double, app string, title string, url string, "
    "category string, is_productive boolean, device_id string, "
    "is_late boolean, late_ts timestamp_ntz, late_seq long, late_is_close boolean, late_is_idle boolean"
)
SESSION_STATE_SCHEMA = (
    "open boolean, app string, title string, url string, start_ts timestamp_ntz, category string, is_productive boolean, "
    "last_ts timestamp_ntz, last_seq long, late_rows long, is_idle boolean"
)
_NULL = "\u0000<null>"
_CLOSE = "\u0000<close>"


def _key_frame(pdf: pd.DataFrame, variant: str) -> pd.DataFrame:
    """Run identity per row. legacy (W1): (app, title, url), null-safe.
    segments (W2/R3): idle rows share one key; otherwise (app, url, title only
    when url is ''), so a title flutter on an unchanged URL continues the run."""
    if variant == "legacy":
        k = pdf[["app", "title", "url"]].astype(object)
    else:
        idle = pdf["is_idle"].fillna(False).astype(bool)
        k = pd.DataFrame(
            {
                "i": idle,
                "a": pdf["app"].where(~idle, None),
                "u": pdf["url"].where(~idle, None),
                "t": pdf["title"].where(~idle & (pdf["url"] == ""), None),
            }
        ).astype(object)
    return k.where(k.notna(), _NULL)


_MARKER_SEQ = 2**62


def _silence_markers(rows: pd.DataFrame, last_ts, silence_us: int) -> pd.DataFrame:
    """``rows`` (sorted) with a close marker wherever a device fell silent: after
    the last row known before, or between two rows."""
    before = rows["ts"].shift(1)
    if len(rows) and last_ts is not None:
        before.iloc[0] = last_ts
    gap = pd.Timedelta(microseconds=silence_us)
    # the row before a gap is no marker itself: nothing is open after one
    quiet = (rows["ts"] - before > gap) & ~rows["is_close"].shift(1, fill_value=False).astype(bool)
    if not quiet.any():
        return rows
    marks = rows[quiet].assign(ts=before[quiet] + gap, seq=_MARKER_SEQ, is_close=True, is_idle=False)
    for c in ("app", "title", "url", "category", "is_productive"):
        marks[c] = None
    return pd.concat([rows, marks], ignore_index=True).sort_values(["ts", "seq"], kind="mergesort").reset_index(drop=True)


def _sessions_fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState, variant: str = "legacy", silence_us: int | None = None) -> Iterator[pd.DataFrame]:
    device = key[0]
    if state.hasTimedOut:
        # the watermark is past the last row and the silence: no row that is on time can come in between
        at = pd.Timestamp(state.get[7]) + pd.Timedelta(microseconds=silence_us)
        pdf = pd.DataFrame({"ts": [at], "seq": [_MARKER_SEQ], "app": [None], "title": [None], "url": [None], "category": [None], "is_productive": [None], "is_close": [True], "is_idle": [False]})
    else:
        pdf = pd.concat(list(pdfs), ignore_index=True)
    if state.exists:
        (is_open, app, title, url, start, cat, prod, last_ts, last_seq, late, idle0) = state.get
    else:
        is_open, app, title, url, start, cat, prod, last_ts, last_seq, late = (False, None, None, None, None, None, None, None, None, 0)
        idle0 = False
    pdf = pdf.sort_values(["ts", "seq"], kind="mergesort").reset_index(drop=True)
    after = pdf["ts"].notna()
    if last_ts is not None:
        last_ts = pd.Timestamp(last_ts)
        after &= (pdf["ts"] > last_ts) | ((pdf["ts"] == last_ts) & (pdf["seq"] > last_seq))
    if not after.all():
        late += int((~after).sum())
        yield _late_frame(pdf[~after], device)
        pdf = pdf[after].reset_index(drop=True)
    rows = pdf.assign(is_close=pdf["is_close"].fillna(False).astype(bool))
    if silence_us is not None and not state.hasTimedOut:
        rows = _silence_markers(rows, last_ts if is_open else None, silence_us)

    # prepend the open run as a pseudo-row so runs continue across batches
    if is_open:
        head = pd.DataFrame(
            {"ts": [pd.Timestamp(start)], "seq": [-1], "app": [app], "title": [title], "url": [url],
             "category": [cat], "is_productive": [prod], "is_close": [False], "is_idle": [bool(idle0)]}
        )
        rows = pd.concat([head, rows[head.columns]], ignore_index=True)
    out = pd.DataFrame(columns=["start_time", "end_time", "duration_sec", "app", "title", "url", "category", "is_productive", "device_id"])
    if len(rows):
        # a close marker ends the run before it and is no run itself, like an idle sample
        marker = rows["is_close"].astype(bool)
        kf = _key_frame(rows, variant)
        kf.loc[marker] = _CLOSE
        change = np.ones(len(rows), dtype=bool)
        if len(rows) > 1:
            change[1:] = (kf.iloc[1:].values != kf.iloc[:-1].values).any(axis=1)
        starts = rows[change].reset_index(drop=True)
        starts = starts.assign(end_time=starts["ts"].shift(-1))
        last = starts.iloc[-1]
        closed = starts.iloc[:-1]
        closed = closed[closed["app"].notna() & ~closed["is_close"].astype(bool) & ~closed["is_idle"].fillna(False).astype(bool)]
        if len(closed):
            out = pd.DataFrame(
                {
                    "start_time": closed["ts"].values,
                    "end_time": pd.to_datetime(closed["end_time"]).values,
                    "duration_sec": (pd.to_datetime(closed["end_time"]) - closed["ts"]).dt.total_seconds().values,
                    "app": closed["app"].values,
                    "title": closed["title"].values,
                    "url": closed["url"].values,
                    "category": closed["category"].values,
                    "is_productive": closed["is_productive"].values,
                    "device_id": device,
                }
            )
        if not last["is_close"]:
            has_lab = last["category"] is not None and not pd.isna(last["category"]) and not pd.isna(last["is_productive"])
            is_open, app, title, url, start = True, last["app"], last["title"], last["url"], last["ts"]
            idle0 = bool(last["is_idle"]) if not pd.isna(last["is_idle"]) else False
            cat = last["category"] if has_lab else None
            prod = bool(last["is_productive"]) if has_lab else None
        else:
            is_open, app, title, url, start, cat, prod, idle0 = False, None, None, None, None, None, None, False
        if len(pdf):
            tail = pdf.iloc[-1]
            last_ts, last_seq = tail["ts"], int(tail["seq"])
    state.update(
        (
            bool(is_open), _s(app), _s(title), _s(url), None if start is None else pd.Timestamp(start).to_pydatetime(),
            _s(cat), None if prod is None or pd.isna(prod) else bool(prod),
            None if last_ts is None else pd.Timestamp(last_ts).to_pydatetime(), None if last_seq is None else int(last_seq),
            int(late),
            bool(idle0),
        )
    )
    if silence_us is not None and is_open:
        due = (pd.Timestamp(last_ts) - pd.Timestamp(0)).value // 1_000_000 + silence_us // 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    none = pd.Series([None] * len(out), dtype=object, index=out.index)
    yield out.assign(is_late=False, late_ts=pd.Series(pd.NaT, index=out.index, dtype="datetime64[ns]"), late_seq=none, late_is_close=none, late_is_idle=none)


def _late_frame(rows: pd.DataFrame, device: str) -> pd.DataFrame:
    """Late rows as output rows: no session, their own fields kept."""
    no_time = pd.Series(pd.NaT, index=rows.index, dtype="datetime64[ns]")
    out = rows[["app", "title", "url", "category", "is_productive"]].astype(object)
    return out.assign(
        start_time=no_time, end_time=no_time, duration_sec=np.nan, device_id=device, is_late=True, late_ts=rows["ts"],
        late_seq=rows["seq"].astype(object), late_is_close=rows["is_close"].astype(object), late_is_idle=rows["is_idle"].astype(object),
    )


def _s(v):
    return None if v is None or (isinstance(v, float) and np.isnan(v)) else v


def stream_sessions(
    samples: DataFrame, device: str = "device_id", variant: str = "legacy", silence_seconds: float | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Streaming W1 (change-based sessions) with per-device state.
    ``variant="segments"`` is the newer capture loop (W2/R3): url '' when
    missing, title changes on an unchanged non-empty URL continue the segment,
    samples without an app or titled 'frontProcess Error' are skipped, and
    ``is_idle`` samples close the open segment and leave a hole.

    ``samples`` needs device_id, ts, seq, app, title, url and optionally
    category / is_productive / is_close (close marker rows) / is_idle.

    Late rows are rows of the output, too: ``on_time`` and ``late_rows`` (or, for
    a sink, ``late_split_writer``) part them from the sessions.

    ``silence_seconds`` closes what no row follows in time (see the module's text);
    ``delay`` is then how far rows may lag behind the newest one."""
    import functools

    cols = samples.columns
    s = samples
    if "is_idle" not in cols:
        s = s.withColumn("is_idle", F.lit(False))
    if variant == "segments":
        closing = F.coalesce(F.col("is_close"), F.lit(False)) if "is_close" in cols else F.lit(False)
        s = s.where(closing | F.coalesce(F.col("is_idle"), F.lit(False)) | not_glitch(legacy=False)).withColumn("url", F.coalesce(F.col("url"), F.lit("")))
    if "category" not in cols:
        s = s.withColumn("category", F.lit(None).cast("string"))
    if "is_productive" not in cols:
        s = s.withColumn("is_productive", F.lit(None).cast("boolean"))
    if "is_close" not in cols:
        s = s.withColumn("is_close", F.lit(False))
    s = s.select(
        F.col(device).alias("device_id"), "ts", "seq", "app", "title", "url", "category", "is_productive", "is_close", "is_idle"
    )
    if silence_seconds is None:
        silence_us, timeout = None, GroupStateTimeout.NoTimeout
    else:
        from dwell.streaming.asof import clocked

        s, silence_us, timeout = clocked(s, delay), round(silence_seconds * 1_000_000), GroupStateTimeout.EventTimeTimeout
    fn = functools.partial(_sessions_fn, variant=variant, silence_us=silence_us)
    return s.groupBy("device_id").applyInPandasWithState(fn, SESSION_OUT_SCHEMA, SESSION_STATE_SCHEMA, "append", timeout)


def on_time(stream: DataFrame) -> DataFrame:
    """The output of ``stream_sessions`` or ``stream_keyword_sessions`` without late rows."""
    return stream.where("NOT is_late").drop(*[c for c in stream.columns if c == "is_late" or c.startswith("late_")])


def late_rows(stream: DataFrame) -> DataFrame:
    """Side output: the late input rows of ``stream_sessions`` or ``stream_keyword_sessions``."""
    late = stream.where("is_late")
    if "late_ts" not in stream.columns:
        return late.drop("is_late", "is_new")
    own = [F.col(f"late_{c}").alias(c) for c in ("is_close", "is_idle")]
    return late.select("device_id", F.col("late_ts").alias("ts"), F.col("late_seq").alias("seq"), "app", "title", "url", "category", "is_productive", *own)


def close_markers(devices: DataFrame, close_ts: str) -> DataFrame:
    """R4 end-of-stream markers: one row per device closing its open session."""
    return devices.select(
        "device_id",
        F.lit(close_ts).cast("timestamp_ntz").alias("ts"),
        F.lit(2**62).cast("long").alias("seq"),
        F.lit(None).cast("string").alias("app"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("url"),
        F.lit(True).alias("is_close"),
    )


# ------------------------------------------------------------------ sinks


def checkpoint_location(spark, name: str) -> str:
    """The checkpoint of the stream ``name``, under the shared
    ``spark.checkpoint.dir``: the same folder on every call, so that a restarted
    job goes on with its state and batch numbers."""
    from dwell.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"


def idempotent_batch_writer(root: str, partition_cols: tuple[str, ...] = ()):
    """R6 ``foreachBatch`` writer: each micro-batch lands in its own
    ``batch_id=`` partition with dynamic overwrite, so a retried batch replaces
    its own output instead of duplicating it. The folder belongs to one stream and
    one checkpoint; ``store.Store`` commits many streams and restarts on one root."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id", *partition_cols)
            .parquet(root)
        )

    return write


def late_split_writer(write, write_late):
    """``foreachBatch`` writer: on-time rows to ``write``, late ones to ``write_late``
    (both ``(batch, batch_id)``, say two ``idempotent_batch_writer``)."""

    def both(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write(on_time(batch), batch_id)
            write_late(late_rows(batch), batch_id)
        finally:
            batch.unpersist()

    return both


def daily_totals_stream(sessions: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming daily minutes per productivity (tumbling 1-day windows on
    session start, watermark for late sessions)."""
    return (
        sessions.withColumn("start_ts", F.col("start_time").cast("timestamp"))
        .withWatermark("start_ts", watermark)
        .groupBy(F.window("start_ts", "1 day").alias("day"), F.col("is_productive"))
        .agg((F.sum("duration_sec") / 60).alias("minutes"))
    )


def label_store_writer(root: str, ruleset, engine_version: str = "rules-v1"):
    """R6 classify-on-ingest as a ``foreachBatch`` writer: each micro-batch of
    events is validated (P3), written to ``root/events``, then classified
    (rules-v1) and its labels appended to ``root/engine_classifications``. Both
    writes are keyed by ``batch_id`` (dynamic partition overwrite), so a retried
    batch replaces its own rows; the latest-wins views (W6) make reruns safe.
    Classification is a total expression: a row it cannot match gets
    'Unknown', never an error, so ingestion never stops on a label."""
    from dwell.functions.text import canonical_json
    from dwell.operators.classify import classify_v1
    from dwell.operators.labels import valid_events

    ev_writer = idempotent_batch_writer(f"{root}/events")
    cl_writer = idempotent_batch_writer(f"{root}/engine_classifications")

    def write(batch: DataFrame, batch_id: int) -> None:
        # both writes read the batch: keep it, so that the stream's state is run once
        ev = valid_events(batch).persist()
        try:
            ev_writer(ev, batch_id)
            labels = classify_v1(ev, ruleset).select(
                F.col("id").alias("event_id"),
                F.lit(engine_version).alias("engine_version"),
                "category_id",
                "confidence",
                "rule_id",
                canonical_json("meta").alias("meta_json"),
                F.current_timestamp().alias("created_at"),
                F.col("id").alias("seq"),
            )
            cl_writer(labels, batch_id)
        finally:
            ev.unpersist()

    return write


def write_raw_polls(polls: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """S9 bronze sink: one JSON line per poll, including polls that produced no
    sample (null payload columns), appended under ``path``. Returns the query."""
    w = polls.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
