"""Stream = batch: the stateful streaming operators equal their batch forms
under several micro-batch cuts."""

import datetime as dt
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from dwell.operators import keywords as K
from dwell.operators import sessionize as S
from dwell.plans.catalog import samples
from dwell.streaming import keywords as SK
from dwell.streaming import sessions as SS

SF = "/root/testdata/sf0.001"
SESSION_COLS = ["device_id", "start_time", "end_time", "app", "title", "url"]


def _write_cuts(df, n_files, order_col="ts"):
    """Write ``df`` as ``n_files`` time-ordered files for a file stream source."""
    path = tempfile.mkdtemp(prefix="dwell-stream-in-")
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    span = (hi - lo).total_seconds() + 1
    cut = F.floor((F.unix_micros(F.col(order_col).cast("timestamp")) - F.lit(int(lo.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6))) / F.lit(span * 1e6 / n_files))
    parts = df.withColumn("_cut", cut)
    for i in range(n_files):
        parts.where(F.col("_cut") == i).drop("_cut").coalesce(1).write.mode("overwrite").parquet(f"{path}/part-{i:03d}")
    return path, df.schema


def _run_stream(spark, stream_df, name):
    q = stream_df.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", SS.checkpoint_location(spark, name)
    ).trigger(availableNow=True).start()
    q.awaitTermination(300)
    out = spark.table(name)
    return out


@pytest.mark.parametrize("n_files", [1, 5])
def test_stream_sessions_equal_batch(spark, n_files):
    sm = samples(spark, SF).select("device_id", "ts", "seq", "app", "title", "url")
    batch = {tuple(r) for r in S.sessionize(sm).select(*SESSION_COLS).collect()}
    path, schema = _write_cuts(sm, n_files)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    out = _run_stream(spark, SS.stream_sessions(src), f"sess_{n_files}")
    got = {tuple(r) for r in out.select(*SESSION_COLS).collect()}
    assert got == batch and len(batch) > 100


def test_stream_close_marker(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("d", t0, 0, "A", "t", None, False), ("d", t0 + dt.timedelta(seconds=300), 1, "A", "t", None, False),
            ("d", t0 + dt.timedelta(seconds=600), 2**62, None, None, None, True)]
    schema = "device_id string, ts timestamp_ntz, seq long, app string, title string, url string, is_close boolean"
    df = spark.createDataFrame(rows, schema)
    path = tempfile.mkdtemp(prefix="dwell-stream-close-")
    df.where("seq < 2").coalesce(1).write.parquet(f"{path}/a")
    df.where("seq >= 2").coalesce(1).write.parquet(f"{path}/b")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    out = _run_stream(spark, SS.stream_sessions(src), "sess_close").collect()
    assert [(r.app, r.duration_sec) for r in out] == [("A", 600.0)]


def test_stream_keyword_sessions_equal_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        rows.append((f"ctx{i % 3}", t0 + dt.timedelta(seconds=37 * i), i, "Cat", ["a", "b"][(i // 4) % 2]))
    hits = spark.createDataFrame(rows, "context_key string, ts timestamp_ntz, seq long, category string, matched_keyword string")
    batch = {(r.seq, r.is_new) for r in K.keyword_sessions(hits, reset_seconds=120).collect()}
    path, schema = _write_cuts(hits, 4)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    out = _run_stream(spark, SK.stream_keyword_sessions(src, reset_seconds=120), "kw_sessions")
    assert {(r.seq, r.is_new) for r in out.collect()} == batch


@pytest.mark.parametrize("n_files", [3])
def test_stream_segments_equal_batch(spark, n_files):
    sm = samples(spark, SF).select("device_id", "ts", "seq", "app", "title", "url", "idle_seconds")
    sm = sm.withColumn("is_idle", S.is_idle("idle_seconds", 600)).drop("idle_seconds")
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    batch = {
        (r.device_id, r.start_ts, r.end_ts, r.app, r.title, r.url)
        for r in S.segments(sm, idle=F.col("is_idle")).collect()
    }
    path, schema = _write_cuts(sm, n_files)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    out = _run_stream(spark, SS.stream_sessions(src, variant="segments"), f"seg_{n_files}")
    secs = lambda c: F.timestamp_diff("MICROSECOND", epoch, F.col(c)) / F.lit(1e6)
    got = {
        (r.device_id, r.s, r.e, r.app, r.title, r.url)
        for r in out.select("device_id", secs("start_time").alias("s"), secs("end_time").alias("e"), "app", "title", "url").collect()
    }
    assert got == batch and len(batch) > 50


def test_stream_restart_from_checkpoint(spark):
    """Stop after the first half of the files, restart from the same
    checkpoint with the rest; the open sessions carried in state continue."""
    sm = samples(spark, SF).select("device_id", "ts", "seq", "app", "title", "url")
    batch = {tuple(r) for r in S.sessionize(sm).select(*SESSION_COLS).collect()}
    path, schema = _write_cuts(sm, 4)
    live = tempfile.mkdtemp(prefix="dwell-stream-live-")
    out = tempfile.mkdtemp(prefix="dwell-stream-out-") + "/sessions"
    ckpt = SS.checkpoint_location(spark, "restart")
    import os

    parts = sorted(os.listdir(path))

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(live)
        q = (SS.stream_sessions(src).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(300)

    for p in parts[:2]:
        spark.read.parquet(f"{path}/{p}").coalesce(1).write.parquet(f"{live}/{p}")
    run()
    for p in parts[2:]:
        spark.read.parquet(f"{path}/{p}").coalesce(1).write.parquet(f"{live}/{p}")
    run()
    got = {tuple(r) for r in spark.read.parquet(out).select(*SESSION_COLS).collect()}
    assert got == batch


def _cut_stream(spark, df, cuts, make, name):
    path = tempfile.mkdtemp(prefix="dwell-stream-cut-")
    for i, seqs in enumerate(cuts):
        df.where(F.col("arrival").isin(seqs)).drop("arrival").coalesce(1).write.parquet(f"{path}/{i}")
        os.utime(next(f for f in glob.glob(f"{path}/{i}/*.parquet")), (1e9 + i, 1e9 + i))
    src = spark.readStream.schema(df.drop("arrival").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    return _run_stream(spark, make(src), name)


CLOSE_SCHEMA = "arrival int, device_id string, ts timestamp_ntz, seq long, app string, title string, url string, is_close boolean"


@pytest.mark.parametrize("variant", ["legacy", "segments"])
def test_stream_close_markers_cut_the_batch_in_order(spark, variant):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    marks = {2: None, 5: None, 6: None, 9: None}  # two of them in a row
    rows = [(i, "d", t(i), i, None if i in marks else "AB"[i == 4], None if i in marks else "t", None, i in marks) for i in range(10)]
    df = spark.createDataFrame(rows, CLOSE_SCHEMA)
    want = [(0, 2, "A"), (3, 4, "A"), (4, 5, "B"), (7, 9, "A")]
    for name, cuts in {"one": [range(10)], "some": [range(4), range(4, 7), range(7, 10)], "each": [[i] for i in range(10)]}.items():
        out = _cut_stream(spark, df, [list(c) for c in cuts], lambda s: SS.stream_sessions(s, variant=variant), f"close_{variant}_{name}")
        got = sorted((r.start_time, r.end_time, r.app) for r in SS.on_time(out).collect())
        assert got == [(t(a), t(b), x) for a, b, x in want], name
        assert SS.late_rows(out).count() == 0


def test_stream_late_rows_come_out_aside(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(0, "d", t(0), 0, "A", "t", None, False), (0, "d", t(5), 5, "B", "t", None, False),
            (1, "d", t(3), 3, "C", "late", "u", False), (1, "d", t(4), 2**62 + 1, None, None, None, True), (1, "d", t(8), 8, "D", "t", None, False)]
    out = _cut_stream(spark, spark.createDataFrame(rows, CLOSE_SCHEMA), [[0], [1]], SS.stream_sessions, "late_sessions")
    assert [(r.start_time, r.end_time, r.app) for r in SS.on_time(out).orderBy("start_time").collect()] == [(t(0), t(5), "A"), (t(5), t(8), "B")]
    late = [(r.device_id, r.ts, r.seq, r.app, r.title, r.url, r.is_close) for r in SS.late_rows(out).orderBy("ts").collect()]
    assert late == [r[1:] for r in rows[2:4]]
    hits = [(0, "c", t(0), 0, "Cat", "a"), (0, "c", t(5), 5, "Cat", "a"), (1, "c", t(3), 3, "Cat", "b"), (1, "c", t(6), 6, "Cat", "a")]
    df = spark.createDataFrame(hits, "arrival int, context_key string, ts timestamp_ntz, seq long, category string, matched_keyword string")
    out = _cut_stream(spark, df, [[0], [1]], lambda s: SK.stream_keyword_sessions(s, reset_seconds=120), "late_hits")
    assert {(r.seq, r.is_new) for r in SS.on_time(out).collect()} == {(0, True), (5, True), (6, False)}
    assert [tuple(r) for r in SS.late_rows(out).collect()] == [hits[2][1:]]
