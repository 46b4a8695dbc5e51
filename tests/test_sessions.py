"""Session vectors (reference buffer tests + derived cases) and invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwell.operators import sessionize as S
from dwell.operators.split import split_midnight

T0 = dt.datetime(2024, 1, 15, 9, 0, 0)
SCHEMA = "device_id string, ts timestamp_ntz, seq long, app string, title string, url string"


def frame(spark, rows, device="d1"):
    return spark.createDataFrame(
        [(device, T0 + dt.timedelta(seconds=s), i, a, t, u) for i, (s, a, t, u) in enumerate(rows)], SCHEMA
    )


def secs(rows):
    return [(r.app, (r.start_time - T0).total_seconds(), (r.end_time - T0).total_seconds()) for r in rows]
from dwell.operators import ordered as O


def test_rollover(spark):
    df = frame(spark, [(0, "App1", "Title1", None), (30, "App1", "Title1", None), (60, "App2", "Title2", "https://example.com")])
    out = S.sessionize(df).collect()
    assert secs(out) == [("App1", 0, 60)]
    assert out[0].url is None and out[0].duration_sec == 60.0


def test_flush_and_all_same(spark):
    assert secs(S.sessionize(frame(spark, [(0, "App1", "t", None), (300, "App2", "t", None)])).collect()) == [("App1", 0, 300)]
    assert S.sessionize(frame(spark, [(0, "App1", "t", None), (300, "App1", "t", None)])).count() == 0


def test_forced_close(spark):
    df = frame(spark, [(0, "App1", "t", None), (300, "App1", "t", None)])
    out = S.sessionize(df, close_ts=(T0 + dt.timedelta(seconds=600)).isoformat(sep=" ")).collect()
    assert secs(out) == [("App1", 0, 600)] and out[0].duration_sec == 600.0


def test_null_vs_empty_url_and_stitch(spark):
    df = frame(spark, [(0, "A", "T", None), (10, "A", "T", ""), (20, "B", "x", None), (30, "C", "x", None)])
    sess = S.sessionize(df)
    assert secs(sess.collect()) == [("A", 0, 10), ("A", 10, 20), ("B", 20, 30)]
    stitched = S.stitch(sess, gap_seconds=60).collect()
    assert secs(stitched) == [("A", 0, 20), ("B", 20, 30)]


def test_null_app_ends_but_is_not_emitted(spark):
    df = frame(spark, [(0, "A", "T", None), (10, None, None, None), (20, "B", "x", None), (30, "C", "x", None)])
    assert secs(S.sessionize(df).collect()) == [("A", 0, 10), ("B", 20, 30)]


def test_stitch_gaps(spark):
    rows = []
    for gap in (0, 60, 61, -1):
        rows.append(gap)
    base = []
    t = 0
    for g in rows:
        base.append((t, t + 10, g))
        t = t + 10 + g + 1000
    # build explicit sessions: pairs (s, e) then (e + gap, e + gap + 10)
    data = []
    for k, gap in enumerate((0, 60, 61, -1)):
        s = k * 10_000
        data.append((T0 + dt.timedelta(seconds=s), T0 + dt.timedelta(seconds=s + 10), "A", "T", None, "d1"))
        data.append((T0 + dt.timedelta(seconds=s + 10 + gap), T0 + dt.timedelta(seconds=s + 20 + gap), "A", "T", None, "d1"))
    df = spark.createDataFrame(data, "start_time timestamp_ntz, end_time timestamp_ntz, app string, title string, url string, device_id string")
    df = df.withColumns({"duration_sec": F.lit(10.0), "category": F.lit("c"), "is_productive": F.lit(True)})
    out = S.stitch(df, gap_seconds=60).orderBy("start_time").collect()
    assert len(out) == 2 + 2 + 2  # merge, merge, keep, keep
    assert (out[0].end_time - out[0].start_time).total_seconds() == 20
    assert (out[1].end_time - out[1].start_time).total_seconds() == 80


def test_segments_title_flutter_and_idle(spark):
    df = frame(spark, [(0, "A", "t1", "u"), (5, "A", "t2", "u"), (10, "A", "t2", ""), (20, "B", "x", ""), (30, "B", "x", "")])
    df = df.withColumn("idle_seconds", F.when(F.col("seq") == 3, F.lit(900.0)).otherwise(F.lit(0.0)))
    out = S.segments(df, idle=S.is_idle("idle_seconds", 600)).orderBy("start_ts").collect()
    base = (T0 - dt.datetime(1970, 1, 1)).total_seconds()
    assert [(r.app, r.title, r.start_ts - base, r.end_ts - base) for r in out] == [("A", "t1", 0, 10), ("A", "t2", 10, 20)]


def test_cross_bucket_equals_single_bucket(spark):
    """Sessions from 60 s buckets equal those from one huge bucket (the skew split is exact)."""
    rows = [(s, "A" if (s // 45) % 3 else "B", "t", None) for s in range(0, 3600, 7)]
    df = frame(spark, rows)
    small = sorted(secs(S.sessionize(df, bucket_seconds=60).collect()))
    big = sorted(secs(S.sessionize(df, bucket_seconds=10**7).collect()))
    assert small == big and len(small) > 10


def test_midnight_split_modes(spark):
    data = [
        (dt.datetime(2024, 1, 1, 23, 50), dt.datetime(2024, 1, 2, 0, 10)),
        (dt.datetime(2024, 1, 1, 23, 0), dt.datetime(2024, 1, 3, 1, 0)),
        (dt.datetime(2024, 1, 1, 22, 0), dt.datetime(2024, 1, 2, 0, 0)),
    ]
    df = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(data)], "i int, start_time timestamp_ntz, end_time timestamp_ntz")
    ref = split_midnight(df, "reference").orderBy("i", "part").collect()
    assert [(r.i, r.duration_sec) for r in ref] == [(0, 599.0), (0, 600.0), (1, 3599.0), (1, 3600.0), (2, 7199.0), (2, 0.0)]
    exact = split_midnight(df, "exact").orderBy("i", "part").collect()
    assert [(r.i, r.duration_sec) for r in exact] == [(0, 600.0), (0, 600.0), (1, 3600.0), (1, 86400.0), (1, 3600.0), (2, 7200.0)]


def test_exact_split_conserves_duration(spark):
    from dwell.plans.catalog import labelled_sessions

    sess = labelled_sessions(spark, "/root/testdata/sf0.001", "user")
    total = sess.agg(F.sum(S.micros_between("start_time", "end_time"))).first()[0]
    parts = split_midnight(sess, "exact").agg(F.sum(S.micros_between("start_time", "end_time"))).first()[0]
    assert total == parts


def test_sessions_contiguous_per_device(spark):
    from dwell.plans.catalog import labelled_sessions
    from pyspark.sql import Window

    sess = labelled_sessions(spark, "/root/testdata/sf0.001")
    w = Window.partitionBy("device_id").orderBy("start_time")
    bad = sess.withColumn("nx", F.lead("start_time").over(w)).where("nx IS NOT NULL AND nx <> end_time").count()
    assert bad == 0


def test_idle_threshold_and_collapse(spark):
    settings = spark.createDataFrame(
        [("a", "displaysleep", "10"), ("a", "sleep", "0"), ("a", "screensaver", "abc"), ("b", "screensaver", "120"), ("c", "sleep", "x")],
        "device_id string, key string, value string",
    )
    got = {r.device_id: r.idle_threshold for r in S.idle_threshold(settings, 300).collect()}
    assert got == {"a": 300, "b": 120, "c": 300}
    df = frame(spark, [(0, "A", "t", None), (10, "A", "t", None), (20, "A", "t", None), (30, "B", "t", None)])
    df = df.withColumn("idle_seconds", F.when(F.col("seq").isin(1, 2), F.lit(700.0)).otherwise(F.lit(0.0)))
    out = S.collapse_idle(df, S.is_idle("idle_seconds", 600)).orderBy("ts").collect()
    assert [(r.app, r.title, r.url) for r in out] == [("A", "t", None), ("Idle", "Idle", None), ("B", "t", None)]


def test_stitch_keeps_span_and_never_adds_time(spark):
    from dwell.plans.catalog import labelled_sessions

    sess = labelled_sessions(spark, "/root/testdata/sf0.001")
    st = S.stitch(sess, gap_seconds=900)

    def span(df):
        return {r.device_id: (r.s, r.e) for r in df.groupBy("device_id").agg(F.min("start_time").alias("s"), F.max("end_time").alias("e")).collect()}

    assert span(st) == span(sess)
    assert st.count() <= sess.count()
    covered = st.agg(F.sum(S.micros_between("start_time", "end_time"))).first()[0]
    original_span = sum((e - s).total_seconds() for s, e in span(sess).values()) * 1e6
    assert covered <= original_span


T0_ = dt.datetime(2024, 1, 1)


def test_null_device_is_a_device_of_its_own(spark):
    rows = [(None, T0_, 0, "A"), (None, T0_ + dt.timedelta(seconds=5), 1, "B"), ("d", T0_, 2, "A")]
    df = spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, seq long, app string")
    got = sorted((r.device_id, r.app, r.prev_app) for r in O.with_prev(df, ["device_id"], ["ts", "seq"], ["app"]).collect())
    assert got == [(O.NO_KEY, "A", None), (O.NO_KEY, "B", "A"), ("d", "A", None)]


def test_idle_poll_without_app_closes_segment(spark):
    at = lambda s: T0_ + dt.timedelta(seconds=s)
    rows = [("d", at(0), 0, "A", "t", None, 0.0), ("d", at(600), 1, None, None, None, 900.0), ("d", at(3600), 2, "A", "t", None, 0.0), ("d", at(3610), 3, "B", "t", None, 0.0)]
    df = spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, seq long, app string, title string, url string, idle_seconds double")
    got = S.segments(df, idle=S.is_idle("idle_seconds", 600)).collect()
    assert sorted(r.end_ts - r.start_ts for r in got) == [10.0, 600.0]
