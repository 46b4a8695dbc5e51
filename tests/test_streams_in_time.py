"""Streams with event-time timers against their batch forms, in several cuts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwell.operators import labels as L
from dwell.operators import sessionize as S
from dwell.operators.asof import apply_tab_override
from dwell.plans.catalog import samples
from dwell.sources import samples as SM
from dwell.streaming import asof as A
from dwell.streaming import feed as FD
from dwell.streaming import replay as RP
from dwell.streaming import sessions as SS

SF = "/root/testdata/sf0.001"
END = "timestamp_ntz'2200-01-01'"
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("cuts,snap_cuts", [(1, 3), (4, 2)])
def test_stream_override_equals_batch(spark, cuts, snap_cuts):
    sm, sn = samples(spark, SF), SM.tab_snapshots(SM.load(spark, SF, "pages"))
    cols = ["device_id", "ts", "seq", "app", "title", "url", "idle_seconds", "overridden"]
    want = sorted(map(tuple, apply_tab_override(sm, sn).select(*cols).collect()))
    assert sum(w[-1] for w in want) > 100
    a = RP.as_stream(RP.tick(sm, device_id="'tick'", ts=END, seq="0"), "ts", cuts)
    b = RP.as_stream(RP.tick(sn, device_id="'tick'", ts=END, seq="0"), "ts", snap_cuts)
    # the spans of the two streams don't fall together: the greater delay keeps every row on time
    out = RP.run_to_table(A.stream_tab_override(a, b, delay="400 days"), f"jt{cuts}")
    assert sorted(map(tuple, out.where("NOT is_late").select(*cols).collect())) == want
    assert out.where("is_late").count() == 0


def test_stream_override_late_rows(spark):
    schema = "device_id string, ts timestamp_ntz, seq long, app string, title string, url string"
    rows = [
        ("d", at(100), 1, "Firefox", "t1", "u1"), ("d", at(4000), 2, "Firefox", "t2", "u2"), ("d", at(50), 3, "Firefox", "late", "late"),
        ("d", None, 4, "Firefox", "no time", None), ("d", at(9000), 5, "Chrome", "t5", "u5"),
    ]
    path = []
    # files in arrival order; the second brings the watermark to 3400 s, the third is behind it
    for i, part in enumerate([rows[:1], rows[1:2], [], rows[2:4], rows[4:], [("tick", at(10**7), 0, None, None, None)]]):
        df = spark.createDataFrame(part, schema)
        path = path or [SS.checkpoint_location(spark, "late-in")]
        df.coalesce(1).write.mode("overwrite").parquet(f"{path[0]}/{i}")
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path[0])
    snaps = spark.createDataFrame([("d", at(90), 1, "S", ""), ("d", at(10**7), 2, "x", "y")], "device_id string, ts timestamp_ntz, seq long, title string, url string")
    out = {r.seq: r for r in RP.run_to_table(A.stream_tab_override(src, RP.as_stream(snaps, "ts", 1)), "late").where("device_id = 'd'").collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    assert [(out[i].title, out[i].url, out[i].is_late) for i in (1, 2, 4, 5)] == [("S", "u1", False), ("S", "u2", False), ("no time", None, True), ("t5", "u5", False)]
    assert out[3].is_late and out[3].title == "late" and not out[3].overridden


@pytest.mark.parametrize("cuts", [(1, 1, 1), (5, 2, 3)])
def test_stream_change_feed_equals_batch(spark, cuts):
    ev = SM.load(spark, SF, "events")
    events, labels, ops = L.valid_events(SM.store_events(ev)), SM.classification_log(ev), SM.override_log(ev)
    want = sorted(map(tuple, L.change_feed(events, labels, ops).select("kind", "event_id", "seq").collect()))
    streams = [
        RP.as_stream(RP.tick(events, id="-7", created_at=END), "created_at", cuts[0]),
        RP.as_stream(RP.tick(labels, event_id="-7", seq="-7", created_at=END), "created_at", cuts[1]),
        RP.as_stream(ops, "seq", cuts[2]),
    ]
    got = RP.run_to_table(FD.stream_change_feed(*streams, delay="400 days"), "feed").where("event_id <> -7").toPandas()
    assert sorted(map(tuple, got[["kind", "event_id", "seq"]].to_numpy().tolist())) == want
    got = got.sort_values(["event_id", "position"])
    assert (got.groupby("event_id")["kind_ord"].diff().fillna(0) >= 0).all()
    assert (got.groupby("event_id").cumcount() + 1 == got["position"]).all()
    # what was never stored is announced as well, by the timer
    known = {r.id for r in events.select("id").collect()}
    assert {i for i, s in zip(got.event_id, got.settled, strict=True) if not s} == {i for _, i, _ in want if i not in known}


def brute_silent(rows, silence):
    """rows: (ts seconds, key) of one device in order."""
    out, start, last = [], None, None
    for t, k in rows:
        if last is not None and t - last[0] > silence:
            out.append((start, last[0] + silence, last[1]))
            start = None
        elif last is not None and last[1] != k:
            out.append((start, t, last[1]))
            start = None
        start = t if start is None else start
        last = (t, k)
    return out + ([(start, last[0] + silence, last[1])] if last else [])


@pytest.mark.parametrize("cuts", [1, 3])
def test_silent_devices_close_without_markers(spark, cuts):
    import random

    rng = random.Random(cuts)
    rows, want, seq = [], [], 0
    for d in "abc":
        t, own = 0, []
        for _ in range(60):
            t += rng.choice([10, 20, 300, 301, 900])
            own.append((t, rng.choice("xy")))
            rows.append((d, at(t), seq, own[-1][1], "t", None))
            seq += 1
        want += [(d, at(s), at(e), k) for s, e, k in brute_silent(own, 300)]
    df = spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, seq long, app string, title string, url string")
    batch = S.sessionize_silent(df, 300, bucket_seconds=1000).select("device_id", "start_time", "end_time", "app").collect()
    assert sorted(map(tuple, batch)) == sorted(want)
    src = _spans(spark, df, cuts)
    out = RP.run_to_table(SS.stream_sessions(src, silence_seconds=300), f"silent{cuts}")
    got = SS.on_time(out).where("device_id <> 'tick'").select("device_id", "start_time", "end_time", "app").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def _spans(spark, df, cuts):
    path = SS.checkpoint_location(spark, f"silent-in-{cuts}")
    n = df.count()
    order = [r.seq for r in df.orderBy("ts").select("seq").collect()]
    for i in range(cuts):
        part = order[i * n // cuts : (i + 1) * n // cuts]
        df.where(F.col("seq").isin(part)).coalesce(1).write.mode("overwrite").parquet(f"{path}/{i}")
    RP.tick(df.limit(0), device_id="'tick'", ts=END, seq="0", app="'x'").coalesce(1).write.mode("overwrite").parquet(f"{path}/{cuts}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_silent_hole_of_segments_and_restart(spark):
    """An idle hole that falls silent ends, and a restarted stream goes on with its timers."""
    schema = "device_id string, ts timestamp_ntz, seq long, app string, title string, url string, is_idle boolean"
    steps = [
        [("d", at(0), 1, "A", "t", "u", False), ("d", at(50), 2, "A", "t", "u", True)],
        [("e", at(5000), 3, "B", "t", "u", False)],
        [("d", at(6000), 4, "A", "t", "u", False)],
        [("e", at(20000), 5, "B", "t", "u", False)],
        [("tick", at(10**8), 6, "x", "t", "u", False)],
    ]
    path, ck, dest = (SS.checkpoint_location(spark, f"restart-{x}") for x in ("in", "ck", "out"))
    for i, part in enumerate(steps):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{i}")
        src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
        q = SS.stream_sessions(src, variant="segments", silence_seconds=300).writeStream.format("parquet").option("path", dest)
        q = q.option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(dest).where("NOT is_late AND device_id <> 'tick'").select("device_id", "start_time", "end_time").collect()
    assert sorted(map(tuple, got)) == [("d", at(0), at(50)), ("d", at(6000), at(6300)), ("e", at(5000), at(5300)), ("e", at(20000), at(20300))]
