"""Remaining operators: R6 ingest writer, S13 tab stream, R9 stream index, R10
windows, W4 resume seed, J6 semi join, X2 labeller via mapInPandas."""

import datetime as dt
import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from dwell.operators import keywords as K
from dwell.operators import labels as L
from dwell.operators import sessionize as S
from dwell.operators.classify import RuleSet
from dwell.streaming import keywords as SK
from dwell.streaming import sessions as SS

T0 = dt.datetime(2024, 1, 1)


def _run(spark, sdf, name, mode="append", fb=None):
    w = sdf.writeStream.option("checkpointLocation", SS.checkpoint_location(spark, name)).trigger(availableNow=True)
    if fb is not None:
        q = w.foreachBatch(fb).start()
    else:
        q = w.format("memory").queryName(name).outputMode(mode).start()
    q.awaitTermination(300)
    return None if fb is not None else spark.table(name)


def test_label_store_writer(spark):
    rs = RuleSet.build(spark)
    src = tempfile.mkdtemp(prefix="dwell-ev-")
    rows = [(1, 10.0, 12.5, "Visual Studio Code", "main.py", ""), (2, 10.0, None, "Slack", "x", ""),
            (3, 10.0, 9.0, "Slack", "x", ""), (4, 20.0, 30.0, "Chrome", "r", "https://www.reddit.com/r/x")]
    spark.createDataFrame(rows, "id long, start_ts double, end_ts double, app string, title string, url string") \
        .coalesce(1).write.parquet(src + "/b0")
    stream = spark.readStream.schema("id long, start_ts double, end_ts double, app string, title string, url string").parquet(src + "/b0")
    root = tempfile.mkdtemp(prefix="dwell-store-")
    _run(spark, stream, "store_ingest", fb=SS.label_store_writer(root, rs))
    assert sorted(r.id for r in spark.read.parquet(root + "/events").collect()) == [1, 4]
    labels = {r.event_id: (r.category_id, r.rule_id, r.meta_json) for r in spark.read.parquet(root + "/engine_classifications").collect()}
    assert labels == {1: ("Coding", "app:visual studio code", '{"productive":true}'),
                      4: ("Social/Forums", "domain:www.reddit.com", '{"productive":false}')}


def test_tab_snapshot_stream(spark):
    src = tempfile.mkdtemp(prefix="dwell-tabs-")
    msgs = [{"url": "https://a.example/x", "title": "A", "tabId": 1, "windowId": 1, "timestamp": "2024-01-01T00:00:00"},
            {"url": "about:blank", "title": "B", "tabId": 2, "windowId": 1, "timestamp": "2024-01-01T00:00:01"}]
    Path(src, "m.json").write_text("\n".join(json.dumps(m) for m in msgs))
    out = _run(spark, SS_tab(spark, src), "tabs").collect()
    assert [r.url for r in out] == ["https://a.example/x"] and out[0].received_at is not None


def SS_tab(spark, path):
    from dwell.sources.samples import tab_snapshot_stream

    return tab_snapshot_stream(spark, path)


def test_stream_keyword_index_equals_sequential(spark):
    rows = [("Cat", T0 + dt.timedelta(seconds=i), i, f"k{(i * 7) % 5}", True) for i in range(40)]
    schema = "category string, ts timestamp_ntz, seq long, matched_keyword string, is_new boolean"
    df = spark.createDataFrame(rows, schema)
    src = tempfile.mkdtemp(prefix="dwell-kwidx-")
    for b in range(4):
        df.where(F.col("seq").between(b * 10, b * 10 + 9)).coalesce(1).write.parquet(f"{src}/p{b}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    out = _run(spark, SK.stream_keyword_index(stream, cap=3), "kw_index", mode="update")
    last_batch = out.collect()[-3:]
    index = SK.CappedIndex([], 3)
    for r in rows:
        index.add(r[3])
    expect = index.entries()
    assert [(r.keyword, r["count"]) for r in sorted(last_batch, key=lambda r: r.position)] == [tuple(e) for e in expect]


def test_daily_totals_stream(spark):
    rows = [(T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=h, minutes=30), 1800.0, h % 12 == 0) for h in range(0, 48, 6)]
    df = spark.createDataFrame(rows, "start_time timestamp_ntz, end_time timestamp_ntz, duration_sec double, is_productive boolean")
    src = tempfile.mkdtemp(prefix="dwell-daily-")
    df.coalesce(1).write.parquet(src + "/p")
    stream = spark.readStream.schema(df.schema).parquet(src + "/p")
    out = _run(spark, SS.daily_totals_stream(stream, "1 hour"), "daily_totals", mode="complete")
    got = sorted((r.day.start.date(), r.is_productive, r.minutes) for r in out.collect())
    assert got == [(dt.date(2024, 1, 1), False, 60.0), (dt.date(2024, 1, 1), True, 60.0),
                   (dt.date(2024, 1, 2), False, 60.0), (dt.date(2024, 1, 2), True, 60.0)]


def test_resume_seed(spark):
    sess = spark.createDataFrame(
        [("d1", T0, T0 + dt.timedelta(seconds=100), "A", "t", None, "c", True),
         ("d1", T0 + dt.timedelta(seconds=100), T0 + dt.timedelta(seconds=200), "B", "t", None, "c", False),
         ("d2", T0, T0 + dt.timedelta(seconds=10), "C", "t", None, "c", True)],
        "device_id string, start_time timestamp_ntz, end_time timestamp_ntz, app string, title string, url string, "
        "category string, is_productive boolean",
    )
    now = (T0 + dt.timedelta(seconds=230)).isoformat(sep=" ")
    got = [(r.device_id, r.app, r.start_time) for r in S.resume_seed(sess, now, gap_seconds=60).collect()]
    assert got == [("d1", "B", T0 + dt.timedelta(seconds=200))]


def test_keep_referenced(spark):
    ev = spark.createDataFrame([(1,), (2,)], "id long")
    labels = spark.createDataFrame([(1, "a"), (3, "b")], "event_id long, category_id string")
    assert [r.event_id for r in L.keep_referenced(labels, ev).collect()] == [1]


def test_labeller_via_map_in_pandas(spark):
    backlog = spark.createDataFrame([("untitled", "Chrome", "Untitled", ""), ("cat videos", "Chrome", "cat videos", "")],
                                    "keyword string, app string, title string, url string")

    def labeller(it):
        for pdf in it:
            out = pdf[["keyword"]].copy()
            out["category"] = ["Entertainment" if "video" in k else "Unknown" for k in pdf["keyword"]]
            out["productive"] = False
            out["confidence"] = 0.5
            out["rationale"] = "test"
            yield out

    got = {r.keyword: r.category for r in K.run_labeller(backlog, labeller).collect()}
    assert got == {"untitled": "Unknown", "cat videos": "Entertainment"}


def test_raw_poll_sink(spark):
    src = tempfile.mkdtemp(prefix="dwell-polls-")
    spark.createDataFrame([(T0, "A", "t", None), (T0 + dt.timedelta(seconds=1), None, None, None)],
                          "ts timestamp_ntz, app string, title string, url string").coalesce(1).write.parquet(src + "/p")
    stream = spark.readStream.schema("ts timestamp_ntz, app string, title string, url string").parquet(src + "/p")
    out = tempfile.mkdtemp(prefix="dwell-polls-out-") + "/bronze"
    q = SS.write_raw_polls(stream, out, SS.checkpoint_location(spark, "polls"))
    q.awaitTermination(300)
    got = spark.read.json(out).collect()
    assert len(got) == 2  # the empty poll is kept


def test_compact_label_store(spark):
    root = tempfile.mkdtemp(prefix="dwell-compact-")
    spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 1.0)], "id long, start_ts double, end_ts double").write.parquet(root + "/events")
    t = T0
    spark.createDataFrame(
        [(1, "rules-v1", "a", 1.0, None, None, t, 1), (1, "rules-v1", "b", 1.0, None, None, t + dt.timedelta(seconds=5), 2),
         (9, "rules-v1", "orphan", 1.0, None, None, t, 3)],
        "event_id long, engine_version string, category_id string, confidence double, rule_id string, meta_json string, "
        "created_at timestamp_ntz, seq long",
    ).write.parquet(root + "/engine_classifications")
    spark.createDataFrame([(2, "set", "focus", None, 1), (2, "clear", None, None, 2), (1, "set", "deep", "n", 3)],
                          "event_id long, op string, category_id string, note string, seq long").write.parquet(root + "/user_overrides")
    paths = L.compact_label_store(spark, root, "v1")
    cl = [(r.event_id, r.category_id) for r in spark.read.parquet(paths["engine_classifications"]).collect()]
    ov = [(r.event_id, r.category_id) for r in spark.read.parquet(paths["user_overrides"]).collect()]
    assert cl == [(1, "b")] and ov == [(1, "deep")]
