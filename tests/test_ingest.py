"""Storage layout, incremental ingest and small column functions."""

import datetime as dt
import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from dwell.functions.text import canonical_json, keyword, keyword_candidates, parse_delimited_sample, parse_suggestion
from dwell.operators import ingest as I
from dwell.plans import reports as RP
from dwell.plans.catalog import labelled_sessions


def test_partitioned_sink_and_week_scan_prunes(spark):
    root = tempfile.mkdtemp(prefix="dwell-sessions-") + "/t"
    sess = labelled_sessions(spark, "/root/testdata/sf0.001")
    I.write_sessions(sess, root)
    I.write_sessions(sess.limit(0), root)  # appending nothing keeps the table readable
    back = I.read_sessions(spark, root)
    assert back.count() == sess.count()
    wk = RP.week_filter(I.week_scan(spark, root, "2024-01-10"), "2024-01-10")
    plan = wk._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "month" in plan
    direct = RP.week_filter(sess, "2024-01-10")
    assert wk.count() == direct.count() > 0


def test_missing_table_is_typed_empty(spark):
    df = I.read_sessions(spark, "/nonexistent/dwell/table")
    assert df.count() == 0 and "start_time" in df.columns


def test_corrupt_file_is_skipped(spark):
    root = tempfile.mkdtemp(prefix="dwell-corrupt-")
    spark.createDataFrame([(1,)], "a int").write.parquet(root + "/ok")
    Path(root + "/ok/part-bad.parquet").write_bytes(b"not parquet")
    assert spark.read.option("ignoreCorruptFiles", "true").parquet(root + "/ok").count() == 1


def test_month_scan_raises_when_absent(spark):
    root = tempfile.mkdtemp(prefix="dwell-month-") + "/t"
    I.write_sessions(labelled_sessions(spark, "/root/testdata/sf0.001"), root)
    assert I.month_scan(spark, root, 2024, 1).count() > 0
    try:
        I.month_scan(spark, root, 2023, 5)
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass


def test_schema_alignment(spark):
    old = spark.createDataFrame([(1, "a")], "x int, app string")
    new = spark.createDataFrame([("b", 2, "u")], "app string, x int, url string")
    out = I.align_schemas(old, new)
    assert out.columns == ["x", "app", "url"]
    assert sorted(map(tuple, out.collect())) == [(1, "a", None), (2, "b", "u")]


def test_manifest_rules(spark):
    remote = spark.createDataFrame(
        [(1, "f1", "m1"), (2, "f2", "m2"), (3, "f3", None), (4, "f4", "m4"), (5, "f5", "m5")], "file_id long, name string, md5 string"
    )
    state = spark.createDataFrame([(1, "m1", "f1"), (3, None, "f3"), (4, "old", "f4")], "file_id long, md5 string, name string")
    local = spark.createDataFrame([("f1", "x"), ("f3", None), ("f4", "m4"), ("f5", "zz")], "name string, md5 string")
    got = {r.file_id: (r.load, r.skip_reason) for r in I.manifest_diff(remote, state, local).collect()}
    assert got == {1: (False, "state"), 2: (True, None), 3: (False, "state"), 4: (False, "digest"), 5: (True, None)}
    nxt = I.next_state(state, remote.where("file_id IN (2, 5)"))
    assert sorted(r.file_id for r in nxt.collect()) == [1, 2, 3, 4, 5]


def test_file_digests(spark):
    import hashlib

    root = tempfile.mkdtemp(prefix="dwell-digest-")
    Path(root, "a.parquet").write_bytes(b"hello")
    got = {r.name: r.md5 for r in I.file_digests(spark, root).collect()}
    assert got == {"a.parquet": hashlib.md5(b"hello").hexdigest()}


def test_delimited_and_json_functions(spark):
    df = spark.createDataFrame([(" Code || main.py || ",), ("Safari||t||https://x",), ("OnlyApp",)], "line string")
    legacy = [tuple(r.s) for r in df.select(parse_delimited_sample("line").alias("s")).collect()]
    assert legacy == [("Code", "main.py", None), ("Safari", "t", "https://x"), ("OnlyApp", "", None)]
    newer = [tuple(r.s) for r in df.select(parse_delimited_sample("line", legacy=False).alias("s")).collect()]
    assert newer[1] == ("Safari", "t")
    m = spark.createDataFrame([({"b": "1", "a": "2"},), (None,)], "m map<string,string>")
    assert [r.j for r in m.select(canonical_json("m").alias("j")).collect()] == ['{"a":"2","b":"1"}', None]
    msgs = spark.createDataFrame([('{"productive": true}',), ('{"category":"Research","productive":false}',)], "m string")
    parsed = [tuple(r.s)[:2] for r in msgs.select(parse_suggestion("m").alias("s")).collect()]
    assert parsed == [("Unknown", True), ("Research", False)]


def test_keyword_functions(spark):
    df = spark.createDataFrame([("Watching youtube video",), ("main.py",), ("a b",), ("Alpha beta alpha beta",)], "t string")
    got = [(r.c, r.k) for r in df.select(keyword_candidates("t").alias("c"), keyword("t").alias("k")).collect()]
    assert got == [(["watching youtube", "youtube video"], "watching youtube"), (["main"], "main"), ([], None),
                   (["alpha beta"], "alpha beta")]


def test_idempotent_foreach_batch(spark):
    from dwell.streaming.sessions import idempotent_batch_writer

    root = tempfile.mkdtemp(prefix="dwell-fb-") + "/out"
    w = idempotent_batch_writer(root)
    df = spark.createDataFrame([(1,), (2,)], "a int")
    w(df, 0)
    w(df, 0)  # a retried batch replaces its own output
    w(df, 1)
    assert spark.read.parquet(root).count() == 4
