"""The bucketed (skew-safe) scans equal plain per-key scans: tiny buckets force
many bucket borders, one huge bucket is the plain window."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dwell.operators import ordered as O
from dwell.operators import sessionize as S

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for dev in ("a", "b", "c"):
        t = 0
        for i in range(400):
            t += rnd.choice([1, 5, 30, 200, 900])
            v = rnd.choice(["x", "y", None]) if dev != "c" else "x"
            data.append((dev, T0 + dt.timedelta(seconds=t), i, v, rnd.random() < 0.3))
    return spark.createDataFrame(data, "k string, ts timestamp_ntz, seq long, v string, flag boolean")


def _collect(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("bucket", [60, 600])
def test_prev_next(rows, bucket):
    small = O.with_prev(rows, ["k"], ["ts", "seq"], ["v", "ts"], bucket)
    big = O.with_prev(rows, ["k"], ["ts", "seq"], ["v", "ts"], 10**8)
    cols = ["k", "seq", "prev_v", "prev_ts", "has_prev"]
    assert _collect(small, cols) == _collect(big, cols)
    small = O.with_next(rows, ["k"], ["ts", "seq"], ["v"], bucket)
    big = O.with_next(rows, ["k"], ["ts", "seq"], ["v"], 10**8)
    assert _collect(small, ["k", "seq", "next_v"]) == _collect(big, ["k", "seq", "next_v"])


@pytest.mark.parametrize("bucket", [60, 600])
def test_last_non_null_and_running_count(rows, bucket):
    cols = ["k", "seq", "o"]
    a = O.with_last_non_null(rows, ["k"], ["ts", "seq"], "v", "o", bucket)
    b = O.with_last_non_null(rows, ["k"], ["ts", "seq"], "v", "o", 10**8)
    assert _collect(a, cols) == _collect(b, cols)
    a = O.with_running_count(rows, ["k"], ["ts", "seq"], "flag", "o", bucket)
    b = O.with_running_count(rows, ["k"], ["ts", "seq"], "flag", "o", 10**8)
    assert _collect(a, cols) == _collect(b, cols)


@pytest.mark.parametrize("bucket", [60, 600])
def test_change_points_and_islands(rows, bucket):
    a = O.change_points(rows.withColumn("key", F.struct("v")), ["k"], ["ts", "seq"], "key", bucket)
    b = O.change_points(rows.withColumn("key", F.struct("v")), ["k"], ["ts", "seq"], "key", 10**8)
    assert _collect(a, ["k", "seq", "_next_start"]) == _collect(b, ["k", "seq", "_next_start"])

    def same(cur, prev):
        return cur["v"].eqNullSafe(prev["v"]) & (F.unix_seconds(cur["ts"].cast("timestamp")) - F.unix_seconds(prev["ts"].cast("timestamp")) <= 100)

    a = O.islands(rows, ["k"], ["ts", "seq"], ["v", "ts"], same, "isl", bucket)
    b = O.islands(rows, ["k"], ["ts", "seq"], ["v", "ts"], same, "isl", 10**8)
    assert _collect(a, ["k", "seq", "isl"]) == _collect(b, ["k", "seq", "isl"])


def test_sessions_bucket_invariant(rows):
    s = rows.select(F.col("k").alias("device_id"), "ts", "seq", F.lit("app").alias("app"), F.col("v").alias("title"),
                    F.lit(None).cast("string").alias("url"))
    a = S.sessionize(s, bucket_seconds=60)
    b = S.sessionize(s, bucket_seconds=10**8)
    cols = ["device_id", "start_time", "end_time", "title"]
    assert _collect(a, cols) == _collect(b, cols)


def test_hot_bucket_split_is_exact(spark, rows):
    """With a tiny per-bucket row cap every bucket is split into time slices;
    results stay equal to the plain scan."""
    spark.conf.set("dwell.bucket.maxRows", "7")
    try:
        a = O.with_prev(rows, ["k"], ["ts", "seq"], ["v"], 3600)
        c = O.change_points(rows.withColumn("key", F.struct("v")), ["k"], ["ts", "seq"], "key", 3600)
        n_buckets = a.select("k", O.BUCKET).distinct().count()
        a_rows = _collect(a, ["k", "seq", "prev_v", "has_prev"])
        c_rows = _collect(c, ["k", "seq", "_next_start"])
    finally:
        spark.conf.unset("dwell.bucket.maxRows")
    b = O.with_prev(rows, ["k"], ["ts", "seq"], ["v"], 10**8)
    d = O.change_points(rows.withColumn("key", F.struct("v")), ["k"], ["ts", "seq"], "key", 10**8)
    assert a_rows == _collect(b, ["k", "seq", "prev_v", "has_prev"])
    assert c_rows == _collect(d, ["k", "seq", "_next_start"])
    plain = O.add_bucket(rows, "ts", 3600).select("k", O.BUCKET).distinct().count()
    assert n_buckets > plain  # hot hours really were split


def test_rows_without_a_timestamp_pass_through(spark, rows):
    """They keep their other columns, get nulls from the scan, and bear on no other row."""
    lost = spark.createDataFrame([("a", None, 10_000 + i, "z", True) for i in range(50)] + [(None, None, 20_000, "z", True)], rows.schema)
    nokey = spark.createDataFrame([(None, T0, 30_000, "n", True), (None, T0 + dt.timedelta(hours=5), 30_001, "m", False), ("(none)", T0, 30_002, "r", False)], rows.schema)
    both = rows.unionByName(lost).unionByName(nokey)
    plain = rows.unionByName(nokey)
    for scan, cols in (
        (lambda d, b: O.with_prev(d, ["k"], ["ts", "seq"], ["v"], b), ["prev_v", "has_prev"]),
        (lambda d, b: O.with_next(d, ["k"], ["ts", "seq"], ["v"], b), ["next_v"]),
        (lambda d, b: O.with_last_non_null(d, ["k"], ["ts", "seq"], "v", "o", b), ["o"]),
        (lambda d, b: O.with_running_count(d, ["k"], ["ts", "seq"], "flag", "o", b), ["o"]),
    ):
        got = scan(both, 600)
        assert _collect(got.where("ts IS NOT NULL"), ["k", "seq", *cols]) == _collect(scan(plain, 10**8), ["k", "seq", *cols])
        side = got.where("ts IS NULL").collect()
        assert len(side) == 51 and {tuple(r[c] for c in cols) for r in side} == {(None,) if len(cols) == 1 else (None, False)}
    points = O.change_points(both, ["k"], ["ts", "seq"], F.struct("v"), 600)
    assert _collect(points, ["k", "seq", "_next_start"]) == _collect(O.change_points(plain, ["k"], ["ts", "seq"], F.struct("v"), 10**8), ["k", "seq", "_next_start"])


def test_one_scan_and_one_shuffle(spark, tmp_path, rows):
    """Boundary rows come from the shuffle of the rows: the input is read once in the final plan."""
    rows.repartition(2).write.parquet(f"{tmp_path}/rows")
    spark.conf.set("dwell.bucket.maxRows", "0")
    try:
        src = spark.read.parquet(f"{tmp_path}/rows")
        for df in (O.with_prev(src, ["k"], ["ts", "seq"], ["v"], 600), O.change_points(src, ["k"], ["ts", "seq"], F.struct("v"), 600)):
            df = df.agg(F.bit_xor(F.xxhash64(*df.columns)))
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1
    finally:
        spark.conf.unset("dwell.bucket.maxRows")
