"""The committed label store and the capture pipeline on top of it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dwell.operators import labels as L
from dwell.operators import sessionize as S
from dwell.operators.classify import RuleSet
from dwell.plans.catalog import samples
from dwell.session import scratch_path
from dwell.sources import samples as SM
from dwell.streaming import capture as C
from dwell.streaming import replay as RY
from dwell.streaming.store import RulesEngine, Store

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
ROW = "device_id string, ts timestamp_ntz, seq long, app string, title string, url string, is_idle boolean"
EVENT = ["device_id", "start_ts", "end_ts", "app", "title", "url"]


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("variant,cuts", [("legacy", 4), ("segments", 3)])
def test_batches_equal_one_scan_with_a_hot_device(spark, variant, cuts):
    """One device sends half of all rows; buckets and slices are small. Any cut gives the sessions of the whole."""
    rng = random.Random(cuts)
    rows = []
    for i in range(900):
        dev = "hot" if i % 2 else rng.choice("abc")
        rows.append((dev, at(i * 7), i, rng.choice(["A", "B", None, ""]), rng.choice(["t", "u", "frontProcess Error"]), rng.choice([None, "", "x"]), rng.random() < 0.2))
    df = spark.createDataFrame(rows, ROW)
    held = C.prepared(df, variant, sanitize=False)
    if variant == "legacy":
        want = S.sessionize(held).select("device_id", "start_time", "end_time", "app", "title", "url")
    else:
        seg = S.segments(df, idle=F.col("is_idle"))
        want = seg.select(*EVENT)
    want = sorted(map(repr, map(tuple, want.collect())))
    spark.conf.set("dwell.bucket.maxRows", "40")
    try:
        carry, got = spark.createDataFrame([], C.CARRY), []
        for i in range(cuts):
            part = held.where((F.col("seq") >= i * 900 // cuts) & (F.col("seq") < (i + 1) * 900 // cuts))
            ended, carry, late = C.advance(part, carry, variant, bucket_seconds=600)
            assert late.count() == 0
            if variant == "legacy":
                got += ended.where("app IS NOT NULL").select("device_id", "start_time", "end_time", "app", "title", "url").collect()
            else:
                got += C.as_events(ended, variant, "s").select(*EVENT).collect()
            carry = spark.createDataFrame(carry.collect(), carry.schema)
    finally:
        spark.conf.unset("dwell.bucket.maxRows")
    assert sorted(map(repr, map(tuple, got))) == want and len(want) > 100


def test_late_rows_of_a_batch(spark):
    first = spark.createDataFrame([("d", at(10), 1, "A", "t", "", False), ("d", at(20), 2, "B", "t", "", False)], ROW)
    carry = C.advance(first, spark.createDataFrame([], C.CARRY), "segments")[1]
    second = spark.createDataFrame(
        [("d", at(20), 2, "B", "t", "", False), ("d", at(15), 3, "C", "t", "", False), ("d", None, 4, "C", "t", "", False), ("d", at(20), 5, "C", "t", "", False), ("e", at(1), 6, "C", "t", "", False)], ROW
    )
    ended, after, late = C.advance(second, carry, "segments")
    assert sorted(r.seq for r in late.collect()) == [2, 3, 4]
    assert [(r.app, r.start_time, r.end_time) for r in ended.collect()] == [("B", at(20), at(20))]
    assert {(r.device_id, r.app, r.last_seq, r.open) for r in after.collect()} == {("d", "C", 5, True), ("e", "C", 6, True)}


class Failing:
    version = "rules-v1"

    def classify(self, events):
        return events.select(F.col("id").alias("event_id"), F.raise_error(F.lit("no label today")).cast("string").alias("category_id"),
                             F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("rule_id"), F.lit("{}").alias("meta_json"))


def _parts(df, n):
    return [df.where((F.col("seq") >= i * 1000 // n) & (F.col("seq") < (i + 1) * 1000 // n)) for i in range(n)]


def test_commits_retries_streams_and_fresh_checkpoints(spark):
    sm = samples(spark, SF).withColumn("is_idle", S.is_idle("idle_seconds", 600)).drop("idle_seconds")
    snaps = SM.tab_snapshots(SM.load(spark, SF, "pages")).limit(0)
    engine = RulesEngine(RuleSet.build(spark))
    cols = [*EVENT, "category_id", "rule_id"]
    want = sorted(map(tuple, C.capture(sm, snaps, engine).select(*cols).collect()))
    order = sm.withColumn("seq", F.row_number().over(__import__("pyspark").sql.Window.orderBy("ts", "seq")).cast("long") - 1)
    store = Store(spark, scratch_path(spark, "store-test"))

    def stored(stream):
        ev = store.events().where(F.col("stream_id") == stream)
        lb = store.labels("rules-v1").withColumnRenamed("event_id", "id")
        return sorted(map(tuple, ev.join(lb, "id", "left").select(*cols).collect()))

    write = C.capture_writer(store, "desk", engine)
    for i, part in enumerate(_parts(order, 3)):
        write(part, i)
        write(part, i)  # a retry of the same batch
        if i == 1:
            store.compact()
    assert stored("desk") == want
    # a failure after the data and before the commit leaves nothing behind
    broken = C.capture_writer(store, "other", engine)
    real, store._put = store._put, lambda *a: (_ for _ in ()).throw(OSError("no commit"))
    with pytest.raises(OSError):
        broken(_parts(order, 2)[0].withColumn("device_id", F.concat(F.lit("o-"), "device_id")), 0)
    store._put = real
    assert stored("other") == []
    # a second stream with the same batch numbers
    for i, part in enumerate(_parts(order, 2)):
        broken(part.withColumn("device_id", F.concat(F.lit("o-"), "device_id")), i)
    assert [r[1:] for r in stored("other")] == [r[1:] for r in want] and stored("desk") == want
    # the first stream starts over, cut otherwise, under a new checkpoint
    real_run, C.run_of = C.run_of, lambda batch: "fresh"
    try:
        again = C.capture_writer(store, "desk", engine)
        for i, part in enumerate(_parts(order, 4)):
            again(part, i)
    finally:
        C.run_of = real_run
    assert stored("desk") == want
    notices = store.log("notices")
    assert notices.where("kind_ord = 0").count() == notices.where("kind_ord = 1").count() == 2 * len(want)


def test_failed_classification_keeps_the_events(spark):
    sm = samples(spark, SF).drop("idle_seconds")
    store = Store(spark, scratch_path(spark, "store-test"))
    seen = []
    C.capture_writer(store, "desk", Failing(), on_failure=lambda *a: seen.append(a[:2]))(sm, 0)
    n = store.events().count()
    assert n > 100 and seen == [("desk", 0)] and store.labels().count() == 0 and store.unlabelled("rules-v1").count() == n
    store.relabel(RulesEngine(RuleSet.build(spark)))
    assert store.unlabelled("rules-v1").count() == 0 and store.labels("rules-v1").count() == n


def test_overrides_deletes_and_compaction(spark):
    """The reader equals the views over all that was ever written, whatever was compacted when."""
    rng = random.Random(8)
    store = Store(spark, scratch_path(spark, "store-test"))
    base = spark.createDataFrame([(i, "d", float(i), i + 1.0, "A", "t", "", None, at(i), "s") for i in range(40)], "id long, device_id string, start_ts double, end_ts double, app string, title string, url string, content_hash string, created_at timestamp, stream_id string")
    store.commit("s", "r", 0, {"events": base})
    model, gone, over = {}, set(), {}
    for step in range(6):
        labels = [(rng.randrange(45), "v1", f"c{step}{k}", 1.0, None, "{}", at(rng.randrange(100)), step * 100 + k) for k in range(15)]
        for r in labels:
            model[r[0]] = max(model.get(r[0], (at(-1), 0, "")), (r[6], r[7], r[2]))
        store.commit("s", "r", step + 1, {"engine_classifications": spark.createDataFrame(labels, "event_id long, engine_version string, category_id string, confidence double, rule_id string, meta_json string, created_at timestamp, seq long")})
        for _ in range(3):
            i = rng.randrange(40)
            if i in gone:
                with pytest.raises(ValueError):
                    store.set_override(i, "x")
            elif rng.random() < 0.6:
                store.set_override(i, f"o{step}", "why")
                over[i] = f"o{step}"
            else:
                store.clear_override(i)
                over.pop(i, None)
        if step % 2:
            dead = rng.sample(range(40), 2)
            store.delete_events(dead)
            gone |= set(dead)
        if step != 3:
            store.compact()
        want = sorted((i, over.get(i) or (model[i][2] if i in model else None)) for i in range(40) if i not in gone)
        assert sorted((r.id, r.category_id) for r in store.effective("v1").collect()) == want
    assert store.compact() == store.version().number
    assert all(len(r) <= 4 for r in store.version().runs.values())
    assert {r.event_id for r in store.labels().collect()} & gone == set() and {r.event_id for r in store.overrides().collect()} == set(over) - gone
    assert store.log("notices").where("kind = 'override_updated'").count() >= len(over)


def test_empty_store(spark):
    store = Store(spark, scratch_path(spark, "store-test"))
    assert store.compact() == 0 and store.events().count() == store.labels().count() == store.effective("v1").count() == 0


def test_capture_stream_equals_batch_in_one_span(spark):
    sm = samples(spark, SF).withColumn("is_idle", S.is_idle("idle_seconds", 600)).drop("idle_seconds")
    snaps = SM.tab_snapshots(SM.load(spark, SF, "pages"))
    engine = RulesEngine(RuleSet.build(spark))
    want = sorted(map(tuple, C.capture(sm, snaps, engine, variant="legacy").select(*EVENT, "category_id").collect()))
    end = {"device_id": "'tick'", "ts": "timestamp_ntz'2200-01-01'", "seq": "0"}
    store = Store(spark, scratch_path(spark, "store-test"))
    q = C.capture_stream(RY.as_stream(RY.tick(sm, **end), "ts", 2), RY.as_stream(RY.tick(snaps, **end), "ts", 1), store, "d", engine, scratch_path(spark, "ck"), "400 days", variant="legacy")
    q.awaitTermination()
    got = store.events().where("device_id <> 'tick'").join(store.labels("rules-v1").withColumnRenamed("event_id", "id"), "id")
    assert sorted(map(tuple, got.select(*EVENT, "category_id").collect())) == want and len(want) > 100
    assert L.orphan_labels(store.events(), store.log("engine_classifications")).count() == 0


def test_batches_of_a_stream_are_spread_and_empty_ones_commit_the_carry_alone(spark, monkeypatch):
    """A device's rows come from J4 in one task: they leave it before their URLs are sanitized."""
    store, engine = Store(spark, scratch_path(spark, "capture-spread")), RulesEngine(RuleSet.build(spark))
    rows = [("a", at(i), i, "App", f"t{i // 10}", "", False) for i in range(200)]
    seen, real = [], C.prepared

    def noting(df, *args):
        seen.append(df)
        return real(df, *args)

    monkeypatch.setattr(C, "prepared", noting)
    writer = C.capture_writer(store, "s", engine)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writer(spark.createDataFrame(rows[:150], ROW).coalesce(1), 0)
        assert seen[0].select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    writer(spark.createDataFrame([], ROW), 1)
    names = store.commits()
    assert len(names) == 2 and set(store._get(f"{store.root}/_commits/{names[1]}")["tables"]) == {"carry"}
    writer(spark.createDataFrame(rows[150:], ROW), 2)
    got = sorted(r["title"] for r in store.events().select("title").collect())
    assert got == sorted(f"t{i}" for i in range(19)) and store.labels("rules-v1").count() == 19 and store.log("late").count() == 0
