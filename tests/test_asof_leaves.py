"""Streaming J4 of devices with more waiting rows than a task may hold."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from dwell.streaming import asof as A

LEAF = 6_000


class Stored:
    """A state variable, with its tables in memory."""

    def __init__(self):
        self.rows, self.value, self.largest = {}, None, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.largest = max(self.largest, len(value[0]))
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


class Handle:
    def __init__(self):
        self.known, self.waiting, self.timers = Stored(), Stored(), set()

    def getValueState(self, *_):
        return self.known

    def getMapState(self, *_):
        return self.waiting

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def table(rows):
    """(us, kind, seq, app, title, url) as the rows of a device."""
    return pa.table({c: [r[i] for r in rows] for i, c in enumerate(("us", "kind", "seq", "app", "title", "url"))}).cast(A._schema(()))


def frame(rows):
    return table(rows).to_pandas().assign(block=None)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_waiting_rows_lie_in_leaves(monkeypatch, seed):
    """Whatever the cut into micro-batches: every row leaves once, as the brute force has it, and no call holds more than a leaf and a half."""
    monkeypatch.setattr(A, "LEAF_BYTES", LEAF)
    held, matched = [], A._override_fn
    monkeypatch.setattr(A, "_override_fn", lambda key, tables, *a: matched(key, iter([held.append(t.nbytes) or t for t in tables]), *a))
    rng, handle = random.Random(seed), Handle()
    processor = A.TabOverride("legacy", (), None)
    processor.init(handle)
    rows = []
    for i in range(3000):
        us = rng.choice([rng.randrange(1, 2_000_000), 777_000])
        snap = rng.random() < 0.2
        rows.append((us, A.SNAPSHOT if snap else A.SAMPLE, i, None if snap else rng.choice(["Firefox", "Chrome"]), f"t{i}", rng.choice([None, "", f"u{i}"])))
    out, wm = [], 0
    # the later a micro-batch, the later its rows; within the watermark's delay they come in any order
    rows.sort(key=lambda r: r[0] + rng.randrange(500_000))
    seen = 0
    for i in range(0, len(rows), 400):
        part = rows[i : i + 400]
        out += [f for f in processor.handleInputRows(("d",), iter([frame(part[:150]), frame(part[150:])]), SimpleNamespace(getCurrentWatermarkInMs=lambda: wm))]
        seen = max(seen, max(r[0] for r in part))
        wm = max(0, (seen - 500_001) // 1000)
        assert len(handle.timers) == 1
    assert len(handle.waiting.rows) > 10
    (at,) = handle.timers
    wm = 3000
    out += list(processor.handleExpiredTimer(("d",), SimpleNamespace(getCurrentWatermarkInMs=lambda: wm), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    handle.timers.remove(at)
    assert not handle.waiting.rows and not handle.timers

    snaps = sorted((us, i, title, url) for us, kind, i, _, title, url in rows if kind == A.SNAPSHOT)
    got = {int(r.seq): r for f in out for r in f.itertuples()}
    assert sum(len(f) for f in out) == len(got) == sum(r[1] == A.SAMPLE for r in rows)
    for us, kind, i, app, title, url in rows:
        if kind == A.SAMPLE:
            best = max((s for s in snaps if s[0] <= us), default=None)
            want = (best[2] or title, best[3] or url, True) if best and app == "Firefox" else (title, url, False)
            assert (got[i].title, got[i].url, got[i].overridden, got[i].is_late) == (*want, False)
    order = [(int(r.us), int(r.seq)) for f in out for r in f.itertuples()]
    assert order == sorted(order)
    assert handle.waiting.largest < 2 * LEAF
    assert max(held) < 2.5 * LEAF < table(rows).nbytes / 10


def test_rows_of_one_time_stay_in_a_leaf():
    """Rows that have the same place can't be parted; they neither get lost nor are parted again and again."""
    stored = Stored()
    leaves = A._Leaves(stored, None, LEAF)
    same = [(5, A.SAMPLE, None, "x", "t" * 50, "u")] * 40
    for _ in range(20):
        leaves.put(table([*same, (9, A.SAMPLE, 1, "x", "t", "u")]))
    got = pa.concat_tables(list(A._Leaves(stored, leaves.index(), LEAF).ripe(5)))
    assert got.num_rows == 800 and pc.unique(got.column("us")).to_pylist() == [5]
    assert sum(A.unpack(v[0]).num_rows for v in stored.rows.values()) == 20


def test_places_follow_the_order():
    rng = np.random.default_rng(4)
    rows = A._sorted(table([(int(u), int(k), None if s == 3 else int(s), "x", "t", "u") for u, k, s in rng.integers(0, [4, 2, 4], (300, 3))]))
    places = A._places(rows)
    order = list(zip(*(c.tolist() for c in places), strict=True))
    assert order == sorted(order)
    for place in set(order) | {(-1, 0, 0), (9, 0, 0)}:
        assert A._before(places, place) == sum(p < place for p in order)


def test_capture_waits_on_disk(spark, monkeypatch):
    """The capture stream's state is in leaves on disk, what it keeps of a batch is off the heap, and the session's own settings stay."""
    from dwell.operators.classify import RuleSet
    from dwell.session import path_exists, scratch_path
    from dwell.streaming import capture as C
    from dwell.streaming import replay as RY
    from dwell.streaming.store import RulesEngine, Store

    monkeypatch.setattr(A, "LEAF_BYTES", LEAF)
    # an attribute of the processor: the workers have it, too
    assert A.TabOverride("legacy", (), None).leaf_bytes == LEAF
    at = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s)"
    n = 900
    sm = spark.range(n).selectExpr("'d' AS device_id", "cast(id * 7919 % 5000 AS int) AS s", "id AS seq", "if(id % 3 = 0, 'Firefox', concat('App', id % 5)) AS app", "concat('t', id) AS title", "concat('https://a.org/p', id % 11) AS url", "false AS is_idle")
    sm = sm.withColumn("ts", A.F.expr(at)).drop("s")
    snaps = spark.range(100).selectExpr("'d' AS device_id", "cast(id * 53 % 5000 AS int) AS s", "id AS seq", "concat('S', id) AS title", "concat('https://b.org/q', id) AS url").withColumn("ts", A.F.expr(at)).drop("s")
    engine = RulesEngine(RuleSet.build(spark))
    cols = ["device_id", "start_ts", "end_ts", "app", "title", "url"]
    want = sorted(map(tuple, C.capture(sm, snaps, engine).select(*cols).collect()))
    levels, persist = [], type(sm).persist
    monkeypatch.setattr(type(sm), "persist", lambda df, *level: levels.append(level) or persist(df, *level))
    end = {"device_id": "'tick'", "ts": "timestamp_ntz'2200-01-01'", "seq": "0"}
    store, checkpoint = Store(spark, scratch_path(spark, "capture-leaves")), scratch_path(spark, "ck")
    before = {k: spark.conf.get(k, None) for k in A.DISK_STATE}
    q = C.capture_stream(RY.as_stream(RY.tick(sm, **end), "ts", 2), RY.as_stream(RY.tick(snaps, **end), "ts", 2), store, "d", engine, checkpoint, "400 days")
    assert {k: spark.conf.get(k, None) for k in A.DISK_STATE} == before
    q.awaitTermination()
    assert sorted(map(tuple, store.events().where("device_id <> 'tick'").select(*cols).collect())) == want and len(want) > 500
    assert levels and all(level and not level[0].useMemory for level in levels)
    assert path_exists(spark, f"{checkpoint}/state/0/_stateSchema") and not path_exists(spark, f"{checkpoint}/state/0/0/1.delta")
