"""Streams whose work must not grow faster than their rows: the as-of join of busy devices."""

import random

import numpy as np
import pyarrow as pa

from dwell.streaming import asof as A
from dwell.streaming import replay as RP


class State:
    """A group's state with a watermark that the test sets."""

    def __init__(self):
        self.value, self.exists, self.hasTimedOut, self.wm_ms, self.timer = None, False, False, 0, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists, self.timer = value, True, None

    def getCurrentWatermarkMs(self):
        return self.wm_ms

    def setTimeoutTimestamp(self, at):
        assert at >= self.wm_ms
        self.timer = at


def test_busy_devices_are_packed_and_matched(spark):
    rng = random.Random(5)
    device = lambda: rng.choice(["a", "a", "a", "b", None])
    rows = [(device(), rng.randrange(3000), i, rng.choice(["Firefox", "fire fox", "Chrome", None]), f"t{i}", rng.choice([None, "", "u"])) for i in range(3000)] + [("c", 5, 9000, "Firefox", "t", "u")]
    snaps = [(device(), rng.randrange(3000), i, rng.choice([None, "", f"S{i}"]), rng.choice([None, "", f"U{i}"])) for i in range(800)]
    at = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s)"
    s = spark.createDataFrame(rows, "device_id string, s int, seq long, app string, title string, url string").withColumn("ts", A.F.expr(at))
    p = spark.createDataFrame(snaps, "device_id string, s int, seq long, title string, url string").withColumn("ts", A.F.expr(at))
    end = {"device_id": "'tick'", "ts": "timestamp_ntz'2025-01-01'", "seq": "0"}
    got = RP.run_to_table(A.stream_tab_override(RP.as_stream(RP.tick(s.drop("s"), **end), "ts", 2), RP.as_stream(RP.tick(p.drop("s"), **end), "ts", 3), "100 days"), "packed")
    got = {r.seq: r for r in got.where("NOT is_snapshot AND device_id IS DISTINCT FROM 'tick'").collect()}
    assert len(got) == len(rows)
    for d, t, i, app, title, url in rows:
        best = max((x for x in snaps if x[0] == d and x[1] <= t), key=lambda x: (x[1], x[2]), default=None)
        hit = best is not None and (app or "").replace(" ", "").lower().startswith("firefox")
        want = (best[3] or title, best[4] or url, True) if hit else (title, url, False)
        assert (got[i].title, got[i].url, got[i].overridden) == want and not got[i].is_late


def test_blocks_leave_few_rows_to_a_group(spark):
    rows = spark.range(500).selectExpr("'a' AS device_id", "id AS us", "1 AS kind", "id AS seq", "'x' AS app", "'t' AS title", "'u' AS url").coalesce(1)
    got = A.packed(rows.unionByName(rows.limit(3).selectExpr("'b' AS device_id", *rows.columns[1:])).coalesce(1), ()).collect()
    blocks = [A.unpack(bytes(r.block)) for r in got if r.block is not None]
    assert sum(b.num_rows for b in blocks) == 500 and len(blocks) < 10
    assert sorted(r.us for r in got if r.block is None) == [0, 1, 2]


def test_rows_leave_in_frames_of_bounded_size():
    state, n = State(), A.OUT_ROWS * 2 + 7
    rows = pa.table({"us": np.arange(n), "kind": np.ones(n, dtype="int32"), "seq": np.arange(n), "app": ["x"] * n, "title": ["t"] * n, "url": ["u"] * n}).cast(A._schema(()))
    frame = rows.to_pandas().assign(block=None)
    state.wm_ms = n
    frames = list(A._override_fn(("d",), iter([frame]), state, "legacy", (), None))
    assert [len(f) for f in frames] == [A.OUT_ROWS, A.OUT_ROWS, 7]
