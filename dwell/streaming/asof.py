"""Streaming J4: two streams, samples and browser tab snapshots, meet in one state.

Per device the state holds the latest snapshot and the rows that the watermark
has not passed yet. A row's place is certain once the watermark, the smaller of
the two streams', has reached its time: everything earlier of both streams is in.
An event-time timer at the earliest waiting row wakes the device then, whether
or not it sends anything more, and the waiting rows up to the watermark leave in
(ts, snapshots first, seq) order, each sample with the latest snapshot before it.
So neither the cut into micro-batches nor the order in which the two streams
arrive bears on the result, which equals ``operators.asof.apply_tab_override``.

Waiting rows lie on disk, in Spark's RocksDB state store (see ``state_on_disk``), as
Arrow columns in leaves of bounded size that follow one another in time. A leaf that
grows too large is parted; a task holds the rows of one leaf, however many
wait, and matches them in array operations.

Rows at or before the time up to which their device has been handed out, and rows
without a time, are late. They are never dropped: a late sample leaves as it came, marked
``is_late``; a late snapshot leaves marked as well and still counts for later samples.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import MapState

CLOCK = "event_time"
#: optional columns of a sample, beside device_id, ts, seq, app, title and url
EXTRA = {"idle_seconds": "double", "category": "string", "is_productive": "boolean", "is_idle": "boolean", "is_close": "boolean"}
STATE = "snap_us long, snap_seq long, snap_title string, snap_url string, done_us long, timer_ms long, leaves string"
SNAPSHOT, SAMPLE = 0, 1
OUT_ROWS = 50_000
BLOCK_ROWS = 64
#: bytes of rows that are put to a device's leaves at a time, and that a leaf holds
LEAF_BYTES = 8 << 20
_NO_SEQ = 2**63 - 1
#: what a stream that waits in leaves runs with
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # the stores of an executor, one for each of its partitions, share their buffers
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    # a commit writes what a micro-batch changed, not the whole state
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # blocks are rows as well: a number of rows alone does not bound what Python is handed
    "spark.sql.execution.arrow.maxBytesPerBatch": str(LEAF_BYTES // 4),
}


@contextmanager
def state_on_disk(df: DataFrame) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, if ``df`` waits in leaves."""
    spark: SparkSession = df.sparkSession
    conf = DISK_STATE if "TransformWithState" in df._jdf.queryExecution().analyzed().toString() else {}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def epoch_micros(ts: Column) -> Column:
    """Microseconds of a naive timestamp since 1970, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def clocked(rows: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """``rows`` with a null ``event_time``, behind a watermark of ``delay`` that their
    times advance. Spark drops rows whose event time is behind the watermark before a
    state sees them; here the times pass through a branch of their own, which hands
    on no rows, so that late rows reach the state and can be told apart there."""
    return clock(rows, delay, ts).unionByName(rows.withColumn(CLOCK, F.lit(None).cast("timestamp")), allowMissingColumns=True)


def clock(rows: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """No rows, and a watermark of ``delay`` that the times of ``rows`` advance."""
    times = rows.select(F.timestamp_micros(epoch_micros(F.col(ts))).alias(CLOCK)).withWatermark(CLOCK, delay)
    return times.where(F.col(CLOCK) > F.lit("9999-12-31 23:59:59.999999").cast("timestamp"))


def pack(rows: pa.Table) -> bytes:
    rows = rows.combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _schema(extra: tuple[str, ...]) -> pa.Schema:
    kinds = {"double": pa.float64(), "string": pa.large_string(), "boolean": pa.bool_()}
    texts = [(c, pa.large_string()) for c in ("app", "title", "url")]
    return pa.schema([("us", pa.int64()), ("kind", pa.int32()), ("seq", pa.int64()), *texts, *((c, kinds[EXTRA[c]]) for c in extra)])


def packed(rows: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """``rows`` with those of a device that has many in an Arrow batch as one row, in
    ``block``: Spark hands a group's state to Python once per chunk of its rows."""
    schema = _schema(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            fields = pa.schema([*(pa.field(f.name, f.type) for f in t.schema), pa.field("block", pa.binary())])
            keys = t.column("device_id").combine_chunks().dictionary_encode()
            group = pc.fill_null(keys.indices, len(keys.dictionary)).to_numpy()
            counts = np.bincount(group, minlength=len(keys.dictionary) + 1)
            own = t.select(schema.names).cast(schema)
            few = pa.array(counts[group] < BLOCK_ROWS)
            plain = t.filter(few)
            yield from plain.append_column("block", pa.nulls(plain.num_rows, pa.binary())).cast(fields).combine_chunks().to_batches()
            many = np.flatnonzero(counts >= BLOCK_ROWS)
            if len(many):
                names = [keys.dictionary[int(g)].as_py() if g < len(keys.dictionary) else None for g in many]
                blocks = [pack(own.filter(pa.array(group == g))) for g in many]
                cols = {f.name: pa.nulls(len(many), f.type) for f in t.schema} | {"device_id": pa.array(names, t.schema.field("device_id").type), "block": pa.array(blocks, pa.binary())}
                yield pa.RecordBatch.from_pydict(cols, fields)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, block binary")


def _tables(pdf: pd.DataFrame | pa.Table, schema: pa.Schema) -> Iterator[pa.Table]:
    if isinstance(pdf, pa.Table):
        yield pdf
        return
    plain = pdf["block"].isna()
    yield pa.Table.from_pandas(pdf.loc[plain, schema.names], schema, preserve_index=False)
    for x in pdf.loc[~plain, "block"]:
        yield unpack(bytes(x))


def _numbers(col: pa.ChunkedArray, null: int) -> np.ndarray:
    return pc.fill_null(col, null).to_numpy()


def _set(col: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.not_equal(col, ""), False).to_numpy(zero_copy_only=False)


def _handed_out(rows: pa.Table, device, extra: tuple[str, ...], title, url, overridden: np.ndarray, is_late: bool, is_snapshot: np.ndarray) -> Iterator[pd.DataFrame]:
    """The output rows, in frames of bounded size."""
    for i in range(0, rows.num_rows, OUT_ROWS):
        t, z = rows.slice(i, OUT_ROWS), i + OUT_ROWS
        longs = {c: pd.arrays.IntegerArray(_numbers(t.column(c), 0), t.column(c).is_null().to_numpy()) for c in ("us", "seq")}
        yield pd.DataFrame(
            {
                "device_id": pd.Series([device] * t.num_rows, dtype=object),
                **longs,
                "app": t.column("app").to_pandas(),
                **{c: t.column(c).to_pandas() for c in extra},
                "title": title.slice(i, OUT_ROWS).to_pandas(),
                "url": url.slice(i, OUT_ROWS).to_pandas(),
                "overridden": overridden[i:z],
                "is_late": is_late,
                "is_snapshot": is_snapshot[i:z],
            }
        )


def _override_fn(key: tuple, pdfs: Iterator[pd.DataFrame | pa.Table], state: GroupState | _Step, variant: str, extra: tuple[str, ...], max_age_us: int | None) -> Iterator[pd.DataFrame]:
    """The rows of a device that leave, of some that memory holds; the rest of them stays in ``state``."""
    schema = _schema(extra)
    snap_us = snap_seq = snap_title = snap_url = done = waiting = None
    if state.exists:
        snap_us, snap_seq, snap_title, snap_url, done, waiting = state.get
    parts = [t for p in pdfs if len(p) for t in _tables(p, schema)]
    if waiting is not None:
        parts.append(unpack(bytes(waiting)))
    rows = pa.concat_tables(parts) if parts else schema.empty_table()
    wm = state.getCurrentWatermarkMs() * 1000
    us = _numbers(rows.column("us"), 0)
    late = rows.column("us").is_null().to_numpy() | ((us <= done) if done is not None else False)
    ready = ~late & (us <= wm)

    behind = rows.filter(pa.array(late))
    if behind.num_rows:
        snaps = behind.column("kind").to_numpy() == SNAPSHOT
        yield from _handed_out(behind, key[0], extra, behind.column("title"), behind.column("url"), np.zeros(len(snaps), dtype=bool), True, snaps)
        # the newest of the late snapshots, where it is newer than the one known
        at, seq = _numbers(behind.column("us"), 0), _numbers(behind.column("seq"), _NO_SEQ)
        timed = np.flatnonzero(snaps & ~behind.column("us").is_null().to_numpy())
        if len(timed):
            i = int(timed[np.lexsort((-timed, seq[timed], at[timed]))[-1]])
            if snap_us is None or (int(at[i]), int(seq[i])) > (snap_us, snap_seq):
                snap_us, snap_seq, snap_title, snap_url = int(at[i]), int(seq[i]), behind.column("title")[i].as_py(), behind.column("url")[i].as_py()

    if ready.any():
        place = np.flatnonzero(ready)
        kind, seq = rows.column("kind").to_numpy()[place], _numbers(rows.column("seq"), _NO_SEQ)[place]
        order = np.lexsort((seq, kind, us[place]))
        now, kind, seq, at = rows.take(pa.array(place[order])), kind[order], seq[order], us[place][order]
        # row 0 is the snapshot that the state knows; a row's snapshot is the last one up to it
        latest = np.maximum.accumulate(np.where(kind == SNAPSHOT, np.arange(1, len(kind) + 1), 0))
        named = {c: pa.chunked_array([pa.array([v], pa.large_string()), *now.column(c).chunks]).take(pa.array(latest)) for c, v in (("title", snap_title), ("url", snap_url))}
        age = at - np.concatenate([[snap_us or 0], at])[latest]
        fresh = ((latest > 0) | (snap_us is not None)) & (True if max_age_us is None else age <= max_age_us)
        apps = now.column("app").combine_chunks().dictionary_encode()
        applies = np.array([_applies(a, variant) for a in apps.dictionary.to_pylist()] + [False])
        hit = fresh & applies[pc.fill_null(apps.indices, len(applies) - 1).to_numpy()]
        has = {c: _set(v) for c, v in named.items()}
        if variant != "legacy":
            hit &= has["title"] | has["url"]
        named = {c: pc.if_else(pa.array(hit & has[c]), v, now.column(c)) for c, v in named.items()}
        own = pa.array(kind != SNAPSHOT)
        mine = now.filter(own)
        yield from _handed_out(mine, key[0], extra, named["title"].filter(own), named["url"].filter(own), hit[kind != SNAPSHOT], False, np.zeros(mine.num_rows, dtype=bool))
        if latest[-1]:
            i = int(latest[-1]) - 1
            snap_us, snap_seq, snap_title, snap_url = int(at[i]), int(seq[i]), now.column("title")[i].as_py(), now.column("url")[i].as_py()

    rest = ~late & ~ready
    done = max(done, wm) if done is not None else wm
    state.update((snap_us, snap_seq, snap_title, snap_url, done, pack(rows.filter(pa.array(rest))) if rest.any() else None))
    if rest.any():
        state.setTimeoutTimestamp(max(int(us[rest].min()) // 1000, wm // 1000 + 1))


def _applies(app, variant: str) -> bool:
    if not isinstance(app, str):
        return False
    return app.replace(" ", "").lower().startswith("firefox") if variant == "legacy" else app == "Firefox"


_Place = tuple[int, int, int]


def _places(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a device's rows are ordered by: (ts, snapshots first, seq)."""
    return _numbers(rows.column("us"), 0), rows.column("kind").to_numpy(), _numbers(rows.column("seq"), _NO_SEQ)


def _sorted(rows: pa.Table) -> pa.Table:
    us, kind, seq = _places(rows)
    return rows.take(pa.array(np.lexsort((seq, kind, us))))


def _before(places: tuple[np.ndarray, ...], place: _Place) -> int:
    """How many of the rows, in order, come before ``place``."""
    lo, hi = 0, len(places[0])
    for c, v in zip(places, place, strict=True):
        lo, hi = lo + int(np.searchsorted(c[lo:hi], v)), lo + int(np.searchsorted(c[lo:hi], v, "right"))
    return lo


@dataclass
class _Leaf:
    """Waiting rows from ``place`` up to the next leaf's: ``parts`` tables, of ``size``
    bytes together; parted beyond ``limit``."""

    number: int
    place: _Place
    first_us: int = 0
    parts: int = 0
    size: int = 0
    limit: int = 0


class _Leaves:
    """A device's waiting rows, as leaves in order, of ``most`` bytes or less. ``stored``
    maps (leaf, part) to a table."""

    def __init__(self, stored: MapState, index: str | None, most: int):
        self.stored, self.most = stored, most
        self.leaves = [_Leaf(n, tuple(place), *rest) for n, place, *rest in json.loads(index or "[]")]

    def index(self) -> str | None:
        return json.dumps([astuple(x) for x in self.leaves]) if self.leaves else None

    def first_us(self) -> int | None:
        return self.leaves[0].first_us if self.leaves else None

    def _new(self, at: int, rows: pa.Table, place: _Place) -> _Leaf:
        leaf = _Leaf(max((x.number for x in self.leaves), default=-1) + 1, place)
        self.leaves.insert(at, leaf)
        self._append(leaf, rows)
        # rows of one place can't be parted: tried again when there are twice as many
        leaf.limit = max(self.most, 2 * leaf.size)
        return leaf

    def _append(self, leaf: _Leaf, rows: pa.Table) -> None:
        self.stored.updateValue((leaf.number, leaf.parts), (pack(rows),))
        first = pc.min(rows.column("us")).as_py()
        leaf.first_us = min(first, leaf.first_us) if leaf.parts else first
        leaf.parts, leaf.size = leaf.parts + 1, leaf.size + rows.nbytes

    def _take(self, leaf: _Leaf) -> pa.Table:
        """The rows of a leaf, which is one no longer."""
        rows = []
        for part in range(leaf.parts):
            rows.append(unpack(bytes(self.stored.getValue((leaf.number, part))[0])))
            self.stored.removeKey((leaf.number, part))
        self.leaves.remove(leaf)
        return pa.concat_tables(rows)

    def put(self, rows: pa.Table) -> None:
        if not rows.num_rows:
            return
        rows = _sorted(rows)
        if not self.leaves:
            self._part(0, rows, (-(2**63), SNAPSHOT, -(2**63)))
            return
        places, held = _places(rows), list(self.leaves)
        cuts = [0, *(_before(places, x.place) for x in held[1:]), rows.num_rows]
        for leaf, a, z in zip(held, cuts[:-1], cuts[1:], strict=True):
            if z > a:
                self._append(leaf, rows.slice(a, z - a))
                if leaf.size > leaf.limit:
                    at = self.leaves.index(leaf)
                    self._part(at, _sorted(self._take(leaf)), leaf.place)

    def _part(self, at: int, rows: pa.Table, place: _Place) -> None:
        """``rows``, in order, as leaves from ``place`` on that are half full."""
        places, step = _places(rows), -(-rows.num_rows // -(-2 * rows.nbytes // self.most))
        begin = {_before(places, p): p for p in (tuple(int(c[i]) for c in places) for i in range(0, rows.num_rows, step))} | {0: place}
        starts = sorted(begin)
        for i, (a, z) in enumerate(zip(starts, [*starts[1:], rows.num_rows], strict=True)):
            self._new(at + i, rows.slice(a, z - a), begin[a])

    def ripe(self, wm: int) -> Iterator[pa.Table]:
        """The rows up to ``wm``, which wait no longer, a leaf at a time."""
        while self.leaves and self.leaves[0].first_us <= wm:
            leaf = self.leaves[0]
            rows = self._take(leaf)
            ready = pc.less_equal(rows.column("us"), wm)
            rest = rows.filter(pc.invert(ready))
            if rest.num_rows:
                self._new(0, rest, leaf.place)
            yield rows.filter(ready)


class _Step:
    """A device's state for one call of ``_override_fn``, on rows that all leave.
    ``done`` stands until the micro-batch ends."""

    exists = True

    def __init__(self, snap: tuple, done: int | None, wm_ms: int):
        self.snap, self.done, self.wm_ms = snap, done, wm_ms

    @property
    def get(self) -> tuple:
        return (*self.snap, self.done, None)

    def update(self, value: tuple) -> None:
        self.snap = value[:4]

    def getCurrentWatermarkMs(self) -> int:
        return self.wm_ms


class TabOverride(StatefulProcessor):
    """J4 of one device."""

    def __init__(self, variant: str, extra: tuple[str, ...], max_age_us: int | None):
        self.variant, self.extra, self.max_age_us, self.leaf_bytes = variant, extra, max_age_us, LEAF_BYTES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)
        self.waiting = handle.getMapState("waiting", "leaf long, part long", "rows binary")

    def _gathered(self, frames: Iterator[pd.DataFrame], schema: pa.Schema) -> Iterator[pa.Table]:
        some, size = [], 0
        for t in (t for p in frames for t in _tables(p, schema)):
            some.append(t)
            size += t.nbytes
            if size >= self.leaf_bytes:
                yield pa.concat_tables(some)
                some, size = [], 0
        if some:
            yield pa.concat_tables(some)

    def _batch(self, key: tuple, frames: Iterator[pd.DataFrame], wm_ms: int, expired: int | None) -> Iterator[pd.DataFrame]:
        schema = _schema(self.extra)
        *snap, done, timer, index = self.known.get() or (None,) * 7
        leaves = _Leaves(self.waiting, index, self.leaf_bytes)
        step = _Step(tuple(snap), done, wm_ms)

        def left(rows: pa.Table) -> Iterator[pd.DataFrame]:
            return _override_fn(key, iter([rows]), step, self.variant, self.extra, self.max_age_us)

        for rows in self._gathered(frames, schema):
            late = rows.column("us").is_null()
            if done is not None:
                late = pc.or_(late, pc.fill_null(pc.less_equal(rows.column("us"), done), True))
            behind = rows.filter(late)
            if behind.num_rows:
                yield from left(behind)
            leaves.put(rows.filter(pc.invert(late)))
        wm = wm_ms * 1000
        for rows in leaves.ripe(wm):
            yield from left(rows)
        first = leaves.first_us()
        wake = None if first is None else max(first // 1000, wm_ms + 1)
        if timer is not None and timer not in (wake, expired):
            self.handle.deleteTimer(timer)
        if wake is not None and wake != timer:
            self.handle.registerTimer(wake)
        self.known.update((*step.snap, wm if done is None else max(done, wm), wake, leaves.index()))
        # a worker that idles keeps what it has freed
        pa.default_memory_pool().release_unused()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._batch(key, rows, max(timerValues.getCurrentWatermarkInMs(), 0), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._batch(key, iter(()), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())


def stream_tab_override(
    samples: DataFrame, snapshots: DataFrame, delay: str = "10 minutes", variant: str = "legacy", max_age_seconds: float | None = None
) -> DataFrame:
    """Streaming J4: the samples (device_id, ts, seq, app, title, url and any of
    ``EXTRA``) with the latest snapshot's non-empty title and url, ``overridden``,
    ``is_late`` and ``is_snapshot``. ``delay`` is how far either stream may lag
    behind its newest row before a row is late. To be started within ``state_on_disk``."""
    extra = tuple(c for c in EXTRA if c in samples.columns)
    def side(df: DataFrame, kind: int, cols: tuple[str, ...]) -> DataFrame:
        rows = df.select(
            F.col("device_id").cast("string").alias("device_id"), epoch_micros(F.col("ts")).alias("us"), F.lit(kind).alias("kind"), F.col("seq").cast("long").alias("seq"),
            *[(F.col(c) if c in cols else F.lit(None)).cast(EXTRA.get(c, "string")).alias(c) for c in ("app", "title", "url", *extra)],
        )
        return clock(df.select("ts"), delay).unionByName(packed(rows, extra).withColumn(CLOCK, F.lit(None).cast("timestamp")), allowMissingColumns=True)

    rows = side(samples, SAMPLE, ("app", "title", "url", *extra)).unionByName(side(snapshots, SNAPSHOT, ("title", "url")))
    rows = rows.select(CLOCK, "device_id", "us", "kind", "seq", "app", "title", "url", *extra, "block")
    own = ", ".join(f"{c} {EXTRA[c]}" for c in extra)
    schema = f"device_id string, us long, seq long, app string, {own + ', ' if own else ''}title string, url string, overridden boolean, is_late boolean, is_snapshot boolean"
    max_age = None if max_age_seconds is None else round(max_age_seconds * 1_000_000)
    out = rows.groupBy("device_id").transformWithStateInPandas(TabOverride(variant, extra, max_age), schema, "Append", "EventTime")
    ts = F.timestamp_add("MICROSECOND", F.col("us"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return out.select("device_id", ts.alias("ts"), "seq", "app", "title", "url", *extra, "overridden", "is_late", "is_snapshot")
