"""Streaming R7: the three append-only logs as one change feed, ordered per event.

The logs arrive on their own: a label may come in before its event, an override
before the label. The state of an event knows which kinds have been announced
and keeps the notices whose predecessors have not: a label waits for its event, an
override for a label. Held notices leave with the row they waited for, or, when the
logs' watermark has passed ``patience`` after the newest of them, by an event-time
timer, marked ``settled`` = false (labels of events that were never stored, events
that nothing labelled). Every row of the logs is announced once, as in
``operators.labels.change_feed``, and ``position`` numbers an event's notices.

A state holds the events of one hash bucket, as Arrow columns, and a micro-batch goes
through it in array operations: no call per event. The timer of a bucket is that of
its earliest waiting event.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dwell.streaming.asof import CLOCK, clocked, epoch_micros, pack, unpack

KINDS = ("event_recorded", "label_updated", "override_updated")
OUT = "event_id long, kind string, kind_ord int, seq long, position long, settled boolean"
STATE = "books binary, waiting binary"
#: fixed for the life of a checkpoint
BUCKETS = 256
BOOKS = {"none": "bool", "id": "int64", "seen": "int8", "announced": "int64", "last_us": "int64", "due": "int64"}
HELD = {"none": "bool", "id": "int64", "kind": "int8", "no_seq": "bool", "seq": "int64"}
NO_TIME = -(2**63)


def _columns(data: bytes | None, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    if data is None:
        return {c: np.empty(0, dtype=k) for c, k in kinds.items()}
    t = unpack(bytes(data))
    return {c: t.column(c).to_numpy().astype(k) for c, k in kinds.items()}


def _feed_fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState, patience_us: int) -> Iterator[pd.DataFrame]:
    books, held = state.get if state.exists else (None, None)
    books, held = _columns(books, BOOKS), _columns(held, HELD)
    wm_ms = state.getCurrentWatermarkMs()
    pdfs = [p for p in pdfs if len(p)]
    new = {c: np.concatenate([p[c].to_numpy().astype(k) for p in pdfs] or [np.empty(0, dtype=k)]) for c, k in {**HELD, "us": "int64"}.items()}
    rows = {c: np.concatenate([held[c], new[c]]) for c in HELD}

    # the events of the bucket, known or new, in order, and the place of every row among them
    known, fresh = len(books["id"]), np.arange(len(rows["id"])) >= len(held["id"])
    none, ids = np.concatenate([books["none"], rows["none"]]), np.concatenate([books["id"], rows["id"]])
    order = np.lexsort((ids, none))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (np.diff(none[order].astype("int8")) != 0) | (ids[order][1:] != ids[order][:-1])
    place = np.empty(len(order), dtype="int64")
    place[order] = np.cumsum(first) - 1
    event, old, n = place[known:], place[:known], int(first.sum())
    none, ids = none[order][first], ids[order][first]
    seen, announced, last_us, due = (np.zeros(n, dtype=k) for k in ("int8", "int64", "int64", "int64"))
    for a, c in ((seen, "seen"), (announced, "announced"), (last_us, "last_us"), (due, "due")):
        a[old] = books[c]
    np.maximum.at(last_us, event[fresh], np.where(new["us"] == NO_TIME, 0, new["us"]))
    touched, waits = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    touched[event[fresh]] = True
    waits[event[~fresh]] = True
    late = waits & ~touched & (due < wm_ms)

    # kinds in order: what is released here may be what the next kind waits for
    settled = np.zeros(len(event), dtype=bool)
    for kind in range(len(KINDS)):
        mine = rows["kind"] == kind
        free = mine if kind == 0 else mine & (seen[event] >> (kind - 1) & 1 == 1)
        settled |= free
        seen[event[free]] |= 1 << kind
    leaves = settled | late[event]
    for kind in range(len(KINDS)):
        seen[event[leaves & (rows["kind"] == kind)]] |= 1 << kind

    out = np.flatnonzero(leaves)
    out = out[np.lexsort((rows["seq"][out], ~rows["no_seq"][out], rows["kind"][out], event[out]))]
    e = event[out]
    start = np.flatnonzero(np.diff(e, prepend=-1) != 0) if len(e) else np.empty(0, dtype="int64")
    size = np.diff(start, append=len(e))
    position = announced[e] + np.arange(len(e)) - np.repeat(start, size) + 1
    announced[e[start]] += size

    rest = {c: rows[c][~leaves] for c in HELD}
    waits = np.zeros(n, dtype=bool)
    waits[event[~leaves]] = True
    due = np.where(touched, np.maximum(last_us + patience_us, wm_ms * 1000) // 1000 + 1, due)
    books = {"none": none, "id": ids, "seen": seen, "announced": announced, "last_us": last_us, "due": due}
    state.update((pack(pa.table(books)), pack(pa.table(rest)) if waits.any() else None))
    if waits.any():
        state.setTimeoutTimestamp(max(int(due[waits].min()), wm_ms))
    if len(out):
        yield pd.DataFrame(
            {
                "event_id": pd.arrays.IntegerArray(rows["id"][out], rows["none"][out]),
                "kind": np.array(KINDS, dtype=object)[rows["kind"][out]],
                "kind_ord": rows["kind"][out].astype("int32"),
                "seq": pd.arrays.IntegerArray(rows["seq"][out], rows["no_seq"][out]),
                "position": position,
                "settled": settled[out],
            }
        )


def stream_change_feed(events: DataFrame, classifications: DataFrame, overrides: DataFrame, delay: str = "10 minutes", patience_seconds: float = 3600, buckets: int = BUCKETS) -> DataFrame:
    """(event_id, kind, kind_ord, seq, position, settled) of three streaming logs:
    events (id, created_at), labels and override operations (event_id, seq and
    created_at; without that column a log has no say in the watermark). ``buckets``
    states share the events."""

    def notices(log: DataFrame, kind: int, event_id: str, seq: str) -> DataFrame:
        at: Column = F.col("created_at") if "created_at" in log.columns else F.lit(None).cast("timestamp_ntz")
        rows = log.select(F.col(event_id).cast("long").alias("event_id"), F.lit(kind).alias("kind"), F.col(seq).cast("long").alias("seq"), at.alias("ts"))
        if "created_at" not in log.columns:
            return rows.withColumn(CLOCK, F.lit(None).cast("timestamp"))
        return clocked(rows, delay)

    rows = notices(events, 0, "id", "id").unionByName(notices(classifications, 1, "event_id", "seq")).unionByName(notices(overrides, 2, "event_id", "seq"))
    # nulls as flags: beside a null, pandas would hold a long as a double
    rows = rows.select(
        CLOCK, F.pmod(F.xxhash64("event_id"), F.lit(buckets)).alias("bucket"),
        F.col("event_id").isNull().alias("none"), F.coalesce("event_id", F.lit(0)).alias("id"), "kind",
        F.col("seq").isNull().alias("no_seq"), F.coalesce("seq", F.lit(0)).alias("seq"),
        F.coalesce(epoch_micros(F.col("ts")), F.lit(NO_TIME)).alias("us"),
    )
    fn = functools.partial(_feed_fn, patience_us=round(patience_seconds * 1_000_000))
    return rows.groupBy("bucket").applyInPandasWithState(fn, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
