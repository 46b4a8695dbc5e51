"""Streams whose work must not grow faster than their rows: many events in one state of the feed."""

import numpy as np
import pandas as pd

from dwell.streaming import feed as FD

from test_streams_at_size import State

US = 1_000_000


def notices(rows):
    """(event or None, kind, seq or None, seconds or None)"""
    return pd.DataFrame(
        {
            "none": [e is None for e, *_ in rows], "id": np.array([e or 0 for e, *_ in rows], dtype="int64"), "kind": [k for _, k, *_ in rows],
            "no_seq": [s is None for _, _, s, _ in rows], "seq": np.array([s or 0 for _, _, s, _ in rows], dtype="int64"),
            "us": np.array([FD.NO_TIME if t is None else t * US for *_, t in rows], dtype="int64"),
        }
    )


def feed(state, rows, wm_s):
    state.wm_ms = wm_s * 1000
    out = [p for p in FD._feed_fn((0,), iter([notices(rows)] if rows else []), state, 100 * US)]
    return [tuple(None if pd.isna(v) else v for v in r) for p in out for r in p[["event_id", "kind_ord", "seq", "position", "settled"]].itertuples(index=False)]


def test_feed_state_holds_many_events():
    s, big = State(), 2**62 + 1
    assert feed(s, [(1, 1, 10, 5), (2, 0, 2, 5), (2, 1, 20, 5), (big, 0, big, 9), (None, 2, None, None)], 0) == [(2, 0, 2, 1, True), (2, 1, 20, 2, True), (big, 0, big, 1, True)]
    assert s.timer == 100_001  # of the null event, which has no time
    # event 1 comes in before its timer, the null event's has passed
    assert feed(s, [(1, 0, 1, 7), (2, 2, 21, 8)], 101) == [(1, 0, 1, 1, True), (1, 1, 10, 2, True), (2, 2, 21, 3, True), (None, 2, None, 1, False)]
    assert s.timer is None
    assert feed(s, [(None, 2, 5, 200), (None, 1, 6, 200), (None, 1, None, 200)], 102) == []
    assert feed(s, [], 301) == [(None, 1, None, 2, False), (None, 1, 6, 3, False), (None, 2, 5, 4, False)]
