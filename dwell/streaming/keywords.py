"""Streaming keyword state.

R8 keeps, per context key, the last hit (keyword, time) so a keyword hit is
counted once per keyword session even across micro-batches. R9 keeps the capped
per-category keyword index with the exact replacement rule: when a category is
full, the entry with the least (count, position) is replaced in place by the
new keyword with count 1. Both states are O(1) / O(cap) per key.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dwell.operators.keywords import KEYWORD_SESSION_RESET_SECONDS, KEYWORDS_PER_CATEGORY

HIT_OUT_SCHEMA = "context_key string, ts timestamp_ntz, seq long, category string, matched_keyword string, is_new boolean, is_late boolean"
HIT_STATE_SCHEMA = "keyword string, ts timestamp_ntz, seq long"
HIT_OUT = ["context_key", "ts", "seq", "category", "matched_keyword", "is_new", "is_late"]
INDEX_OUT_SCHEMA = "category string, position int, keyword string, count long"
INDEX_STATE_SCHEMA = "entries string"


def _hits_fn(reset_seconds: float):
    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "seq"], kind="mergesort").reset_index(drop=True)
        after = pdf["ts"].notna()
        if state.exists:
            kw0, ts0, seq0 = state.get
            ts0 = pd.Timestamp(ts0)
            after &= (pdf["ts"] > ts0) | ((pdf["ts"] == ts0) & (pdf["seq"] > seq0))
        if not after.all():
            # rows not after the last counted hit are late, as in stream_sessions: not judged, is_new is null
            yield pdf[~after].assign(context_key=key[0], is_new=None, is_late=True)[HIT_OUT]
            pdf = pdf[after].reset_index(drop=True)
            if pdf.empty:
                return
        prev_kw = pdf["matched_keyword"].shift(1)
        prev_ts = pdf["ts"].shift(1)
        if state.exists:
            prev_kw.iloc[0] = kw0
            prev_ts.iloc[0] = ts0
        gap = (pdf["ts"] - pd.to_datetime(prev_ts)).dt.total_seconds()
        same = prev_kw.notna() & (prev_kw == pdf["matched_keyword"]) & (gap < reset_seconds)
        pdf["is_new"] = ~same.fillna(False)
        last = pdf.iloc[-1]
        state.update((last["matched_keyword"], pd.Timestamp(last["ts"]).to_pydatetime(), int(last["seq"])))
        yield pdf.assign(context_key=key[0], is_new=pdf["is_new"].astype(object), is_late=False)[HIT_OUT]

    return fn


def stream_keyword_sessions(hits: DataFrame, reset_seconds: float = KEYWORD_SESSION_RESET_SECONDS) -> DataFrame:
    """Streaming W5 over keyword hits (context_key, ts, seq, category, matched_keyword).
    Late hits come out with ``is_late`` (``streaming.sessions.late_rows``) and null ``is_new``."""
    h = hits.where("context_key IS NOT NULL AND context_key <> ''").select(
        "context_key", "ts", "seq", "category", "matched_keyword"
    )
    return h.groupBy("context_key").applyInPandasWithState(
        _hits_fn(reset_seconds), HIT_OUT_SCHEMA, HIT_STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


class CappedIndex:
    """At most ``cap`` counted keywords in fixed positions. A new keyword that
    finds all positions taken starts at 1 in the position of least (count,
    position). That position comes from a heap whose outdated entries are
    skipped as they surface, so an update costs O(log cap)."""

    def __init__(self, entries: list[list], cap: int):
        self.cap = cap
        self.words = [k for k, _ in entries]
        self.counts = [int(c) for _, c in entries]
        self.where = {k: p for p, k in enumerate(self.words)}
        self.heap = [(c, p) for p, c in enumerate(self.counts)]
        heapq.heapify(self.heap)
        self.changed: set[int] = set()

    def _set(self, position: int, count: int) -> None:
        self.counts[position] = count
        heapq.heappush(self.heap, (count, position))
        self.changed.add(position)

    def _weakest(self) -> int:
        while self.heap[0][0] != self.counts[self.heap[0][1]]:
            heapq.heappop(self.heap)
        return self.heap[0][1]

    def add(self, keyword: str | None) -> None:
        word = (keyword or "").strip().lower()
        if not word:
            return
        at = self.where.get(word)
        if at is not None:
            self._set(at, self.counts[at] + 1)
            return
        if len(self.words) < self.cap:
            at = len(self.words)
            self.words.append(word)
            self.counts.append(0)
        else:
            at = self._weakest()
            del self.where[self.words[at]]
            self.words[at] = word
        self.where[word] = at
        self._set(at, 1)

    def entries(self) -> list[list]:
        return [[w, c] for w, c in zip(self.words, self.counts, strict=True)]


def _index_fn(cap: int):
    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "seq"], kind="mergesort")
        index = CappedIndex(json.loads(state.get[0]) if state.exists else [], cap)
        for word in pdf["matched_keyword"]:
            index.add(word)
        state.update((json.dumps(index.entries()),))
        at = sorted(index.changed)
        yield pd.DataFrame({"category": key[0], "position": at, "keyword": [index.words[p] for p in at], "count": [index.counts[p] for p in at]})

    return fn


def stream_keyword_index(new_hits: DataFrame, cap: int = KEYWORDS_PER_CATEGORY) -> DataFrame:
    """Per category, the entries of the capped keyword index that a micro-batch changed
    (input: counted hits, i.e. ``is_new`` rows of R8/W5)."""
    h = new_hits.where("is_new").select("category", "ts", "seq", "matched_keyword")
    return h.groupBy("category").applyInPandasWithState(
        _index_fn(cap), INDEX_OUT_SCHEMA, INDEX_STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout
    )
