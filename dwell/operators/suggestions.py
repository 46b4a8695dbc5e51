"""Asking an external labeller once per keyword, over all runs.

Answers and failures are rows of the store's ``suggestions`` table. Before a run the
backlog loses the keywords that have an answer, or have failed too often; what is
left is asked, one call per keyword, inside the tasks that write the answers, and
committed as a whole. A labeller that raises leaves a failed row: the keyword's rows
keep their rule label, and the next run tries again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.streaming.store import SCHEMAS, Store

MAX_ATTEMPTS = 3
#: (app, title, url) -> {"category": str, "productive": bool, "confidence": float, "rationale": str}, all optional
Labeller = Callable[[str | None, str | None, str | None], dict | None]


def to_ask(store: Store, backlog: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Backlog keywords (P13) that the store has no answer for, with the number of the coming attempt."""
    known = store.suggestions().select("keyword", F.col("ok").alias("_ok"), F.col("attempt").alias("_n"))
    j = backlog.join(known, "keyword", "left")
    left = F.col("_n").isNull() | (~F.col("_ok") & (F.col("_n") < max_attempts))
    return j.where(left).select("keyword", "app", "title", "url", (F.coalesce("_n", F.lit(0)) + 1).alias("attempt"))


def ask(store: Store, backlog: DataFrame, labeller: Labeller, run: str | None = None, max_attempts: int = MAX_ATTEMPTS) -> bool:
    """Ask for what is missing and commit the answers; False if this ``run`` has been committed already.
    A lost task is run again and may repeat its calls, never its rows."""
    run = run or uuid.uuid4().hex
    if store.is_committed("suggestions", run, 0):
        return False

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    s = labeller(r.app, r.title, r.url) or {}
                    confidence = s.get("confidence")
                    answer = (str(s.get("category") or "Unknown"), bool(s.get("productive", False)), None if confidence is None else float(confidence), s.get("rationale"), True)
                except Exception as e:  # the labeller is foreign code: whatever it raises is its failure
                    answer = (None, None, None, f"{type(e).__name__}: {e}", False)
                rows.append((r.keyword, *answer, int(r.attempt), pd.Timestamp.now(tz="UTC")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMAS["suggestions"].split(", ")])

    asked = to_ask(store, backlog, max_attempts).mapInPandas(call, SCHEMAS["suggestions"])
    return store.commit("suggestions", run, 0, {"suggestions": asked})


def accepted(store: Store) -> DataFrame:
    """(keyword, category, productive, confidence, rationale) for ``keywords.apply_suggestions`` and ``learned_rules``."""
    return store.suggestions().where("ok AND category <> 'Unknown'").select("keyword", "category", "productive", "confidence", "rationale")
