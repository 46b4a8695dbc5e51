"""Keyword learning.

Keyword hits come from the legacy classifier (``matched_keyword``); a hit is
counted once per keyword session of its context (W5). External suggestions
arrive as a table (or from a ``mapInPandas`` labeller run on the deduplicated
backlog only) and are joined back by keyword; accepted ones become new rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwell.functions import text as T
from dwell.operators import ordered as O
from dwell.operators.sessionize import seconds_between

KEYWORDS_PER_CATEGORY = 500
KEYWORD_SESSION_RESET_SECONDS = 120


def keyword_hits(classified: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows decided by a keyword, with their context key."""
    return classified.where(F.col("matched_keyword").isNotNull()).withColumn(
        "context_key", T.context_key(F.col("app"), T.url_host(F.col("url")), F.col("title"))
    )


def keyword_sessions(
    hits: DataFrame,
    reset_seconds: float = KEYWORD_SESSION_RESET_SECONDS,
    ts: str = "ts",
    seq: str = "seq",
    bucket_seconds: int | None = O.DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Per context, a hit is new unless the previous hit of that context had
    the same keyword less than ``reset_seconds`` earlier (every hit refreshes
    the clock). Hits without a context key are never counted. Output:
    (context_key, ts, seq, category, matched_keyword, is_new)."""
    # a fixed projection: the summary branch and the row branch then carry the
    # same columns and share one shuffle (see ordered._whole_row)
    h = hits.where(F.col("context_key").isNotNull() & (F.col("context_key") != "")).select(
        "context_key", ts, seq, "category", "matched_keyword"
    )
    h = O.with_prev(h, ["context_key"], [ts, seq], ["matched_keyword", ts], bucket_seconds, prefix="_p", has_prev="_hp")
    same = (
        F.col("_hp")
        & (F.col("_pmatched_keyword") == F.col("matched_keyword"))
        & (seconds_between(F.col(f"_p{ts}"), F.col(ts)) < reset_seconds)
    )
    return h.withColumn("is_new", ~F.coalesce(same, F.lit(False))).drop("_pmatched_keyword", f"_p{ts}", "_hp", O.BUCKET)


def keyword_counts(sessions: DataFrame, first_count: int = 1, ts: str = "ts") -> DataFrame:
    """A5: hits per (category, keyword), one per keyword session; ``first_count``
    = 2 reproduces the external-label path that counts a new keyword twice."""
    g = sessions.groupBy("category", F.col("matched_keyword").alias("keyword")).agg(
        F.sum(F.col("is_new").cast("long")).alias("hits"), F.min(ts).alias("first_seen")
    )
    return g.where(F.col("hits") > 0).withColumn("count", F.col("hits") + F.lit(first_count - 1)).drop("hits")


def keyword_top_k(counts: DataFrame, k: int = KEYWORDS_PER_CATEGORY, salt_buckets: int = 64) -> DataFrame:
    """A6 (batch): the ``k`` most counted keywords per category (ties: earlier
    first_seen, then keyword). Two-phase: top-k inside (category, salt) groups,
    then per category over at most k * salt_buckets rows, so a category holding
    most keywords is never ranked in one task."""
    order = [F.desc("count"), F.asc("first_seen"), F.asc("keyword")]
    salted = counts.withColumn("_salt", F.abs(F.xxhash64("keyword")) % salt_buckets)
    w1 = Window.partitionBy("category", "_salt").orderBy(*order)
    cand = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy("category").orderBy(*order)
    return cand.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k).drop("_salt", "_r")


def _needs_label(host: Column) -> Column:
    """The row has a keyword and is on an ambiguous host or still Unknown."""
    return (F.size(T.keyword_candidates(F.col("title"))) > 0) & (T.is_ambiguous_host(host) | (F.col("category") == "Unknown"))


def label_backlog(classified: DataFrame, ts: str = "ts", seq: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """Rows that need an external label and none of whose title candidates the
    keyword index holds, whatever rule decided the row so far (``index_hit`` of
    ``classify``). One row per keyword (its first occurrence), since labels are
    cached by keyword; keywords of ``known`` have been asked for. A partial aggregate
    (min_by), never a group collect."""
    cands = T.keyword_candidates(F.col("title"))
    host = T.url_host(F.col("url"))
    b = classified.where(_needs_label(host) & F.col("index_hit").isNull()).withColumns(
        {"keyword": F.get(cands, 0), "cache_key": T.context_key(F.col("app"), host, F.col("title"))}
    )
    first = F.min_by(F.struct("app", "title", "url", "cache_key", "category", "is_productive", ts), F.struct(ts, seq))
    g = b.groupBy("keyword").agg(first.alias("f"), F.count(F.lit(1)).alias("rows"))
    if known is not None:
        g = g.join(known.select("keyword").distinct(), "keyword", "left_anti")
    return g.select(
        "keyword", "f.app", "f.title", "f.url", "f.cache_key", F.col("f.category").alias("rule_category"),
        F.col("f.is_productive").alias("rule_productive"), F.col(f"f.{ts}").alias("first_seen"), "rows",
    )


def run_labeller(backlog: DataFrame, labeller: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Call an external labeller on the deduplicated backlog only
    (Arrow batches via ``mapInPandas``); it must return keyword + suggestion."""
    schema = "keyword string, category string, productive boolean, confidence double, rationale string"
    return backlog.select("keyword", "app", "title", "url").mapInPandas(labeller, schema)


def apply_suggestions(classified: DataFrame, suggestions: DataFrame) -> DataFrame:
    """A row that needs a label takes that of its first title candidate with
    one: the keyword index's, else the accepted suggestion's ('Unknown' is none).
    ``label_source`` says which ('index' also where an app, idle or host rule had
    decided the row), ``hit_keyword`` names the keyword (W5 counts its hits).
    Suggestions are one row per keyword (deduplicated backlog).

    Only the rows that an index hit of the first candidate leaves open are joined:
    each brings its candidates as rows, the suggestions meet them, and the answers
    return by a row id; all other rows pass by without a shuffle."""
    sg = suggestions.where(F.col("category").isNotNull() & (F.col("category") != "Unknown")).select(
        F.col("keyword").alias("_k"), F.struct(F.col("category").alias("c"), F.coalesce("productive", F.lit(False)).alias("p"), F.col("keyword").alias("k")).alias("_s")
    )
    cands = T.keyword_candidates(F.col("title"))
    hit = F.col("index_hit")
    d = classified.withColumn("_need", _needs_label(T.url_host(F.col("url"))))
    by_index = F.col("_need") & F.coalesce(hit.getField("keyword") == F.get(cands, 0), F.lit(False))
    d = d.withColumn("_open", F.col("_need") & ~by_index).withColumns({"_k1": F.get(cands, 0), "_k2": F.get(cands, 1)})
    rest = d.where(~F.coalesce("_open", F.lit(False))).withColumn("_s", F.lit(None).cast("struct<c:string,p:boolean,k:string>"))
    todo = d.where("_open")
    # an index hit here is one of the second candidate: only the first may come before it
    todo = todo.join(sg.select(F.col("_k").alias("_k1"), F.col("_s").alias("_s1")), "_k1", "left")
    second = F.when(F.col("_s1").isNull() & hit.isNull(), F.col("_k2"))
    # a row that asks for no second label gets a key that can't match, spread by its hash
    own = [c for c in ("title", "url", "app", "device_id", "ts", "seq") if c in classified.columns]
    spread = F.concat(F.lit("\u0001"), F.xxhash64(*own).cast("string"))
    todo = todo.withColumn("_k2", F.coalesce(second, spread)).join(sg.select(F.col("_k").alias("_k2"), F.col("_s").alias("_s2")), "_k2", "left")
    todo = todo.withColumn("_s", F.coalesce("_s1", "_s2")).drop("_s1", "_s2")
    out = rest.unionByName(todo)
    indexed = F.col("_need") & F.col("_s").isNull() & hit.isNotNull()
    return out.withColumns(
        {
            "label_source": F.when(F.col("_s").isNotNull(), F.lit("suggestion")).when(indexed, F.lit("index")).otherwise(F.lit("rules")),
            "hit_keyword": F.coalesce(F.col("_s.k"), F.when(indexed, hit.getField("keyword")), F.col("matched_keyword")),
            "category": F.coalesce(F.col("_s.c"), F.when(indexed, hit.getField("category")), F.col("category")),
            "is_productive": F.coalesce(F.col("_s.p"), F.when(indexed, hit.getField("productive")), F.col("is_productive")),
        }
    ).drop("_need", "_open", "_k1", "_k2", "_s")


def learned_rules(backlog: DataFrame, suggestions: DataFrame, rules_df: DataFrame) -> DataFrame:
    """Accepted suggestions (not Unknown) of a non-ambiguous host become a
    domain rule (browser or no app with a host) or an app rule (other apps),
    unless the category already has that token. Unknown categories are new."""
    acc = backlog.join(
        suggestions.where(F.col("category") != "Unknown").select("keyword", "category", "productive"), "keyword"
    )
    host = T.url_host(F.col("url"))
    app_norm = F.lower(F.coalesce(F.col("app"), F.lit("")))
    browserish = app_norm.isin(*T.BROWSER_APPS) | (app_norm == "")
    cand = acc.where(~T.is_ambiguous_host(host)).select(
        "category",
        "productive",
        "first_seen",
        "keyword",
        F.when(browserish & (host != ""), F.lit("domain")).when((app_norm != "") & ~browserish, F.lit("app")).alias("kind"),
        F.when(browserish & (host != ""), host).when((app_norm != "") & ~browserish, app_norm).alias("token"),
    ).where(F.col("kind").isNotNull())
    existing = rules_df.select(
        "category", F.explode(F.array_union(
            F.transform("apps", lambda a: F.concat(F.lit("app|"), F.lower(a))),
            F.transform("domains", lambda d: F.concat(F.lit("domain|"), F.lower(d))),
        )).alias("_t")
    )
    cand = cand.withColumn("_t", F.concat("kind", F.lit("|"), "token"))
    # one row per rule token; whether that is small is known at run time, so the join is left to AQE
    new = cand.join(existing, ["category", "_t"], "left_anti").drop("_t")
    # the earliest suggestion decides the flag (it creates a new category)
    return new.groupBy("category", "kind", "token").agg(
        F.min_by("productive", F.struct("first_seen", "keyword")).alias("productive"),
        F.min("first_seen").alias("first_seen"),
    )


def derived_suggestions(backlog: DataFrame) -> DataFrame:
    """Test labeller as a table: one suggestion per backlog keyword, category by
    length(keyword) % 3 (one of them 'Unknown')."""
    m = F.length("keyword") % 3
    return backlog.select(
        "keyword",
        F.when(m == 0, F.lit("Research")).when(m == 1, F.lit("Shopping")).otherwise(F.lit("Unknown")).alias("category"),
        (F.length("keyword") % 2 == 0).alias("productive"),
        F.lit(0.5).alias("confidence"),
        F.lit("derived").alias("rationale"),
    )


def suggestion_messages(backlog: DataFrame) -> DataFrame:
    """Raw labeller replies (JSON text) for F17: some lack a category or carry a
    non-boolean productive flag."""
    m = F.length("keyword") % 4
    msg = (
        F.when(m == 0, F.to_json(F.struct(F.lit("Research").alias("category"), F.lit(True).alias("productive"))))
        .when(m == 1, F.to_json(F.struct(F.lit(False).alias("productive"), F.lit(0.9).alias("confidence"))))
        .when(m == 2, F.to_json(F.struct(F.lit("").alias("category"), F.lit("fine").alias("rationale"))))
        .otherwise(F.to_json(F.struct(F.lit("Shopping").alias("category"), F.lit(None).cast("boolean").alias("productive"))))
    )
    return backlog.select("keyword", msg.alias("message"))
