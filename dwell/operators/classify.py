"""Rule classification of a sessions/events table (F5-F7 over J1-J3).

Every lookup is an equi-join against a small dimension built from the rules
document; the dimensions are broadcast only after their row count is checked,
so the fact table is never shuffled for classification.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.functions import text as T
from dwell.sources import rules as R

BROADCAST_ROW_LIMIT = 2_000_000
LOCAL_DIM_ROW_LIMIT = 100_000  # config-derived dimensions up to this size become local relations


def checked_broadcast(df: DataFrame, limit_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint only when the side is proven small; otherwise leave the
    choice to the planner (sort-merge join, AQE may still broadcast at runtime)."""
    n = df.count()
    return F.broadcast(df) if n <= limit_rows else df


_CACHE: dict = {}


def _doc_size(doc) -> int | None:
    """Rows a rules / keyword document can yield (known without a Spark job)."""
    if isinstance(doc, dict):
        n = 0
        for v in doc.values():
            if isinstance(v, dict):
                n += len(v.get("apps", []) or []) + len(v.get("domains", []) or [])
            else:
                n += len(v or [])
        return n
    return None


@dataclass
class RuleSet:
    """Pre-built dimensions (cached in the driver as small DataFrames)."""

    apps: DataFrame
    domains: DataFrame
    keywords: DataFrame | None
    rules: DataFrame

    @classmethod
    def build(
        cls,
        spark: SparkSession,
        rules: dict | str = R.DEFAULT_RULES,
        keyword_index: dict | str | None = None,
    ) -> "RuleSet":
        import json as _json

        key = (id(spark), _json.dumps(rules, sort_keys=True, default=str), _json.dumps(keyword_index, sort_keys=True, default=str))
        if key in _CACHE:
            return _CACHE[key]
        rdf = R.rules_frame(spark, rules)

        def bcast(df: DataFrame, doc) -> DataFrame:
            # A dict document bounds the dimension's rows without running a job.
            # Such a small dimension is derived once per session and re-embedded
            # as a local relation: broadcasting it then needs no stage per query,
            # and unlike a cached relation it does not block shuffle reuse.
            n = _doc_size(doc)
            if n is not None and n <= LOCAL_DIM_ROW_LIMIT:
                return F.broadcast(spark.createDataFrame(df.collect(), df.schema))
            if n is not None:
                return F.broadcast(df) if n <= BROADCAST_ROW_LIMIT else df
            return checked_broadcast(df)

        kw = None
        if keyword_index is not None:
            kw = bcast(R.keyword_dim(R.keyword_index_frame(spark, keyword_index), rdf), keyword_index)
        # Not .cache()d on purpose: a cached relation inside a shuffle's subtree
        # stops AQE from reusing that shuffle across branches (the dimensions are
        # tiny; re-deriving them costs far less than a second full shuffle).
        out = cls(
            apps=bcast(R.app_dim(rdf), rules),
            domains=bcast(R.domain_dim(rdf), rules),
            keywords=kw,
            rules=rdf,
        )
        _CACHE[key] = out
        return out


def classify(
    df: DataFrame,
    ruleset: RuleSet,
    app: str = "app",
    title: str = "title",
    url: str = "url",
    variant: str = "v1",
    prefix: str = "",
) -> DataFrame:
    """Label each row.

    ``variant="v1"`` (newer engine, ``rules-v1``): idle -> app -> host/path ->
    Unknown; app/title/host/path trimmed; emits ``rule_id``.
    ``variant="legacy"``: idle -> app -> host/path (keyword index first on
    ambiguous hosts) -> keyword index -> Unknown; no trimming; emits
    ``matched_keyword`` (the keyword whose hit decided the label) and, with a
    keyword index, ``index_hit`` (keyword, category, productive): the first title candidate
    that the index holds, whatever decided the label.

    Adds ``category``, ``is_productive``, ``rule_id`` / ``matched_keyword``
    (names prefixed with ``prefix``).
    """
    trim = (lambda c: F.trim(c)) if variant == "v1" else (lambda c: c)
    app_n = F.lower(trim(F.coalesce(F.col(app), F.lit(""))))
    title_n = F.lower(trim(F.coalesce(F.col(title), F.lit(""))))
    d = df.withColumns(
        {
            "_app_n": app_n,
            "_idle": (app_n == "idle") | (title_n == "idle"),
            "_host": trim(T.url_host(url)),
            "_path": F.lower(trim(T.url_path(url))),
        }
    )
    apps = ruleset.apps.select(
        F.col("app_token").alias("_app_n"), F.col("category").alias("_a_cat"), F.col("productive").alias("_a_prod")
    )
    doms = ruleset.domains.select(F.col("host").alias("_host"), F.col("rules").alias("_d_rules"))
    d = d.join(apps, "_app_n", "left").join(doms, "_host", "left")
    d = d.withColumn(
        "_dm", F.get(F.filter("_d_rules", lambda r: F.startswith(F.col("_path"), r.getField("prefix"))), 0)
    )
    app_hit = F.col("_a_cat").isNotNull()
    dom_hit = F.col("_dm").isNotNull()

    if variant == "v1":
        out = d.withColumns(
            {
                f"{prefix}category": F.when(F.col("_idle"), F.lit("Idle"))
                .when(app_hit, F.col("_a_cat"))
                .when(dom_hit, F.col("_dm.category"))
                .otherwise(F.lit("Unknown")),
                f"{prefix}is_productive": F.when(F.col("_idle"), F.lit(False))
                .when(app_hit, F.col("_a_prod"))
                .when(dom_hit, F.col("_dm.productive"))
                .otherwise(F.lit(False)),
                f"{prefix}rule_id": F.when(F.col("_idle"), F.lit("idle"))
                .when(app_hit, F.concat(F.lit("app:"), F.col("_app_n")))
                .when(dom_hit, F.concat(F.lit("domain:"), F.col("_host"), F.col("_dm.prefix")))
                .otherwise(F.lit(None).cast("string")),
            }
        )
        return out.drop("_app_n", "_idle", "_host", "_path", "_a_cat", "_a_prod", "_d_rules", "_dm")

    # legacy: keyword index lookup over the two ordered title candidates
    if ruleset.keywords is not None:
        cands = T.keyword_candidates(title)
        d = d.withColumns({"_k1": F.get(cands, 0), "_k2": F.get(cands, 1)})
        for i in (1, 2):
            kd = ruleset.keywords.select(
                F.col("keyword").alias(f"_k{i}"),
                F.col("category").alias(f"_k{i}_cat"),
                F.col("productive").alias(f"_k{i}_prod"),
            )
            d = d.join(kd, f"_k{i}", "left")
        kw_hit = F.col("_k1_cat").isNotNull() | F.col("_k2_cat").isNotNull()
        kw_cat = F.coalesce("_k1_cat", "_k2_cat")
        kw_prod = F.when(F.col("_k1_cat").isNotNull(), F.col("_k1_prod")).otherwise(F.col("_k2_prod"))
        kw_word = F.when(F.col("_k1_cat").isNotNull(), F.col("_k1")).otherwise(F.col("_k2"))
    else:
        kw_hit = F.lit(False)
        kw_cat = kw_prod = kw_word = F.lit(None)

    hit = F.when(kw_hit, F.struct(kw_word.cast("string").alias("keyword"), kw_cat.cast("string").alias("category"), kw_prod.cast("boolean").alias("productive")))
    use_kw = ~F.col("_idle") & ~app_hit & kw_hit & (~dom_hit | T.is_ambiguous_host(F.col("_host")))
    out = d.withColumns(
        {
            f"{prefix}category": F.when(F.col("_idle"), F.lit("Idle"))
            .when(app_hit, F.col("_a_cat"))
            .when(use_kw, kw_cat)
            .when(dom_hit, F.col("_dm.category"))
            .otherwise(F.lit("Unknown")),
            f"{prefix}is_productive": F.when(F.col("_idle"), F.lit(False))
            .when(app_hit, F.col("_a_prod"))
            .when(use_kw, kw_prod.cast("boolean"))
            .when(dom_hit, F.col("_dm.productive"))
            .otherwise(F.lit(False)),
            f"{prefix}matched_keyword": F.when(use_kw, kw_word.cast("string")),
            **({f"{prefix}index_hit": hit} if ruleset.keywords is not None else {}),
        }
    )
    return out.drop(
        "_app_n", "_idle", "_host", "_path", "_a_cat", "_a_prod", "_d_rules", "_dm",
        "_k1", "_k2", "_k1_cat", "_k2_cat", "_k1_prod", "_k2_prod",
    )


def classify_v1(df: DataFrame, ruleset: RuleSet, **kw) -> DataFrame:
    """F7 ``rules-v1``: adds category_id, confidence 1.0, rule_id and meta map."""
    out = classify(df, ruleset, variant="v1", **kw)
    return (
        out.withColumnRenamed("category", "category_id")
        .withColumn("confidence", F.lit(1.0))
        .withColumn("meta", F.create_map(F.lit("productive"), F.col("is_productive")))
    )


ENGINE_VERSION = "rules-v1"
