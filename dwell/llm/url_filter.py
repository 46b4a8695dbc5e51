"""URL filter: host-suffix / path-prefix expressions against hashed rules (native).

Each distinct (host, path) is expanded into the expressions a rule could be
filed under: every label suffix of the host joined with every directory prefix
of the path, down to the deepest rule. The expressions meet the rules in an
equi-join on a short hash prefix; the full digest confirms the hit, the rule's
own path prefix is checked, and the longest rule wins.

Everything is built-in column expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.common import table, write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: (action, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
PREFIX_HEX = 8  # 32-bit hash prefixes, as hex digits
DEFAULT_VERDICT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased. Path: then up to ``?``, ``#`` or the end. Null or no ``://``:
    both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path, rule, dir, digest): ``dir`` is the rule's path up to
    its last slash, the directory it is filed under."""
    df = spark.createDataFrame(rules, "action string, r_host string, r_path string")
    df = df.select(
        "action",
        F.translate("r_host", UPPER, LOWER).alias("r_host"),
        F.coalesce("r_path", F.lit("")).alias("r_path"),
    ).distinct()
    d = F.regexp_extract("r_path", r"(?s)^.*/", 0)
    return df.select("*", F.concat("r_host", "r_path").alias("rule"), F.sha2(F.concat("r_host", F.lit("\n"), d), 256).alias("digest"))


def expressions(host: Column, path: Column, max_labels: int, max_dirs: int) -> Column:
    """Array of ``suffix \\n directory`` expressions, suffixes of at most
    ``max_labels`` labels and directories of at most ``max_dirs`` slashes: no
    rule is filed deeper, so nothing that could match is left out."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max_labels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    parts = F.split(path, "/", max_dirs + 1)
    n_dirs = F.least(F.size(parts) - 1, F.lit(max_dirs))
    # directory 0 is the empty one (rules whose path has no slash are filed there)
    dirs = F.transform(
        F.sequence(F.lit(0), n_dirs),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))),
    )
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(dirs, lambda d: F.concat(s, F.lit("\n"), d)))))


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    url_col: str = "url",
    default_verdict: str = DEFAULT_VERDICT,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (default: all but clashing ones) + host, path, rule, verdict.

    Every input row gives one row, repeated rows and null ids too. Null or
    scheme-less urls have empty host and path and get the default verdict, as
    does a url that no rule fits. Of several rules that fit, the longest
    (host plus path) wins; equally long ones: the longer host, then block.
    An empty rule list leaves every row at the default. An empty table gives an
    empty result. Input columns named like an output are replaced."""
    spark = pages.sparkSession
    out_cols = ["host", "path", "rule", "verdict"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in out_cols]
    host, path = url_parts(F.col(url_col))
    rows = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    max_labels = max([len((h or "").split(".")) for _, h, _ in rules], default=0)
    max_dirs = max([(p or "").count("/") for _, _, p in rules], default=0)

    urls = rows.select("host", "path").distinct()
    ex = urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), max(1, max_labels), max_dirs)).alias("expr"))
    ex = ex.select("host", "path", F.sha2("expr", 256).alias("digest")).withColumn("hp", F.substring("digest", 1, PREFIX_HEX))
    rf = rule_frame(spark, rules).select("action", "r_host", "r_path", "rule", F.col("digest").alias("r_digest"), F.substring("digest", 1, PREFIX_HEX).alias("hp"))
    # the rules are a parameter; whether their side is broadcast is the planner's choice, by its size
    hits = ex.join(rf, "hp").where((F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path")))
    rank = F.struct(F.length("rule"), F.length("r_host"), (F.col("action") == "block"), "rule", "action")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("b")).select("host", "path", F.col("b.rule").alias("rule"), F.col("b.action").alias("action"))
    # written, so that the join has plain shuffles on both sides and a popular url (or the empty one) can be split
    best = write_table(best, "url-best")
    j = rows.join(best, ["host", "path"], "left")
    return j.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "host",
        "path",
        "rule",
        F.coalesce("action", F.lit(default_verdict)).alias("verdict"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), keep=["page_id"])


ORACLE = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
f AS (
  SELECT *, (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') AS f1,
    (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') AS f2,
    (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') AS f3,
    (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') AS f4,
    (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') AS f5 FROM q)
SELECT page_id, host, path,
  CASE WHEN f3 THEN 'www.example.com/en/' WHEN f2 THEN 'example.com/en/' WHEN f4 THEN 'net/es/' WHEN f5 THEN 'net/fr/' WHEN f1 THEN 'com/' END AS rule,
  CASE WHEN f3 THEN 'allow' WHEN f2 OR f4 OR f5 THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
