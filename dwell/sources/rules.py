"""Category rules and keyword index sources.

A rules document maps category -> {apps: [...], domains: [...], productive}.
It is read with Spark (``from_json`` into an ordered map, then
``posexplode``), so file order survives: apps are last-wins, equal-length
domain prefixes are first-wins.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwell.session import path_exists

RULES_SCHEMA = "map<string, struct<apps: array<string>, domains: array<string>, productive: boolean>>"
KEYWORD_INDEX_SCHEMA = "map<string, array<struct<keyword: string, count: bigint>>>"

# ---------------------------------------------------------------------------
# The default category rules (category -> apps, domains,
# productive), in file order. Classification results depend on them exactly.
# ---------------------------------------------------------------------------
DEFAULT_RULES: dict[str, dict] = {
    "Coding": {
        "apps": ["VSCode", "Visual Studio Code", "Code", "PyCharm", "Electron", "IntelliJ", "Terminal", "iTerm"],
        "domains": ["localhost", "127.0.0.1"],
        "productive": True,
    },
    "Docs & Learning": {
        "apps": ["preview"],
        "domains": [
            "docs.python.org", "developer.mozilla.org", "readthedocs.io", "arxiv.org", "overleaf.com",
            "neetcode.io", "leetcode.com", "stackexchange.com", "stackoverflow.com", "platform.openai.com/docs",
            "www.udemy.com", "workspace.google.com", "www.microsoft.com", "word.cloud.microsoft",
            "www.office.com", "www.umontreal.ca", "authentification.umontreal.ca", "sites.google.com",
        ],
        "productive": True,
    },
    "Communication": {
        "apps": ["Mail", "Outlook", "Slack"],
        "domains": [
            "mail.google.com", "outlook.office.com", "outlook.live.com", "slack.com", "accounts.google.com",
            "login.microsoftonline.com", "outlook.office365.com",
        ],
        "productive": True,
    },
    "Meetings": {
        "apps": ["Zoom", "Google Meet"],
        "domains": ["meet.google.com", "zoom.us"],
        "productive": True,
    },
    "Research": {
        "apps": [],
        "domains": [
            "www.google.com/search", "google.com/search", "bing.com/search", "duckduckgo.com", "wikipedia.org",
            "chatgpt.com", "github.com", "scholar.google.com", "openreview.net", "text-compare.com",
            "platform.openai.com", "www.geeksforgeeks.org", "m365.cloud.microsoft",
            "gemini.google.com",
        ],
        "productive": True,
    },
    "Productivity": {
        "apps": ["Notion", "Word", "Excel", "PowerPoint", "Pages"],
        "domains": [
            "notion.so", "docs.google.com", "sheets.google.com", "slides.google.com", "drive.google.com",
            "calendar.google.com",
        ],
        "productive": True,
    },
    "Social/Forums": {
        "apps": [],
        "domains": [
            "www.reddit.com", "reddit.com", "www.zhihu.com", "zhihu.com", "www.hupu.com", "hupu.com",
            "twitter.com", "x.com", "quora.com", "discord.com", "www.linkedin.com", "blog.liinks.co",
        ],
        "productive": False,
    },
    "Shopping": {
        "apps": [],
        "domains": ["amazon.com", "amazon.ca", "ebay.com", "aliexpress.com", "www.amazon.ca"],
        "productive": False,
    },
    "Entertainment": {
        "apps": ["YouTube", "Netflix", "Prime Video", "Music", "Spotify"],
        "domains": [
            "youtube.com", "youtu.be", "netflix.com", "primevideo.com", "spotify.com", "music.apple.com",
            "www.youtube.com", "www.primevideo.com", "www.rottentomatoes.com",
        ],
        "productive": False,
    },
    "Gaming": {
        "apps": ["RuneScape", "League of Legends", "Steam", "riot client", "leagueclientux", "leagueoflegends"],
        "domains": ["lichess.org"],
        "productive": False,
    },
    "Utilities": {
        "apps": ["Finder", "System Preferences", "Settings", "App Store", "system settings"],
        "domains": ["auth.openai.com"],
        "productive": False,
    },
}

# Hosts whose rule label is re-checked against the keyword index,
# and app names treated as browsers.
AMBIGUOUS_HOSTS = ["www.google.com", "google.com", "www.bing.com", "bing.com", "www.chatgpt.com", "chatgpt.com"]
BROWSER_APPS = [
    "chrome", "google chrome", "firefox", "mozilla firefox", "safari", "edge", "microsoft edge", "brave", "arc",
    "opera", "vivaldi",
]

# Our own keyword index used by the keyword queries and tests (category -> keywords
# in index order). "youtube video" comes from the reference's keyword test.
DEFAULT_KEYWORD_INDEX: dict[str, list[dict]] = {
    "Entertainment": [{"keyword": "youtube video", "count": 1}, {"keyword": "google maps", "count": 3}],
    "Docs & Learning": [{"keyword": "engineering guide", "count": 2}],
    "Research": [{"keyword": "search results", "count": 5}, {"keyword": "google maps", "count": 9}],
    "Coding": [{"keyword": "main", "count": 4}],
}


def _doc_frame(spark: SparkSession, doc: dict | str | Path, schema: str) -> DataFrame:
    """One-row frame holding the parsed document (dict, JSON text or path)."""
    if isinstance(doc, dict):
        text_df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    elif isinstance(doc, Path) or (isinstance(doc, str) and not doc.lstrip().startswith("{")):
        text_df = spark.read.text(str(doc), wholetext=True)
    else:
        text_df = spark.createDataFrame([(doc,)], "value string")
    return text_df.select(F.from_json("value", schema).alias("doc"))


def rules_frame(spark: SparkSession, rules: dict | str | Path = DEFAULT_RULES) -> DataFrame:
    """(cat_ord, category, apps, domains, productive), one row per category."""
    doc = _doc_frame(spark, rules, RULES_SCHEMA)
    return doc.select(F.posexplode(F.map_entries("doc")).alias("cat_ord", "e")).select(
        "cat_ord",
        F.col("e.key").alias("category"),
        F.coalesce(F.col("e.value.apps"), F.array().cast("array<string>")).alias("apps"),
        F.coalesce(F.col("e.value.domains"), F.array().cast("array<string>")).alias("domains"),
        F.coalesce(F.col("e.value.productive"), F.lit(False)).alias("productive"),
    )


def app_dim(rules_df: DataFrame) -> DataFrame:
    """J1 dimension: (app_token, category, productive); duplicate token -> last in file wins."""
    ex = rules_df.select(
        "cat_ord", "category", "productive", F.posexplode("apps").alias("pos", "tok")
    ).select("cat_ord", "pos", "category", "productive", F.lower(F.trim("tok")).alias("app_token"))
    w = Window.partitionBy("app_token").orderBy(F.desc("cat_ord"), F.desc("pos"))
    return (
        ex.where(F.col("app_token") != "")
        .withColumn("_r", F.row_number().over(w))
        .where("_r = 1")
        .select("app_token", "category", "productive")
    )


def domain_rows(rules_df: DataFrame) -> DataFrame:
    """(host, prefix, category, productive, cat_ord, pos): one row per domain token."""
    ex = rules_df.select(
        "cat_ord", "category", "productive", F.posexplode("domains").alias("pos", "tok")
    ).withColumn("tok", F.lower(F.trim("tok")))
    has_sep = F.instr("tok", "/") > 0
    rest = F.trim(F.when(has_sep, F.expr("substr(tok, instr(tok, '/') + 1)")).otherwise(F.lit("")))
    prefix = F.when(has_sep & (rest != "") & ~rest.startswith("/"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return (
        ex.where(F.col("tok") != "")
        .select(
            F.trim(F.substring_index("tok", "/", 1)).alias("host"),
            prefix.alias("prefix"),
            "category",
            "productive",
            "cat_ord",
            "pos",
        )
        .where(F.col("host") != "")
    )


def domain_dim(rules_df: DataFrame) -> DataFrame:
    """J2 dimension: host -> rules sorted most-specific first (longest prefix,
    then file order), so a lookup is one equi-join plus an array scan."""
    rows = domain_rows(rules_df)
    entry = F.struct(
        (-F.length("prefix")).alias("neg_len"),
        F.col("cat_ord"),
        F.col("pos"),
        F.col("prefix"),
        F.col("category"),
        F.col("productive"),
    )
    return rows.groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("rules"))


def keyword_index_frame(spark: SparkSession, index: dict | str | Path = DEFAULT_KEYWORD_INDEX) -> DataFrame:
    """S6 source: (category, cat_ord, ord, keyword, count); bad/missing JSON -> empty."""
    if isinstance(index, (str, Path)) and not str(index).lstrip().startswith("{") and not path_exists(spark, str(index)):
        index = {}
    doc = _doc_frame(spark, index, KEYWORD_INDEX_SCHEMA)
    return (
        doc.select(F.posexplode(F.map_entries(F.coalesce("doc", F.create_map().cast(KEYWORD_INDEX_SCHEMA)))).alias("cat_ord", "e"))
        .select("cat_ord", F.col("e.key").alias("category"), F.posexplode("e.value").alias("ord", "kw"))
        .select(
            "category",
            "cat_ord",
            "ord",
            F.lower(F.trim(F.coalesce("kw.keyword", F.lit("")))).alias("keyword"),
            F.coalesce("kw.count", F.lit(0)).alias("count"),
        )
    )


def keyword_dim(kw_index: DataFrame, rules_df: DataFrame) -> DataFrame:
    """J3 dimension (keyword, category, productive): first category in index order
    wins; productive comes from the rules (unknown category -> false)."""
    w = Window.partitionBy("keyword").orderBy("cat_ord", "ord")
    first = kw_index.where(F.col("keyword") != "").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    prod = rules_df.select("category", F.col("productive").alias("_p"))
    return first.join(F.broadcast(prod), "category", "left").select(
        "keyword", "category", F.coalesce("_p", F.lit(False)).alias("productive")
    )
