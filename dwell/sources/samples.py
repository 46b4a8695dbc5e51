"""Adapters from the shared test tables to activity-log shaped inputs.

The test tables hold no activity log, so ``samples_from_events`` derives one
deterministically from ``events`` with plain projections (no join: the six
title/url links are a literal array indexed by ``k % 6``). Every other derived
input (store events, label logs, snapshots, manifests) is a projection or
filter over ``events`` / ``pages`` / ``documents``, so its size grows with them.
The same derivations are repeated in SQL by ``dwell.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of our test adapter: (title, url) per link index 0..5.
LINKS = [
    ("Prompt engineering guide", "https://chatgpt.com/session"),
    ("r/python - Reddit", "https://www.reddit.com/r/python"),
    ("Search results", "https://www.google.com/search?q=spark&token=abc#top"),
    ("Watching youtube video", "https://unknown.example.com/watch"),
    ("Google Maps", "https://www.google.com/maps/42"),
    ("Untitled", ""),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_seconds(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    # naive timestamps read as UTC wall time, independent of the session zone
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c) / F.lit(1e6)


def samples_from_events(events: DataFrame, device: str = "mod4") -> DataFrame:
    """samples(device_id, ts, seq, app, title, url, idle_seconds).

    ``device="mod4"`` maps users onto four devices (dense per-device streams);
    ``device="user"`` keeps one device per user."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    links = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(u).alias("u")) for t, u in LINKS])
    et = F.col("event_type")
    web = et.isin("view", "click", "purchase")
    if device == "mod4":
        dev = F.concat(F.lit("dev-"), (F.col("user_id") % 4).cast("string"))
    else:
        dev = F.concat(F.lit("dev-"), F.col("user_id").cast("string"))
    e = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    link = F.get(links, F.col("k") % 6)
    return e.select(
        dev.alias("device_id"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.when(et.isin("view", "click"), F.lit("Google Chrome"))
        .when(et == "purchase", F.lit("Firefox"))
        .when(et == "signup", F.lit("Visual Studio Code"))
        .otherwise(F.lit("Idle"))
        .alias("app"),
        F.when(web, link.getField("t"))
        .when(et == "error", F.lit("Idle"))
        .when(F.col("k") % 2 == 0, F.lit("main.py"))
        .otherwise(F.lit("test.py"))
        .alias("title"),
        F.when(web, link.getField("u")).alias("url"),
        (F.col("value") * 10).alias("idle_seconds"),
    )


def store_events(events: DataFrame) -> DataFrame:
    """Store ``events`` table (id, start_ts, end_ts, app, title, url, content_hash,
    created_at); every 50th row has no end and the next one ends before it starts."""
    s = samples_from_events(events)
    start = epoch_seconds("ts")
    m = F.col("seq") % 50
    end = F.when(m == 0, F.lit(None).cast("double")).when(m == 1, start - 1).otherwise(start + F.col("idle_seconds") / 10)
    return s.select(
        F.col("seq").alias("id"),
        start.alias("start_ts"),
        end.alias("end_ts"),
        "app",
        "title",
        F.coalesce("url", F.lit("")).alias("url"),
        F.lit(None).cast("string").alias("content_hash"),
        F.col("ts").alias("created_at"),
        "device_id",
    )


def classification_log(events: DataFrame) -> DataFrame:
    """Append-only engine label log (event_id, engine_version, category_id,
    confidence, rule_id, meta_json, created_at, seq): each valid event once as
    rules-v1, relabelled later when id % 7 = 0, a rules-v0 row when id % 5 = 0,
    and orphan rows (no such event) when id % 100 = 0. One scan: every event
    generates its log rows with ``explode``."""
    se = store_events(events).where("end_ts >= start_ts")
    cat = F.lower(F.col("app"))
    idc = F.col("id")

    def row(cond: Column, event_id: Column, version: str, category: Column, n: int, secs: int) -> Column:
        return F.when(
            cond,
            F.struct(
                event_id.alias("event_id"),
                F.lit(version).alias("engine_version"),
                category.alias("category_id"),
                F.lit(1.0).alias("confidence"),
                F.lit(None).cast("string").alias("rule_id"),
                F.to_json(F.create_map(F.lit("n"), F.lit(n))).alias("meta_json"),
                (F.col("created_at") + F.expr(f"INTERVAL {secs} SECONDS")).alias("created_at"),
                (idc * 10 + n).alias("seq"),
            ),
        )

    rows = F.array(
        row(F.lit(True), idc, "rules-v1", cat, 0, 0),
        row(idc % 7 == 0, idc, "rules-v1", F.lit("relabelled"), 1, 60),
        row(idc % 5 == 0, idc, "rules-v0", F.lit("legacy"), 2, 30),
        row(idc % 100 == 0, -1 - idc, "rules-v1", cat, 3, 0),
    )
    return se.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def override_log(events: DataFrame) -> DataFrame:
    """User override operations (event_id, op, category_id, note, seq):
    set 'focus' when id % 10 = 0, later set 'deep-work' when % 20 = 0, later
    clear when % 40 = 0. One scan + ``explode``."""
    e = F.col("event_id")

    def op(cond: Column, kind: str, cat: str | None, note: str | None, n: int) -> Column:
        return F.when(
            cond,
            F.struct(
                e.alias("event_id"),
                F.lit(kind).alias("op"),
                F.lit(cat).cast("string").alias("category_id"),
                F.lit(note).cast("string").alias("note"),
                (e * 10 + n).alias("seq"),
            ),
        )

    ops = F.array(
        op(e % 10 == 0, "set", "focus", None, 1),
        op(e % 20 == 0, "set", "deep-work", "adjusted", 2),
        op(e % 40 == 0, "clear", None, None, 3),
    )
    return events.select(F.explode(F.filter(ops, lambda r: r.isNotNull())).alias("r")).select("r.*")


def tab_snapshots(pages: DataFrame) -> DataFrame:
    """Browser tab snapshots placed in time: ts = 2024-01-01 + page_id hours,
    device = page_id % 4, title null for odd ids, url prefixed 'about:' when
    page_id % 9 = 0."""
    return pages.select(
        F.concat(F.lit("dev-"), (F.col("page_id") % 4).cast("string")).alias("device_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("page_id").cast("int"))).alias("ts"),
        F.col("page_id").alias("seq"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Page "), F.col("page_id").cast("string"))).alias("title"),
        F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("about:"), F.col("url"))).otherwise(F.col("url")).alias("url"),
    )


def manifests(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remote, state, local) manifests derived from ``documents``."""
    d = documents.select(F.col("doc_id"), F.md5(F.col("text")).alias("md5"))
    nul = F.col("doc_id") % 11 == 0
    name = F.concat(F.lit("activity_"), F.col("doc_id").cast("string"), F.lit(".parquet"))
    remote = d.select(
        F.col("doc_id").alias("file_id"), name.alias("name"), F.when(~nul, F.col("md5")).alias("md5")
    )
    state = d.where(F.col("doc_id") % 3 != 0).select(
        F.col("doc_id").alias("file_id"),
        F.when(nul, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.concat(F.col("md5"), F.lit("x"))).otherwise(F.col("md5")).alias("md5"),
        name.alias("name"),
    )
    local = d.where(F.col("doc_id") % 4 != 0).select(
        name.alias("name"),
        F.when(nul, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.concat(F.col("md5"), F.lit("y"))).otherwise(F.col("md5")).alias("md5"),
    )
    return remote, state, local


def device_settings(events: DataFrame) -> DataFrame:
    """Per-device power settings (device_id, key, value) as strings, derived from
    the devices that appear in ``events`` (values exercise zero and unparsable)."""
    devs = samples_from_events(events).select("device_id").distinct()
    kv = F.array(
        F.struct(F.lit("sleep").alias("key"), F.lit("0").alias("value")),
        F.struct(F.lit("screensaver").alias("key"), F.lit("abc").alias("value")),
        F.struct(F.lit("displaysleep").alias("key"), F.lit("4").alias("value")),
        F.struct(F.lit("screensaver").alias("key"), F.lit("120").alias("value")),
    )
    idx = F.regexp_extract("device_id", "[0-9]+", 0).cast("int") % 4
    return devs.select("device_id", F.explode(F.slice(kv, 1, idx + 1)).alias("kv")).select(
        "device_id", "kv.key", "kv.value"
    )


VISIT_SEQ_OFFSET = 1_000_000_000


def browser_visits(pages: DataFrame) -> DataFrame:
    """Browser samples derived from raw pages: one visit per page at
    2024-01-01 + page_id hours on device page_id % 4, app 'Google Chrome',
    title = the page's <title>, url = the page URL (same columns as samples)."""
    return pages.select(
        F.concat(F.lit("dev-"), (F.col("page_id") % 4).cast("string")).alias("device_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("page_id").cast("int"))).alias("ts"),
        (F.col("page_id") + F.lit(VISIT_SEQ_OFFSET)).alias("seq"),
        F.lit("Google Chrome").alias("app"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("url"),
        F.lit(0.0).alias("idle_seconds"),
    )


EMBEDDED_SEQ_OFFSET = 2_000_000_000


def embedded_visits(events: DataFrame) -> DataFrame:
    """Pages seen inside an app that has a rule of its own: every third 'Firefox'
    sample once more as 'Slack' (so that app rules meet ambiguous hosts and titles
    that the keyword index holds)."""
    s = samples_from_events(events).where((F.col("app") == "Firefox") & (F.col("seq") % 3 == 0))
    return s.withColumns({"app": F.lit("Slack"), "seq": F.col("seq") + F.lit(EMBEDDED_SEQ_OFFSET)})


#: URL forms of our test adapter; {n} is the event's id, {h} the md5 of it, {u} that md5 as a UUID, {t} a long run of words
URL_FORMS = [
    "https://Example.com/item/{n}/view",
    "https://example.com/u/{u}/edit?tab=1",
    "https://example.com/profile/me{n}@example.org/x",
    "https://example.com/t/aaa.{n}.bbb/end",
    "https://example.com/h/{h}/",
    "https://example.com/b/Zz_{n}-abcdefghijklmnopqrstuvwx",
    "https://example.com/p/{t}",
    "https://example.com//a//{n}//",
    "https://user{n}:pw@example.com:8443/a?b=2&a=1#part-{n}",
    "http://EXAMPLE.org?access_token=x{n}&q=ok",
    "https://example.com/s?contact=me{n}@example.org&page=2",
    "https://example.com/s?x={u}&y={h}&z=short",
    "https://example.com/s?blob=abcdefghijklmnopqrstuvwx{n}&lang=en",
    "https://example.com/s?to=https%3A%2F%2Fother.example%2F{n}&u=plain",
    "https://example.com/s?to=https%253A%252F%252Fother.example%252F{n}",
    "https://example.com/s?c=aB3%24{n}.aB3%24aB3%24aB3%24aB3%24aB3%24aB3%24aB3%24aB3%24aB3%24aB3%24aB3%24aB3%24",
    "https://example.com/s?long={t}&empty=&flag",
    "https://example.com/s?a.b.c=1&v=x.{n}.z&B=2&a=3&A=4",
    "https://example.com:99999/bad/{n}",
    "https://example.com/s?PIN={n}&Redirect=/home&next=1",
    "ftp://example.com/{n}?token=1",
    "mailto:someone{n}@example.com",
    "  https://example.com/blank/{n}  ",
    "about:blank#{n}",
]


def url_forms(events: DataFrame) -> DataFrame:
    """URLs of every kind that the sanitizer tells apart: (src, id, url), a form per event."""
    e = F.col("event_id")
    h = F.md5(e.cast("string"))
    u = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    t = F.concat(F.lit("some+words"), F.repeat(F.lit("+and+more"), 15), e.cast("string"))
    url = F.element_at(F.array(*[F.lit(x) for x in URL_FORMS]), (F.pmod(e, F.lit(len(URL_FORMS))) + 1).cast("int"))
    for mark, value in (("{n}", e.cast("string")), ("{h}", h), ("{u}", u), ("{t}", t)):
        url = F.replace(url, F.lit(mark), value)
    return events.select(F.lit("form").alias("src"), e.alias("id"), url.alias("url"))


TAB_SNAPSHOT_SCHEMA = "url string, title string, tabId bigint, windowId bigint, timestamp string"


def tab_snapshot_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Browser tab messages (JSON lines, fixed schema) as a stream, stamped
    with ``received_at`` on arrival; internal-scheme tabs are filtered (P2)."""
    from dwell.functions.urls import tab_should_transmit

    return (
        spark.readStream.schema(TAB_SNAPSHOT_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(path)
        .where(tab_should_transmit("url"))
        .withColumn("received_at", F.current_timestamp())
    )
