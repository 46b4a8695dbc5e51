"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with their SQL oracles.

Every query reads the shared test tables (or data Spark derives from them) in
full; parameters such as gaps and thresholds are fixed per query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.operators import classify as C
from dwell.operators import ordered as O
from dwell.operators import sessionize as S
from dwell.operators.split import split_midnight
from dwell.plans import oracle as Q
from dwell.plans import reports as RP
from dwell.sources import samples as SM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# --------------------------------------------------------------- shared inputs


def samples(spark: SparkSession, sf: str, device: str = "mod4") -> DataFrame:
    return SM.samples_from_events(SM.load(spark, sf, "events"), device)


def labelled_sessions(spark: SparkSession, sf: str, device: str = "mod4", keep_bucket: bool = False) -> DataFrame:
    """W1 sessions labelled by the legacy rules (no keyword index). With
    ``keep_bucket`` the sessions keep their (device, bucket) partitioning for a
    following ordered scan (stitch, gap fill)."""
    rs = C.RuleSet.build(spark)
    raw = S.sessionize(samples(spark, sf, device))
    out = S.label_sessions(raw, lambda d: C.classify(d, rs, variant="legacy").drop("matched_keyword"))
    cols = S.session_columns(out, extra=[O.BUCKET])
    return cols if keep_bucket else O.drop_bucket(cols)


SESSION_COLS = "start_time, end_time, duration_sec, app, title, url, category, is_productive, device_id"

# ------------------------------------------------------------------ sessions


@register("sessions", Q.sessions_ctes() + f"\nSELECT {SESSION_COLS} FROM sessions")
def q_sessions(spark, sf):
    return labelled_sessions(spark, sf)


@register(
    "split_midnight_exact",
    Q.sessions_ctes("user")
    + """,
parts AS (
  SELECT s.*, d::DATE AS day FROM sessions s,
         unnest(generate_series(CAST(start_time AS DATE), CAST(end_time AS DATE), INTERVAL 1 DAY)) t(d)),
p2 AS (
  SELECT device_id, app, title, url, category, is_productive,
         greatest(start_time, CAST(day AS TIMESTAMP)) AS start_time,
         least(end_time, CAST(day + 1 AS TIMESTAMP)) AS end_time,
         CAST(day - CAST(s_start AS DATE) + 1 AS INTEGER) AS part, s_start, s_end
  FROM (SELECT *, start_time AS s_start, end_time AS s_end FROM parts))
SELECT device_id, app, title, url, category, is_productive, start_time, end_time,
       """
    + Q.secs("start_time", "end_time")
    + """ AS duration_sec, part
FROM p2 WHERE end_time > start_time OR s_start = s_end""",
)
def q_split_exact(spark, sf):
    return split_midnight(labelled_sessions(spark, sf, "user"), mode="exact")


@register(
    "daily_productivity",
    Q.sessions_ctes("user")
    + """,
parts AS (
  SELECT s.*, d::DATE AS day FROM sessions s,
         unnest(generate_series(CAST(start_time AS DATE), CAST(end_time AS DATE), INTERVAL 1 DAY)) t(d)),
p2 AS (
  SELECT is_productive, day,
         greatest(start_time, CAST(day AS TIMESTAMP)) AS ps, least(end_time, CAST(day + 1 AS TIMESTAMP)) AS pe,
         start_time AS s0, end_time AS e0 FROM parts)
SELECT day AS date,
       CASE WHEN is_productive THEN 'productive' WHEN NOT is_productive THEN 'unproductive' ELSE 'unknown' END AS productivity,
       sum("""
    + Q.us("pe")
    + " - "
    + Q.us("ps")
    + """) / 60000000.0 AS minutes, count(*) AS parts
FROM p2 WHERE pe > ps OR s0 = e0 GROUP BY ALL""",
)
def q_daily_productivity(spark, sf):
    return RP.daily_productivity(labelled_sessions(spark, sf, "user"))



def _drop(df: DataFrame) -> DataFrame:
    return O.drop_bucket(df)


def raw_sessions(spark, sf, device="mod4"):
    return S.sessionize(samples(spark, sf, device))


SAMPLES_MOD4 = "WITH " + Q.samples_cte("mod4").strip()
SAMPLES_USER = "WITH " + Q.samples_cte("user").strip()
IDLE_S = 600
GAP_S = 900


# ------------------------------------------------------------------ W2 segments

SEGMENT_CTES = (
    SAMPLES_MOD4
    + f""",
seg_in AS (
  SELECT device_id, ts, seq, app, title, coalesce(url, '') AS url, coalesce(idle_seconds >= {IDLE_S}, FALSE) AS idle
  FROM samples WHERE coalesce(idle_seconds >= {IDLE_S}, FALSE) OR (app IS NOT NULL AND app <> '' AND coalesce(title <> 'frontProcess Error', TRUE))),
seg_k AS (
  SELECT *, idle AS ki, CASE WHEN idle THEN NULL ELSE app END AS ka, CASE WHEN idle THEN NULL ELSE url END AS ku,
         CASE WHEN idle THEN NULL WHEN url = '' THEN title END AS kt FROM seg_in),
seg_l AS (
  SELECT *, row_number() OVER w AS rn, lag(ki) OVER w AS pki, lag(ka) OVER w AS pka, lag(ku) OVER w AS pku,
         lag(kt) OVER w AS pkt
  FROM seg_k WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)),
seg_b AS (
  SELECT * FROM seg_l WHERE rn = 1 OR ki IS DISTINCT FROM pki OR ka IS DISTINCT FROM pka
                         OR ku IS DISTINCT FROM pku OR kt IS DISTINCT FROM pkt),
seg_e AS (SELECT *, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, seq) AS end_time FROM seg_b)"""
)


@register(
    "segments",
    SEGMENT_CTES
    + f"""
SELECT device_id, {Q.us('ts')} / 1e6 AS start_ts, {Q.us('end_time')} / 1e6 AS end_ts, app,
       coalesce(title, '') AS title, url, CAST(NULL AS VARCHAR) AS content_hash
FROM seg_e WHERE end_time IS NOT NULL AND NOT idle""",
)
def q_segments(spark, sf):
    sm = samples(spark, sf)
    return _drop(S.segments(sm, idle=S.is_idle("idle_seconds", IDLE_S)))


# ---------------------------------------------------------------- W3 / W4

#: W2 segments as labelled sessions: idleness leaves holes between them, which W3 and W4 work on
HOLED_SQL = (
    SEGMENT_CTES
    + f""",
segs AS (
  SELECT ts AS start_time, end_time, {Q.secs('ts', 'end_time')} AS duration_sec, app, coalesce(title, '') AS title, url, device_id
  FROM seg_e WHERE end_time IS NOT NULL AND NOT idle),"""
    + Q.rule_dims_cte()
    + ","
    + Q.classify_cte("segs", ["device_id", "start_time"], "seg_c", variant="legacy")
    + f""",
sessions AS (SELECT {SESSION_COLS} FROM seg_c)"""
)


def holed_sessions(spark, sf) -> DataFrame:
    """W2 segments as labelled sessions, still bucketed."""
    seg = S.segments(samples(spark, sf), idle=S.is_idle("idle_seconds", IDLE_S))
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    time = {n: F.timestamp_add("MICROSECOND", F.round(F.col(c) * 1e6).cast("long"), epoch) for n, c in (("start_time", "start_ts"), ("end_time", "end_ts"))}
    seg = seg.withColumns(time).withColumn("duration_sec", S.seconds_between("start_time", "end_time"))
    out = C.classify(seg, C.RuleSet.build(spark), variant="legacy")
    return S.session_columns(out, extra=[O.BUCKET])


@register(
    "stitch",
    HOLED_SQL
    + f""",
st AS (SELECT *, nullif(url, '') AS u FROM sessions),
st_l AS (
  SELECT *, row_number() OVER w AS rn, lag(app) OVER w AS pa, lag(title) OVER w AS pt, lag(u) OVER w AS pu,
         lag(end_time) OVER w AS pe
  FROM st WINDOW w AS (PARTITION BY device_id ORDER BY start_time, end_time)),
st_n AS (
  SELECT *, CASE WHEN rn > 1 AND app IS NOT DISTINCT FROM pa AND title IS NOT DISTINCT FROM pt
                  AND u IS NOT DISTINCT FROM pu AND {Q.secs('pe', 'start_time')} >= 0
                  AND {Q.secs('pe', 'start_time')} <= {GAP_S} THEN 0 ELSE 1 END AS nw FROM st_l),
st_i AS (
  SELECT *, sum(nw) OVER (PARTITION BY device_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS island
  FROM st_n),
st_g AS (
  SELECT device_id, min(start_time) AS start_time, arg_max(end_time, start_time) AS end_time,
         arg_min(app, start_time) AS app, arg_min(title, start_time) AS title, arg_min(url, start_time) AS url,
         arg_min(category, start_time) AS category, arg_min(is_productive, start_time) AS is_productive
  FROM st_i GROUP BY device_id, island)
SELECT start_time, end_time, {Q.secs('start_time', 'end_time')} AS duration_sec, app, title, url, category,
       is_productive, device_id FROM st_g""",
)
def q_stitch(spark, sf):
    return S.stitch(holed_sessions(spark, sf), gap_seconds=GAP_S)


@register(
    "gap_fill",
    HOLED_SQL
    + f""",
gf AS (SELECT *, lead(start_time) OVER (PARTITION BY device_id ORDER BY start_time, end_time) AS ns FROM sessions),
gf2 AS (SELECT *, coalesce({Q.secs('end_time', 'ns')} >= 0 AND {Q.secs('end_time', 'ns')} <= {GAP_S}, FALSE) AS resumed
        FROM gf)
SELECT start_time, CASE WHEN resumed THEN ns ELSE end_time END AS end_time,
       {Q.secs('start_time', 'CASE WHEN resumed THEN ns ELSE end_time END')} AS duration_sec,
       app, title, url, category, is_productive, device_id, resumed FROM gf2""",
)
def q_gap_fill(spark, sf):
    return _drop(S.gap_fill(holed_sessions(spark, sf), gap_seconds=GAP_S))


# ---------------------------------------------------------------- P5-P7

@register(
    "idle_collapse",
    SAMPLES_MOD4
    + f""",
ic AS (SELECT *, coalesce(idle_seconds >= {IDLE_S}, FALSE) AS is_idle FROM samples),
ic_l AS (SELECT *, lag(is_idle) OVER (PARTITION BY device_id ORDER BY ts, seq) AS p FROM ic)
SELECT device_id, ts, seq,
       CASE WHEN is_idle THEN 'Idle' ELSE app END AS app,
       CASE WHEN is_idle THEN 'Idle' ELSE title END AS title,
       CASE WHEN is_idle THEN NULL ELSE url END AS url,
       idle_seconds, is_idle
FROM ic_l WHERE NOT is_idle OR NOT coalesce(p, FALSE)""",
)
def q_idle_collapse(spark, sf):
    sm = samples(spark, sf)
    return _drop(S.collapse_idle(sm, S.is_idle("idle_seconds", IDLE_S)))


DEVICE_SETTINGS_SQL = """
devs AS (SELECT DISTINCT device_id FROM samples),
settings AS (
  SELECT device_id, kv.key AS key, kv.value AS value FROM (
    SELECT device_id, unnest(list_slice([
        {'key': 'sleep', 'value': '0'}, {'key': 'screensaver', 'value': 'abc'},
        {'key': 'displaysleep', 'value': '4'}, {'key': 'screensaver', 'value': '120'}],
        1, CAST(regexp_extract(device_id, '[0-9]+', 0) AS INTEGER) % 4 + 1)) AS kv FROM devs))"""


@register(
    "idle_threshold",
    SAMPLES_MOD4
    + ","
    + DEVICE_SETTINGS_SQL
    + """
SELECT device_id, least(300, coalesce(min(
  CASE WHEN key IN ('displaysleep', 'sleep') AND TRY_CAST(value AS INTEGER) > 0
         THEN greatest(1, TRY_CAST(value AS INTEGER) * 60 - 1)
       WHEN key = 'screensaver' AND TRY_CAST(value AS INTEGER) > 0 THEN TRY_CAST(value AS INTEGER) END), 300))
  AS idle_threshold
FROM settings GROUP BY device_id""",
)
def q_idle_threshold(spark, sf):
    settings = SM.device_settings(SM.load(spark, sf, "events").transform(lambda e: e))
    return S.idle_threshold(settings)


# ---------------------------------------------------------------- J4 as-of

SNAPSHOTS_SQL = """
snaps AS (
  SELECT 'dev-' || CAST(page_id % 4 AS VARCHAR) AS device_id, TIMESTAMP '2024-01-01' + to_hours(CAST(page_id AS INTEGER)) AS ts,
         page_id AS seq, CASE WHEN page_id % 2 = 0 THEN 'Page ' || CAST(page_id AS VARCHAR) END AS title,
         CASE WHEN page_id % 9 = 0 THEN 'about:' || url ELSE url END AS url
  FROM pages),
snaps_ok AS (
  SELECT * FROM snaps WHERE url IS NOT NULL AND url <> '' AND NOT (starts_with(url, 'about:')
     OR starts_with(url, 'chrome:') OR starts_with(url, 'moz-extension:') OR starts_with(url, 'resource:')))"""


@register(
    "override_asof",
    SAMPLES_MOD4
    + ","
    + SNAPSHOTS_SQL
    + """,
j AS (
  SELECT s.*, p.title AS pt, p.url AS pu, p.ts AS pts FROM samples s
  ASOF LEFT JOIN snaps_ok p ON s.device_id = p.device_id AND s.ts >= p.ts),
j2 AS (SELECT *, starts_with(lower(replace(coalesce(app, ''), ' ', '')), 'firefox') AND pts IS NOT NULL AS overridden FROM j)
SELECT device_id, ts, seq, app,
       CASE WHEN overridden AND coalesce(pt, '') <> '' THEN pt ELSE title END AS title,
       CASE WHEN overridden AND coalesce(pu, '') <> '' THEN pu ELSE url END AS url,
       idle_seconds, overridden
FROM j2""",
)
def q_override_asof(spark, sf):
    from dwell.functions.urls import tab_should_transmit
    from dwell.operators.asof import apply_tab_override

    snaps = SM.tab_snapshots(SM.load(spark, sf, "pages")).where(tab_should_transmit("url"))
    return _drop(apply_tab_override(samples(spark, sf), snaps))


@register(
    "tab_filter",
    "WITH "
    + SNAPSHOTS_SQL.strip()
    + "\nSELECT device_id, ts, seq, title, url FROM snaps_ok",
)
def q_tab_filter(spark, sf):
    from dwell.functions.urls import tab_should_transmit

    return SM.tab_snapshots(SM.load(spark, sf, "pages")).where(tab_should_transmit("url"))


# --------------------------------------------------------- classification

@register(
    "classify_rules_v1",
    SAMPLES_MOD4
    + ","
    + Q.rule_dims_cte()
    + ","
    + Q.classify_cte("samples", ["device_id", "seq"], "cv1", variant="v1")
    + """
SELECT device_id, seq, app, title, url, category AS category_id, is_productive, rule_id, CAST(1.0 AS DOUBLE) AS confidence,
       '{"productive":' || CASE WHEN is_productive THEN 'true' ELSE 'false' END || '}' AS meta_json
FROM cv1""",
)
def q_classify_v1(spark, sf):
    from dwell.functions.text import canonical_json

    rs = C.RuleSet.build(spark)
    out = C.classify_v1(samples(spark, sf), rs)
    return out.select(
        "device_id", "seq", "app", "title", "url", "category_id", "is_productive", "rule_id", "confidence",
        canonical_json("meta").alias("meta_json"),
    )


def _ctx_sql(app: str, host: str, title: str) -> str:
    a = f"lower(trim(coalesce({app}, '')))"
    kw = Q.keyword_sql(title)
    return (
        f"CASE WHEN ({a} IN {Q.BROWSERS} OR {a} = '') AND {host} <> '' THEN "
        f"(CASE WHEN {host} IN {Q.AMBIG} AND {kw} IS NOT NULL THEN {host} || '|' || {kw} ELSE {host} END) "
        f"ELSE coalesce(nullif({a}, ''), nullif({host}, ''), 'unknown') END"
    )


VISITS_SQL = f"""
visits AS (
  SELECT 'dev-' || CAST(page_id % 4 AS VARCHAR) AS device_id, TIMESTAMP '2024-01-01' + to_hours(CAST(page_id AS INTEGER)) AS ts,
         page_id + {SM.VISIT_SEQ_OFFSET} AS seq, 'Google Chrome' AS app,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url, 0.0 AS idle_seconds
  FROM pages),
embedded AS (
  SELECT device_id, ts, seq + {SM.EMBEDDED_SEQ_OFFSET} AS seq, 'Slack' AS app, title, url, idle_seconds
  FROM samples WHERE app = 'Firefox' AND seq % 3 = 0),
kw_src AS (SELECT * FROM samples UNION ALL SELECT * FROM visits UNION ALL SELECT * FROM embedded)"""

CLASSIFY_KW_SQL = (
    SAMPLES_MOD4
    + ","
    + VISITS_SQL
    + ","
    + Q.rule_dims_cte()
    + ","
    + Q.keyword_dim_cte()
    + ","
    + Q.classify_cte("kw_src", ["device_id", "seq"], "ckw", variant="legacy", keywords=True)
)


def keyword_corpus(spark, sf) -> DataFrame:
    """Samples, browser visits derived from pages and pages seen inside apps: the input of keyword learning."""
    embedded = SM.embedded_visits(SM.load(spark, sf, "events"))
    return samples(spark, sf).unionByName(SM.browser_visits(SM.load(spark, sf, "pages"))).unionByName(embedded)


@register(
    "classify_keywords",
    CLASSIFY_KW_SQL
    + f"""
SELECT device_id, seq, ts, app, title, url, category, is_productive, matched_keyword,
       {Q.keyword_sql('title')} AS keyword, {_ctx_sql('app', 'host', 'title')} AS context_key
FROM ckw""",
)
def q_classify_keywords(spark, sf):
    from dwell.functions import text as T
    from dwell.sources.rules import DEFAULT_KEYWORD_INDEX

    rs = C.RuleSet.build(spark, keyword_index=DEFAULT_KEYWORD_INDEX)
    out = C.classify(keyword_corpus(spark, sf), rs, variant="legacy")
    return out.select(
        "device_id", "seq", "ts", "app", "title", "url", "category", "is_productive", "matched_keyword",
        T.keyword("title").alias("keyword"),
        T.context_key(F.col("app"), T.url_host("url"), F.col("title")).alias("context_key"),
    )


# ----------------------------------------------------------- midnight split

REF_SPLIT_SQL = f"""
rs AS (
  SELECT *, CAST(start_time AS DATE) <> CAST(end_time AS DATE) AS cross_ FROM sessions),
parts AS (
  SELECT device_id, app, title, url, category, is_productive, start_time, end_time, 1 AS part FROM rs WHERE NOT cross_
  UNION ALL
  SELECT device_id, app, title, url, category, is_productive, start_time,
         CAST(CAST(start_time AS DATE) AS TIMESTAMP) + INTERVAL 86399 SECOND, 1 FROM rs WHERE cross_
  UNION ALL
  SELECT device_id, app, title, url, category, is_productive, CAST(CAST(end_time AS DATE) AS TIMESTAMP), end_time, 2
  FROM rs WHERE cross_)"""


@register(
    "split_midnight_reference",
    Q.sessions_ctes("user")
    + ","
    + REF_SPLIT_SQL
    + f"""
SELECT device_id, app, title, url, category, is_productive, start_time, end_time,
       {Q.secs('start_time', 'end_time')} AS duration_sec, part FROM parts""",
)
def q_split_reference(spark, sf):
    return split_midnight(labelled_sessions(spark, sf, "user"), mode="reference")


def _rint1_sql(x: str) -> str:
    return f"(round_even(({x}) * 10, 0) / 10)"


@register(
    "daily_timeline",
    Q.sessions_ctes("user")
    + f""",
ps AS (
  SELECT *, CASE WHEN is_productive THEN 'productive' ELSE 'unproductive' END AS productive,
         {_rint1_sql('duration_sec / 60')} AS duration_min FROM sessions),
rs AS (SELECT *, CAST(start_time AS DATE) <> CAST(end_time AS DATE) AS cross_, CAST(start_time AS DATE) AS day,
              category || '|' || productive AS activity_id FROM ps),
parts AS (
  SELECT device_id, day, start_time, end_time, app, title, category, activity_id, duration_min, 1 AS part FROM rs WHERE NOT cross_
  UNION ALL
  SELECT device_id, day, start_time, CAST(CAST(start_time AS DATE) AS TIMESTAMP) + INTERVAL 86399 SECOND, app, title,
         category, activity_id, duration_min, 1 FROM rs WHERE cross_
  UNION ALL
  SELECT device_id, day, CAST(CAST(end_time AS DATE) AS TIMESTAMP), end_time, app, title, category, activity_id,
         duration_min, 2 FROM rs WHERE cross_)
SELECT * FROM parts""",
)
def q_daily_timeline(spark, sf):
    return RP.daily_timeline(labelled_sessions(spark, sf, "user"))


@register(
    "activity_rollup",
    Q.sessions_ctes("user")
    + f""",
ps AS (
  SELECT *, CASE WHEN is_productive THEN 'productive' ELSE 'unproductive' END AS productive,
         {_rint1_sql('duration_sec / 60')} AS duration_min FROM sessions),
rs AS (SELECT *, CASE WHEN CAST(start_time AS DATE) <> CAST(end_time AS DATE) THEN 2 ELSE 1 END AS n,
              CAST(start_time AS DATE) AS day, category || '|' || productive AS activity_id FROM ps)
SELECT day, activity_id, CAST(sum(n) AS BIGINT) AS bars, round(sum(duration_min * n), 1) AS minutes
FROM rs GROUP BY day, activity_id""",
)
def q_activity_rollup(spark, sf):
    return RP.activity_rollup(labelled_sessions(spark, sf, "user"))


def _anchor_sql(ts: str) -> str:
    return f"make_timestamp(2000, 1, 1, hour({ts}), minute({ts}), floor(second({ts})))"


def _prod_sql(col: str = "is_productive") -> str:
    return f"CASE WHEN {col} THEN 'productive' WHEN NOT {col} THEN 'unproductive' END"


@register(
    "weekly_timeline",
    Q.sessions_ctes("user")
    + ","
    + REF_SPLIT_SQL.replace("SELECT *, CAST(start_time AS DATE) <> CAST(end_time AS DATE) AS cross_ FROM sessions",
                            "SELECT *, CAST(start_time AS DATE) <> CAST(end_time AS DATE) AS cross_, CAST(date_trunc('week', start_time) AS DATE) AS week_start FROM sessions")
    .replace("SELECT device_id, app, title, url,", "SELECT week_start, device_id, app, title, url,")
    + f"""
SELECT device_id, week_start, strftime(start_time, '%a') AS day_label, {_anchor_sql('start_time')} AS time_start,
       {_anchor_sql('end_time')} AS time_end, {_prod_sql()} AS productivity, app, title, start_time,
       ({Q.us('end_time')} - {Q.us('start_time')}) / 60000000.0 AS duration_min
FROM parts""",
)
def q_weekly_timeline(spark, sf):
    return RP.weekly_timeline(labelled_sessions(spark, sf, "user"))


@register(
    "monthly_timeline",
    Q.sessions_ctes("user")
    + ","
    + REF_SPLIT_SQL.replace("SELECT *, CAST(start_time AS DATE) <> CAST(end_time AS DATE) AS cross_ FROM sessions",
                            "SELECT *, CAST(start_time AS DATE) <> CAST(end_time AS DATE) AS cross_, CAST(date_trunc('month', start_time) AS DATE) AS month_start FROM sessions")
    .replace("SELECT device_id, app, title, url,", "SELECT month_start, device_id, app, title, url,")
    + f"""
SELECT device_id, month_start, strftime(start_time, '%Y-%m-%d') AS date_label, {_anchor_sql('start_time')} AS time_start,
       {_anchor_sql('end_time')} AS time_end, {_prod_sql()} AS productivity, app, title, start_time,
       ({Q.us('end_time')} - {Q.us('start_time')}) / 60000000.0 AS duration_min
FROM parts""",
)
def q_monthly_timeline(spark, sf):
    return RP.monthly_timeline(labelled_sessions(spark, sf, "user"))


WEEK_PARTS = (
    Q.sessions_ctes("user")
    + ","
    + REF_SPLIT_SQL.replace("SELECT *, CAST(start_time AS DATE) <> CAST(end_time AS DATE) AS cross_ FROM sessions",
                            "SELECT *, CAST(start_time AS DATE) <> CAST(end_time AS DATE) AS cross_, CAST(date_trunc('week', start_time) AS DATE) AS week_start FROM sessions")
    .replace("SELECT device_id, app, title, url,", "SELECT week_start, device_id, app, title, url,")
)
WEEK_TOTALS = f"""
wt AS (
  SELECT week_start, strftime(start_time, '%a') AS day_label, CAST(start_time AS DATE) AS date, {_prod_sql()} AS productivity,
         sum({Q.us('end_time')} - {Q.us('start_time')}) / 60000000.0 AS duration_min
  FROM parts WHERE is_productive IS NOT NULL GROUP BY ALL)"""
MONTH_PARTS = (
    Q.sessions_ctes("user")
    + ","
    + REF_SPLIT_SQL.replace("SELECT *, CAST(start_time AS DATE) <> CAST(end_time AS DATE) AS cross_ FROM sessions",
                            "SELECT *, CAST(start_time AS DATE) <> CAST(end_time AS DATE) AS cross_, CAST(date_trunc('month', start_time) AS DATE) AS month_start FROM sessions")
    .replace("SELECT device_id, app, title, url,", "SELECT month_start, device_id, app, title, url,")
)
MONTH_TOTALS = f"""
mt AS (
  SELECT month_start, CAST(dayofmonth(start_time) AS INTEGER) AS day, CAST(start_time AS DATE) AS date,
         {_prod_sql()} AS productivity, sum({Q.us('end_time')} - {Q.us('start_time')}) / 60000000.0 AS duration_min
  FROM parts WHERE is_productive IS NOT NULL GROUP BY ALL)"""


@register("weekly_totals", WEEK_PARTS + "," + WEEK_TOTALS + "\nSELECT * FROM wt")
def q_weekly_totals(spark, sf):
    return RP.weekly_totals(labelled_sessions(spark, sf, "user"))


def _sessions_of(name: str, condition: str) -> None:
    """A picked-date filter: the sessions of the first recorded day / week / month."""
    pick = getattr(RP, name)

    @register(name, Q.sessions_ctes("user") + f"\nSELECT {SESSION_COLS} FROM sessions, (SELECT min(CAST(start_time AS DATE)) AS d FROM sessions) WHERE {condition}")
    def query(spark, sf):
        s = labelled_sessions(spark, sf, "user")
        return pick(s, RP.first_date(s))


_sessions_of("day_filter", "CAST(start_time AS DATE) = d")
_sessions_of("week_filter", "date_trunc('week', start_time) = date_trunc('week', d)")
_sessions_of("month_filter", "date_trunc('month', start_time) = date_trunc('month', d)")


@register(
    "weekly_totals_ordered",
    WEEK_PARTS + "," + WEEK_TOTALS + """
SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS day_order, CASE WHEN productivity = 'productive' THEN 0 ELSE 1 END AS productive_order FROM wt""",
)
def q_weekly_totals_ordered(spark, sf):
    return RP.ordered_totals(RP.weekly_totals(labelled_sessions(spark, sf, "user")))


@register(
    "month_head_count",
    Q.sessions_ctes("user") + f"""
, m AS (SELECT {SESSION_COLS}, count(*) OVER () AS month_rows FROM sessions, (SELECT min(CAST(start_time AS DATE)) AS d FROM sessions)
  WHERE date_trunc('month', start_time) = date_trunc('month', d))
SELECT * FROM m ORDER BY start_time, end_time, device_id, app, title, url NULLS FIRST LIMIT 5""",
)
def q_month_head_count(spark, sf):
    s = labelled_sessions(spark, sf, "user")
    return RP.month_head_count(s, RP.first_date(s))


@register("monthly_totals", MONTH_PARTS + "," + MONTH_TOTALS + "\nSELECT * FROM mt")
def q_monthly_totals(spark, sf):
    return RP.monthly_totals(labelled_sessions(spark, sf, "user"))


@register(
    "max_daily_total",
    WEEK_PARTS + "," + WEEK_TOTALS + """
SELECT week_start, coalesce(max(total), 0.0) AS max_daily_min FROM (
  SELECT week_start, day_label, date, sum(duration_min) AS total FROM wt GROUP BY ALL) GROUP BY week_start""",
)
def q_max_daily_total(spark, sf):
    return RP.max_daily_total(labelled_sessions(spark, sf, "user"), "week")


@register(
    "max_daily_total_month",
    MONTH_PARTS + "," + MONTH_TOTALS + """
SELECT month_start, coalesce(max(total), 0.0) AS max_daily_min FROM (
  SELECT month_start, day, date, sum(duration_min) AS total FROM mt GROUP BY ALL) GROUP BY month_start""",
)
def q_max_daily_total_month(spark, sf):
    return RP.max_daily_total(labelled_sessions(spark, sf, "user"), "month")


@register(
    "category_rollup",
    Q.sessions_ctes("user")
    + """,
parts AS (
  SELECT s.*, d::DATE AS day FROM sessions s,
         unnest(generate_series(CAST(start_time AS DATE), CAST(end_time AS DATE), INTERVAL 1 DAY)) t(d)),
p2 AS (
  SELECT category, greatest(start_time, CAST(day AS TIMESTAMP)) AS ps, least(end_time, CAST(day + 1 AS TIMESTAMP)) AS pe,
         start_time AS s0, end_time AS e0 FROM parts),
p3 AS (SELECT category, CAST(ps AS DATE) AS date, """
    + Q.us("pe")
    + " - "
    + Q.us("ps")
    + """ AS us_ FROM p2 WHERE pe > ps OR s0 = e0)
SELECT date, category, sum(us_) / 60000000.0 AS minutes, count(*) AS parts,
       CASE WHEN grouping(date) = 1 THEN 'all' WHEN grouping(category) = 1 THEN 'date' ELSE 'date_category' END AS level
FROM p3 GROUP BY ROLLUP (date, category)""",
)
def q_category_rollup(spark, sf):
    return RP.category_rollup(labelled_sessions(spark, sf, "user"))


@register(
    "last_n_sessions",
    Q.sessions_ctes()
    + """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY start_time DESC, end_time DESC) AS rank_from_end
  FROM sessions) WHERE rank_from_end <= 5""",
)
def q_last_n(spark, sf):
    return RP.last_n_sessions(labelled_sessions(spark, sf), n=5)


# --------------------------------------------------------------- label store

STORE_SQL = f""",
store_events AS (
  SELECT seq AS id, {Q.us('ts')} / 1e6 AS start_ts,
         CASE WHEN seq % 50 = 0 THEN NULL WHEN seq % 50 = 1 THEN {Q.us('ts')} / 1e6 - 1
              ELSE {Q.us('ts')} / 1e6 + idle_seconds / 10 END AS end_ts,
         app, title, coalesce(url, '') AS url, CAST(NULL AS VARCHAR) AS content_hash, ts AS created_at, device_id
  FROM samples),
valid AS (SELECT * FROM store_events WHERE end_ts IS NOT NULL AND end_ts >= start_ts),
clog AS (
  SELECT id AS event_id, 'rules-v1' AS engine_version, lower(app) AS category_id, CAST(1.0 AS DOUBLE) AS confidence,
         CAST(NULL AS VARCHAR) AS rule_id, '{{"n":0}}' AS meta_json, created_at, id * 10 AS seq FROM valid
  UNION ALL
  SELECT id, 'rules-v1', 'relabelled', 1.0, NULL, '{{"n":1}}', created_at + INTERVAL 60 SECOND, id * 10 + 1
  FROM valid WHERE id % 7 = 0
  UNION ALL
  SELECT id, 'rules-v0', 'legacy', 1.0, NULL, '{{"n":2}}', created_at + INTERVAL 30 SECOND, id * 10 + 2
  FROM valid WHERE id % 5 = 0
  UNION ALL
  SELECT -1 - id, 'rules-v1', lower(app), 1.0, NULL, '{{"n":3}}', created_at, id * 10 + 3 FROM valid WHERE id % 100 = 0),
olog AS (
  SELECT event_id, 'set' AS op, 'focus' AS category_id, CAST(NULL AS VARCHAR) AS note, event_id * 10 + 1 AS seq
  FROM events WHERE event_id % 10 = 0
  UNION ALL SELECT event_id, 'set', 'deep-work', 'adjusted', event_id * 10 + 2 FROM events WHERE event_id % 20 = 0
  UNION ALL SELECT event_id, 'clear', NULL, NULL, event_id * 10 + 3 FROM events WHERE event_id % 40 = 0),
latest_c AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id, engine_version ORDER BY created_at DESC, seq DESC) AS r FROM clog)
  WHERE r = 1),
cur_o AS (
  SELECT event_id, category_id, note, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS r FROM olog) WHERE r = 1 AND op = 'set')"""
STORE = SAMPLES_MOD4 + STORE_SQL


def _store(spark, sf):
    ev = SM.load(spark, sf, "events")
    return SM.store_events(ev), SM.classification_log(ev), SM.override_log(ev)


@register("valid_events", STORE + "\nSELECT * FROM valid")
def q_valid_events(spark, sf):
    from dwell.operators.labels import valid_events

    return valid_events(_store(spark, sf)[0])


@register(
    "latest_classification",
    STORE + "\nSELECT event_id, engine_version, category_id, confidence, rule_id, meta_json, created_at FROM latest_c",
)
def q_latest_classification(spark, sf):
    from dwell.operators.labels import latest_classification

    return latest_classification(_store(spark, sf)[1])


@register("current_overrides", STORE + "\nSELECT * FROM cur_o")
def q_current_overrides(spark, sf):
    from dwell.operators.labels import current_overrides

    return current_overrides(_store(spark, sf)[2])


@register(
    "effective_labels",
    STORE
    + """
SELECT v.id, coalesce(o.category_id, c.category_id) AS category_id,
       CASE WHEN o.category_id IS NOT NULL THEN 'override' WHEN c.category_id IS NOT NULL THEN 'engine' END AS label_source,
       c.category_id AS engine_category, o.category_id AS override_category
FROM valid v LEFT JOIN (SELECT * FROM latest_c WHERE engine_version = 'rules-v1') c ON c.event_id = v.id
LEFT JOIN cur_o o ON o.event_id = v.id""",
)
def q_effective_labels(spark, sf):
    from dwell.operators.labels import effective_labels, valid_events

    ev, cl, ov = _store(spark, sf)
    return effective_labels(valid_events(ev), cl, ov, "rules-v1")


@register(
    "orphan_labels",
    STORE
    + """
SELECT event_id, 'classification' AS kind, seq FROM clog WHERE event_id NOT IN (SELECT id FROM valid)
UNION ALL
SELECT event_id, 'override' AS kind, seq FROM olog WHERE event_id NOT IN (SELECT id FROM valid)""",
)
def q_orphan_labels(spark, sf):
    from dwell.operators.labels import orphan_labels, valid_events

    ev, cl, ov = _store(spark, sf)
    return orphan_labels(valid_events(ev), cl, ov)


@register(
    "change_feed",
    STORE
    + """
SELECT 'event_recorded' AS kind, 0 AS kind_ord, id AS event_id, id AS seq FROM valid
UNION ALL SELECT 'label_updated', 1, event_id, seq FROM clog
UNION ALL SELECT 'override_updated', 2, event_id, seq FROM olog""",
)
def q_change_feed(spark, sf):
    from dwell.operators.labels import change_feed, valid_events

    ev, cl, ov = _store(spark, sf)
    return change_feed(valid_events(ev), cl, ov)


@register(
    "store_counts",
    STORE
    + """
SELECT 'events' AS table_name, count(*) AS n FROM valid
UNION ALL SELECT 'engine_classifications', count(*) FROM latest_c
UNION ALL SELECT 'user_overrides', count(*) FROM cur_o""",
)
def q_store_counts(spark, sf):
    from dwell.operators.labels import store_counts, valid_events

    ev, cl, ov = _store(spark, sf)
    return store_counts(valid_events(ev), cl, ov)


@register(
    "latest_events",
    STORE + "\nSELECT id, app, title, start_ts, end_ts, end_ts - start_ts AS duration_sec FROM valid ORDER BY id DESC LIMIT 5",
)
def q_latest_events(spark, sf):
    from dwell.operators.labels import latest_events, valid_events

    return latest_events(valid_events(_store(spark, sf)[0]))


@register(
    "event_ids",
    SAMPLES_MOD4
    + ","
    + Q.raw_sessions_cte()
    + "\nSELECT row_number() OVER (ORDER BY start_time, device_id) AS id, start_time, device_id, app, title, url FROM raw_sessions",
)
def q_event_ids(spark, sf):
    from dwell.operators.labels import sequential_ids

    sess = _drop(raw_sessions(spark, sf)).select("start_time", "device_id", "app", "title", "url")
    return sequential_ids(sess, ["start_time", "device_id"])


# ------------------------------------------------------------ keyword learning

KW_HITS_SQL = (
    CLASSIFY_KW_SQL
    + f""",
hits AS (
  SELECT *, {_ctx_sql('app', 'host', 'title')} AS context_key FROM ckw WHERE matched_keyword IS NOT NULL),
ks AS (
  SELECT *, lag(matched_keyword) OVER w AS pk, lag(ts) OVER w AS pts, row_number() OVER w AS rn
  FROM hits WHERE context_key IS NOT NULL AND context_key <> ''
  WINDOW w AS (PARTITION BY context_key ORDER BY ts, seq)),
kss AS (
  SELECT *, NOT coalesce(rn > 1 AND pk = matched_keyword AND {Q.secs('pts', 'ts')} < {GAP_S}, FALSE) AS is_new FROM ks)"""
)


@register(
    "keyword_sessions",
    KW_HITS_SQL
    + "\nSELECT seq, ts, context_key, category, matched_keyword, is_new FROM kss",
)
def q_keyword_sessions(spark, sf):
    return _keyword_sessions(spark, sf)


def _keyword_classified(spark, sf):
    from dwell.sources.rules import DEFAULT_KEYWORD_INDEX

    rs = C.RuleSet.build(spark, keyword_index=DEFAULT_KEYWORD_INDEX)
    return C.classify(keyword_corpus(spark, sf), rs, variant="legacy"), rs


def _keyword_sessions(spark, sf):
    from dwell.operators import keywords as K

    cl, _ = _keyword_classified(spark, sf)
    return K.keyword_sessions(K.keyword_hits(cl), reset_seconds=GAP_S)


KW_COUNTS_SQL = """,
kc AS (
  SELECT category, matched_keyword AS keyword, sum(CAST(is_new AS BIGINT)) AS count, min(ts) AS first_seen
  FROM kss GROUP BY ALL HAVING sum(CAST(is_new AS BIGINT)) > 0)"""


@register("keyword_counts", KW_HITS_SQL + KW_COUNTS_SQL + "\nSELECT * FROM kc")
def q_keyword_counts(spark, sf):
    from dwell.operators import keywords as K

    return K.keyword_counts(_keyword_sessions(spark, sf))


TOP_K = 5


@register(
    "keyword_top_k",
    CLASSIFY_KW_SQL
    + f""",
th AS (
  SELECT *, {Q.keyword_sql('title')} AS kw, {_ctx_sql('app', 'host', 'title')} AS context_key FROM ckw),
ts_ AS (
  SELECT *, lag(kw) OVER w AS pk, lag(ts) OVER w AS pts, row_number() OVER w AS rn
  FROM th WHERE kw IS NOT NULL AND context_key IS NOT NULL AND context_key <> ''
  WINDOW w AS (PARTITION BY context_key ORDER BY ts, seq)),
tc AS (
  SELECT category, kw AS keyword, sum(CASE WHEN rn > 1 AND pk = kw AND {Q.secs('pts', 'ts')} < {GAP_S} THEN 0 ELSE 1 END)::BIGINT AS count,
         min(ts) AS first_seen
  FROM ts_ GROUP BY ALL)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC, first_seen, keyword) AS rank FROM tc WHERE count > 0)
WHERE rank <= {TOP_K}""",
)
def q_keyword_top_k(spark, sf):
    """A6 over every title keyword (F3) of the corpus: categories hold more keywords than the index may keep."""
    from dwell.functions import text as T
    from dwell.operators import keywords as K

    cl, _ = _keyword_classified(spark, sf)
    hits = cl.withColumn("matched_keyword", T.keyword("title"))
    return K.keyword_top_k(K.keyword_counts(K.keyword_sessions(K.keyword_hits(hits), reset_seconds=GAP_S)), k=TOP_K)


BACKLOG_SQL = (
    CLASSIFY_KW_SQL
    + f""",
bl0 AS (
  SELECT *, cands[1] AS keyword, {_ctx_sql('app', 'host', 'title')} AS cache_key FROM ckw
  WHERE len(cands) > 0 AND (host IN {Q.AMBIG} OR category = 'Unknown') AND index_keyword IS NULL),
backlog AS (
  SELECT keyword, arg_min(app, (ts, seq)) AS app, arg_min(title, (ts, seq)) AS title, arg_min(url, (ts, seq)) AS url,
         arg_min(cache_key, (ts, seq)) AS cache_key, arg_min(category, (ts, seq)) AS rule_category,
         arg_min(is_productive, (ts, seq)) AS rule_productive, min(ts) AS first_seen, count(*) AS rows
  FROM bl0 GROUP BY keyword),
sugg AS (
  SELECT keyword, CASE length(keyword) % 3 WHEN 0 THEN 'Research' WHEN 1 THEN 'Shopping' ELSE 'Unknown' END AS category,
         length(keyword) % 2 = 0 AS productive FROM backlog)"""
)


@register("label_backlog", BACKLOG_SQL + "\nSELECT * FROM backlog")
def q_label_backlog(spark, sf):
    from dwell.operators import keywords as K

    cl, _ = _keyword_classified(spark, sf)
    return K.label_backlog(cl)


@register(
    "apply_suggestions",
    BACKLOG_SQL
    + f""",
ok AS (SELECT * FROM sugg WHERE category IS NOT NULL AND category <> 'Unknown'),
ap0 AS (
  SELECT c.*, (len(cands) > 0 AND (host IN {Q.AMBIG} OR c.category = 'Unknown')) AS need,
         i1.category AS i1c, i1.productive AS i1p, i2.category AS i2c, i2.productive AS i2p,
         s1.category AS s1c, s1.productive AS s1p, s2.category AS s2c, s2.productive AS s2p
  FROM ckw c LEFT JOIN ok s1 ON s1.keyword = c.cands[1] LEFT JOIN ok s2 ON s2.keyword = c.cands[2]
  LEFT JOIN kw_dim i1 ON i1.keyword = c.cands[1] LEFT JOIN kw_dim i2 ON i2.keyword = c.cands[2]),
ap AS (
  SELECT *, CASE WHEN NOT need THEN 0 WHEN i1c IS NOT NULL THEN 1 WHEN s1c IS NOT NULL THEN 2
                 WHEN i2c IS NOT NULL THEN 3 WHEN s2c IS NOT NULL THEN 4 ELSE 0 END AS pick FROM ap0)
SELECT device_id, seq, app, title, url,
       CASE pick WHEN 1 THEN i1c WHEN 2 THEN s1c WHEN 3 THEN i2c WHEN 4 THEN s2c ELSE category END AS category,
       coalesce(CASE pick WHEN 1 THEN i1p WHEN 2 THEN s1p WHEN 3 THEN i2p WHEN 4 THEN s2p ELSE is_productive END, FALSE) AS is_productive,
       CASE WHEN pick IN (1, 3) THEN 'index' WHEN pick IN (2, 4) THEN 'suggestion' ELSE 'rules' END AS label_source,
       CASE pick WHEN 1 THEN cands[1] WHEN 2 THEN cands[1] WHEN 3 THEN cands[2] WHEN 4 THEN cands[2] ELSE matched_keyword END AS hit_keyword
FROM ap""",
)
def q_apply_suggestions(spark, sf):
    from dwell.operators import keywords as K

    cl, _ = _keyword_classified(spark, sf)
    sg = K.derived_suggestions(K.label_backlog(cl))
    out = K.apply_suggestions(cl, sg)
    return out.select("device_id", "seq", "app", "title", "url", "category", "is_productive", "label_source", "hit_keyword")


@register(
    "learned_rules",
    BACKLOG_SQL
    + f""",
acc AS (SELECT b.*, s.category, s.productive FROM backlog b JOIN sugg s USING (keyword) WHERE s.category <> 'Unknown'),
cand AS (
  SELECT category, productive, first_seen, keyword,
         CASE WHEN (lower(coalesce(app, '')) IN {Q.BROWSERS} OR lower(coalesce(app, '')) = '') AND {Q.host_sql('url')} <> '' THEN 'domain'
              WHEN lower(coalesce(app, '')) <> '' AND NOT lower(coalesce(app, '')) IN {Q.BROWSERS} THEN 'app' END AS kind,
         CASE WHEN (lower(coalesce(app, '')) IN {Q.BROWSERS} OR lower(coalesce(app, '')) = '') AND {Q.host_sql('url')} <> '' THEN {Q.host_sql('url')}
              WHEN lower(coalesce(app, '')) <> '' AND NOT lower(coalesce(app, '')) IN {Q.BROWSERS} THEN lower(coalesce(app, '')) END AS token
  FROM acc WHERE NOT {Q.host_sql('url')} IN {Q.AMBIG}),
existing AS (
  SELECT category, 'app' AS kind, lower(tok) AS token FROM rules_app
  UNION ALL SELECT category, 'domain', lower(tok) FROM rules_dom)
SELECT c.category, c.kind, c.token, arg_min(c.productive, (c.first_seen, c.keyword)) AS productive,
       min(c.first_seen) AS first_seen FROM cand c
WHERE c.kind IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM existing e WHERE e.category = c.category AND e.kind = c.kind AND e.token = c.token)
GROUP BY ALL""",
)
def q_learned_rules(spark, sf):
    from dwell.operators import keywords as K

    cl, rs = _keyword_classified(spark, sf)
    bl = K.label_backlog(cl)
    return K.learned_rules(bl, K.derived_suggestions(bl), rs.rules)


@register(
    "parse_suggestions",
    BACKLOG_SQL
    + """,
msgs AS (
  SELECT keyword, CASE length(keyword) % 4
      WHEN 0 THEN '{"category":"Research","productive":true}'
      WHEN 1 THEN '{"productive":false,"confidence":0.9}'
      WHEN 2 THEN '{"category":"","rationale":"fine"}'
      ELSE '{"category":"Shopping","productive":null}' END AS message FROM backlog)
SELECT keyword, coalesce(nullif(json_extract_string(message, '$.category'), ''), 'Unknown') AS category,
       coalesce(CAST(json_extract(message, '$.productive') AS BOOLEAN), FALSE) AS productive,
       CAST(json_extract(message, '$.confidence') AS DOUBLE) AS confidence,
       json_extract_string(message, '$.rationale') AS rationale
FROM msgs""",
)
def q_parse_suggestions(spark, sf):
    from dwell.functions.text import parse_suggestion
    from dwell.operators import keywords as K

    cl, _ = _keyword_classified(spark, sf)
    msgs = K.suggestion_messages(K.label_backlog(cl))
    return msgs.select("keyword", parse_suggestion("message").alias("s")).select("keyword", "s.*")


# ------------------------------------------------------------------- ingest

@register(
    "manifest_diff",
    """
WITH d AS (SELECT doc_id, md5(text) AS md5 FROM documents),
remote AS (SELECT doc_id AS file_id, 'activity_' || CAST(doc_id AS VARCHAR) || '.parquet' AS name,
                  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE md5 END AS md5 FROM d),
state AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN md5 || 'x' ELSE md5 END AS md5
          FROM d WHERE doc_id % 3 <> 0),
loc AS (SELECT 'activity_' || CAST(doc_id AS VARCHAR) || '.parquet' AS name,
               CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN md5 || 'y' ELSE md5 END AS md5
        FROM d WHERE doc_id % 4 <> 0),
j AS (
  SELECT r.*, s.file_id IS NOT NULL AS in_state, s.md5 AS state_md5, l.name IS NOT NULL AS has_local, l.md5 AS local_md5
  FROM remote r LEFT JOIN state s ON s.file_id = r.file_id LEFT JOIN loc l ON l.name = r.name),
k AS (
  SELECT *, in_state AND state_md5 IS NOT DISTINCT FROM md5 AND has_local AS skip_state,
         coalesce(md5 IS NOT NULL AND md5 <> '' AND has_local AND local_md5 = md5, FALSE) AS skip_digest FROM j)
SELECT file_id, name, md5, NOT (skip_state OR skip_digest) AS load,
       CASE WHEN skip_state THEN 'state' WHEN skip_digest THEN 'digest' END AS skip_reason FROM k""",
)
def q_manifest_diff(spark, sf):
    from dwell.operators.ingest import manifest_diff

    remote, state, local = SM.manifests(SM.load(spark, sf, "documents"))
    return manifest_diff(remote, state, local)


@register(
    "schema_align",
    Q.sessions_ctes()
    + """,
old_gen AS (SELECT start_time, end_time, duration_sec, app, title, category, is_productive FROM sessions
            WHERE dayofmonth(start_time) <= 15),
new_gen AS (SELECT start_time, end_time, duration_sec, app, title, url, category, is_productive, device_id FROM sessions
            WHERE dayofmonth(start_time) > 15)
SELECT * FROM old_gen UNION ALL BY NAME SELECT * FROM new_gen""",
)
def q_schema_align(spark, sf):
    from dwell.operators.ingest import align_schemas

    s = labelled_sessions(spark, sf)
    old = s.where(F.dayofmonth("start_time") <= 15).select(
        "start_time", "end_time", "duration_sec", "app", "title", "category", "is_productive"
    )
    new = s.where(F.dayofmonth("start_time") > 15)
    return align_schemas(old, new)



# ------------------------------------------------------------ URL sanitizer

def url_corpus(spark, sf) -> DataFrame:
    """Every URL the tables hold: raw web pages plus the samples' browser URLs."""
    pages = SM.load(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "url")
    smp = samples(spark, sf).where(F.col("url").isNotNull()).select(F.lit("sample").alias("src"), F.col("seq").alias("id"), "url")
    return pages.unionByName(smp)


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _unquote_plus_sql(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def _quote_plus_sql(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def _sensitive_value_sql(v: str) -> str:
    from dwell.functions import urls as U

    d1 = f"url_decode({v})"
    d2 = f"(CASE WHEN {d1} = {v} THEN {d1} ELSE url_decode({d1}) END)"
    net = f"regexp_extract({d2}, '^[Hh][Tt][Tt][Pp][Ss]?://([^/?#]*)', 1)"
    hi = f"regexp_extract({net}, '([^@]*)$', 1)"
    host = f"(CASE WHEN starts_with({hi}, '[') THEN regexp_extract({hi}, '^\\[([^\\]]*)', 1) ELSE split_part({hi}, ':', 1) END)"
    emb = f"(regexp_matches({d2}, '^[Hh][Tt][Tt][Pp][Ss]?://') AND {host} <> '')"
    classes = (
        f"(CAST(regexp_matches({v}, '\\p{{Ll}}') AS INTEGER) + CAST(regexp_matches({v}, '\\p{{Lu}}') AS INTEGER)"
        f" + CAST(regexp_matches({v}, '\\p{{Nd}}') AS INTEGER) + CAST(regexp_matches({v}, '[^\\p{{L}}\\p{{N}}]') AS INTEGER))"
    )
    compact = f"(length({v}) >= {U.COMPACT_SECRET_MIN_LEN} AND NOT regexp_matches({v}, '\\s') AND {classes} >= 3)"
    pats = " OR ".join(f"regexp_full_match({v}, '{r[1:-1]}')" for r in (U.EMAIL_RE, U.JWT_RE, U.UUID_RE, U.HEX_RE, U.B64URL_RE))
    return f"({v} <> '' AND ({pats} OR {emb} OR {compact} OR length({v}) > {U.MAX_VALUE_LEN}))"


def _segment_sql(seg: str) -> str:
    from dwell.functions import urls as U

    s = _strip_sql(seg)
    return (
        f"CASE WHEN {s} = '' THEN '' WHEN regexp_full_match({s}, '\\p{{Nd}}+') THEN '[INT]' "
        f"WHEN regexp_full_match({s}, '{U.UUID_RE[1:-1]}') THEN '[UUID]' "
        f"WHEN regexp_full_match({s}, '{U.EMAIL_RE[1:-1]}') THEN '[EMAIL]' "
        f"WHEN regexp_full_match({s}, '{U.JWT_RE[1:-1]}') THEN '[JWT]' "
        f"WHEN regexp_full_match({s}, '{U.HEX_RE[1:-1]}') OR regexp_full_match({s}, '{U.B64URL_RE[1:-1]}') THEN '[ID]' "
        f"WHEN length({s}) > 64 THEN '[TEXT_LONG]' ELSE {s} END"
    )


URL_CORPUS_SQL = """
  SELECT 'page' AS src, page_id AS id, url FROM pages
  UNION ALL SELECT 'sample', seq, url FROM samples WHERE url IS NOT NULL"""


def _sanitize_sql(head: str = SAMPLES_MOD4 + ",", corpus: str = URL_CORPUS_SQL) -> str:
    from dwell.functions import urls as U

    key_re = U.SENSITIVE_KEY_RE.replace("\\", "")
    return (
        head
        + f"""
corpus AS ({corpus}),
u1 AS (SELECT *, {_strip_sql("coalesce(url, '')")} AS raw FROM corpus),
u2 AS (SELECT *, regexp_replace(raw, '[\\t\\r\\n]', '', 'g') AS u FROM u1),
u3 AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM u2),
u4 AS (SELECT *, substr(u, length(scheme) + 2) AS rest FROM u3),
u5 AS (SELECT *, CASE WHEN starts_with(rest, '//') THEN regexp_extract(rest, '^//([^/?#]*)', 1) ELSE '' END AS netloc,
              CASE WHEN starts_with(rest, '//') THEN regexp_extract(rest, '^//[^/?#]*((?s).*)$', 1) ELSE rest END AS after FROM u4),
u6 AS (SELECT *, split_part(after, '#', 1) AS no_frag,
              CASE WHEN instr(after, '#') > 0 THEN substr(after, instr(after, '#') + 1) ELSE '' END AS frag FROM u5),
u7 AS (SELECT *, split_part(no_frag, '?', 1) AS path,
              CASE WHEN instr(no_frag, '?') > 0 THEN substr(no_frag, instr(no_frag, '?') + 1) ELSE '' END AS query,
              regexp_extract(netloc, '([^@]*)$', 1) AS hostinfo FROM u6),
u8 AS (SELECT *,
         CASE WHEN contains(hostinfo, '[') THEN regexp_extract(hostinfo, '\\[([^\\]]*)', 1) ELSE split_part(hostinfo, ':', 1) END AS host_raw,
         CASE WHEN contains(hostinfo, '[') THEN regexp_extract(hostinfo, '\\][^:]*:(.*)$', 1)
              WHEN instr(hostinfo, ':') > 0 THEN substr(hostinfo, instr(hostinfo, ':') + 1) ELSE '' END AS port_raw
       FROM u7),
u9 AS (SELECT *, regexp_full_match(port_raw, '[0-9]+') AND length(ltrim(port_raw, '0')) <= 5 AS digits,
              scheme IN ('http', 'https') AS is_http FROM u8),
u10 AS (SELECT *, CASE WHEN digits THEN CAST(port_raw AS INTEGER) END AS port_num FROM u9),
u11 AS (SELECT *, is_http AND (contains(netloc, '[') <> contains(netloc, ']') OR NOT (port_raw = '' OR (digits AND port_num <= 65535))) AS err
        FROM u10),
q1 AS (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '') AS pieces FROM u11),
q2 AS (SELECT *, list_transform(pieces, lambda p, i: {{
          'lk': lower({_strip_sql(_unquote_plus_sql("CASE WHEN instr(p, '=') > 0 THEN split_part(p, '=', 1) ELSE p END"))}),
          'i': i,
          'key': {_strip_sql(_unquote_plus_sql("CASE WHEN instr(p, '=') > 0 THEN split_part(p, '=', 1) ELSE p END"))},
          'v': {_strip_sql(_unquote_plus_sql("CASE WHEN instr(p, '=') > 0 THEN substr(p, instr(p, '=') + 1) ELSE '' END"))}}}) AS items0
        FROM q1 WHERE is_http AND NOT err),
q3 AS (SELECT *, list_filter(list_transform(items0, lambda it: {{'lk': it.lk, 'i': it.i, 'key': it.key,
          'red': regexp_matches(lower(it.key), '{key_re}') OR {_sensitive_value_sql('it.v')}, 'v': it.v}}),
          lambda it: it.key <> '') AS items FROM q2),
q4 AS (SELECT *, list_sort(items) AS sorted_items,
              list_transform(list_sort(list_transform(list_filter(items, lambda it: it.red), lambda it: {{'lk': it.lk, 'key': it.key}})),
                             lambda r: r.key) AS red_sorted FROM q3),
q5 AS (SELECT src, id,
         array_to_string(list_transform(sorted_items, lambda it: {_quote_plus_sql('it.key')} || '=' ||
             {_quote_plus_sql("CASE WHEN it.red THEN '_REDACTED_' ELSE it.v END")}), '&') AS qs,
         list_filter(red_sorted, lambda x, i: NOT list_contains(red_sorted[1:i - 1], x)) AS red_keys
       FROM q4),
p1 AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM u11),
p2 AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE '/' || array_to_string(list_transform(segs, lambda s: {_segment_sql('s')}), '/') END AS spath
       FROM p1)
SELECT p.src, p.id, p.url,
       CASE WHEN p.raw = '' THEN '' WHEN NOT p.is_http THEN p.raw WHEN p.err THEN NULL
            ELSE p.scheme || '://' || lower(p.host_raw) || CASE WHEN p.port_raw = '' THEN '' ELSE ':' || CAST(p.port_num AS VARCHAR) END
                 || p.spath || CASE WHEN coalesce(q.qs, '') <> '' THEN '?' || q.qs ELSE '' END END AS sanitized_url,
       CASE WHEN p.is_http AND NOT p.err THEN p.frag <> '' ELSE FALSE END AS dropped_fragment,
       CASE WHEN p.is_http AND NOT p.err THEN coalesce(q.red_keys, CAST([] AS VARCHAR[])) ELSE CAST([] AS VARCHAR[]) END AS redacted_keys,
       p.err AS sanitize_error
FROM p2 p LEFT JOIN q5 q ON q.src = p.src AND q.id = p.id"""
    )


SANITIZE_SQL = _sanitize_sql()


@register("sanitize_urls", SANITIZE_SQL)
def q_sanitize_urls(spark, sf):
    from dwell.functions.urls import sanitize_urls

    return sanitize_urls(url_corpus(spark, sf))


def _forms_sql() -> str:
    forms = ", ".join(Q.q(x) for x in SM.URL_FORMS)
    h = "md5(event_id::VARCHAR)"
    u = "concat_ws('-', " + ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"
    url = f"list_extract([{forms}], (event_id % {len(SM.URL_FORMS)} + 1)::INT)"
    for mark, value in (("{n}", "event_id::VARCHAR"), ("{h}", h), ("{u}", u), ("{t}", "'some+words' || repeat('+and+more', 15) || event_id::VARCHAR")):
        url = f"replace({url}, '{mark}', {value})"
    return f"SELECT 'form' AS src, event_id AS id, {url} AS url FROM events"


@register("sanitize_url_forms", _sanitize_sql("WITH ", _forms_sql()))
def q_sanitize_url_forms(spark, sf):
    """F8-F13, F15 over URLs of every kind that they tell apart."""
    from dwell.functions.urls import sanitize_urls

    return sanitize_urls(SM.url_forms(SM.load(spark, sf, "events")))


@register(
    "redaction_report",
    "WITH s AS (" + SANITIZE_SQL + ")\n"
    + f"""SELECT {Q.host_sql('url')} AS host, key, count(*) AS urls
FROM (SELECT url, unnest(redacted_keys) AS key FROM s) GROUP BY ALL
UNION ALL
SELECT {Q.host_sql('url')} AS host, '#fragment' AS key, count(*) AS urls FROM s WHERE dropped_fragment GROUP BY ALL""",
)
def q_redaction_report(spark, sf):
    from dwell.plans.urls_report import redaction_report

    return redaction_report(q_sanitize_urls(spark, sf))


# --------------------------------------------------- streams and the label store

STREAM_CUTS = 3
#: the last row of a replayed stream: far beyond the data, it moves the watermark past all of it
TICK = "timestamp_ntz'2200-01-01'"
TICK_ID = "-9007199254740992"
#: replayed spans of two streams don't fall together; a delay as long as the data keeps all rows on time
REPLAY_DELAY = "3650 days"


def _replayed(df: DataFrame, order: str, **tick) -> DataFrame:
    from dwell.streaming import replay as RY

    return RY.as_stream(RY.tick(df, **tick) if tick else df, order, STREAM_CUTS)


@register("stream_override_asof", ORACLE["override_asof"])
def q_stream_override_asof(spark, sf):
    """J4 over two replayed streams."""
    from dwell.functions.urls import tab_should_transmit
    from dwell.streaming import replay as RY
    from dwell.streaming.asof import stream_tab_override

    snaps = SM.tab_snapshots(SM.load(spark, sf, "pages")).where(tab_should_transmit("url"))
    ends = {"device_id": "'tick'", "ts": TICK, "seq": "0"}
    out = stream_tab_override(_replayed(samples(spark, sf), "ts", **ends), _replayed(snaps, "ts", **ends), REPLAY_DELAY)
    out = RY.run_to_table(out, "override_asof").where("NOT is_snapshot AND device_id <> 'tick'")
    return out.drop("is_late", "is_snapshot")


@register("stream_change_feed", ORACLE["change_feed"])
def q_stream_change_feed(spark, sf):
    """R7 over three replayed logs."""
    from dwell.operators.labels import valid_events
    from dwell.streaming import replay as RY
    from dwell.streaming.feed import stream_change_feed

    ev, cl, ov = _store(spark, sf)
    out = stream_change_feed(
        _replayed(valid_events(ev), "created_at", id=TICK_ID, created_at=TICK), _replayed(cl, "created_at", event_id=TICK_ID, seq="0", created_at=TICK), _replayed(ov, "seq"), REPLAY_DELAY
    )
    return RY.run_to_table(out, "change_feed").where(f"event_id <> {TICK_ID}").select("kind", "kind_ord", "event_id", "seq")


SILENCE_S = 900
SILENT_SQL = (
    SAMPLES_MOD4
    + f""",
sil AS (SELECT *, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, seq) AS nts FROM samples),
mk AS (
  SELECT device_id, ts, seq, app, title, url, FALSE AS closing FROM sil
  UNION ALL
  SELECT device_id, ts + INTERVAL {SILENCE_S} SECOND, 4611686018427387904, NULL, NULL, NULL, TRUE FROM sil
  WHERE nts IS NULL OR {Q.secs('ts', 'nts')} > {SILENCE_S}),
ml AS (SELECT *, lag(closing) OVER w AS pc, lag(app) OVER w AS pa, lag(title) OVER w AS pt, lag(url) OVER w AS pu, row_number() OVER w AS rn
       FROM mk WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)),
mb AS (SELECT * FROM ml WHERE rn = 1 OR closing <> pc OR app IS DISTINCT FROM pa OR title IS DISTINCT FROM pt OR url IS DISTINCT FROM pu),
me AS (SELECT *, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, seq) AS end_time FROM mb)
SELECT ts AS start_time, end_time, {Q.secs('ts', 'end_time')} AS duration_sec, app, title, url, device_id
FROM me WHERE end_time IS NOT NULL AND NOT closing AND app IS NOT NULL"""
)


@register("silent_sessions", SILENT_SQL)
def q_silent_sessions(spark, sf):
    """R4 without markers: sessions of devices that fall silent."""
    return S.sessionize_silent(samples(spark, sf), SILENCE_S)


@register("stream_silent_sessions", SILENT_SQL)
def q_stream_silent_sessions(spark, sf):
    """The same from a replayed stream, closed by event-time timers."""
    from dwell.streaming import replay as RY
    from dwell.streaming import sessions as SS

    src = _replayed(samples(spark, sf).drop("idle_seconds"), "ts", device_id="'tick'", ts=TICK, seq="0")
    out = SS.on_time(RY.run_to_table(SS.stream_sessions(src, silence_seconds=SILENCE_S, delay=REPLAY_DELAY), "silent"))
    return out.where("device_id <> 'tick'").select("start_time", "end_time", "duration_sec", "app", "title", "url", "device_id")


def _calendar_sql(trunc: str) -> str:
    daily = ORACLE["daily_productivity"]
    return f"SELECT date_trunc('{trunc}', date)::DATE AS start, productivity, sum(minutes) AS minutes, sum(parts)::BIGINT AS parts FROM ({daily}) GROUP BY ALL"


def _calendar(spark, sf, period: str) -> DataFrame:
    from dwell.streaming import calendar as CA
    from dwell.streaming import replay as RY

    src = _replayed(labelled_sessions(spark, sf, "user"), "start_time", start_time=TICK, end_time=TICK)
    out = RY.run_to_table(getattr(CA, period)(src, 3650), period)
    return out.where("start < DATE'2190-01-01'").select("start", "productivity", F.round("minutes", 6).alias("minutes"), "parts")


@register("stream_weekly_totals", f"SELECT start, productivity, round(minutes, 6) AS minutes, parts FROM ({_calendar_sql('week')})")
def q_stream_weekly_totals(spark, sf):
    """Weeks of a replayed stream of sessions."""
    return _calendar(spark, sf, "weekly")


@register("stream_monthly_totals", f"SELECT start, productivity, round(minutes, 6) AS minutes, parts FROM ({_calendar_sql('month')})")
def q_stream_monthly_totals(spark, sf):
    """Calendar months of a replayed stream of sessions."""
    return _calendar(spark, sf, "monthly")


DELETED_SQL = STORE + """,
gone AS (SELECT DISTINCT id AS event_id FROM store_events WHERE id % 9 = 0),
kept AS (SELECT * FROM valid WHERE id NOT IN (SELECT event_id FROM gone))
SELECT v.id, coalesce(o.category_id, c.category_id) AS category_id,
       CASE WHEN o.category_id IS NOT NULL THEN 'override' WHEN c.category_id IS NOT NULL THEN 'engine' END AS label_source,
       c.category_id AS engine_category, o.category_id AS override_category
FROM kept v LEFT JOIN (SELECT * FROM latest_c WHERE engine_version = 'rules-v1') c ON c.event_id = v.id
LEFT JOIN cur_o o ON o.event_id = v.id"""


def _tombstones(events: DataFrame) -> DataFrame:
    """Every ninth event is deleted."""
    return events.where(F.col("id") % 9 == 0).select(F.col("id").alias("event_id"))


@register("labels_after_deletes", DELETED_SQL)
def q_labels_after_deletes(spark, sf):
    """Deletes take an event's labels and overrides along."""
    from dwell.operators.labels import effective_labels, valid_events

    ev, cl, ov = _store(spark, sf)
    return effective_labels(valid_events(ev), cl, ov, "rules-v1", _tombstones(ev))


@register("labels_after_compaction", DELETED_SQL)
def q_labels_after_compaction(spark, sf):
    """The logs arrive in commits of three streams, with compactions between
    them; the reader merges compacted runs with later commits."""
    from dwell.operators.labels import valid_events
    from dwell.session import scratch_path
    from dwell.streaming.store import Store

    ev, cl, ov = _store(spark, sf)
    store = Store(spark, scratch_path(spark, "store"))
    utc = F.to_timestamp("created_at")
    ev2 = valid_events(ev).withColumns({"created_at": utc, "stream_id": F.lit("a")})
    cl2 = cl.withColumn("created_at", utc)
    ov2 = ov.withColumn("created_at", F.to_timestamp(F.lit("2024-01-01")))
    for i in range(STREAM_CUTS):
        third = F.pmod(F.col("seq"), F.lit(STREAM_CUTS)) == i
        store.commit("events", "r", i, {"events": ev2.where(F.col("id") % STREAM_CUTS == i)})
        store.commit("labels", "r", i, {"engine_classifications": cl2.where(third)})
        store.commit("user", f"r{i}", 0, {"user_overrides": ov2.where(third)})
        if i == 1:
            store.commit("user", "d", 0, {"tombstones": _tombstones(ev).withColumn("created_at", F.current_timestamp())})
        if i < STREAM_CUTS - 1:
            store.compact()
    return store.effective("rules-v1")


@register(
    "suggestion_cache",
    BACKLOG_SQL
    + """
SELECT s.keyword, s.category, s.productive, CASE WHEN length(s.keyword) % 10 = 0 THEN 2 ELSE 1 END AS attempt FROM sugg s""",
)
def q_suggestion_cache(spark, sf):
    """Two runs over one cache. The first asks for half of the backlog and fails
    now and then; the second asks only for what has no answer yet."""
    from dwell.operators import keywords as K
    from dwell.operators import suggestions as SG
    from dwell.session import scratch_path
    from dwell.streaming.store import Store

    cl, _ = _keyword_classified(spark, sf)
    backlog = K.label_backlog(cl)
    store = Store(spark, scratch_path(spark, "suggestions"))

    def labeller(fails):
        def answer(app, title, url):
            n = len(title)
            if fails and n % 5 == 0:
                raise TimeoutError("no answer")
            return {"category": ("Research", "Shopping", "Unknown")[n % 3], "productive": n % 2 == 0}

        return answer

    # the labeller sees the keyword itself, as the title it is to judge
    asked = backlog.withColumn("title", F.col("keyword"))
    SG.ask(store, asked.where(F.length("keyword") % 2 == 0), labeller(True), "first")
    SG.ask(store, asked, labeller(False), "second")
    return store.suggestions().select("keyword", "category", "productive", "attempt")


CAPTURE_SQL = (
    SAMPLES_MOD4
    + ","
    + SNAPSHOTS_SQL
    + """,
cj AS (
  SELECT s.*, p.title AS pt, p.url AS pu, p.ts AS pts FROM samples s
  ASOF LEFT JOIN snaps_ok p ON s.device_id = p.device_id AND s.ts >= p.ts),
co AS (
  SELECT device_id, ts, seq, app, idle_seconds,
         CASE WHEN app = 'Firefox' AND pts IS NOT NULL AND coalesce(pt, '') <> '' THEN pt ELSE title END AS title,
         CASE WHEN app = 'Firefox' AND pts IS NOT NULL AND coalesce(pu, '') <> '' THEN pu ELSE url END AS url
  FROM cj),
san AS ("""
    + _sanitize_sql("WITH ", "SELECT 'sample' AS src, seq AS id, url FROM co")
    + f"""),
cs AS (
  SELECT co.* EXCLUDE (url), coalesce(CASE WHEN co.url IS NULL THEN NULL WHEN san.sanitize_error THEN trim(co.url) ELSE san.sanitized_url END, '') AS url,
         coalesce(idle_seconds >= {IDLE_S}, FALSE) AS idle
  FROM co JOIN san ON san.id = co.seq),
ck AS (
  SELECT *, CASE WHEN idle THEN NULL ELSE app END AS ka, CASE WHEN idle THEN NULL ELSE url END AS ku,
         CASE WHEN idle THEN NULL WHEN url = '' THEN title END AS kt
  FROM cs WHERE idle OR (app IS NOT NULL AND app <> '' AND coalesce(title <> 'frontProcess Error', TRUE))),
cl AS (
  SELECT *, row_number() OVER w AS rn, lag(idle) OVER w AS pi, lag(ka) OVER w AS pa, lag(ku) OVER w AS pku, lag(kt) OVER w AS pkt
  FROM ck WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)),
cb AS (SELECT * FROM cl WHERE rn = 1 OR idle <> pi OR ka IS DISTINCT FROM pa OR ku IS DISTINCT FROM pku OR kt IS DISTINCT FROM pkt),
ce AS (SELECT *, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, seq) AS end_time FROM cb),
cev AS (
  SELECT device_id, {Q.us('ts')} / 1e6 AS start_ts, {Q.us('end_time')} / 1e6 AS end_ts, app, coalesce(title, '') AS title, url
  FROM ce WHERE end_time IS NOT NULL AND NOT idle),"""
    + Q.rule_dims_cte()
    + ","
    + Q.classify_cte("cev", ["device_id", "start_ts"], "cv", variant="v1")
    + """
SELECT device_id, start_ts, end_ts, app, title, url, category AS category_id, rule_id, CAST(1.0 AS DOUBLE) AS confidence,
       '{"productive":' || CASE WHEN is_productive THEN 'true' ELSE 'false' END || '}' AS meta_json
FROM cv"""
)
CAPTURED = ["device_id", "start_ts", "end_ts", "app", "title", "url", "category_id", "rule_id", "confidence", "meta_json"]


def _capture_inputs(spark, sf) -> tuple[DataFrame, DataFrame]:
    from dwell.functions.urls import tab_should_transmit

    sm = samples(spark, sf).withColumn("is_idle", S.is_idle("idle_seconds", IDLE_S)).drop("idle_seconds")
    return sm, SM.tab_snapshots(SM.load(spark, sf, "pages")).where(tab_should_transmit("url"))


@register("capture_to_labels", CAPTURE_SQL)
def q_capture_to_labels(spark, sf):
    """The assembled pipeline over stored samples: J4, F15, W2, P3, F7."""
    from dwell.streaming.capture import capture
    from dwell.streaming.store import RulesEngine

    return capture(*_capture_inputs(spark, sf), RulesEngine(C.RuleSet.build(spark))).select(*CAPTURED)


@register("stream_capture_to_labels", CAPTURE_SQL)
def q_stream_capture_to_labels(spark, sf):
    """The same from two replayed streams into a committed store, and read back."""
    from dwell.session import scratch_path
    from dwell.streaming import sessions as SS
    from dwell.streaming.capture import capture_stream
    from dwell.streaming.store import RulesEngine, Store

    sm, snaps = _capture_inputs(spark, sf)
    ends = {"device_id": "'tick'", "ts": TICK, "seq": "0"}
    store = Store(spark, scratch_path(spark, "capture"))
    checkpoint = SS.checkpoint_location(spark, store.root.rsplit("/", 1)[1])
    q = capture_stream(_replayed(sm, "ts", **ends), _replayed(snaps, "ts", **ends), store, "desk", RulesEngine(C.RuleSet.build(spark)), checkpoint, REPLAY_DELAY)
    q.awaitTermination()
    labels = store.labels("rules-v1").withColumnRenamed("event_id", "id")
    return store.events().where("device_id <> 'tick'").join(labels, "id", "left").select(*CAPTURED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
