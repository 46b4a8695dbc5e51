"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

These are written independently of the Spark plans: plain windows over the whole
device (no buckets), theta joins for prefix rules, ``row_number`` for
latest-wins. The rule dimensions are VALUES lists generated from the same
rules document the Spark side reads.
"""

from __future__ import annotations

from dwell.sources.rules import AMBIGUOUS_HOSTS, BROWSER_APPS, DEFAULT_KEYWORD_INDEX, DEFAULT_RULES
from dwell.sources.samples import LINKS

URL_RE = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _in_list(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def samples_cte(device: str = "mod4") -> str:
    links = ", ".join(f"({i}, {q(t)}, {q(u)})" for i, (t, u) in enumerate(LINKS))
    dev = "concat('dev-', CAST(user_id % 4 AS VARCHAR))" if device == "mod4" else "concat('dev-', CAST(user_id AS VARCHAR))"
    return f"""
links(i, l_title, l_url) AS (SELECT * FROM (VALUES {links}) v(i, t, u)),
ev AS (SELECT event_id, ts, user_id, event_type, value,
              CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events),
samples AS (
  SELECT {dev} AS device_id, ts, event_id AS seq,
         CASE WHEN event_type IN ('view', 'click') THEN 'Google Chrome'
              WHEN event_type = 'purchase' THEN 'Firefox'
              WHEN event_type = 'signup' THEN 'Visual Studio Code'
              ELSE 'Idle' END AS app,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN l_title
              WHEN event_type = 'error' THEN 'Idle'
              WHEN k % 2 = 0 THEN 'main.py' ELSE 'test.py' END AS title,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN l_url END AS url,
         value * 10 AS idle_seconds
  FROM ev JOIN links ON links.i = ev.k % 6)"""


def us(a: str) -> str:
    return f"epoch_us(CAST({a} AS TIMESTAMP))"


def secs(a: str, b: str) -> str:
    return f"(({us(b)} - {us(a)}) / 1e6)"


def raw_sessions_cte(src: str = "samples", name: str = "raw_sessions", close_ts: str | None = None) -> str:
    end = "lead(ts) OVER (PARTITION BY device_id ORDER BY ts, seq)"
    if close_ts:
        end = f"coalesce({end}, TIMESTAMP '{close_ts}')"
    return f"""
{name}_l AS (
  SELECT *, row_number() OVER w AS rn, lag(app) OVER w AS papp, lag(title) OVER w AS ptitle, lag(url) OVER w AS purl
  FROM {src} WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)),
{name}_b AS (
  SELECT * FROM {name}_l
  WHERE rn = 1 OR app IS DISTINCT FROM papp OR title IS DISTINCT FROM ptitle OR url IS DISTINCT FROM purl),
{name}_e AS (SELECT *, {end} AS end_time FROM {name}_b),
{name} AS (
  SELECT ts AS start_time, end_time, {secs('ts', 'end_time')} AS duration_sec, app, title, url, device_id
  FROM {name}_e WHERE end_time IS NOT NULL AND app IS NOT NULL)"""


def rule_dims_cte() -> str:
    apps, doms = [], []
    for ci, (cat, r) in enumerate(DEFAULT_RULES.items()):
        p = "TRUE" if r.get("productive") else "FALSE"
        for pi, t in enumerate(r.get("apps", [])):
            apps.append(f"({ci}, {pi}, {q(t)}, {q(cat)}, {p})")
        for pi, t in enumerate(r.get("domains", [])):
            doms.append(f"({ci}, {pi}, {q(t)}, {q(cat)}, {p})")
    return f"""
rules_app(cat_ord, pos, tok, category, productive) AS (SELECT * FROM (VALUES {', '.join(apps)})),
app_dim AS (
  SELECT app_token, category, productive FROM (
    SELECT lower(trim(tok)) AS app_token, category, productive,
           row_number() OVER (PARTITION BY lower(trim(tok)) ORDER BY cat_ord DESC, pos DESC) AS r
    FROM rules_app WHERE lower(trim(tok)) <> '') WHERE r = 1),
rules_dom(cat_ord, pos, tok, category, productive) AS (SELECT * FROM (VALUES {', '.join(doms)})),
dom0 AS (
  SELECT cat_ord, pos, category, productive, t,
         CASE WHEN instr(t, '/') > 0 THEN trim(substr(t, instr(t, '/') + 1)) ELSE '' END AS rest
  FROM (SELECT *, lower(trim(tok)) AS t FROM rules_dom) WHERE t <> ''),
dom_dim AS (
  SELECT trim(split_part(t, '/', 1)) AS host,
         CASE WHEN instr(t, '/') > 0 AND rest <> '' AND NOT starts_with(rest, '/') THEN '/' || rest ELSE rest END AS prefix,
         category, productive, cat_ord, pos
  FROM dom0 WHERE trim(split_part(t, '/', 1)) <> '')"""


def host_sql(url: str) -> str:
    auth = f"regexp_extract(coalesce({url}, ''), '{URL_RE}', 1)"
    hostinfo = f"regexp_extract({auth}, '([^@]*)$', 1)"
    return (
        f"lower(CASE WHEN starts_with({hostinfo}, '[') THEN regexp_extract({hostinfo}, '^\\[([^\\]]*)\\]', 1) "
        f"ELSE split_part({hostinfo}, ':', 1) END)"
    )


def path_sql(url: str) -> str:
    return f"regexp_replace(regexp_extract(coalesce({url}, ''), '{URL_RE}', 2), ';[^/]*$', '')"


def keyword_dim_cte() -> str:
    rows = []
    cats = list(DEFAULT_RULES)
    for ci, (cat, entries) in enumerate(DEFAULT_KEYWORD_INDEX.items()):
        for oi, e in enumerate(entries):
            rows.append(f"({ci}, {oi}, {q(cat)}, {q(e['keyword'])})")
    return f"""
kw_index(cat_ord, ord, category, keyword) AS (SELECT * FROM (VALUES {', '.join(rows)})),
kw_dim AS (
  SELECT k.keyword, k.category, coalesce(r.productive, FALSE) AS productive FROM (
    SELECT lower(trim(keyword)) AS keyword, category,
           row_number() OVER (PARTITION BY lower(trim(keyword)) ORDER BY cat_ord, ord) AS r
    FROM kw_index WHERE lower(trim(keyword)) <> '') k
  LEFT JOIN (SELECT DISTINCT category, productive FROM rules_app UNION SELECT DISTINCT category, productive FROM rules_dom) r
    ON r.category = k.category
  WHERE k.r = 1)"""


def words_sql(title: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({title}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 4)"


def candidates_sql(title: str) -> str:
    w = words_sql(title)
    return (
        f"CASE WHEN len({w}) >= 2 AND array_to_string({w}[1:2], ' ') = array_to_string({w}[-2:], ' ') "
        f"THEN [array_to_string({w}[1:2], ' ')] "
        f"WHEN len({w}) >= 2 THEN [array_to_string({w}[1:2], ' '), array_to_string({w}[-2:], ' ')] "
        f"WHEN len({w}) = 1 THEN [{w}[1]] ELSE [] END"
    )


def keyword_sql(title: str) -> str:
    return f"nullif(array_to_string({words_sql(title)}[1:2], ' '), '')"


def classify_cte(src: str, keys: list[str], name: str, variant: str = "v1", keywords: bool = False) -> str:
    """Label every row of ``src`` (unique on ``keys``)."""
    tr = (lambda x: f"trim({x})") if variant == "v1" else (lambda x: x)
    keyj = ", ".join(keys)
    on = " AND ".join(f"m.{k} = x.{k}" for k in keys)
    kw_cols = ""
    kw_join = ""
    if keywords:
        kw_cols = f", {candidates_sql('title')} AS cands"
        kw_join = (
            " LEFT JOIN kw_dim k1 ON k1.keyword = x.cands[1] LEFT JOIN kw_dim k2 ON k2.keyword = x.cands[2]"
        )
    base = f"""
{name}_x AS (
  SELECT s.*, lower({tr("coalesce(app, '')")}) AS app_n, lower({tr("coalesce(title, '')")}) AS title_n,
         {tr(host_sql('url'))} AS host, lower({tr(path_sql('url'))}) AS path {kw_cols}
  FROM {src} s),
{name}_m AS (
  SELECT {', '.join('x.' + k for k in keys)}, d.category AS d_cat, d.productive AS d_prod, d.prefix AS d_prefix,
         row_number() OVER (PARTITION BY {', '.join('x.' + k for k in keys)} ORDER BY length(d.prefix) DESC, d.cat_ord, d.pos) AS r
  FROM {name}_x x JOIN dom_dim d ON x.host = d.host AND starts_with(x.path, d.prefix)),"""
    idle = "(x.app_n = 'idle' OR x.title_n = 'idle')"
    if variant == "v1":
        body = f"""
{name} AS (
  SELECT x.*,
         CASE WHEN {idle} THEN 'Idle' WHEN a.category IS NOT NULL THEN a.category
              WHEN m.d_cat IS NOT NULL THEN m.d_cat ELSE 'Unknown' END AS category,
         CASE WHEN {idle} THEN FALSE WHEN a.category IS NOT NULL THEN a.productive
              WHEN m.d_cat IS NOT NULL THEN m.d_prod ELSE FALSE END AS is_productive,
         CASE WHEN {idle} THEN 'idle' WHEN a.category IS NOT NULL THEN 'app:' || x.app_n
              WHEN m.d_cat IS NOT NULL THEN 'domain:' || x.host || m.d_prefix END AS rule_id
  FROM {name}_x x LEFT JOIN app_dim a ON x.app_n = a.app_token
  LEFT JOIN (SELECT * FROM {name}_m WHERE r = 1) m ON {on})"""
    else:
        kwhit = "(k1.category IS NOT NULL OR k2.category IS NOT NULL)" if keywords else "FALSE"
        kwcat = "coalesce(k1.category, k2.category)" if keywords else "NULL"
        kwprod = "CASE WHEN k1.category IS NOT NULL THEN k1.productive ELSE k2.productive END" if keywords else "NULL"
        kwword = "CASE WHEN k1.category IS NOT NULL THEN k1.keyword ELSE k2.keyword END" if keywords else "NULL"
        usekw = f"(NOT {idle} AND a.category IS NULL AND {kwhit} AND (m.d_cat IS NULL OR x.host IN {_in_list(AMBIGUOUS_HOSTS)}))"
        body = f"""
{name} AS (
  SELECT x.*,
         CASE WHEN {idle} THEN 'Idle' WHEN a.category IS NOT NULL THEN a.category WHEN {usekw} THEN {kwcat}
              WHEN m.d_cat IS NOT NULL THEN m.d_cat ELSE 'Unknown' END AS category,
         CASE WHEN {idle} THEN FALSE WHEN a.category IS NOT NULL THEN a.productive WHEN {usekw} THEN {kwprod}
              WHEN m.d_cat IS NOT NULL THEN m.d_prod ELSE FALSE END AS is_productive,
         CASE WHEN {usekw} THEN {kwword} END AS matched_keyword,
         {kwword} AS index_keyword, {kwcat} AS index_category, {kwprod} AS index_productive
  FROM {name}_x x LEFT JOIN app_dim a ON x.app_n = a.app_token
  LEFT JOIN (SELECT * FROM {name}_m WHERE r = 1) m ON {on} {kw_join})"""
    return base + body


def sessions_ctes(device: str = "mod4") -> str:
    """samples -> raw sessions -> labelled (legacy rules, no keyword index)."""
    return (
        "WITH "
        + samples_cte(device).strip()
        + ","
        + raw_sessions_cte()
        + ","
        + rule_dims_cte()
        + ","
        + classify_cte("raw_sessions", ["device_id", "start_time"], "sess_c", variant="legacy")
        + """,
sessions AS (SELECT start_time, end_time, duration_sec, app, title, url, category, is_productive, device_id FROM sess_c)"""
    )


BROWSERS = _in_list(BROWSER_APPS)
AMBIG = _in_list(AMBIGUOUS_HOSTS)
