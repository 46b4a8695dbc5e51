"""Column functions for titles, URLs (host/path for rules), keys and labels.

All are built-in expressions (no Python UDF), so they stay in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwell.sources.rules import AMBIGUOUS_HOSTS, BROWSER_APPS

# scheme "://" authority path — the parts a URL parser splits before query/fragment
_URL_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_host(url: Column | str) -> Column:
    """F1 host: authority minus userinfo (up to the last '@') and port, lower-cased;
    bracketed IPv6 hosts lose their brackets; '' when there is no '//' authority."""
    auth = F.regexp_extract(F.coalesce(_c(url), F.lit("")), _URL_RE, 1)
    hostinfo = F.substring_index(auth, "@", -1)
    bracketed = F.regexp_extract(hostinfo, r"^\[([^\]]*)\]", 1)
    plain = F.substring_index(hostinfo, ":", 1)
    return F.lower(F.when(hostinfo.startswith("["), bracketed).otherwise(plain))


def url_path(url: Column | str) -> Column:
    """F1 path: the path component with ';params' of the last segment removed."""
    path = F.regexp_extract(F.coalesce(_c(url), F.lit("")), _URL_RE, 2)
    return F.regexp_replace(path, r";[^/]*$", "")


def title_words(title: Column | str) -> Column:
    """Lower-cased words of at least 4 chars split on non [a-z0-9]."""
    parts = F.split(F.lower(F.coalesce(_c(title), F.lit(""))), "[^a-z0-9]+")
    return F.filter(parts, lambda w: F.length(w) >= 4)


def keyword_candidates(title: Column | str) -> Column:
    """[first two words] and [last two words] (deduplicated); one word -> itself."""
    ws = title_words(title)
    n = F.size(ws)
    lead = F.array_join(F.slice(ws, 1, 2), " ")
    trail = F.array_join(F.slice(ws, -2, 2), " ")
    return (
        F.when(n >= 2, F.array_distinct(F.array(lead, trail)))
        .when(n == 1, F.array(F.get(ws, 0)))
        .otherwise(F.array().cast("array<string>"))
    )


def keyword(title: Column | str) -> Column:
    """first two words (>=4 chars) joined by a space, or null."""
    return F.nullif(F.array_join(F.slice(title_words(title), 1, 2), " "), F.lit(""))


def is_browser(app: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(_c(app), F.lit("")))).isin(BROWSER_APPS)


def is_ambiguous_host(host: Column | str) -> Column:
    return _c(host).isin(AMBIGUOUS_HOSTS)


def context_key(app: Column | str, host: Column | str, title: Column | str) -> Column:
    """F4 cache / context key: browser-or-no-app with a host -> host (plus
    '|keyword' on ambiguous hosts); else app, else host, else 'unknown'."""
    app_norm = F.lower(F.trim(F.coalesce(_c(app), F.lit(""))))
    h = F.coalesce(_c(host), F.lit(""))
    kw = keyword(title)
    browserish = (app_norm.isin(BROWSER_APPS) | (app_norm == "")) & (h != "")
    host_key = F.when(h.isin(AMBIGUOUS_HOSTS) & kw.isNotNull(), F.concat(h, F.lit("|"), kw)).otherwise(h)
    return F.when(browserish, host_key).otherwise(
        F.coalesce(F.nullif(app_norm, F.lit("")), F.nullif(h, F.lit("")), F.lit("unknown"))
    )


def productivity_label(is_productive: Column | str, null_as: str | None = None) -> Column:
    """True -> 'productive', false -> 'unproductive', null -> ``null_as``."""
    p = _c(is_productive)
    return F.when(p, F.lit("productive")).when(~p, F.lit("unproductive")).otherwise(F.lit(null_as))


def parse_delimited_sample(line: Column | str, legacy: bool = True) -> Column:
    """S14: 'app||title||url' (legacy: trim, missing -> '', empty url -> null) or the
    newer 'title||url' form (no trim). Returns a struct."""
    parts = F.split(F.coalesce(_c(line), F.lit("")), r"\|\|")
    if legacy:
        part = lambda i: F.coalesce(F.trim(F.get(parts, i)), F.lit(""))
        return F.struct(
            part(0).alias("app"), part(1).alias("title"), F.nullif(part(2), F.lit("")).alias("url")
        )
    part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    return F.struct(part(0).alias("title"), part(1).alias("url"))


def canonical_json(meta: Column | str) -> Column:
    """F16: JSON of a map with keys sorted and no spaces; null stays null."""
    m = _c(meta)
    return F.when(m.isNull(), F.lit(None)).otherwise(
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    )


SUGGESTION_SCHEMA = "category string, productive boolean, confidence double, rationale string"


def parse_suggestion(message: Column | str) -> Column:
    """labeller JSON reply -> struct; missing category -> 'Unknown', productive -> bool."""
    s = F.from_json(_c(message), SUGGESTION_SCHEMA)
    return F.struct(
        F.coalesce(F.nullif(s.getField("category"), F.lit("")), F.lit("Unknown")).alias("category"),
        F.coalesce(s.getField("productive"), F.lit(False)).alias("productive"),
        s.getField("confidence").alias("confidence"),
        s.getField("rationale").alias("rationale"),
    )
