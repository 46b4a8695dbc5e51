"""URL hygiene as column expressions (F8-F15, A9 inputs).

``sanitize_url`` drops fragment and userinfo, lower-cases the host, keeps the
port, replaces id-like path segments with placeholders, redacts sensitive query
values and sorts the query by key — all with built-in expressions (regex,
``split``/``transform``/``filter``/``array_sort``, ``url_decode``/``url_encode``),
so a URL column of any size is cleaned inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# value/segment patterns, sensitive key substrings and limits.
# ---------------------------------------------------------------------------
UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX_RE = r"^[0-9a-fA-F]{16,}$"
B64URL_RE = r"^[A-Za-z0-9_-]{24,}$"
JWT_RE = r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"
EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SENSITIVE_KEY_SUBSTRINGS = (
    "pass", "password", "pwd",
    "token", "access_token", "refresh_token", "serviceToken", "id_token", "session", "auth",
    "key", "api_key", "secret", "signature", "sig",
    "code", "otp", "pin", "assertion",
    "cookie", "jwt", "saml",
    "email", "phone", "user", "username",
    "redirect", "return", "next", "continue",
)
MAX_VALUE_LEN = 128
COMPACT_SECRET_MIN_LEN = 48
REDACTED = "_REDACTED_"

SENSITIVE_KEY_RE = "|".join(re.escape(s) for s in SENSITIVE_KEY_SUBSTRINGS)
DIGITS_RE = r"^\p{Nd}+$"
_WS = r"(?U)^\s+|\s+$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pystrip(x: Column) -> Column:
    """str.strip(): remove leading/trailing (Unicode) whitespace."""
    return F.regexp_replace(x, _WS, "")


def _escape_bad_percent(x: Column) -> Column:
    """'%' not followed by two hex digits stays literal (as Python's unquote)."""
    return F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")


def unquote(x: Column) -> Column:
    """Percent-decoding that leaves '+' and malformed escapes alone."""
    return F.url_decode(F.replace(_escape_bad_percent(x), F.lit("+"), F.lit("%2B")))


def unquote_plus(x: Column) -> Column:
    """Form decoding: '+' is a space, then percent-decoding."""
    return F.url_decode(_escape_bad_percent(F.replace(x, F.lit("+"), F.lit(" "))))


def quote_plus(x: Column) -> Column:
    """Form encoding keeping A-Za-z0-9_.-~ (space -> '+')."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def segment_placeholder(seg: Column) -> Column:
    """F9 placeholder for one path segment ([INT] [UUID] [EMAIL] [JWT] [ID]
    [TEXT_LONG] in that order); blank -> ''; otherwise the stripped segment."""
    s = pystrip(seg)
    return (
        F.when(s == "", F.lit(""))
        .when(s.rlike(DIGITS_RE), F.lit("[INT]"))
        .when(s.rlike(UUID_RE), F.lit("[UUID]"))
        .when(s.rlike(EMAIL_RE), F.lit("[EMAIL]"))
        .when(s.rlike(JWT_RE), F.lit("[JWT]"))
        .when(s.rlike(HEX_RE) | s.rlike(B64URL_RE), F.lit("[ID]"))
        .when(F.length(s) > 64, F.lit("[TEXT_LONG]"))
        .otherwise(s)
    )


def sanitize_path(path: Column) -> Column:
    """'' -> '/'; empty segments (and so the trailing slash) are dropped."""
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(path == "", F.lit("/")).otherwise(
        F.concat(F.lit("/"), F.array_join(F.transform(segs, segment_placeholder), "/"))
    )


def is_sensitive_key(key: Column) -> Column:
    """the lower-cased key contains one of the sensitive substrings."""
    return F.lower(key).rlike(SENSITIVE_KEY_RE)


def looks_like_embedded_url(val: Column) -> Column:
    """after up to two more percent-decodes, an http(s) URL with a host."""
    d1 = unquote(val)
    d2 = F.when(d1 == val, d1).otherwise(unquote(d1))
    netloc = F.regexp_extract(d2, r"^[Hh][Tt][Tt][Pp][Ss]?://([^/?#]*)", 1)
    has_scheme = d2.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://")
    hostinfo = F.substring_index(netloc, "@", -1)
    host = F.when(hostinfo.startswith("["), F.regexp_extract(hostinfo, r"^\[([^\]]*)", 1)).otherwise(
        F.substring_index(hostinfo, ":", 1)
    )
    return has_scheme & (host != "")


def looks_like_compact_secret(val: Column) -> Column:
    """>= 48 chars, no whitespace, >= 3 of lower/upper/digit/other."""
    classes = (
        val.rlike(r"\p{Ll}").cast("int")
        + val.rlike(r"\p{Lu}").cast("int")
        + val.rlike(r"\p{Nd}").cast("int")
        + val.rlike(r"[^\p{L}\p{N}]").cast("int")
    )
    return (F.length(val) >= COMPACT_SECRET_MIN_LEN) & ~val.rlike(r"(?U)\s") & (classes >= 3)


def is_sensitive_value(val: Column) -> Column:
    """email, jwt-like, uuid, hex >= 16, base64url >= 24, embedded URL,
    compact secret, or longer than 128 chars."""
    return (val != "") & (
        val.rlike(EMAIL_RE)
        | val.rlike(JWT_RE)
        | val.rlike(UUID_RE)
        | val.rlike(HEX_RE)
        | val.rlike(B64URL_RE)
        | looks_like_embedded_url(val)
        | looks_like_compact_secret(val)
        | (F.length(val) > MAX_VALUE_LEN)
    )


def _split_url(url: Column) -> dict[str, Column]:
    """urlsplit of an http(s) URL: scheme, netloc, path, query, fragment."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.substr(url, F.length(scheme) + 2)
    has_netloc = rest.startswith("//")
    netloc = F.when(has_netloc, F.regexp_extract(rest, r"^//([^/?#]*)", 1)).otherwise(F.lit(""))
    after = F.when(has_netloc, F.regexp_extract(rest, r"(?s)^//[^/?#]*(.*)\z", 1)).otherwise(rest)
    return {"scheme": scheme, "netloc": netloc, "after": after}


def _item_struct(key: Column, val: Column, i: Column, red: Column) -> Column:
    return F.struct(F.lower(key).alias("lk"), i.alias("i"), key.alias("key"), val.alias("val"), red.alias("red"))


def sanitize_urls(df: DataFrame, url: str = "url", on_error: str = "null", keep_work: bool = False) -> DataFrame:
    """F8 + F15 over a URL column: adds ``sanitized_url``, ``dropped_fragment``,
    ``redacted_keys`` and ``sanitize_error``.

    Only http/https URLs are rewritten (after stripping); other schemes pass
    through; '' stays ''. A bad port or unbalanced IPv6 bracket is an error:
    ``on_error="null"`` (default, fail closed) gives a null URL, ``"keep"``
    returns the stripped input as the capture loop does.

    Written as a chain of projections so every intermediate (split parts,
    decoded keys/values, their decoded-again forms) is computed once per row;
    Catalyst keeps projections apart when merging them would repeat costly
    expressions, and lambdas only read struct fields of the previous stage.
    """
    raw = pystrip(F.coalesce(F.col(url), F.lit("")))
    d = df.withColumn("_raw", raw).withColumn("_u", F.regexp_replace("_raw", r"[\t\r\n]", ""))
    parts = _split_url(F.col("_u"))
    d = d.withColumn("_scheme", parts["scheme"])
    parts = _split_url(F.col("_u"))
    d = d.withColumns({"_netloc": parts["netloc"], "_after": parts["after"]})
    after = F.col("_after")
    d = d.withColumns(
        {
            "_frag": F.when(F.instr(after, "#") > 0, F.substr(after, F.instr(after, "#") + 1)).otherwise(F.lit("")),
            "_nofrag": F.substring_index(after, "#", 1),
            "_hostinfo": F.substring_index(F.col("_netloc"), "@", -1),
        }
    )
    nf, hi = F.col("_nofrag"), F.col("_hostinfo")
    br = hi.contains("[")
    d = d.withColumns(
        {
            "_path": F.substring_index(nf, "?", 1),
            "_query": F.when(F.instr(nf, "?") > 0, F.substr(nf, F.instr(nf, "?") + 1)).otherwise(F.lit("")),
            "_host": F.lower(F.when(br, F.regexp_extract(hi, r"\[([^\]]*)", 1)).otherwise(F.substring_index(hi, ":", 1))),
            "_port": F.when(br, F.regexp_extract(hi, r"(?s)\][^:]*:(.*)\z", 1)).otherwise(
                F.when(F.instr(hi, ":") > 0, F.substr(hi, F.instr(hi, ":") + 1)).otherwise(F.lit(""))
            ),
        }
    )
    port = F.col("_port")
    digits = port.rlike(r"^[0-9]+\z") & (F.length(F.regexp_replace(port, "^0+", "")) <= 5)
    d = d.withColumns({"_pnum": F.when(digits, port.cast("int")), "_is_http": F.col("_scheme").isin("http", "https")})
    port_ok = (port == "") | (F.col("_pnum").isNotNull() & (F.col("_pnum") <= 65535))
    bad_br = F.col("_netloc").contains("[") != F.col("_netloc").contains("]")
    d = d.withColumn("_err", F.col("_is_http") & (bad_br | ~port_ok))
    # query: split -> decode once -> decode the value twice more -> classify
    pieces = F.filter(F.split(F.col("_query"), "&"), lambda x: x != "")

    def raw_item(p: Column, i: Column) -> Column:
        has_eq = F.instr(p, "=") > 0
        return F.struct(
            F.when(has_eq, F.substring_index(p, "=", 1)).otherwise(p).alias("n"),
            F.when(has_eq, F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit("")).alias("v"),
            i.alias("i"),
        )

    d = d.withColumn("_q0", F.transform(pieces, raw_item))
    d = d.withColumn(
        "_q1",
        F.transform(
            "_q0",
            lambda x: F.struct(
                pystrip(unquote_plus(x.getField("n"))).alias("key"),
                pystrip(unquote_plus(x.getField("v"))).alias("v"),
                x.getField("i").alias("i"),
            ),
        ),
    )
    d = d.withColumn(
        "_q2",
        F.transform("_q1", lambda x: F.struct(x.getField("key").alias("key"), x.getField("v").alias("v"), x.getField("i").alias("i"),
                                              unquote(x.getField("v")).alias("d1"))),
    )
    d = d.withColumn(
        "_q3",
        F.transform(
            "_q2",
            lambda x: F.struct(
                x.getField("key").alias("key"), x.getField("v").alias("v"), x.getField("i").alias("i"),
                F.when(x.getField("d1") == x.getField("v"), x.getField("d1")).otherwise(unquote(x.getField("d1"))).alias("d2"),
            ),
        ),
    )

    def classify_item(x: Column) -> Column:
        v = x.getField("v")
        red = is_sensitive_key(x.getField("key")) | _sensitive_value(v, x.getField("d2"))
        return _item_struct(x.getField("key"), F.when(red, F.lit(REDACTED)).otherwise(v), x.getField("i"), red)

    d = d.withColumn("_items", F.filter(F.transform("_q3", classify_item), lambda it: it.getField("key") != ""))
    items = F.col("_items")
    qs = F.array_join(
        F.transform(F.array_sort(items), lambda it: F.concat(quote_plus(it.getField("key")), F.lit("="), quote_plus(it.getField("val")))),
        "&",
    )
    red = F.transform(
        F.filter(items, lambda it: it.getField("red")),
        lambda it: F.struct(it.getField("lk").alias("lk"), it.getField("key").alias("key")),
    )
    red_keys = F.array_distinct(F.transform(F.array_sort(red), lambda r: r.getField("key")))
    netloc = F.when(port == "", F.col("_host")).otherwise(F.concat(F.col("_host"), F.lit(":"), F.col("_pnum").cast("string")))
    clean = F.concat(
        F.col("_scheme"), F.lit("://"), netloc, sanitize_path(F.col("_path")),
        F.when(qs != "", F.concat(F.lit("?"), qs)).otherwise(F.lit("")),
    )
    ok = F.col("_is_http") & ~F.col("_err")
    fallback = F.lit(None).cast("string") if on_error == "null" else F.col("_raw")
    out = d.withColumns(
        {
            "sanitized_url": F.when(F.col("_raw") == "", F.lit("")).when(~F.col("_is_http"), F.col("_raw"))
            .when(F.col("_err"), fallback).otherwise(clean),
            "dropped_fragment": F.when(ok, F.col("_frag") != "").otherwise(F.lit(False)),
            "redacted_keys": F.when(ok, red_keys).otherwise(F.array().cast("array<string>")),
            "sanitize_error": F.col("_err"),
        }
    )
    if keep_work:
        return out
    return out.drop(
        "_raw", "_u", "_scheme", "_netloc", "_after", "_frag", "_nofrag", "_hostinfo", "_path", "_query", "_host",
        "_port", "_pnum", "_is_http", "_err", "_q0", "_q1", "_q2", "_q3", "_items",
    )


def _sensitive_value(val: Column, decoded2: Column) -> Column:
    return (val != "") & (
        val.rlike(EMAIL_RE)
        | val.rlike(JWT_RE)
        | val.rlike(UUID_RE)
        | val.rlike(HEX_RE)
        | val.rlike(B64URL_RE)
        | _embedded_url(decoded2)
        | looks_like_compact_secret(val)
        | (F.length(val) > MAX_VALUE_LEN)
    )


def _embedded_url(d2: Column) -> Column:
    netloc = F.regexp_extract(d2, r"^[Hh][Tt][Tt][Pp][Ss]?://([^/?#]*)", 1)
    hostinfo = F.substring_index(netloc, "@", -1)
    host = F.when(hostinfo.startswith("["), F.regexp_extract(hostinfo, r"^\[([^\]]*)", 1)).otherwise(
        F.substring_index(hostinfo, ":", 1)
    )
    return d2.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://") & (host != "")


def tab_should_transmit(url: Column | str) -> Column:
    """A tab is forwarded only with a non-empty URL outside the internal
    schemes about:, chrome:, moz-extension:, resource:."""
    u = _c(url)
    internal = u.startswith("about:") | u.startswith("chrome:") | u.startswith("moz-extension:") | u.startswith("resource:")
    return u.isNotNull() & (u != "") & ~internal
