"""Parity of the Spark URL expressions with Python's urllib.parse on generated
inputs (one Spark job per property, many cases per job)."""

import random
from urllib.parse import quote_plus as py_quote_plus
from urllib.parse import unquote_plus as py_unquote_plus
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from dwell.functions.text import url_host, url_path
from dwell.functions.urls import quote_plus, unquote_plus

ALPHABET = list("abcXYZ019-._~*+ =&/?#:@%") + ["é", "ü", "%41", "%2B", "%20", "%zz", "%C3%A9", "%", "%E9", "%C3"]


def _strings(n, seed, alphabet=ALPHABET, max_len=12):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, max_len))) for _ in range(n)]


@pytest.fixture(scope="module")
def strings():
    return _strings(800, 11)


def test_unquote_plus_matches_python(spark, strings):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    got = {r.i: r.d for r in df.select("i", unquote_plus(F.col("s")).alias("d")).collect()}
    for i, s in enumerate(strings):
        assert got[i] == py_unquote_plus(s), s


def test_quote_plus_matches_python(spark, strings):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    got = {r.i: r.q for r in df.select("i", quote_plus(F.col("s")).alias("q")).collect()}
    for i, s in enumerate(strings):
        assert got[i] == py_quote_plus(s), s


def test_host_and_path_match_urlparse(spark):
    rnd = random.Random(5)
    parts = ["http://", "https://", "HTTPS://", "ftp://", "", "mailto:", "localhost:3000/"]
    hosts = ["Example.COM", "user:pw@host.org", "a_b.example.com", "h:8080", "[::1]:80", "x.y", ""]
    paths = ["", "/", "/a/b", "/A;p=1", "/a;x/b;y", "/s p", "/%41"]
    tails = ["", "?q=1", "#f", "?a=b#c"]
    urls = [rnd.choice(parts) + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(tails) for _ in range(600)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = {r.i: (r.h, r.p) for r in df.select("i", url_host("u").alias("h"), url_path("u").alias("p")).collect()}
    for i, u in enumerate(urls):
        try:
            parsed = urlparse(u)
            host = parsed.hostname or ""
        except ValueError:
            continue
        if not parsed.netloc:
            # only scheme://authority URLs carry a host the rules can match
            assert got[i][0] == "", u
            continue
        assert got[i] == (host, parsed.path), u
