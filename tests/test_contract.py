"""Driver contract: entry() runs, every registered query has an oracle or is
documented as rows-only, and a sample of queries matches DuckDB at sf0.001."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from dwell.plans import catalog

SF = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert [f.name for f in df.schema.fields] == ["date", "productivity", "minutes", "parts"]


def test_every_query_has_oracle():
    # the llm queries have tests of their own, in tests/llm
    missing = set(catalog.queries()) - set(catalog.oracle_sql()) - ROWS_ONLY
    assert not missing, missing


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(v)
    return v


@pytest.mark.parametrize("name", ["sessions", "segments", "stitch", "override_asof", "classify_keywords", "sanitize_urls",
                                  "weekly_totals", "effective_labels", "keyword_sessions", "manifest_diff"])
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("events", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    orows = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert len(srows) == len(orows)
    assert srows == orows


def test_queries_change_their_input(spark):
    """Operators that could pass rows through unchanged have work to do in the registered queries."""
    from pyspark.sql import functions as F

    sf, q = "/root/testdata/sf0.01", E.queries()
    holed = catalog.holed_sessions(spark, sf).count()
    assert q["stitch"](spark, sf).count() < holed
    filled = q["gap_fill"](spark, sf).groupBy("resumed").count().collect()
    assert {r["resumed"] for r in filled} == {True, False} and sum(r["count"] for r in filled) == holed
    assert len({r.idle_threshold for r in q["idle_threshold"](spark, sf).collect()}) >= 3
    top = q["keyword_top_k"](spark, sf)
    assert top.groupBy("category").agg(F.max("rank").alias("m")).where(F.col("m") == catalog.TOP_K).count() >= 2
    assert {r.label_source for r in q["apply_suggestions"](spark, sf).select("label_source").distinct().collect()} == {"rules", "index", "suggestion"}


def test_url_forms_reach_every_rule(spark):
    """Each placeholder, redaction, dropped part and failure of the sanitizer occurs in the registered corpus."""
    rows = E.queries()["sanitize_url_forms"](spark, SF).collect()
    seen = " ".join(r.sanitized_url or "" for r in rows)
    assert all(p in seen for p in ("[INT]", "[UUID]", "[EMAIL]", "[JWT]", "[ID]", "[TEXT_LONG]", "_REDACTED_", "mailto:", "ftp://"))
    assert {k for r in rows for k in r.redacted_keys} >= {"access_token", "contact", "x", "y", "blob", "to", "c", "long", "v", "PIN", "Redirect", "next"}
    assert "z" not in {k for r in rows for k in r.redacted_keys}
    assert any(r.dropped_fragment for r in rows) and any(r.sanitize_error for r in rows)
    # "user1:pw@" goes, "someone1@example.com" of a mailto stays
    assert not any("pw@" in (r.sanitized_url or "") for r in rows)
