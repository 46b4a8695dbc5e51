"""A9 over a whole URL corpus: which query keys get redacted, per host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.functions.text import url_host


def redaction_report(sanitized: DataFrame) -> DataFrame:
    """Per (host, redacted key) the number of URLs, plus a '#fragment' row per
    host counting dropped fragments. ``explode`` + partial aggregate."""
    # one pass: the fragment flag becomes one more exploded key
    keys = F.concat(
        F.col("redacted_keys"),
        F.when(F.col("dropped_fragment"), F.array(F.lit("#fragment"))).otherwise(F.array().cast("array<string>")),
    )
    rows = sanitized.select(url_host("url").alias("host"), F.explode(keys).alias("key"))
    return rows.groupBy("host", "key").agg(F.count(F.lit(1)).alias("urls"))
