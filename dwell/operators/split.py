"""Split sessions at midnight (a generator: one row in, one or more out).

``mode="reference"`` reproduces the dashboard's split exactly: a session whose
start and end dates differ becomes [start, start-date 23:59:59] and
[end-date 00:00, end] (days in between vanish, one second is lost per split).
``mode="exact"`` emits one half-open part per calendar day, so the parts'
durations always add up to the session's duration.

Both are a projection + ``explode``: no shuffle, stays in codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.operators.sessionize import seconds_between


def split_midnight(df: DataFrame, mode: str = "exact", start: str = "start_time", end: str = "end_time") -> DataFrame:
    s, e = F.col(start), F.col(end)
    sd, ed = F.to_date(s), F.to_date(e)
    if mode == "reference":
        eod = F.make_timestamp_ntz(F.year(sd), F.month(sd), F.dayofmonth(sd), F.lit(23), F.lit(59), F.lit(59))
        mid = ed.cast("timestamp_ntz")
        parts = F.when(
            sd != ed,
            F.array(
                F.struct(s.alias("_s"), eod.alias("_e"), F.lit(1).alias("part")),
                F.struct(mid.alias("_s"), e.alias("_e"), F.lit(2).alias("part")),
            ),
        ).otherwise(F.array(F.struct(s.alias("_s"), e.alias("_e"), F.lit(1).alias("part"))))
    elif mode == "exact":
        days = F.sequence(sd, ed)
        parts = F.filter(
            F.transform(
                days,
                lambda d, i: F.struct(
                    F.greatest(s, d.cast("timestamp_ntz")).alias("_s"),
                    F.least(e, F.date_add(d, 1).cast("timestamp_ntz")).alias("_e"),
                    (i + 1).alias("part"),
                ),
            ),
            lambda p: (p.getField("_e") > p.getField("_s")) | (s == e),
        )
    else:
        raise ValueError(f"unknown split mode {mode!r}")
    others = [c for c in df.columns if c not in (start, end, "duration_sec")]
    out = df.select(*others, F.explode(parts).alias("_p"))
    return out.select(
        *others,
        F.col("_p._s").alias(start),
        F.col("_p._e").alias(end),
        seconds_between(F.col("_p._s"), F.col("_p._e")).alias("duration_sec"),
        F.col("_p.part").alias("part"),
    )
