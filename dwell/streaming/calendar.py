"""Streaming totals over calendar days, weeks and months.

Sessions are split at midnight, so every part belongs to one day. Days are built-in
windows, and weeks are windows of seven days that start on a Monday (windows count
from a Thursday). A month is no window of fixed width. Its watermark runs on a clock
of months: a monotone map of time on which every month takes one day, so that a month is a
window there and is over when the watermark has passed its end.

All are built-in aggregates: summed before their shuffle (a busy month is no hot
key), each period handed out once, sums kept in whole microseconds until the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.functions.text import productivity_label
from dwell.operators.sessionize import micros_between
from dwell.operators.split import split_midnight
from dwell.streaming.asof import epoch_micros

MONDAY = "4 days"  # 1970-01-01 was a Thursday
DAY_US = 86_400_000_000
SHORTEST_MONTH = 28


def month_clock(ts: Column) -> Column:
    """A naive time on the clock of months: days since 1970 are months since then, the time of day is the share of the month that has passed."""
    first = F.trunc(F.to_date(ts), "MM")
    begin, end = epoch_micros(first.cast("timestamp_ntz")), epoch_micros(F.add_months(first, 1).cast("timestamp_ntz"))
    months = ((F.year(ts) - 1970) * 12 + F.month(ts) - 1).cast("long")
    return F.timestamp_micros(months * DAY_US + F.floor((epoch_micros(ts) - begin) / (end - begin) * DAY_US).cast("long"))


def _totals(sessions: DataFrame, clock, delay_seconds: float, width: str, offset: str = "0 days") -> DataFrame:
    p = split_midnight(sessions, mode="exact")
    p = p.select(
        clock(F.col("start_time")).alias("event_time"), productivity_label("is_productive", null_as="unknown").alias("productivity"),
        micros_between("start_time", "end_time").alias("us"),
    ).withWatermark("event_time", f"{math.ceil(delay_seconds)} seconds")
    g = p.groupBy(F.window("event_time", width, width, offset).alias("w"), "productivity").agg(F.sum("us").alias("us"), F.count(F.lit(1)).alias("parts"))
    return g.select(F.to_date(F.col("w.start")).alias("start"), "productivity", (F.col("us") / 60_000_000).alias("minutes"), "parts")


def _plain(ts: Column) -> Column:
    return F.timestamp_micros(epoch_micros(ts))


def daily(sessions: DataFrame, delay_days: float = 1) -> DataFrame:
    """(start, productivity, minutes, parts) of every calendar day that is over;
    rows may lag ``delay_days`` behind the newest one. Dates are those of the
    naive times under a UTC session, as in all streaming windows."""
    return _totals(sessions, _plain, delay_days * 86_400, "1 day")


def weekly(sessions: DataFrame, delay_days: float = 1) -> DataFrame:
    """The same of weeks, Monday to Sunday."""
    return _totals(sessions, _plain, delay_days * 86_400, "7 days", MONDAY)


def monthly(sessions: DataFrame, delay_days: float = 1) -> DataFrame:
    """The same of calendar months. On their clock a day is longest in the shortest
    month: the delay is at least ``delay_days`` in every one."""
    t = _totals(sessions, month_clock, delay_days * 86_400 / SHORTEST_MONTH, "1 day")
    months = F.datediff(F.col("start"), F.lit("1970-01-01").cast("date"))
    return t.withColumn("start", F.add_months(F.lit("1970-01-01").cast("date"), months))
