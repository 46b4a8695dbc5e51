"""Calendar reports over a sessions table.

Each report works for one picked date (a range filter on ``start_time``, which
prunes partitions and pushes down to the scan) or, with ``date=None``, for every
day / week / month at once (the period becomes a grouping key). Sums are taken
over integer microseconds and converted once, so totals are exact and
independent of summation order.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwell.functions.text import productivity_label
from dwell.operators import ordered as O
from dwell.operators.sessionize import micros_between
from dwell.operators.split import split_midnight

US_PER_MIN = 60_000_000.0


def _d(date: str | _dt.date) -> _dt.date:
    return date if isinstance(date, _dt.date) else _dt.date.fromisoformat(date)


def rint1(x: Column) -> Column:
    """Round to one decimal, half to even (pandas ``round(1)``)."""
    return F.rint(x * 10) / 10


# ------------------------------------------------------------------- filters


def _in_range(df: DataFrame, first: _dt.date, end: _dt.date, col: str) -> DataFrame:
    """Rows of [first, end); on a stored table (year / month columns) its
    partitions are pruned as well."""
    out = df.where((F.col(col) >= F.lit(first).cast("timestamp_ntz")) & (F.col(col) < F.lit(end).cast("timestamp_ntz")))
    if col == "start_time" and {"year", "month"} <= set(df.columns):
        a, z = first.year * 12 + first.month, (end - _dt.timedelta(days=1))
        months = [divmod(m - 1, 12) for m in range(a, z.year * 12 + z.month + 1)]
        cond = F.lit(False)
        for y, m in months:
            cond = cond | ((F.col("year") == y) & (F.col("month") == m + 1))
        out = out.where(cond)
    return out


def day_filter(df: DataFrame, date: str | _dt.date, col: str = "start_time") -> DataFrame:
    """Sessions starting on ``date`` (half-open range, prunes and pushes down)."""
    d = _d(date)
    return _in_range(df, d, d + _dt.timedelta(days=1), col)


def week_filter(df: DataFrame, date: str | _dt.date, col: str = "start_time") -> DataFrame:
    """Sessions starting Monday..Sunday of the week of ``date``."""
    d = _d(date)
    mon = d - _dt.timedelta(days=d.weekday())
    return _in_range(df, mon, mon + _dt.timedelta(days=7), col)


def month_filter(df: DataFrame, date: str | _dt.date, col: str = "start_time") -> DataFrame:
    """P10: sessions starting in the month of ``date``."""
    d = _d(date).replace(day=1)
    nxt = (d.replace(day=28) + _dt.timedelta(days=4)).replace(day=1)
    return _in_range(df, d, nxt, col)


def prepare_summary(df: DataFrame) -> DataFrame:
    """Productive label (null -> 'unproductive'), duration_min rounded to
    0.1 (half even), activity_id = category|productive."""
    prod = F.when(F.col("is_productive"), F.lit("productive")).otherwise(F.lit("unproductive"))
    return df.withColumns(
        {
            "productive": prod,
            "duration_min": rint1(F.col("duration_sec") / 60),
            "activity_id": F.concat(F.col("category"), F.lit("|"), prod),
        }
    )


def anchor_time(ts: Column | str) -> Column:
    """D3: time of day on 2000-01-01, truncated to whole seconds."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.make_timestamp_ntz(F.lit(2000), F.lit(1), F.lit(1), F.hour(c), F.minute(c), F.floor(F.second(c)))


# ------------------------------------------------------------------ timelines


def daily_timeline(sessions: DataFrame, date: str | None = None) -> DataFrame:
    """Rows behind the daily timeline: day filter on start (pre-split), P11, then
    reference split; both halves keep the pre-split ``duration_min``."""
    df = sessions if date is None else day_filter(sessions, date)
    df = prepare_summary(df).withColumn("day", F.to_date("start_time"))
    parts = split_midnight(df, mode="reference")
    return parts.select(
        "device_id", "day", "start_time", "end_time", "app", "title", "category", "activity_id", "duration_min", "part"
    )


def activity_rollup(sessions: DataFrame, date: str | None = None) -> DataFrame:
    """A10: per day and activity_id (category|productive), the number of timeline
    bars and their minutes (pre-split minutes, as the chart shows them)."""
    t = daily_timeline(sessions, date)
    return t.groupBy("day", "activity_id").agg(
        F.count(F.lit(1)).alias("bars"), F.round(F.sum("duration_min"), 1).alias("minutes")
    )


def category_rollup(sessions: DataFrame, mode: str = "exact") -> DataFrame:
    """A10 extension: ROLLUP(date, category) of split minutes (exact split)."""
    parts = split_midnight(sessions, mode=mode).withColumn("date", F.to_date("start_time"))
    return (
        parts.rollup("date", "category")
        .agg(
            (F.sum(micros_between("start_time", "end_time")) / F.lit(US_PER_MIN)).alias("minutes"),
            F.count(F.lit(1)).alias("parts"),
            F.when(F.grouping("date") == 1, "all").when(F.grouping("category") == 1, "date").otherwise("date_category").alias("level"),
        )
    )


def _week_start(c: Column) -> Column:
    return F.date_trunc("week", c).cast("date")


def weekly_timeline(sessions: DataFrame, date: str | None = None) -> DataFrame:
    """Rows behind the weekly timeline: week filter on start, reference split,
    day label of the part, anchored times, productivity (null stays null)."""
    df = sessions if date is None else week_filter(sessions, date)
    df = df.withColumn("week_start", _week_start(F.col("start_time")))
    parts = split_midnight(df, mode="reference")
    return parts.select(
        "device_id",
        "week_start",
        F.date_format("start_time", "E").alias("day_label"),
        anchor_time("start_time").alias("time_start"),
        anchor_time("end_time").alias("time_end"),
        productivity_label("is_productive").alias("productivity"),
        "app",
        "title",
        "start_time",
        (micros_between("start_time", "end_time") / F.lit(US_PER_MIN)).alias("duration_min"),
    )


def monthly_timeline(sessions: DataFrame, date: str | None = None) -> DataFrame:
    df = sessions if date is None else month_filter(sessions, date)
    df = df.withColumn("month_start", F.trunc("start_time", "MM"))
    parts = split_midnight(df, mode="reference")
    return parts.select(
        "device_id",
        "month_start",
        F.date_format("start_time", "yyyy-MM-dd").alias("date_label"),
        anchor_time("start_time").alias("time_start"),
        anchor_time("end_time").alias("time_end"),
        productivity_label("is_productive").alias("productivity"),
        "app",
        "title",
        "start_time",
        (micros_between("start_time", "end_time") / F.lit(US_PER_MIN)).alias("duration_min"),
    )


# ------------------------------------------------------------------- totals


def weekly_totals(sessions: DataFrame, date: str | None = None) -> DataFrame:
    """A1: minutes per (week, day label, date, productivity) after the
    reference split; rows with unknown productivity are dropped. Partial +
    final hash aggregate."""
    df = sessions if date is None else week_filter(sessions, date)
    df = df.withColumn("week_start", _week_start(F.col("start_time")))
    parts = split_midnight(df, mode="reference").where(F.col("is_productive").isNotNull())
    return parts.groupBy(
        "week_start",
        F.date_format("start_time", "E").alias("day_label"),
        F.to_date("start_time").alias("date"),
        productivity_label("is_productive").alias("productivity"),
    ).agg((F.sum(micros_between("start_time", "end_time")) / F.lit(US_PER_MIN)).alias("duration_min"))


def monthly_totals(sessions: DataFrame, date: str | None = None) -> DataFrame:
    """A2: minutes per (month, day of month, date, productivity)."""
    df = sessions if date is None else month_filter(sessions, date)
    df = df.withColumn("month_start", F.trunc("start_time", "MM"))
    parts = split_midnight(df, mode="reference").where(F.col("is_productive").isNotNull())
    return parts.groupBy(
        "month_start",
        F.dayofmonth("start_time").alias("day"),
        F.to_date("start_time").alias("date"),
        productivity_label("is_productive").alias("productivity"),
    ).agg((F.sum(micros_between("start_time", "end_time")) / F.lit(US_PER_MIN)).alias("duration_min"))


def max_daily_total(sessions: DataFrame, period: str = "week", date: str | _dt.date | None = None) -> DataFrame:
    """A3: per period, the largest daily total (both productivities); for a
    picked ``date`` one row for its period, 0 when nothing was recorded."""
    if period == "week":
        t, key, day = weekly_totals(sessions, date), "week_start", ["day_label", "date"]
    else:
        t, key, day = monthly_totals(sessions, date), "month_start", ["day", "date"]
    daily = t.groupBy(key, *day).agg(F.sum("duration_min").alias("total"))
    if date is not None:
        d = _d(date)
        start = d - _dt.timedelta(days=d.weekday()) if period == "week" else d.replace(day=1)
        return daily.agg(F.coalesce(F.max("total"), F.lit(0.0)).alias("max_daily_min")).select(F.lit(start).alias(key), "max_daily_min")
    return daily.groupBy(key).agg(F.coalesce(F.max("total"), F.lit(0.0)).alias("max_daily_min"))


def daily_productivity(sessions: DataFrame) -> DataFrame:
    """Flagship: productive vs unproductive minutes per calendar day (exact split)."""
    parts = split_midnight(sessions, mode="exact")
    return parts.groupBy(
        F.to_date("start_time").alias("date"),
        productivity_label("is_productive", null_as="unknown").alias("productivity"),
    ).agg(
        (F.sum(micros_between("start_time", "end_time")) / F.lit(US_PER_MIN)).alias("minutes"),
        F.count(F.lit(1)).alias("parts"),
    )


# ------------------------------------------------------------- sort / top-k


def last_n_sessions(sessions: DataFrame, n: int = 5, device: str = "device_id") -> DataFrame:
    """The last ``n`` sessions of every device by start time, returned in
    ascending order. Two-phase top-k: first inside each (device, hour bucket),
    then per device over at most n rows per bucket, so a hot device never
    sorts all of its rows in one task."""
    d = O.add_bucket(O.drop_bucket(sessions), "start_time")
    order = [F.desc("start_time"), F.desc("end_time")]
    w1 = Window.partitionBy(device, O.BUCKET).orderBy(*order)
    cand = d.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)
    w2 = Window.partitionBy(device).orderBy(*order)
    top = cand.withColumn("rank_from_end", F.row_number().over(w2)).where(F.col("rank_from_end") <= n)
    return top.drop("_r", O.BUCKET)


def month_head_count(sessions: DataFrame, date: str | _dt.date, n: int = 5) -> DataFrame:
    """T5: the first ``n`` sessions of a month by start time, with the month's row count."""
    month = month_filter(sessions, date)
    total = month.agg(F.count(F.lit(1)).alias("month_rows"))
    top = month.orderBy("start_time", "end_time", "device_id", "app", "title", "url").limit(n)
    return top.join(F.broadcast(total))  # one row


def ordered_totals(totals: DataFrame) -> DataFrame:
    """T4: totals in chart order: by date (Mon..Sun within a week), productive
    first; the order is given as columns as well."""
    keyed = totals.withColumns(
        {
            "day_order": F.weekday("date"),
            "productive_order": F.when(F.col("productivity") == "productive", 0).otherwise(1),
        }
    )
    return keyed.orderBy("date", "productive_order")


def by_start(sessions: DataFrame) -> DataFrame:
    """Sessions by start time (a range-partitioned sort)."""
    return sessions.orderBy("start_time", "end_time", "device_id", "app", "title", "url")


def first_date(sessions: DataFrame) -> _dt.date:
    """The first day on which a session starts (a partial aggregate, one row)."""
    return sessions.agg(F.min(F.to_date("start_time"))).first()[0] or _dt.date(1970, 1, 1)
