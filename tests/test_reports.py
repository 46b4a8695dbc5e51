"""Report filters (P8-P10) and picked-date reports equal the all-period
reports restricted to that period."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwell.plans import reports as RP
from dwell.plans.catalog import labelled_sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sess(spark):
    return labelled_sessions(spark, SF, "user")


def test_filters(sess):
    d = dt.date(2024, 1, 10)  # a Wednesday
    day = {r.start_time.date() for r in RP.day_filter(sess, d).collect()}
    assert day == {d}
    week = {r.start_time.date() for r in RP.week_filter(sess, d).collect()}
    assert week and all(dt.date(2024, 1, 8) <= x <= dt.date(2024, 1, 14) for x in week)
    month = RP.month_filter(sess, "2024-01-17").count()
    assert month == sess.where(F.month("start_time") == 1).count()


def test_picked_week_equals_all_weeks(sess):
    picked = {tuple(r) for r in RP.weekly_totals(sess, "2024-01-10").collect()}
    allw = {tuple(r) for r in RP.weekly_totals(sess).where(F.col("week_start") == dt.date(2024, 1, 8)).collect()}
    assert picked == allw and picked


def test_picked_day_timeline(sess):
    picked = RP.daily_timeline(sess, "2024-01-10")
    assert picked.count() == RP.daily_timeline(sess).where(F.col("day") == dt.date(2024, 1, 10)).count() > 0


def test_prepare_summary_rounding(spark):
    df = spark.createDataFrame([(15.0, True, "A"), (81.0, False, "B"), (3.0, None, "C")],
                               "duration_sec double, is_productive boolean, category string")
    out = [(r.duration_min, r.productive, r.activity_id) for r in RP.prepare_summary(df).collect()]
    # 0.25 -> 0.2 and 1.35 -> 1.4 (half to even, as pandas rounds); null productivity -> unproductive
    assert out == [(0.2, "productive", "A|productive"), (1.4, "unproductive", "B|unproductive"), (0.0, "unproductive", "C|unproductive")]


def test_max_daily_total_empty_is_zero(spark, sess):
    empty = sess.where(F.lit(False))
    rows = RP.max_daily_total(empty, "week", "2024-01-03").collect()
    assert [(str(r.week_start), r.max_daily_min) for r in rows] == [("2024-01-01", 0.0)]
    assert [r.max_daily_min for r in RP.max_daily_total(empty, "month", "2024-01-03").collect()] == [0.0]


def test_category_rollup_null_category(spark):
    t = dt.datetime(2024, 1, 1, 9)
    df = spark.createDataFrame([(t, t + dt.timedelta(minutes=5), None), (t, t + dt.timedelta(minutes=7), "A")], "start_time timestamp_ntz, end_time timestamp_ntz, category string")
    got = sorted((r.level, str(r.category), r.minutes) for r in RP.category_rollup(df).collect())
    assert got == [("all", "None", 12.0), ("date", "None", 12.0), ("date_category", "A", 7.0), ("date_category", "None", 5.0)]
