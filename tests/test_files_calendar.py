"""Stored file generations, streamed digests, and calendar totals of streams."""

import datetime as dt
import hashlib
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dwell.operators import ingest as I
from dwell.plans import reports as RP
from dwell.plans.catalog import labelled_sessions
from dwell.sources import files as FL
from dwell.streaming import calendar as CA
from dwell.streaming import replay as RY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """January to March of four devices: device files, and months of the older form without url and device."""
    root = tmp_path_factory.mktemp("logs")
    s = labelled_sessions(spark, SF).toPandas()
    s["start_time"] = s["start_time"] + pd.to_timedelta((s.index % 3) * 31, unit="D")
    s["end_time"] = s["end_time"] + pd.to_timedelta((s.index % 3) * 31, unit="D")
    s["key"] = s["start_time"].dt.strftime("%Y_%m")
    for (key, dev), part in s[s.device_id != "dev-0"].groupby(["key", "device_id"]):
        t = pa.Table.from_pandas(part.drop(columns="key"), preserve_index=False)
        times = {c: pa.timestamp("ns" if dev == "dev-1" else "us") for c in ("start_time", "end_time")}
        t = t.cast(pa.schema([pa.field(f.name, times.get(f.name, f.type)) for f in t.schema]))
        pq.write_table(t, root / f"activity_{key}_{dev}.parquet")
    for key, part in s[s.device_id == "dev-0"].groupby("key"):
        old = part.drop(columns=["key", "url", "device_id"]).assign(duration_sec=part.duration_sec.round().astype("int64"))
        pq.write_table(pa.Table.from_pandas(old, preserve_index=False), root / f"activity_{key}.parquet")
    (root / "activity_2024_01_broken.parquet").write_bytes((root / "activity_2024_01.parquet").read_bytes()[:-20])
    (root / "activity_2024_01_empty.parquet").write_bytes(b"")
    (root / "activity_2024_1.parquet").write_bytes(b"no month")
    (root / "notes.txt").write_text("x")
    return str(root), s


def test_listing_and_report(spark, folder):
    root, s = folder
    files = FL.session_files(spark, root)
    got = {r.name: (r.year, r.month, r.device_id) for r in files.collect()}
    assert got["activity_2024_01.parquet"] == (2024, 1, None) and got["activity_2024_02_dev-3.parquet"] == (2024, 2, "dev-3")
    assert "activity_2024_1.parquet" not in got and "notes.txt" not in got
    rep = {r.name: r for r in FL.file_report(files).collect()}
    assert {n for n, r in rep.items() if not r.readable} == {"activity_2024_01_broken.parquet"}
    assert all(r.error for r in rep.values() if not r.readable)
    assert sum(r.rows for r in rep.values() if r.readable) == len(s)
    assert "url" not in rep["activity_2024_01.parquet"].columns
    assert FL.session_files(spark, root + "/none").count() == 0


def test_both_generations_in_one_schema(spark, folder):
    root, s = folder
    back = FL.month_files(spark, root, 2024, 1)
    want = s[s.key == "2024_01"]
    got = back.toPandas()
    assert len(got) == len(want) and back.columns[:9] == [f.name for f in I.SESSION_SCHEMA.fields]
    assert set(got[got.file == "activity_2024_01.parquet"].device_id.map(repr)) == {"None"} and got[got.file == "activity_2024_01.parquet"].url.isna().all()
    assert sorted(got[got.device_id.notna()].device_id.unique()) == ["dev-1", "dev-2", "dev-3"]
    assert sorted(got.start_time) == sorted(want.start_time) and got.duration_sec.dtype == float
    week = FL.week_files(spark, root, "2024-02-01").toPandas()  # 29 January to 4 February
    assert set(week.start_time.dt.month) == {1, 2} and len(week) == s.key.isin(["2024_01", "2024_02"]).sum()
    with pytest.raises(FileNotFoundError):
        FL.month_files(spark, root, 2023, 5)
    # and on into the partitioned table
    table = root + "/../table"
    I.write_sessions(FL.read_files(FL.session_files(spark, root)).drop("file"), table)
    assert I.read_sessions(spark, table).count() == len(s)


def test_digests_are_streamed(spark, folder):
    root, _ = folder
    got = {r.path.rsplit("/", 1)[1]: (r.md5, r.length) for r in FL.digests(FL.session_files(spark, root), chunk=1000).collect()}
    want = {p.name: (hashlib.md5(p.read_bytes()).hexdigest(), p.stat().st_size) for p in Path(root).glob("activity_????_??*.parquet")}
    want.pop("activity_2024_01_empty.parquet")
    assert got == want and any(n > 1000 for _, n in want.values())


@pytest.mark.parametrize("cuts", [1, 4])
def test_calendar_totals_of_a_stream(spark, cuts):
    s = labelled_sessions(spark, SF, "user")
    days = RP.daily_productivity(s).toPandas()
    days["date"] = pd.to_datetime(days["date"])
    src = RY.as_stream(RY.tick(s, start_time="timestamp_ntz'2200-01-01'", end_time="timestamp_ntz'2200-01-01'"), "start_time", cuts)
    for name, fn, key in (
        ("day", CA.daily, days.date),
        ("week", CA.weekly, days.date - pd.to_timedelta(days.date.dt.weekday, unit="D")),
        ("month", CA.monthly, days.date.dt.to_period("M").dt.to_timestamp()),
    ):
        got = RY.run_to_table(fn(src, 400), f"cal-{name}{cuts}").where(F.col("start") < "2190-01-01").toPandas()
        want = days.assign(start=key).groupby(["start", "productivity"], as_index=False)[["minutes", "parts"]].sum()
        got["start"] = pd.to_datetime(got["start"])
        m = got.merge(want, on=["start", "productivity"], suffixes=("", "_w"), how="outer")
        assert len(m) == len(want) == len(got) and (m.parts == m.parts_w).all() and (m.minutes - m.minutes_w).abs().max() < 1e-6
    assert days.date.dt.date.nunique() > 20 and dt.date(2024, 1, 1) <= days.date.dt.date.min()
