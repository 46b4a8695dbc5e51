"""Incremental ingest and storage layout.

Sessions are stored as one Parquet table partitioned by year / month /
device_id (appends only, snappy), so a week or month report reads only the
touched partitions and pushes its range filter into the scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwell.session import path_exists

SESSION_SCHEMA = T.StructType(
    [
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("duration_sec", T.DoubleType()),
        T.StructField("app", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("is_productive", T.BooleanType()),
        T.StructField("device_id", T.StringType()),
    ]
)
STORED_SCHEMA = T.StructType([*SESSION_SCHEMA.fields, T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])
PARTITION_COLUMNS = ["year", "month", "device_id"]


def manifest_diff(remote: DataFrame, state: DataFrame, local: DataFrame) -> DataFrame:
    """Which remote files to (re)load.

    Skip when the recorded md5 equals the remote md5 (null-safe, as None == None)
    and a local copy exists; also skip when the remote md5 is known and equals
    the local copy's digest. Everything else is loaded. Equi-joins on file id and
    name; all three manifests grow with the file count, so nothing is broadcast
    without the planner's own size check."""
    st = state.select("file_id", F.col("md5").alias("state_md5"), F.lit(True).alias("_in_state"))
    lo = local.select("name", F.col("md5").alias("local_md5"), F.lit(True).alias("_local"))
    j = remote.join(st, "file_id", "left").join(lo, "name", "left")
    has_local = F.coalesce(F.col("_local"), F.lit(False))
    skip_state = F.coalesce(F.col("_in_state"), F.lit(False)) & F.col("state_md5").eqNullSafe(F.col("md5")) & has_local
    skip_digest = F.col("md5").isNotNull() & (F.col("md5") != "") & has_local & (F.col("local_md5") == F.col("md5"))
    load = ~(skip_state | F.coalesce(skip_digest, F.lit(False)))
    return j.select(
        "file_id",
        "name",
        "md5",
        load.alias("load"),
        F.when(skip_state, F.lit("state")).when(F.coalesce(skip_digest, F.lit(False)), F.lit("digest")).alias("skip_reason"),
    )


def next_state(state: DataFrame, loaded: DataFrame) -> DataFrame:
    """After a load, record (file_id -> md5, name); loaded entries replace old ones."""
    new = loaded.select("file_id", "md5", "name")
    return state.join(new.select("file_id"), "file_id", "left_anti").unionByName(new)


def file_digests(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """md5 of every file's content (binaryFile source, one row per file)."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        .select(F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.md5("content").alias("md5"), "length")
    )


def align_schemas(existing: DataFrame, new: DataFrame) -> DataFrame:
    """S3: union of an older and a newer frame: columns of the older first,
    then the newer's extra columns; missing values are null."""
    target = list(existing.columns) + [c for c in new.columns if c not in existing.columns]
    return existing.unionByName(new, allowMissingColumns=True).select(*target)


def with_partition_columns(sessions: DataFrame) -> DataFrame:
    """Each row is filed under the month of its own start (not the batch's first row)."""
    return sessions.withColumns({"year": F.year("start_time"), "month": F.month("start_time")})


def write_sessions(sessions: DataFrame, root: str, mode: str = "append") -> None:
    """Partitioned, snappy Parquet sink (append); creates the table if absent.
    Rows are dealt by partition and day first, so that a task writes few files
    and a busy device is spread over its days."""
    (
        with_partition_columns(sessions)
        .repartition(*PARTITION_COLUMNS, F.dayofmonth("start_time"))
        .write.mode(mode)
        .option("compression", "snappy")
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(root)
    )


def read_sessions(spark: SparkSession, root: str, tolerant: bool = True) -> DataFrame:
    """S1/S2/S4 scan: explicit schema, old and new file generations merged,
    unreadable or vanished files skipped; no files -> typed empty frame."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], STORED_SCHEMA)
    r = spark.read.schema(STORED_SCHEMA)
    if tolerant:
        r = r.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return r.parquet(root)


def months_of_week(date: str | _dt.date) -> list[tuple[int, int]]:
    d = date if isinstance(date, _dt.date) else _dt.date.fromisoformat(date)
    mon = d - _dt.timedelta(days=d.weekday())
    return sorted({((mon + _dt.timedelta(days=i)).year, (mon + _dt.timedelta(days=i)).month) for i in range(7)})


def week_scan(spark: SparkSession, root: str, date: str | _dt.date) -> DataFrame:
    """Every session file of the (year, month) pairs touched by the
    Monday..Sunday week of ``date``, all devices: a partition filter (pruned at
    planning time) — the week-range filter itself is the report's job."""
    df = read_sessions(spark, root)
    pairs = months_of_week(date)
    cond = None
    for y, m in pairs:
        c = (F.col("year") == y) & (F.col("month") == m)
        cond = c if cond is None else (cond | c)
    return df.where(cond)


def month_scan(spark: SparkSession, root: str, year: int, month: int) -> DataFrame:
    """One month of every device; raises when nothing is stored for it."""
    df = read_sessions(spark, root).where((F.col("year") == year) & (F.col("month") == month))
    if df.limit(1).count() == 0:
        raise FileNotFoundError(f"No sessions stored for {year}-{month:02d} under {root}")
    return df
