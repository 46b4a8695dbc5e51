"""Monthly session files as they were stored before the partitioned table.

Two generations of names exist, ``activity_YYYY_MM_<device>.parquet`` and, older and
without a device, ``activity_YYYY_MM.parquet``; their columns and types differ
(no url or device_id, durations as integers, times in nano- or microseconds). The
listing is a DataFrame, footers are read in tasks, and a file that can't be read is
a row of the report instead of a failure. ``ingest.write_sessions`` turns what is read here
into the partitioned table, which later scans prune.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.operators.ingest import SESSION_SCHEMA, months_of_week
from dwell.session import path_exists

NAME = r"^activity_(\d{4})_(\d{2})(?:_(.+))?\.parquet$"
LISTING = "path string, name string, year int, month int, device_id string, length long"
REPORT = LISTING + ", readable boolean, rows long, columns array<string>, error string"
CHUNK = 1 << 20
#: target types of the columns, as Arrow sees them
ARROW = pa.schema(
    [("start_time", pa.timestamp("us")), ("end_time", pa.timestamp("us")), ("duration_sec", pa.float64()), ("app", pa.string()), ("title", pa.string()),
     ("url", pa.string()), ("category", pa.string()), ("is_productive", pa.bool_()), ("device_id", pa.string())]
)


def open_file(path: str) -> BinaryIO:
    """A file of the listing, opened in a task: local paths and what pyarrow reaches (hdfs, s3, gs)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """Every session file under ``root``, with the year, month and device of its
    name (device null in the older form). No file is opened; Spark leaves files of
    no bytes out. No folder: no rows."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], LISTING)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "activity_*.parquet").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), "length").where(F.col("name").rlike(NAME))
    part = {c: F.regexp_extract("name", NAME, i) for i, c in enumerate(("year", "month", "device_id"), 1)}
    return out.select("path", "name", part["year"].cast("int").alias("year"), part["month"].cast("int").alias("month"), F.nullif(part["device_id"], F.lit("")).alias("device_id"), "length")


def file_report(files: DataFrame) -> DataFrame:
    """The listing with what each footer says, or why it can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for f in frames:
            found = []
            for path in f["path"]:
                try:
                    with open_file(path) as src:
                        meta = pq.read_metadata(src)
                    found.append((True, meta.num_rows, meta.schema.to_arrow_schema().names, None))
                except Exception as e:  # a broken file is a result here
                    found.append((False, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield f.assign(**{c: pd.Series([r[i] for r in found], dtype=object, index=f.index) for i, c in enumerate(("readable", "rows", "columns", "error"))})

    return files.select(*[c.split()[0] for c in LISTING.split(", ")]).mapInPandas(run, REPORT)


def _as_sessions(t: pa.Table, device: str | None) -> pa.Table:
    """A file's rows with the session columns: absent ones null, the device of the name where no column says it."""
    cols = []
    for field in ARROW:
        if field.name not in t.column_names:
            cols.append(pa.array([device if field.name == "device_id" else None] * t.num_rows, field.type))
            continue
        c = t.column(field.name)
        if pa.types.is_timestamp(field.type) and pa.types.is_timestamp(c.type):
            c = c.cast(pa.timestamp("us", c.type.tz), safe=False)
            c = c.cast(pa.timestamp("us")) if c.type.tz else c
        elif pa.types.is_dictionary(c.type):
            c = c.cast(c.type.value_type)
        c = c.cast(field.type)
        cols.append(c.fill_null(device) if field.name == "device_id" and device is not None else c)
    return pa.table(cols, schema=ARROW)


def read_files(files: DataFrame) -> DataFrame:
    """The sessions of the listed files, all generations in one schema. A file is
    read whole (a device's month) before its rows leave, so an unreadable one gives none."""
    from pyspark.sql.types import StructField, StructType, StringType

    schema = StructType([*SESSION_SCHEMA.fields, StructField("file", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for path, name, device in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    with open_file(path) as src:
                        t = _as_sessions(pq.read_table(src), device)
                except Exception:  # file_report names it
                    continue
                yield from t.append_column("file", pa.array([name] * t.num_rows, pa.string())).to_batches(max_chunksize=10_000)

    # whole files are the unit of work: dealt by name, not by the listing's few partitions
    return files.select("path", "name", "device_id").repartition("path").mapInArrow(run, schema)


def week_files(spark: SparkSession, root: str, date: str | _dt.date) -> DataFrame:
    """Sessions of every file, of either generation, of the (year, month) pairs
    that the Monday..Sunday week of ``date`` touches."""
    wanted = F.lit(False)
    for y, m in months_of_week(date):
        wanted = wanted | ((F.col("year") == y) & (F.col("month") == m))
    return read_files(session_files(spark, root).where(wanted))


def month_files(spark: SparkSession, root: str, year: int, month: int) -> DataFrame:
    """One month of every device; raises when there is no file for it."""
    files = session_files(spark, root).where((F.col("year") == year) & (F.col("month") == month))
    if not files.limit(1).count():
        raise FileNotFoundError(f"no session file of {year}-{month:02d} under {root}")
    return read_files(files)


def digests(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, md5, length) of the listed files' contents, streamed through the
    digest chunk by chunk in the tasks: files of any size in constant memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                h, n = hashlib.md5(), 0
                with open_file(path) as src:
                    while part := src.read(chunk):
                        h.update(part)
                        n += len(part)
                yield pd.DataFrame({"path": [path], "md5": [h.hexdigest()], "length": [n]})

    return files.select("path").repartition("path").mapInPandas(run, "path string, md5 string, length long")
