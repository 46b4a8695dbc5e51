"""Skew-safe ordered scans: lag / lead / last-non-null / running counts per key.

A plain ``Window.partitionBy(device).orderBy(ts)`` puts every row of a device
into one task; one hot device (a third of all rows) would then be one task.
Here the window is partitioned by ``(key, time bucket)`` instead, and the only
thing that crosses bucket borders is a one-row-per-bucket summary:

1. window over ``(key, bucket)`` ordered by the sort columns (the one full
   shuffle);
2. the bucket's boundary row, found by its place in that window and carrying what
   the bucket adds up to (no aggregate, no new exchange: both branches read one shuffle);
3. a window over the boundary rows per key (rows per key = buckets per key, bounded
   by time span / bucket width);
4. join them back on ``(key, bucket)``: the big side keeps its
   partitioning, only the boundary side moves (AQE broadcasts it when small).

All frames run from the start of the partition to the current row, or one row to
either side, so each window is linear in its rows. (A frame that reaches to the end of the
partition is evaluated anew for every row.)

Rows without a timestamp have no place in an order. The scans that add columns to
rows pass them through with nulls in these, spread over buckets of their own; the scans
that make new rows out of runs (``change_points``, ``islands``) leave them out.

The bucket column is kept on the output so that a following scan over the same
key reuses the partitioning without another exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BUCKET = "_bkt"
NO_KEY = "\u0000none"  # a null string key; no device can be called so


def _epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
DEFAULT_BUCKET_SECONDS = None  # resolved per session: conf "dwell.bucket.seconds", else 3600
FALLBACK_BUCKET_SECONDS = 3600


#: buckets at or below this hold the rows without a timestamp, spread by a hash
UNTIMED = -(2**62)
UNTIMED_BUCKETS = 1024


def bucket_width(df: DataFrame, bucket_seconds: int | None = None) -> int:
    """Time-bucket width in seconds: the explicit argument, else the session
    setting ``dwell.bucket.seconds`` (tune on a cluster: smaller splits hotter
    keys into more tasks), else one hour."""
    if bucket_seconds:
        return int(bucket_seconds)
    conf = df.sparkSession.conf.get("dwell.bucket.seconds", None)
    return int(conf) if conf else FALLBACK_BUCKET_SECONDS


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _alive(d: DataFrame) -> Column:
    """A condition that always holds and reads every column.

    On the boundary branch it keeps the columns below the window the same as on the
    main branch, so that both read one shuffle (exchange reuse) instead of
    scanning and shuffling a narrower copy of the input."""
    cols = [F.size(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in d.schema]
    return F.xxhash64(*cols) >= F.lit(-(2**63))


def _boundary(d: DataFrame, at: Column, keys: Sequence[str], *cols: Column) -> DataFrame:
    """One row per (key, bucket): the row where ``at`` holds."""
    return d.where(at & _alive(d)).select(*keys, BUCKET, *cols)


def _timed() -> Column:
    """Not a filter before the shuffle (it would part the branches): rows with and
    without a timestamp are kept apart in the windows over boundary rows."""
    return F.col(BUCKET) > UNTIMED


def _at_last(w) -> Column:
    return F.lead(F.lit(1)).over(w).isNull()


def add_bucket(df: DataFrame, ts_col: str, bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Add the time-bucket column (no-op when already present)."""
    if BUCKET in df.columns:
        return df
    bucket_seconds = bucket_width(df, bucket_seconds)
    ts = F.col(ts_col)
    # micros since the naive epoch: monotone in ts under any session time zone
    micros = F.timestamp_diff("MICROSECOND", _epoch_ntz(), ts.cast("timestamp_ntz"))
    return df.withColumn(BUCKET, F.floor(micros / F.lit(bucket_seconds * 1_000_000)))


FALLBACK_MAX_BUCKET_ROWS = 4_000_000
_SUB_BITS = 20  # a hot bucket splits into at most 2^20 slices


def _max_bucket_rows(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("dwell.bucket.maxRows", None)
    return int(conf) if conf is not None else FALLBACK_MAX_BUCKET_ROWS


def _ts_micros(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), c.cast("timestamp_ntz"))


def _split_hot_buckets(d: DataFrame, keys: Sequence[str], ts_col: str, max_rows: int) -> DataFrame:
    """Split every (key, bucket) holding more than ``max_rows`` rows into equal
    time slices of about ``max_rows`` rows; the slice number is appended to the
    bucket id, so buckets still sort in time order. The hot list comes from a
    partial aggregate (map-side combine, tiny shuffle) and has at most
    total rows / ``max_rows`` entries, a bound that makes broadcasting it safe
    without a counting pass."""
    part = [*keys, BUCKET]
    ts = _ts_micros(F.col(ts_col))
    hot = (
        d.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
        .where(F.col("_n") > max_rows)
        .select(
            *part,
            F.least(F.ceil(F.col("_n") / F.lit(max_rows)), F.lit(2**_SUB_BITS - 1)).alias("_pieces"),
            "_t0",
            (F.col("_t1") - F.col("_t0") + 1).alias("_span"),
        )
    )
    j = d.join(F.broadcast(hot), part, "left")
    sub = F.when(
        F.col("_pieces").isNotNull(),
        F.floor((ts - F.col("_t0")) * F.col("_pieces") / F.col("_span")),
    ).otherwise(F.lit(0))
    return j.withColumn(BUCKET, F.shiftleft(F.col(BUCKET), _SUB_BITS) + sub.cast("long")).drop("_pieces", "_t0", "_span")


def _keyed(df: DataFrame, keys: Sequence[str], ts_col: str, bucket_seconds: int, untimed: bool = True) -> DataFrame:
    """Rows bucketed, hot buckets split (see ``_split_hot_buckets``;
    ``dwell.bucket.maxRows`` = 0 turns that off). A null string key is a key of its
    own, written as ``NO_KEY``. Rows without a timestamp go to buckets of their own,
    or (``untimed`` false) out.
    Stating the not-null filter here keeps it identical on both branches
    (otherwise the optimizer infers it only on the join's boundary side and the
    branches stop sharing their shuffle)."""
    fresh = BUCKET not in df.columns
    if fresh:
        text = [k for k in keys if df.schema[k].dataType == StringType()]
        df = df.withColumns({k: F.coalesce(F.col(k), F.lit(NO_KEY)) for k in text})
    d = add_bucket(df, ts_col, bucket_seconds)
    cond = F.lit(True) if untimed else F.col(BUCKET).isNotNull() & F.col(ts_col).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    d = d.where(cond)
    max_rows = _max_bucket_rows(df)
    if fresh and max_rows > 0:
        d = _split_hot_buckets(d, keys, ts_col, max_rows)
    if untimed:
        plain = [f.name for f in df.schema if f.dataType.typeName() != "map" and f.name != BUCKET]
        spread = F.lit(UNTIMED) - F.pmod(F.xxhash64(*plain), F.lit(UNTIMED_BUCKETS))
        d = d.withColumn(BUCKET, F.coalesce(BUCKET, spread))
    # shuffled here and not below the window, so that what a scan derives from a row is computed behind the shuffle
    return d.repartition(*keys, BUCKET) if fresh else d


def with_prev(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
    prefix: str = "prev_",
    has_prev: str = "has_prev",
) -> DataFrame:
    """Add ``prev_<c>`` (value of ``c`` on the preceding row of the same key in
    ``order``) and a ``has_prev`` flag. ``order[0]`` must be the timestamp."""
    d = _keyed(df, keys, order[0], bucket_seconds)
    part = [*keys, BUCKET]
    w = Window.partitionBy(*part).orderBy(*_cols(order))
    d1 = d.withColumn("_rn", F.row_number().over(w)).withColumns({f"_lag_{c}": F.lag(c).over(w) for c in cols}).withColumn("_end", _at_last(w))
    last = _boundary(d1, F.col("_end"), keys, F.struct(*_cols(cols)).alias("_l"))
    ws = Window.partitionBy(*keys, _timed()).orderBy(BUCKET)
    summ = last.select(*part, F.lag("_l").over(ws).alias("_pl"))
    j = d1.join(summ, list(part), "left")
    first = F.col("_rn") == 1
    out = j.withColumns(
        {f"{prefix}{c}": F.when(~_timed(), F.lit(None)).when(first, F.col("_pl").getField(c)).otherwise(F.col(f"_lag_{c}")) for c in cols}
    ).withColumn(has_prev, _timed() & ((~first) | F.col("_pl").isNotNull()))
    return out.drop("_rn", "_pl", "_end", *[f"_lag_{c}" for c in cols])


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
    prefix: str = "next_",
) -> DataFrame:
    """Add ``next_<c>``: value of ``c`` on the following row of the same key."""
    d = _keyed(df, keys, order[0], bucket_seconds)
    part = [*keys, BUCKET]
    w = Window.partitionBy(*part).orderBy(*_cols(order))
    d1 = d.withColumn("_rn", F.row_number().over(w)).withColumns({f"_lead_{c}": F.lead(c).over(w) for c in cols}).withColumn("_end", _at_last(w))
    first = _boundary(d1, F.col("_rn") == 1, keys, F.struct(*_cols(cols)).alias("_f"))
    ws = Window.partitionBy(*keys, _timed()).orderBy(BUCKET)
    summ = first.select(*part, F.lead("_f").over(ws).alias("_nf"))
    j = d1.join(summ, list(part), "left")
    out = j.withColumns(
        {
            f"{prefix}{c}": F.when(~_timed(), F.lit(None)).when(F.col("_end"), F.col("_nf").getField(c)).otherwise(F.col(f"_lead_{c}"))
            for c in cols
        }
    )
    return out.drop("_rn", "_end", "_nf", *[f"_lead_{c}" for c in cols])


def with_last_non_null(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row (per key, in
    ``order``): the backward as-of building block."""
    d = _keyed(df, keys, order[0], bucket_seconds)
    part = [*keys, BUCKET]
    w = Window.partitionBy(*part).orderBy(*_cols(order))
    d1 = d.withColumn("_lnn", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_end", _at_last(w))
    # the bucket's last non-null value is the running one on its last row
    last = _boundary(d1, F.col("_end"), keys, F.col("_lnn").alias("_bl"))
    ws = Window.partitionBy(*keys, _timed()).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    summ = last.select(*part, F.last("_bl", ignorenulls=True).over(ws).alias("_pb"))
    j = d1.join(summ, list(part), "left")
    return j.withColumn(out, F.when(_timed(), F.coalesce(F.col("_lnn"), F.col("_pb")))).drop("_lnn", "_pb", "_end")


def with_running_count(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    flag: str,
    out: str,
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """``out`` = number of rows with ``flag`` true at or before each row (per key)."""
    d = _keyed(df, keys, order[0], bucket_seconds)
    part = [*keys, BUCKET]
    f = F.col(flag).cast("long")
    w = Window.partitionBy(*part).orderBy(*_cols(order))
    d1 = d.withColumn("_rc", F.sum(f).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_end", _at_last(w))
    last = _boundary(d1, F.col("_end"), keys, F.col("_rc").alias("_bc"))
    ws = Window.partitionBy(*keys, _timed()).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    summ = last.select(*part, F.coalesce(F.sum("_bc").over(ws), F.lit(0)).alias("_pc"))
    j = d1.join(summ, list(part), "left")
    return j.withColumn(out, F.when(_timed(), F.col("_rc") + F.col("_pc"))).drop("_rc", "_pc", "_end")


def change_points(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    key: str | Column,
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Run starts of ``key`` (null-safe; a column or an expression) per ``keys`` in ``order``, in one pass.

    Returns only the rows that start a run, with ``_next_start`` = ``order[0]``
    of the next run's start (null for the last run). Inside a bucket, a row
    starts a run when its key differs from the previous row; the first row of a
    bucket compares with the last row of the previous non-empty bucket, and a
    bucket's last run ends at the first run start of a later bucket — both
    resolved on one summary row per bucket.
    """
    ts = order[0]
    d = _keyed(df, keys, ts, bucket_seconds, untimed=False)
    if isinstance(key, Column):
        d, key = d.withColumn("_key", key), "_key"
    part = [*keys, BUCKET]
    w = Window.partitionBy(*part).orderBy(*_cols(order))
    d1 = d.withColumn("_rn", F.row_number().over(w)).withColumn("_lk", F.lag(key).over(w))
    # only the bucket's first row and the changes inside it go on: a run's last key is its first one
    c = d1.where((F.col("_rn") == 1) | ~F.col(key).eqNullSafe(F.col("_lk"))).drop("_lk")
    c = c.withColumn("_next_chg", F.lead(ts).over(w))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns(
        {"_fk": F.first(key).over(so_far), "_fts": F.first(ts).over(so_far), "_fchg": F.first("_next_chg").over(so_far), "_end": _at_last(w)}
    )
    last = _boundary(c, F.col("_end"), keys, F.col("_fk"), F.col(key).alias("_lk"), F.col("_fts"), F.col("_fchg"))
    ws = Window.partitionBy(*keys).orderBy(BUCKET)
    first_is_start = F.lag(BUCKET).over(ws).isNull() | ~F.col("_fk").eqNullSafe(F.lag("_lk").over(ws))
    summ = last.select(*part, first_is_start.alias("_fis"), "_fts", "_fchg")
    summ = summ.withColumn("_bstart", F.when(F.col("_fis"), F.col("_fts")).otherwise(F.col("_fchg")))
    later = Window.partitionBy(*keys).orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*part, "_fis", F.last("_bstart", ignorenulls=True).over(later).alias("_nbs"))
    j = c.drop("_fk", "_fts", "_fchg", "_end").join(summ, list(part), "left")
    return (
        j.where((F.col("_rn") > 1) | F.col("_fis"))
        .withColumn("_next_start", F.coalesce(F.col("_next_chg"), F.col("_nbs")))
        .drop("_rn", "_next_chg", "_fis", "_nbs", "_key")
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    same,
    out: str = "_island",
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Label every row with the order key (a struct of ``order``) of the first
    row of its island, in one pass. A row continues its predecessor's island
    when ``same(cur, prev)`` holds, where both are dicts col -> Column over
    ``cols``. Inside a bucket this is a lag plus a running last-non-null; the
    first row of a bucket is resolved against the previous bucket's last row,
    and rows before the bucket's first new island inherit the island carried
    over from earlier buckets — all on one summary row per bucket."""
    d = _keyed(df, keys, order[0], bucket_seconds, untimed=False)
    part = [*keys, BUCKET]
    w = Window.partitionBy(*part).orderBy(*_cols(order))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.struct(*_cols(order))
    d1 = d.withColumn("_rn", F.row_number().over(w)).withColumns({f"_l_{c}": F.lag(c).over(w) for c in cols})
    cont = same({c: F.col(c) for c in cols}, {c: F.col(f"_l_{c}") for c in cols})
    d1 = d1.withColumn("_inew", (F.col("_rn") > 1) & ~F.coalesce(cont, F.lit(False)))
    d1 = d1.withColumns(
        {
            "_istart": F.last(F.when(F.col("_inew"), ok), ignorenulls=True).over(so_far),
            "_f": F.first(F.struct(*_cols(cols), ok.alias("_k"))).over(so_far),
            "_end": _at_last(w),
        }
    ).drop(*[f"_l_{c}" for c in cols])
    last = _boundary(d1, F.col("_end"), keys, F.col("_f"), F.struct(*_cols(cols)).alias("_l"), F.col("_istart").alias("_li"))
    ws = Window.partitionBy(*keys).orderBy(BUCKET)
    prev = {c: F.lag(F.col("_l").getField(c)).over(ws) for c in cols}
    first_cont = F.lag(BUCKET).over(ws).isNotNull() & F.coalesce(
        same({c: F.col("_f").getField(c) for c in cols}, prev), F.lit(False)
    )
    summ = last.select(*part, (~first_cont).alias("_fnew"), F.col("_f._k").alias("_fk"), "_li")
    summ = summ.withColumn("_blast", F.coalesce(F.col("_li"), F.when(F.col("_fnew"), F.col("_fk"))))
    summ = summ.select(
        *part, "_fnew", "_fk",
        F.last("_blast", ignorenulls=True).over(ws.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
    )
    j = d1.drop("_f", "_end").join(summ, list(part), "left")
    island = F.coalesce(F.col("_istart"), F.when(F.col("_fnew"), F.col("_fk")).otherwise(F.col("_carry")))
    return j.withColumn(out, island).drop("_rn", "_inew", "_istart", "_fnew", "_fk", "_carry")


def drop_bucket(df: DataFrame) -> DataFrame:
    return df.drop(BUCKET)
