"""Helpers the operators of this subpackage share: row keys, scratch tables,
word hashing inside Arrow tasks, and distributed connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.session import scratch_path

T = TypeVar("T")
NULL_ID = -(2**63)
SLICE_ROWS = 256
SLICE_BYTES = 4 << 20
WORD_CACHE = 400_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_key(col: str) -> Column:
    """Long ordering key of an id; null ids sort first (as the smallest long)."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``_id``, ``_th``, ``_text``): rows that share an id are told apart by the
    hash of their text, so a repeated id never mixes two texts' positions."""
    text = F.col(text_col)
    return docs.select(id_key(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and reread it:
    cuts the lineage and survives lost executors. The write's shuffle files are
    removed once it has ended, since nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`write_table` whose results have been written on."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a linear 64-bit hash over all its bits (wraps)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def odd_constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    """word bytes -> 64-bit hash; a cache of bounded size in front of xxh64."""

    def __init__(self, limit: int = WORD_CACHE):
        import xxhash

        super().__init__()
        self._fn, self._limit = xxhash.xxh64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        h = self[word] = self._fn(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_HELD: list = [None, None]


def held(key: tuple, make: Callable[[], T]) -> T:
    """A worker's cached helper, kept for its later tasks. One at a time: the
    task of another operator drops it, so that caches never add up."""
    if _HELD[0] != key:
        _HELD[:] = None, None
        _HELD[:] = key, make()
    return _HELD[1]


def word_hash() -> WordHash:
    return held(("words",), WordHash)


def rolling(w: np.ndarray, consts: np.ndarray) -> np.ndarray:
    """Hash of every run of ``len(consts)`` consecutive word hashes."""
    k = len(consts)
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = w[:n] * consts[0]
    for j in range(1, k):
        h += w[j : j + n] * consts[j]
    return mix64(h)


def as_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """Raw UTF-8 of a string column, without decoding it."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into slices of bounded bytes (one row at least)."""
    import pyarrow.compute as pc

    lens = np.nan_to_num(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))).to_numpy(zero_copy_only=False).astype(float))
    start, size = 0, 0.0
    for i, n in enumerate(lens):
        if i > start and (size + n > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, size = i, 0.0
        size += n
    if start < len(lens):
        yield batch.slice(start)


def arrow_map(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, text_col: str = "_text") -> DataFrame:
    """``mapInArrow`` over byte-bounded slices. ``fn`` is a factory: called once
    per task, it returns the function that turns a slice into a result batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for b in batches:
            for s in slices(b, text_col):
                out = work(s)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def u64_as_i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("a").cast("decimal(38,0)")).alias("sa"),
        F.sum(F.col("b").cast("decimal(38,0)")).alias("sb"),
        F.expr("bit_xor(xxhash64(a, b))").alias("x"),
    ).first()
    return tuple(r)


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(``node``, ``component``) for every node of ``edges(a, b)``: the smallest
    node reachable. Alternating large-star / small-star rounds; each is a
    partially aggregated minimum per node joined back, so a hub with millions of
    neighbours is never gathered in a task. Every round is written to the
    shared folder. Nodes without edges are not returned."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = write_table(e, name)
    seen = _fingerprint(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.min("b").alias("mb")).select("a", F.least("a", "mb").alias("m"))
        large = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = write_table(m2.select("a", F.col("m").alias("b")).unionByName(small).distinct(), name)
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    comp = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return comp.unionByName(comp.select(F.col("component").alias("node"), "component").distinct())
