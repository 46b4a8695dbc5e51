"""Embedding near-duplicates: random-hyperplane sign hashing in several tables,
exact cosine verification, distributed connected components.

Identical vectors collapse into one class first. A class goes into one bucket
per table (the signs of its products with that table's hyperplanes); buckets
larger than ``block_rows`` are cut into blocks and every pair of blocks is a
group of its own, so no bucket, however hot, meets in one task, and no pair is
emitted: a group counts links and returns edges to its local components only.
A pair that collides in several tables is counted in the first one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.common import NULL_ID, connected_components, table, write_table

THRESHOLD = 0.9
MISS = 0.02  # accepted chance to miss a pair at exactly the threshold
BUCKET_ROWS = 128  # bits per signature grow with the table so that a mean bucket stays this size
BLOCK_ROWS = 512
SEED = 20240917


def plan_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): bits from the number of vectors, tables so that a pair at
    the threshold is missed with probability ``miss`` at most."""
    bits = min(31, max(4, math.ceil(math.log2(max(2, n / BUCKET_ROWS)))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - p))


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the greatest component lies in [0.5, 1):
    exact, and no square under- or overflows."""
    _, e = np.frexp(np.abs(m).max(axis=1))
    return np.ldexp(m, -e[:, None])


def signatures(m: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables) signatures; the hyperplanes come from the seed and the dimension alone."""
    planes = np.random.default_rng([seed, m.shape[1]]).standard_normal((m.shape[1], bits * tables))
    pos = (scaled(m) @ planes) > 0
    return pos.reshape(len(m), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def valid(v) -> F.Column:
    inf = float("inf")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def _by_dim(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each dimension in a list column."""
    off = np.asarray(col.offsets)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    dims = np.diff(off)
    for d in np.unique(dims):
        r = np.flatnonzero(dims == d)
        yield r, flat[off[r][:, None] + np.arange(d)]


def _buckets(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(k1, k2, dim, t, sig), without the vectors."""

    def run(batches):
        for b in batches:
            k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
            for r, m in _by_dim(b.column(2)):
                sig = signatures(m, bits, tables)
                n = len(r)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(k1[r], tables)),
                        pa.array(np.repeat(k2[r], tables)),
                        pa.array(np.full(n * tables, m.shape[1], dtype=np.int32)),
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), n)),
                        pa.array(sig.reshape(-1)),
                    ],
                    names=["k1", "k2", "dim", "t", "sig"],
                )

    return classes.select("k1", "k2", "v").mapInArrow(run, "k1 long, k2 long, dim int, t int, sig long")


def _local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member index reachable in a small graph."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, lab[i])
        new = np.minimum(new, new[new])
        if (new == lab).all():
            return lab
        lab = new


def _verify(threshold: float, bits: int, tables: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        tab = t.column("t")[0].as_py()
        same = t.column("bi")[0].as_py() == t.column("bj")[0].as_py()
        v = t.column("v").combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        _, m = next(_by_dim(v))
        blk, cid, cnt = (t.column(c).to_numpy() for c in ("blk", "cid", "cnt"))
        m = scaled(m)
        x = m / np.sqrt((m * m).sum(axis=1))[:, None]
        sig = signatures(m, bits, tables)[:, :tab] if tab else None
        bi = t.column("bi")[0].as_py()
        left = np.flatnonzero(blk == bi)
        right = left if same else np.flatnonzero(blk != bi)
        links = np.zeros(len(m), dtype=np.int64)
        e_i, e_j = [], []
        for s in range(0, len(left), 256):
            a = left[s : s + 256]
            near = (x[a] @ x[right].T) >= threshold
            if same:
                near &= a[:, None] < right[None, :]
            ai, bj = np.nonzero(near)
            ai, bj = a[ai], right[bj]
            if tab and len(ai):
                keep = np.concatenate([~(sig[ai[p : p + 65536]] == sig[bj[p : p + 65536]]).any(axis=1) for p in range(0, len(ai), 65536)])
                ai, bj = ai[keep], bj[keep]
            np.add.at(links, ai, cnt[bj])
            np.add.at(links, bj, cnt[ai])
            e_i.append(ai)
            e_j.append(bj)
        ei, ej = np.concatenate(e_i or [np.empty(0, int)]).astype(int), np.concatenate(e_j or [np.empty(0, int)]).astype(int)
        lab = _local_components(len(m), ei, ej)
        hit = np.flatnonzero(links > 0)
        return pa.table(
            {
                "k1": t.column("k1").to_numpy()[hit],
                "k2": t.column("k2").to_numpy()[hit],
                "n": links[hit],
                "a": cid[hit],
                "b": cid[lab[hit]],
            }
        )

    return run


def embedding_near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    miss: float = MISS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Links: cosine >= threshold in doubles, found in a shared bucket; identical
    vectors always link. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id, link with nothing (their
    component is their own id; a null id has a null component and is kept).
    Vectors of different lengths don't link. Repeated rows count as separate
    vectors of one class; different vectors of one id count their own links, but
    share the component. An empty table gives an empty result."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    ok = valid(F.col("v")) & F.col("vec_id").isNotNull()
    rows = rows.select(
        "vec_id",
        F.when(ok, F.xxhash64("v")).alias("k1"),
        F.when(ok, F.xxhash64("v", F.lit(1))).alias("k2"),
        F.when(ok, F.col("v")).alias("v"),
    )
    classes = (
        rows.where("v IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("cnt"), F.first("v").alias("v"))
    )
    classes = write_table(classes, "emb-classes")
    n = classes.count()
    bits, tables = plan_tables(n, threshold, miss)
    buckets = _buckets(classes, bits, tables)
    counts = buckets.groupBy("dim", "t", "sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counts = write_table(counts, "emb-buckets")  # plain shuffles on both sides of the join: a hot bucket can be split
    where = buckets.join(counts, ["dim", "t", "sig"]).select("k1", "k2", F.struct("dim", "t", "sig", F.ceil(F.col("c") / block_rows).cast("int").alias("nb")).alias("s"))
    # at most one bucket per table and class
    mine = where.groupBy("k1", "k2").agg(F.collect_list("s").alias("ss"))
    m = classes.join(mine, ["k1", "k2"]).select("k1", "k2", "cid", "cnt", "v", F.explode("ss").alias("s"))
    m = m.select("*", F.pmod(F.xxhash64("k2", "k1"), F.col("s.nb").cast("long")).cast("int").alias("blk"))
    m = m.select("k1", "k2", "cid", "cnt", "v", "s.dim", "s.t", "s.sig", "blk", F.explode(F.sequence(F.lit(0), F.col("s.nb") - 1)).alias("o"))
    m = m.select("k1", "k2", "cid", "cnt", "v", "dim", "t", "sig", "blk", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"))
    found = m.groupBy("dim", "t", "sig", "bi", "bj").applyInArrow(_verify(threshold, bits, tables), "k1 long, k2 long, n long, a long, b long")
    found = write_table(found, "emb-links")
    cc = connected_components(found.where("a <> b").select("a", "b"), "emb-cc")
    links = found.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    res = classes.select("k1", "k2", "cid", "cnt").join(links, ["k1", "k2"], "left").join(cc.withColumnRenamed("node", "cid"), "cid", "left")
    res = res.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), F.coalesce("component", "cid").alias("comp"))
    # rows without a class get keys of their own, so that they don't meet in one task
    key = F.coalesce("k1", F.xxhash64(F.coalesce("vec_id", F.lit(NULL_ID))))
    out = rows.select("vec_id", key.alias("k1"), "k2").join(res, ["k1", "k2"], "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        comp.alias("component_id"),
        F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
