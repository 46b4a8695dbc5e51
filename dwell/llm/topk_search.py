"""Exact top-k inner-product search by distributed histogram selection.

For a bounded block of queries every candidate is scored in Arrow tasks; each
round counts the scores of every query in a histogram over the range that
still holds its k-th value, the counts are summed by Spark, and the range
shrinks to one bin, until it is a single score. A last pass returns the rows
at or above it; ties go to the smaller id. Scores are recomputed per round
(cheaper than storing queries x rows), and a task reports only the bins down to
its own k-th best score: lower bins cannot hold the global one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwell.llm.common import table

K = 10
BIN_BITS = 10
BLOCK_ROWS = 1024
BLOCK_BYTES = 16 << 20
CAND_ROWS = 1024
EXACT = 2**53
WIDE = 2**62


def quantized(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(``_id``, ``_v`` array of doubles holding floor(scale * x)); rows with a
    null id, a null or empty vector, or null / non-finite components take no part."""
    v = F.col(vec_col)
    d = df.select(F.col(id_col).cast("long").alias("_id"), F.transform(v, lambda x: x.cast("double")).alias("_v"))
    inf = float("inf")
    ok = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))
    d = d.where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0) & ok)
    return d.select("_id", F.transform("_v", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("_v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows of each dimension in the batch, in bounded pieces."""
    col = batch.column(1)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    off = np.asarray(col.offsets)
    flat = col.values.to_numpy(zero_copy_only=False)
    dims = np.diff(off)
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        for i in range(0, len(rows), CAND_ROWS):
            r = rows[i : i + CAND_ROWS]
            yield ids[r], flat[off[r][:, None] + np.arange(d)]


def _scores(q: np.ndarray, c: np.ndarray, bound: int) -> np.ndarray:
    """q @ c.T as int64: through doubles where every sum is exact, else in
    64-bit integers (products beyond 64 bits wrap, as Spark's longs do)."""
    if bound < EXACT:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _ordered(scores: np.ndarray, bound: int) -> np.ndarray:
    """Unsigned keys in the order of the scores, from 0 to twice the bound."""
    if bound < WIDE:
        return (scores + np.int64(bound)).view(np.uint64)
    return scores.view(np.uint64) ^ np.uint64(1 << 63)


def _block_jobs(cands: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, bound: int) -> DataFrame | None:
    """Top-k rows (query_id, vec_id, score) of one block of queries of one dimension."""
    spark = cands.sparkSession
    nq, dim = q.shape
    bits = 64 if bound >= WIDE else max(1, int(2 * bound).bit_length())
    bq = spark.sparkContext.broadcast((ids, q))
    # state per query: the key's leading bits found so far, rows above that range, found or fewer than k rows
    prefix = np.zeros(nq, dtype=np.uint64)
    above = np.zeros(nq, dtype=np.int64)
    few = np.zeros(nq, dtype=bool)
    left = bits
    while left > 0:
        step = min(BIN_BITS, left)
        left -= step
        n_bins = 1 << step

        def count(batches: Iterator[pa.RecordBatch], prefix=prefix, above=above, few=few, left=left, step=step, n_bins=n_bins):
            ids_q, mat = bq.value
            hist = np.zeros(nq * n_bins, dtype=np.int64)
            base = (np.arange(nq, dtype=np.int64) * n_bins)[:, None]
            for b in batches:
                for cid, m in _matrices(b):
                    if m.shape[1] != dim:
                        continue
                    u = _ordered(_scores(mat, m, bound), bound) >> np.uint64(left)
                    live = (u >> np.uint64(step)) == prefix[:, None] if left + step < 64 else np.ones(u.shape, dtype=bool)
                    live &= (cid[None, :] != ids_q[:, None]) & ~few[:, None]
                    cell = base + (u & np.uint64(n_bins - 1)).astype(np.int64)
                    hist += np.bincount(cell[live], minlength=nq * n_bins)
            h = hist.reshape(nq, n_bins)
            from_top = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h  # rows in higher bins
            qi, bi = np.nonzero((h > 0) & (from_top < k))
            if len(qi):
                yield pa.RecordBatch.from_arrays([pa.array(qi.astype(np.int64)), pa.array(bi.astype(np.int64)), pa.array(h[qi, bi])], names=["qi", "bin", "n"])

        hist = cands.mapInArrow(count, "qi long, bin long, n long").groupBy("qi", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("qi").orderBy(F.desc("bin"))
        need = spark.createDataFrame([(i, int(k - above[i])) for i in range(nq)], "qi long, need long")
        cum = hist.withColumn("cum", F.sum("n").over(w)).join(need, "qi")
        # the first bin from the top where the count reaches what is needed (the lowest bin, if it never does)
        pick = cum.groupBy("qi").agg(
            F.max(F.when(F.col("cum") >= F.col("need"), F.struct("bin", (F.col("cum") - F.col("n")).alias("over")))).alias("hit")
        )
        got = {r["qi"]: r["hit"] for r in pick.collect()}  # one row per query of the block
        prefix, above, few = prefix << np.uint64(step), above.copy(), few.copy()
        for i in range(nq):
            hit = got.get(i)
            if hit is None:
                few[i] = True
            elif not few[i]:
                prefix[i] |= np.uint64(hit["bin"])
                above[i] += hit["over"]

    def select(batches: Iterator[pa.RecordBatch], kth=prefix, few=few):
        ids_q, mat = bq.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * nq
        for b in batches:
            for cid, m in _matrices(b):
                if m.shape[1] != dim:
                    continue
                s = _scores(mat, m, bound)
                take = (_ordered(s, bound) >= kth[:, None]) | few[:, None]
                take &= cid[None, :] != ids_q[:, None]
                for i in np.flatnonzero(take.any(axis=1)):
                    sc = np.concatenate([best[i][0], s[i, take[i]]])
                    vi = np.concatenate([best[i][1], cid[take[i]]])
                    o = np.lexsort((vi, -sc.astype(object) if bound >= WIDE else -sc))[:k]
                    best[i] = (sc[o], vi[o])
        for i, (sc, vi) in enumerate(best):
            if len(sc):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sc), i)), pa.array(vi), pa.array(sc)], names=["qi", "vec_id", "score"])

    rows = cands.mapInArrow(select, "qi long, vec_id long, score long")
    w = Window.partitionBy("qi").orderBy(F.desc("score"), F.asc("vec_id"))
    names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "qi long, query_id long")
    return (
        rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(names, "qi").select("query_id", "rank", "vec_id", "score")
    )


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: float = 1024.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest integer inner
    product per query row, ties to the smaller id; candidates carrying the query's own id are left out.

    Queries are streamed through the driver in blocks of at most ``block_rows``
    rows and ``BLOCK_BYTES`` bytes; each block is broadcast and meets all
    candidates. A repeated query row gives its rows again; repeated candidate
    rows each count. Vectors of another length than the query's don't meet it.
    Fewer than k candidates: all of them. Empty tables give an empty result."""
    spark = candidates.sparkSession
    cands = quantized(candidates, id_col, vec_col, scale)
    qs = quantized(queries, id_col, vec_col, scale)
    top = cands.agg(F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()["m"]
    out: list[DataFrame] = []
    pend: dict[int, tuple[list[int], list[list[float]]]] = {}

    def flush(d: int) -> None:
        ids, vs = pend.pop(d)
        q = np.array(vs, dtype=np.float64)
        norm = float(np.sqrt((q * q).sum(axis=1).max()))
        b = norm * float(np.sqrt(top)) * (1 + 1e-9) + 1
        bound = int(b) + 1 if b < WIDE else WIDE
        out.append(_block_jobs(cands, np.array(ids, dtype=np.int64), q, k, bound))

    if top is not None:
        for r in qs.toLocalIterator():
            d = len(r["_v"])
            ids, vs = pend.setdefault(d, ([], []))
            ids.append(r["_id"])
            vs.append(r["_v"])
            if len(ids) >= block_rows or len(ids) * d * 8 >= BLOCK_BYTES:
                flush(d)
        for d in list(pend):
            flush(d)
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(e.where("vec_id % 100 = 0"), e)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
