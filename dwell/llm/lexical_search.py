"""Ranked lexical search by presence masks.

One pass over the documents keeps, per document, its number of terms and the
frequencies of the terms that some item asks for. The search then takes blocks of
documents: every asked term is a bitmap over the block, an item's bitmaps are
transposed into one mask per document, and documents with equal masks form a
group. A mask's maximum score is the sum of its terms' greatest contributions in
the block; masks are scored in descending order of it until the next maximum is
below the item's k-th best score so far, so that no document left out could have
entered. A task carries its k best over all its blocks and hands out k rows an
item, ranked on in two steps (salted, then per item).

Items are the stated query set: they are taken in blocks of bounded rows and bytes
by a hash of the item, each of which is broadcast and dropped once its rows are
written. Documents and items without terms (null, empty) match nothing. Rows are
ranked as they stand: a repeated document ranks once per row, a null id before
all others; two texts under one item id are two items, repeated rows are one.
Empty tables give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwell.llm.common import NULL_ID, arrow_map, as_bytes, discard, held, id_key, table, write_table

TOP = 10
ITEM_ROWS = 4096  # items of a block, as a hash deals them
ITEM_BYTES = 8 << 20  # and their text
DOC_BLOCK = 4096  # documents whose masks are grouped at once
SALT = 64
#: fixed values of the term rule: what is no term byte; bytes of other scripts are
_APART = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in _APART else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
INDEX = "doc long, n long, ids binary, tfs binary"
HITS = "item int, item_id long, doc long, score long"


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, letters and all non-ASCII characters; A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


def build_index(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, ids, tfs): each document with a term, its number of terms, and the
    numbers and frequencies of those of the broadcast ``vocabulary`` (32-bit)."""
    name = uuid.uuid4().hex

    def build():
        # the worker keeps the vocabulary, a dictionary of bounded size, for its later tasks
        number = held(("lexical", name), lambda: {t: i for i, t in enumerate(vocabulary.value)})

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            words = [terms(t) for t in as_bytes(b.column(1))]
            n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ids = np.fromiter((number.get(w, -1) for ws in words for w in ws), dtype=np.int64, count=int(n.sum()))
            doc = np.repeat(np.arange(len(words)), n)[ids >= 0]
            key, tf = np.unique(doc << 32 | ids[ids >= 0], return_counts=True)
            cut = np.searchsorted(key, np.arange(1, len(words)) << 32)
            split = [[x.astype(np.uint32).tobytes() for x in np.split(a, cut)] for a in (key & 0xFFFFFFFF, tf)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(split[0], pa.binary()), pa.array(split[1], pa.binary())], names=["doc", "n", "ids", "tfs"])
            return out.filter(pa.array(n > 0))

        return work

    return arrow_map(docs.select(id_key(id_col).alias("_doc"), F.col(text_col).alias("_text")), build, INDEX)


def _statistics(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(N, L, document frequency of every asked term), counted in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        df = np.zeros(size, dtype=np.int64)
        for b in batches:
            docs += b.num_rows
            total += int(np.sum(b.column(0).to_numpy(zero_copy_only=False)))
            ids = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32)
            df += np.bincount(ids, minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[docs, total], df[at]]))], names=["term", "n"])

    rows = index.select("n", "ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    got = {r.term: r.n for r in rows}
    df = np.zeros(size, dtype=np.int64)
    for t, n in got.items():
        if t >= 0:
            df[t] = n
    return got.get(-2, 0), got.get(-1, 0), df


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


class Searcher:
    """The k best documents of every item over the blocks given so far."""

    def __init__(self, items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.items, self.weight, self.n_docs, self.n_terms, self.k = items, weight, n_docs, n_terms, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in items]  # (-score, document), best first
        self.groups = self.scored = 0  # masks met and masks scored

    def block(self, docs: np.ndarray, n: list[int], ids: list[bytes], tfs: list[bytes]) -> None:
        size = len(docs)
        counts = [len(x) // 4 for x in ids]
        term = np.frombuffer(b"".join(ids), dtype=np.uint32).astype(np.int64)
        if not len(term):
            return
        tf = np.frombuffer(b"".join(tfs), dtype=np.uint32).astype(np.int64)
        m = np.array([10 + 90 * x * self.n_docs // self.n_terms for x in n], dtype=np.int64)
        doc = np.repeat(np.arange(size), counts)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        factor = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        present, start = np.unique(term, return_index=True)
        end = np.append(start[1:], len(term))
        most = np.maximum.reduceat(factor, start) * self.weight[present]
        # one bitmap over the block's documents per term
        width = (size + 7) // 8
        cell = np.repeat(np.arange(len(present)), end - start) * width + (doc >> 3)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        bitmaps = np.zeros(len(present) * width, dtype=np.uint8)
        bitmaps[cell[first]] = np.add.reduceat(128 >> (doc & 7), first)
        bitmaps = bitmaps.reshape(len(present), width)
        slot = np.full(len(self.weight), -1)
        slot[present] = np.arange(len(present))
        for i, wanted in enumerate(self.items):
            own = slot[wanted]
            own = own[own >= 0]
            if len(own) and not self._below(i, int(most[own].sum())):
                self._item(i, own, bitmaps[own], most[own], docs, doc, factor, present, start, end)

    def _below(self, i: int, bound: int) -> bool:
        """No document with this maximum can enter (an equal score might, by a smaller id)."""
        best = self.best[i]
        return bound <= 0 or (len(best) == self.k and bound < -best[-1][0])

    def _item(self, i, own, bitmaps, most, docs, doc, factor, present, start, end) -> None:
        members = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps, axis=0)))
        flags = np.unpackbits(bitmaps, axis=1)[:, members]
        masks = np.packbits(flags, axis=0).T
        if len(own) <= 64:
            wide = np.zeros((len(members), 8), dtype=np.uint8)
            wide[:, : masks.shape[1]] = masks
            distinct, group = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
            distinct = distinct.view(np.uint8).reshape(-1, 8)
        else:
            distinct, group = np.unique(masks, axis=0, return_inverse=True)
        holds = np.unpackbits(np.ascontiguousarray(distinct), axis=1)[:, : len(own)].astype(bool)
        bound = holds @ most
        by_group = np.argsort(group.ravel(), kind="stable")
        edges = np.append(np.searchsorted(group.ravel()[by_group], np.arange(len(distinct))), len(by_group))
        self.groups += len(distinct)
        for g in np.argsort(-bound, kind="stable"):
            if self._below(i, int(bound[g])):
                break
            self.scored += 1
            who = members[by_group[edges[g] : edges[g + 1]]]
            score = np.zeros(len(who), dtype=np.int64)
            for s in own[holds[g]]:
                at = start[s] + np.searchsorted(doc[start[s] : end[s]], who)
                score += self.weight[present[s]] * factor[at]
            ids = docs[who]
            near = np.lexsort((ids, -score))[: self.k]
            new = [(-int(score[x]), int(ids[x])) for x in near if score[x] > 0]
            self.best[i] = sorted(self.best[i] + new)[: self.k]


def _hits(index: DataFrame, plan) -> DataFrame:
    """The k best documents of every item within each partition of the index."""
    schema = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, weight, n_docs, n_terms, k = plan.value
        search = Searcher(items, weight, n_docs, n_terms, k)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_BLOCK):
                b = batch.slice(at, DOC_BLOCK)
                search.block(b.column(0).to_numpy(zero_copy_only=False), *(b.column(c).to_pylist() for c in (1, 2, 3)))
        rows = [(i, ids[i], doc, -score) for i, best in enumerate(search.best) for score, doc in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return index.mapInArrow(run, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc("doc")]
    salted = Window.partitionBy("item", F.pmod("doc", F.lit(SALT))).orderBy(*order)
    some = hits.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of every item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    rows, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / ITEM_ROWS), math.ceil(size / ITEM_BYTES))
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        part.sort(key=lambda r: (r.item_id is not None, r.item_id or 0, r.text))
        wanted = [sorted(set(terms(r.text.encode()))) for r in part]
        vocabulary = sorted({t for ts in wanted for t in ts})
        number = {t: i for i, t in enumerate(vocabulary)}
        words = spark.sparkContext.broadcast(vocabulary)
        index = write_table(build_index(docs, words, id_col, text_col), "lexical-index")
        n_docs, n_terms, df = _statistics(index, len(vocabulary))
        plan = spark.sparkContext.broadcast(
            ([r.item_id for r in part], [np.array([number[t] for t in ts], dtype=np.int64) for ts in wanted], weights(df, n_docs), n_docs, n_terms, k)
        )
        found = write_table(_ranked(_hits(index, plan), k), "lexical-hits")
        discard(index)
        words.destroy()
        plan.destroy()
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", "rank", F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_SPLIT = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SPLIT} AS t FROM documents),
n AS (SELECT rid, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
tot AS (SELECT count(*)::BIGINT AS nd, coalesce(sum(n), 0)::BIGINT AS nt FROM n),
it AS (SELECT item_id, text, unnest(list_distinct({_SPLIT})) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY term),
s AS (
  SELECT it.item_id, it.text, n.doc_id, tf.rid, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * n.n * tot.nd) // tot.nt))))::BIGINT AS score
  FROM it JOIN tf USING (term) JOIN w USING (term) JOIN n USING (rid), tot GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST, rid)::INT AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= {TOP}
"""
