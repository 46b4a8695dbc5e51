"""Substring dedup by De Bruijn compaction over token k-mers.

Every run of K consecutive words is an edge of a De Bruijn graph (its first and
last K-1 words are the nodes). The graph is never held: neighbouring edges of a
text that share a minimizer (the smallest hashed M-mer inside them) already form
a nonbranching path, so a path piece travels as one row with its minimizer, the
hash of its edges, and its source coordinates (document, first word, length).

1. Pieces whose minimizer occurs once are unique paths and drop out.
2. Equal pieces compact into one: a partially aggregated minimum finds the first
   source place, a join marks the later copies.
3. Where one minimizer has different pieces, the graph branches: the first copy
   of each is opened into its edges, which compact the same way, edge by edge.
4. Marked pieces of a document whose own and first coordinates advance in step
   are glued into one long span.
5. Spans are verified on the texts at both coordinates' digests, then the
   covered words go.

Equal edges have equal minimizers, and the first place of an edge lies in the
first copy of its piece, so the result is that of comparing every edge.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwell.llm.common import arrow_map, as_bytes, id_key, keyed_texts, mix64, odd_constants, rolling, table, u64_as_i64, word_hash, write_table

K = 20
M = 6
POSITION = np.uint64((1 << 20) - 1)
_MMER_SEED, _EDGE_SEED, _RUN_SEED = 101, 202, 303


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2**64 for i < n."""
    p = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


class PathPieces:
    """Cuts concatenated texts into path pieces."""

    def __init__(self, k: int = K, m: int = M):
        self.k, self.m = k, m
        self.words = word_hash()
        self.mmer, self.edge = odd_constants(_MMER_SEED, m), odd_constants(_EDGE_SEED, k)
        self.base = int(odd_constants(_RUN_SEED, 1)[0])
        self.inverse = pow(self.base, -1, 1 << 64)
        self._pow = self._inv = np.empty(0, dtype=np.uint64)

    def _minimizers(self, w: np.ndarray) -> np.ndarray:
        """Per edge: its smallest M-mer as one key, the M-mer's leading 44 bits
        above the low 20 of its position, so that the leftmost of equal ones wins."""
        mm = rolling(w, self.mmer)
        v = (mm & ~POSITION) | (np.arange(len(mm), dtype=np.uint64) & POSITION)
        span, n = self.k - self.m + 1, len(w) - self.k + 1
        done = 1
        while done < span:  # sliding minimum by doubling
            step = min(done, span - done)
            v = np.minimum(v[: len(v) - step], v[step:])
            done += step
        return v[:n]

    def of(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        """Pieces of the texts: doc (index), start (word), n (edges), mh (minimizer), ch (hash of the edges)."""
        split = [(t or b"").split() for t in texts]
        lens = np.array([len(x) for x in split], dtype=np.int64)
        w = self.words.of([x for ws in split for x in ws])
        n = len(w) - self.k + 1
        if n <= 0:
            z = np.empty(0, dtype=np.int64)
            return {"doc": z, "start": z, "n": z, "mh": z.view(np.uint64), "ch": z.view(np.uint64)}
        ends = np.cumsum(lens)
        doc = np.repeat(np.arange(len(lens)), lens)[:n]
        inside = np.arange(n) + self.k <= ends[doc]
        low = self._minimizers(w)
        g = rolling(w, self.edge)
        if len(self._pow) < n:
            self._pow, self._inv = _powers(self.base, 2 * n), _powers(self.inverse, 2 * n)
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * self._inv[:n], dtype=np.uint64)])
        new = np.ones(n, dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n)
        ok = inside[first]
        first, last = first[ok], last[ok]
        return {
            "doc": doc[first],
            "start": first - (ends - lens)[doc[first]],
            "n": last - first,
            "mh": low[first] & ~POSITION,
            "ch": mix64((s[last] - s[first]) * self._pow[first] + (last - first).astype(np.uint64)),
        }


def _pieces(k: int, m: int):
    def build():
        cut = PathPieces(k, m)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            p = cut.of(as_bytes(b.column(2)))
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[p["doc"]]), pa.array(ths[p["doc"]]), pa.array(p["start"].astype(np.int32)), pa.array(p["n"].astype(np.int32)), u64_as_i64(p["mh"]), u64_as_i64(p["ch"])],
                names=["_id", "_th", "start", "n", "mh", "ch"],
            )

        return work

    return build


def _edges(k: int):
    """Opened pieces: one row per edge with its hash and its piece's minimizer."""

    def build():
        words, consts = word_hash(), odd_constants(_EDGE_SEED, k)

        def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, t, runs in zip(range(b.num_rows), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                g = rolling(words.of((t or b"").split()), consts).view(np.int64)
                start = np.array([r["start"] for r in runs], dtype=np.int64)
                n = np.array([r["n"] for r in runs], dtype=np.int64)
                at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                one = np.ones(len(at), dtype=np.int64)
                for c, v in zip(cols, (one * b.column(0)[i].as_py(), one * b.column(1)[i].as_py(), at, np.repeat(np.array([r["mh"] for r in runs], dtype=np.int64), n), g[at]), strict=True):
                    c.append(v)
            v = [np.concatenate(c) for c in cols]
            return pa.RecordBatch.from_arrays([pa.array(v[0]), pa.array(v[1]), pa.array(v[2].astype(np.int32)), pa.array(v[3]), pa.array(v[4])], names=["_id", "_th", "start", "mh", "g"])

        return work

    return build


def _digest(words: list[bytes], start: int, n: int, k: int) -> bytes:
    return blake2b(b" ".join(words[start : start + n + k - 1]), digest_size=16).digest()


def _source_digests(k: int):
    """Digests of the words of spans at their source coordinates."""

    def build():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for fid, fth, t, spans in zip(*(b.column(i).to_pylist() for i in (0, 1)), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = (t or b"").split()
                for x in spans:
                    for c, v in zip(cols, (fid, fth, x["fstart"], x["n"], _digest(words, x["fstart"], x["n"], k)), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["fid", "fth", "fstart", "n", "digest"])

        return work

    return build


def _glued(marked: DataFrame) -> DataFrame:
    """Pieces of a document that continue each other in both coordinates become
    one span; the window's groups are single documents."""
    w = Window.partitionBy("_id", "_th").orderBy("fid", "fth", "delta", "start")
    prev = F.lag(F.struct("fid", "fth", "delta", (F.col("start") + F.col("n")).alias("e"))).over(w)
    d = marked.withColumn("delta", F.col("fstart") - F.col("start")).withColumn("p", prev)
    joins = (F.col("p.fid") == F.col("fid")) & (F.col("p.fth") == F.col("fth")) & (F.col("p.delta") == F.col("delta")) & (F.col("p.e") == F.col("start"))
    d = d.withColumn("span", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w))
    return d.groupBy("_id", "_th", "span").agg(
        F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.first("fid").alias("fid"), F.first("fth").alias("fth"), F.min("fstart").alias("fstart")
    ).drop("span")


def repeated_spans(texts: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(_id, _th, start, n, fid, fth, fstart, digest): glued spans of n edges
    (n + k - 1 words) that start earlier elsewhere, with their source
    coordinates and the digest of the source's words. ``texts``: see ``keyed_texts``."""
    pieces = write_table(arrow_map(texts, _pieces(k, m), "_id long, _th long, start int, n int, mh long, ch long"), "sub-all")
    # written, so that the join below has plain shuffles on both sides and a hot minimizer can be split
    rep = write_table(pieces.groupBy("mh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mh"), "sub-minimizers")
    cand = write_table(pieces.join(rep.hint("shuffle_hash"), "mh"), "sub-pieces")

    place = F.struct("_id", "_th", "start")
    source = [F.col("f._id").alias("fid"), F.col("f._th").alias("fth"), F.col("f.start").alias("fstart")]
    first = write_table(cand.groupBy("mh", "ch").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c"), F.first("n").alias("n")), "sub-first")
    later = cand.join(first.where("c > 1").select("mh", "ch", "f"), ["mh", "ch"]).where(place > F.col("f"))
    copies = later.select("_id", "_th", "start", "n", *source)

    branching = first.groupBy("mh").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("mh")
    opened = first.join(branching, "mh").select(F.col("f._id").alias("_id"), F.col("f._th").alias("_th"), F.struct(F.col("f.start").alias("start"), "n", "mh").alias("r"))
    runs = opened.groupBy("_id", "_th").agg(F.collect_list("r").alias("runs"))  # pieces of one document
    edges = arrow_map(texts.join(runs, ["_id", "_th"]).select("_id", "_th", "_text", "runs"), _edges(k), "_id long, _th long, start int, mh long, g long")
    edges = write_table(edges, "sub-edges")
    first_edge = edges.groupBy("mh", "g").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("mh", "g", "f")
    first_edge = write_table(first_edge, "sub-first-edges")
    later_edges = edges.join(first_edge, ["mh", "g"]).where(place > F.col("f"))
    copies = copies.unionByName(later_edges.select("_id", "_th", "start", F.lit(1).alias("n"), *source))

    spans = write_table(_glued(copies), "sub-spans")
    at = spans.select("fid", "fth", F.struct("fstart", "n").alias("x")).groupBy("fid", "fth").agg(F.collect_set("x").alias("xs"))  # distinct spans of one document
    src = texts.select(F.col("_id").alias("fid"), F.col("_th").alias("fth"), "_text")
    digests = arrow_map(src.join(at, ["fid", "fth"]).select("fid", "fth", "_text", "xs"), _source_digests(k), "fid long, fth long, fstart int, n int, digest binary").dropDuplicates(["fid", "fth", "fstart", "n"])
    return spans.join(digests, ["fid", "fth", "fstart", "n"])


def _cut(k: int):
    def build():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_removed, kept = [], [], []
            for t, spans in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = (t or b"").split()
                gone = np.zeros(len(words), dtype=bool)
                for x in spans or ():
                    if _digest(words, x["start"], x["n"], k) == x["digest"]:
                        gone[x["start"] : x["start"] + x["n"] + k - 1] = True
                out = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(out))
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                names=["row", "text", "n_words", "n_removed"],
            )

        return work

    return build


def dedup_substrings(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_words, n_removed): ``row`` is the input row as a struct,
    ``text`` its kept words joined by one space.

    Words are runs of characters other than ASCII white space. A window of k
    words whose words also start earlier (smaller id, then text hash; or earlier
    in the same text) is a repeat; its words go. Windows are judged on the input.
    Null, empty and short texts have no windows. Rows with the same id and text
    are one document; null ids sort first. Clashing columns stay inside ``row``.
    An empty table gives an empty result."""
    text = F.col(text_col)
    texts = keyed_texts(docs, id_col, text_col)
    spans = repeated_spans(texts, k, m)
    mine = write_table(spans.groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans")), "sub-doc-spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(row, id_key(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    j = base.join(mine, ["_id", "_th"], "left").select("row", "_text", "spans")
    kind = base.schema["row"].dataType.simpleString()
    return arrow_map(j, _cut(k), f"row {kind}, text string, n_words long, n_removed long")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(0, len(w) - {K - 1})) AS s, w FROM d WHERE len(w) >= {K}),
h AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + {K}], ' ')) AS win FROM x),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + {K})) AS p FROM r WHERE r > 1),
a AS (SELECT doc_id, len(w) AS n_words, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE range(0, len(w)) END) AS p, w FROM d),
k AS (SELECT a.doc_id, a.n_words, a.p, a.w[a.p + 1] AS word, c.p IS NOT NULL AS gone FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.p = c.p)
SELECT doc_id, CAST(any_value(n_words) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
