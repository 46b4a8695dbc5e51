"""Language identification as inference in a mixture of languages.

A language is a distribution over hashed byte n-grams, learned from a bounded
sample of labelled documents. A document is a sequence of words, each drawn from
one language with the document's proportions; a word's likelihood is that of its
n-grams. Expectation-maximisation estimates the proportions; the set of
languages grows from the likeliest one, in the order of their proportions under
all languages, as long as the penalised likelihood of the document rises. The
language with the greatest proportion in the chosen set is the prediction, its
proportion the score.

Everything runs on whole texts, many documents at once: words, proportions and
likelihoods are arrays over a slice of documents.

Null texts and texts without a letter are ``und`` with score 0, and so is every
text when no labelled row can be learned from. Letters of scripts that no
language was learned for are likeliest under the smoothest one. Repeated rows are
predicted each; ties go to the language that sorts first; an empty table gives
no rows. Labels are read from the training rows alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.common import arrow_map, as_bytes, slices, table

TRAIN_ROWS = 2_000  # expected labelled rows that a language is learned from, dealt by a hash of the id
ORDERS = (2, 3, 4)  # bytes of an n-gram
BUCKETS = 1 << 16  # hashed n-grams of each order
SMOOTH = 0.5  # added to the count of every n-gram
EM_STEPS = 12
SET_STEPS = 6
PENALTY = 4.0  # log-likelihood that a further language must add, times log(words + 1)
FLOOR = -12.0  # least log-likelihood of a word below its best language (a stray word isn't proof)
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: fixed values: bytes that end a word (ASCII that is no letter), A-Z lower-cased
_APART = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in _APART else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: bytes | None) -> bool:
    """Whether some character is a letter (Unicode category L)."""
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text.decode("utf-8", "replace")))


def _squeezed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each with a space on either side, as one byte array;
    and the position at which every text ends."""
    parts = [b" " + b" ".join((t or b"").translate(_TABLE).split()) + b" " for t in texts]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts])


def _grams(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per order, the bucket of the n-gram that starts at each byte. A word's
    n-grams start on its first space up to its last letter but n - 2."""
    code = x.astype(np.uint64)
    for i, n in enumerate(ORDERS):
        key = code[: len(x) - n + 1].copy()
        for j in range(1, n):
            key = key << np.uint64(8) | code[j : len(x) - n + 1 + j]
        yield i, ((key * _MULTIPLY) >> np.uint64(64 - 16)).astype(np.int64)


def _word_spans(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word with its two spaces."""
    space = np.flatnonzero(x == 0x20)
    wide = np.diff(space) > 1
    return space[:-1][wide], space[1:][wide] + 1


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (orders, BUCKETS, languages) log-probability of an n-gram

    def words(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of every word, its log-likelihood under every language). A letter
        lies in n n-grams of order n, so each order counts 1 / n, and the orders
        are averaged."""
        start, end = _word_spans(x)
        out = np.zeros((len(start), len(self.langs)), dtype=np.float64)
        for i, bucket in _grams(x):
            n = ORDERS[i]
            # sums over the n-grams inside a word: from its first space to the last that ends on its second
            run = np.zeros((len(bucket) + 1, len(self.langs)))
            np.cumsum(self.table[i][bucket], axis=0, out=run[1:])
            last = np.maximum(end - n + 1, start)
            out += (run[last] - run[start]) / (n * len(ORDERS))
        return start, out


def infer(model: Model, like: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions in the chosen set, number of languages in it) of every document.
    ``like`` holds log-likelihoods of words, ``doc`` their document, in order."""
    k = len(model.langs)
    share = np.zeros((n_docs, k))
    chosen = np.zeros(n_docs, dtype=np.int64)
    present, first = np.unique(doc, return_index=True)
    if not len(present):
        return share, chosen
    top = like.max(axis=1, keepdims=True)
    rel = np.exp(np.maximum(like - top, FLOOR))
    size = np.diff(np.append(first, len(doc)))
    at = np.repeat(np.arange(len(present)), size)

    def fit(pi: np.ndarray, rel: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(steps):
            r = pi[at]
            r *= rel
            r /= r.sum(axis=1, keepdims=True)
            pi = np.add.reduceat(r, first, axis=0) / size[:, None]
        mass = np.log(np.einsum("ij,ij->i", pi[at], rel))
        return pi, np.add.reduceat(mass, first)

    pi, _ = fit(np.full((len(present), k), 1 / k), rel, at, first, size, EM_STEPS)
    order = np.argsort(-pi, axis=1, kind="stable")
    # one language: the likeliest; its likelihood needs no steps
    single = np.add.reduceat(np.log(rel), first, axis=0)
    lead = single.argmax(axis=1)
    best = np.zeros_like(pi)
    best[np.arange(len(present)), lead] = 1
    value = single.max(axis=1)
    count = np.ones(len(present), dtype=np.int64)
    # the leader comes first in every set, the others in the order of their proportions
    rank = np.argsort(np.where(order == lead[:, None], -1, np.arange(k)), axis=1, kind="stable")
    order = np.take_along_axis(order, rank, axis=1)
    open_ = np.arange(len(present))
    for width in range(2, k + 1):
        if not len(open_):
            break
        keep = np.isin(at, open_) if len(open_) < len(present) else slice(None)
        sub, sub_size = rel[keep], size[open_]
        sub_at = np.repeat(np.arange(len(open_)), sub_size)
        sub_first = np.append(0, np.cumsum(sub_size)[:-1])
        start = np.zeros((len(open_), k))
        np.put_along_axis(start, order[open_, :width], 1 / width, axis=1)
        p, v = fit(start, sub, sub_at, sub_first, sub_size, SET_STEPS)
        better = v - value[open_] > PENALTY * np.log(sub_size + 1)
        won = open_[better]
        best[won], value[won], count[won] = p[better], v[better], width
        open_ = won
    share[present], chosen[present] = best, count
    return share, chosen


# --- learning -----------------------------------------------------------------


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled rows of ``usable``: of every language those whose
    id's hash is below the share that gives ``rows`` of them (all, where there are
    fewer). Counts are taken in tasks and summed per (language, n-gram)."""
    spark = docs.sparkSession
    d = docs.where(usable & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_lang"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sizes = {r["_lang"]: r["n"] for r in d.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((len(ORDERS), BUCKETS, 0)))
    limits = spark.createDataFrame([(lang, min(1.0, rows / n)) for lang, n in sizes.items()], "_lang string, _share double")
    dealt = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) / (1 << 20)
    picked = d.join(F.broadcast(limits), "_lang").where(dealt < F.col("_share")).where("_text IS NOT NULL").select("_lang", "_text")
    ddl = "_lang string, gram int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for s in slices(b, "_text"):
                langs = s.column(0).to_pylist()
                texts = as_bytes(s.column(1))
                for lang in set(langs):
                    x, _ = _squeezed([t for t, own in zip(texts, langs, strict=True) if own == lang])
                    c = counts.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS, dtype=np.int64))
                    start, end = _word_spans(x)
                    for i, bucket in _grams(x):
                        inside = np.zeros(len(x) + 1, dtype=np.int64)
                        ok = end - ORDERS[i] >= start
                        np.add.at(inside, start[ok], 1)
                        np.add.at(inside, end[ok] - ORDERS[i] + 1, -1)
                        here = np.cumsum(inside)[: len(bucket)] > 0
                        c[i * BUCKETS : (i + 1) * BUCKETS] += np.bincount(bucket[here], minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["_lang", "gram", "n"])

    summed = picked.mapInArrow(run, ddl).groupBy("_lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(summed.column("_lang").to_pylist()))
    total = np.zeros((len(ORDERS) * BUCKETS, len(langs)))
    lang_at = np.array([langs.index(v) for v in summed.column("_lang").to_pylist()], dtype=np.int64)
    total[summed.column("gram").to_numpy(), lang_at] = summed.column("n").to_numpy()
    total = total.reshape(len(ORDERS), BUCKETS, len(langs))
    prob = np.log((total + SMOOTH) / (total.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS))
    return Model(langs, prob)


# --- prediction ---------------------------------------------------------------


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, n_langs, langs, shares): the input row as a struct,
    the predicted language and its proportion, and the chosen set with its
    proportions, greatest first."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col(text_col).alias("_text"))

    def build():
        m = bc.value

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(b.column(1))
            known = np.array([bool(m.langs) and has_letter(t) for t in texts])
            x, ends = _squeezed([t if ok else None for t, ok in zip(texts, known, strict=True)])
            start, like = m.words(x) if m.langs else (np.zeros(0, np.int64), np.zeros((0, 0)))
            doc = np.searchsorted(ends, start, side="right")
            share, n = infer(m, like, doc, len(texts))
            pred, score, langs, shares = [], [], [], []
            for i, s in enumerate(share):
                order = [j for j in np.argsort(-s, kind="stable") if s[j] > 0] if known[i] else []
                pred.append(m.langs[order[0]] if order else UNKNOWN)
                score.append(min(1.0, float(s[order[0]])) if order else 0.0)
                langs.append([m.langs[j] for j in order])
                shares.append([float(s[j]) for j in order])
            cols = [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(np.where(known, n, 0).astype(np.int32))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["row", "lang_pred", "score", "n_langs", "langs", "shares"])

        return work

    kind = d.schema["row"].dataType.simpleString()
    return arrow_map(d, build, f"row {kind}, lang_pred string, score double, n_langs int, langs array<string>, shares array<double>")


def held_out(col: str) -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"), ~held_out("doc_id"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "n_langs")
