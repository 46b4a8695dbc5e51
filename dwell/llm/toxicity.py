"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the hashed embeddings of the word and of its
character prefixes. Filters of several widths slide over the words of the whole
text, each keeps its maximum, and a logistic layer reads the maxima. The model
is trained in numpy, in one task, on a bounded sample of labelled rows and broadcast
(its size is fixed by the parameters); scoring is one pass over the documents.

Scores are calibrated on rows kept out of the training; the decision threshold
is fitted there as well, for each language. The score itself never sees the
language, source, id or a label.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.common import arrow_map, as_bytes, held, table

BUCKETS = 1 << 18  # rows of the embedding table (12 MB with DIM floats each)
DRAWN = 1 << 12  # rows of it drawn at a time
WORD_CACHE = 300_000
PREFIXES = (3, 4, 5)  # characters; hashed beside the word itself
SUBWORDS = 1 + len(PREFIXES)
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8  # per width
MAX_TRAIN_ROWS = 6_000  # labelled rows read for training, calibration and thresholds
MAX_TRAIN_WORDS = 2_000_000  # words of one such row: longer ones are left out. The training task holds SUBWORDS x 4 bytes a word of all rows
EPOCHS = 8
BATCH = 32
LEARNING_RATE = 0.02
SEED = 7
DEFAULT_THRESHOLD = 0.3
MIN_CLASS_ROWS = 8  # calibration rows of either label that a language needs for a threshold of its own


class Features(dict):
    """word bytes -> bytes of its SUBWORDS bucket numbers (int32); bounded cache."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        low = word.decode("utf-8", "replace").lower().strip("\"'.,;:!?()[]{}|*-_")
        keys = [f"w{low}"] + [f"{n}{low[:n]}" if len(low) >= n else f"w{low}" for n in PREFIXES]
        v = self[word] = np.array([xxhash.xxh64_intdigest(k.encode()) % BUCKETS for k in keys], dtype=np.int32).tobytes()
        return v

    def of(self, text: bytes | None) -> np.ndarray:
        """(words, SUBWORDS) bucket numbers of a whole text."""
        words = (text or b"").split()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.int32).reshape(-1, SUBWORDS)


def features() -> Features:
    return held(("features",), Features)


@dataclass
class Model:
    emb: np.ndarray  # (BUCKETS, DIM)
    kernels: list[np.ndarray]  # per width (width * DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out_bias: float = 0.0
    scale: float = 1.0  # Platt calibration of the raw output
    shift: float = 0.0
    constant: float | None = None  # score of every text, where the labels allow no training
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def pooled(self, feats: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Max of every filter over the text, the word each maximum starts at, and the padded word vectors."""
        pad = max(WIDTHS) - 1
        x = np.zeros((max(1, len(feats)) + pad, DIM), dtype=np.float32)
        if len(feats):
            x[: len(feats)] = self.emb[feats].sum(axis=1)
        n = len(x) - pad
        best, at = [], []
        for w, k, b in zip(WIDTHS, self.kernels, self.biases, strict=True):
            y = x[:n] @ k[:DIM]
            for j in range(1, w):
                y += x[j : j + n] @ k[j * DIM : (j + 1) * DIM]
            i = y.argmax(axis=0)
            best.append(np.maximum(y[i, np.arange(FILTERS)] + b, 0))
            at.append(i)
        return np.concatenate(best), at, x

    def raw(self, feats: np.ndarray) -> float:
        return float(self.pooled(feats)[0] @ self.out + self.out_bias)

    def score(self, feats: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return _sigmoid(self.scale * self.raw(feats) + self.shift)


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a regularized logistic fit of y on the raw output (Newton steps)."""
    center, spread = raw.mean(), raw.std() + 1e-9
    x = np.stack([(raw - center) / spread, np.ones(len(raw))], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.05 * w * [1, 0]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 1e-6])
        w -= np.clip(np.linalg.solve(h, g), -3, 3)
    return w[0] / spread, w[1] - w[0] * center / spread


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1; of equal ones the middle of the widest gap."""
    s = np.unique(score)
    cuts = np.concatenate([(s[:-1] + s[1:]) / 2, [s[-1] + 1e-6]])
    best, at = -1.0, DEFAULT_THRESHOLD
    for c, gap in zip(cuts, np.concatenate([np.diff(s), [0]]), strict=True):
        p = score >= c
        f1 = 2 * (p & (y == 1)).sum() / max(1, p.sum() + (y == 1).sum())
        if (f1 + 1e-6 * gap) > best:
            best, at = f1 + 1e-6 * gap, float(c)
    return at


def train(rows: list[tuple[np.ndarray, int, str | None]] | DataFrame, seed: int = SEED) -> Model:
    """The model of (features, label, language) rows; of a :func:`training_sample`
    (bounded) in one task, so that the driver gets the model alone."""
    if not isinstance(rows, DataFrame):
        return _train(rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_train(_rows(batches), seed))], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").toArrow()
    return pickle.loads(got["model"][0].as_buffer()) if got.num_rows else _train([], seed)


def _train(rows: list[tuple[np.ndarray, int, str | None]], seed: int) -> Model:
    """Fit on (features, label, language) rows. No labelled rows: every text scores 0; one class only: its rate (0 or 1)."""
    rng = np.random.default_rng(seed)
    k = len(WIDTHS) * FILTERS
    emb = np.empty((BUCKETS, DIM), dtype=np.float32)
    for at in range(0, BUCKETS, DRAWN):  # the driver never holds all of it in doubles
        emb[at : at + DRAWN] = rng.standard_normal((min(DRAWN, BUCKETS - at), DIM)) * 0.05
    kernels = [(rng.standard_normal((w * DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    model = Model(emb, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.abs(rng.standard_normal(k).astype(np.float32)) * 0.3)
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if not len(rows) or y.min() == y.max():
        model.constant = float(y[0]) if len(rows) else 0.0
        return model
    order = rng.permutation(len(rows))
    # halves within each label: one starts the embeddings, one trains the net; a fifth calibrates
    part = np.empty(len(rows), dtype=np.int8)
    for label in (0, 1):
        own = order[y[order] == label]
        part[own] = np.array([0, 1, 0, 1, 2] if len(own) >= 10 else [0, 1], dtype=np.int8)[np.arange(len(own)) % (5 if len(own) >= 10 else 2)]
    # the first dimension starts as the smoothed log odds of a bucket in the first part
    seen = np.zeros((2, BUCKETS))
    for i in np.flatnonzero(part == 0):
        seen[int(y[i]), np.unique(rows[i][0])] += 1
    n0, n1 = ((part == 0) & (y == 0)).sum(), ((part == 0) & (y == 1)).sum()
    odds = np.log((seen[1] + 0.3) / (n1 + 0.6)) - np.log((seen[0] + 0.3) / (n0 + 0.6))
    odds[seen.sum(axis=0) < (3 if n1 >= 30 else 2)] = 0
    model.emb[:, 0] += np.clip(odds, -3, 6).astype(np.float32) / 4
    for w, kern in zip(WIDTHS, model.kernels, strict=True):
        for j in range(w):
            kern[j * DIM] = np.abs(kern[j * DIM]) + 0.2
    model.out_bias = float(np.log(y.mean() / (1 - y.mean())))

    params = [*model.kernels, *model.biases, model.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    emb_sq = np.zeros(BUCKETS, dtype=np.float32)
    bias_m = [0.0, 0.0]
    fit = np.flatnonzero(part != 2)
    weight = {0: 0.5 / (y[fit] == 0).mean(), 1: 0.5 / (y[fit] == 1).mean()}
    t = 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for s in range(0, len(fit), BATCH):
            grads = [np.zeros_like(p) for p in params]
            g_emb: dict[int, np.ndarray] = {}
            g_bias = 0.0
            for i in fit[s : s + BATCH]:
                feats = rows[i][0]
                h, at, x = model.pooled(feats)
                d = (_sigmoid(float(h @ model.out + model.out_bias)) - y[i]) * weight[int(y[i])] / BATCH
                g_bias += d
                grads[-1] += d * h
                dh = d * model.out * (h > 0)
                for wi, w in enumerate(WIDTHS):
                    for f in np.flatnonzero(dh[wi * FILTERS : (wi + 1) * FILTERS]):
                        g, p = dh[wi * FILTERS + f], at[wi][f]
                        grads[wi][:, f] += g * x[p : p + w].reshape(-1)
                        grads[len(WIDTHS) + wi][f] += g
                        for j in range(w):
                            if p + j < len(feats):
                                gx = g * model.kernels[wi][j * DIM : (j + 1) * DIM, f]
                                for b in feats[p + j]:
                                    g_emb[int(b)] = g_emb.get(int(b), 0) + gx
            t += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= LEARNING_RATE / 2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
            bias_m[0] += 0.1 * (g_bias - bias_m[0])
            bias_m[1] += 0.01 * (g_bias**2 - bias_m[1])
            model.out_bias -= LEARNING_RATE / 2 * (bias_m[0] / (1 - 0.9**t)) / (np.sqrt(bias_m[1] / (1 - 0.99**t)) + 1e-7)
            for b, g in g_emb.items():
                emb_sq[b] += float((g * g).mean())
                model.emb[b] -= LEARNING_RATE * g / (np.sqrt(emb_sq[b]) + 1e-6)

    cal = np.flatnonzero(part == 2)
    if not len(cal) or (y[cal] == 1).sum() < 5:
        cal = np.arange(len(rows))
    raw = np.array([model.raw(rows[i][0]) for i in cal])
    model.scale, model.shift = _platt(raw, y[cal])
    score = np.array([_sigmoid(z) for z in model.scale * raw + model.shift])
    model.thresholds[None] = _threshold(score, y[cal])
    for lang in {rows[i][2] for i in cal} - {None}:
        own = np.array([rows[i][2] == lang for i in cal])
        ones = (y[cal][own] == 1).sum()
        if ones >= MIN_CLASS_ROWS and own.sum() - ones >= MIN_CLASS_ROWS:
            model.thresholds[lang] = _threshold(score[own], y[cal][own])
    return model


def training_sample(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic"
) -> DataFrame:
    """(_id, _y, _lang, f): the bounded training sample, MAX_TRAIN_ROWS labelled ids by
    the order of their hash, met with the documents (the ids, bounded, are broadcast)."""
    ids = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    ids = ids.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("_y"))
    picked = ids.orderBy(F.xxhash64("_id"), "_id").limit(MAX_TRAIN_ROWS)
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    d = d.join(F.broadcast(picked), "_id").select("_id", "_y", "_lang", "_text")

    def build():
        feats = features()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            f = [feats.of(t) for t in as_bytes(b.column(3))]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.tobytes() if len(x) <= MAX_TRAIN_WORDS else None for x in f], pa.binary())], names=["_id", "_y", "_lang", "f"])

        return work

    return arrow_map(d, build, "_id long, _y int, _lang string, f binary").where("f IS NOT NULL").dropDuplicates(["_id"])


def _rows(batches: Iterable[pa.RecordBatch]) -> list[tuple[np.ndarray, int, str | None]]:
    rows = []
    for b in batches:  # the arrays stay views of the batches
        for i, y, lang, f in zip(*(b.column(c).to_pylist() for c in range(3)), b.column(3), strict=True):
            rows.append((i, (np.frombuffer(f.as_buffer(), dtype=np.int32).reshape(-1, SUBWORDS), int(y > 0), lang)))
    rows.sort(key=lambda r: r[0])
    return [r for _, r in rows]


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, **columns: str) -> list[tuple[np.ndarray, int, str | None]]:
    """The rows of :func:`training_sample`, here, by ascending id."""
    return _rows(training_sample(docs, labels, usable, **columns).toArrow().to_batches())


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(row, score, threshold, toxic): the input row as a struct, the score of its
    whole text, its language's threshold, and whether the score reaches it. Null
    and empty texts are scored as texts without words; a null or unseen language takes the overall threshold."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))

    def build():
        feats, m = features(), bc.value

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            s = np.array([m.score(feats.of(t)) for t in as_bytes(b.column(1))])
            top = m.thresholds.get(None, DEFAULT_THRESHOLD)
            cut = np.array([m.thresholds.get(x, top) for x in b.column(2).to_pylist()])
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(cut), pa.array(s >= cut)], names=["row", "score", "threshold", "toxic"])

        return work

    kind = d.schema["row"].dataType.simpleString()
    return arrow_map(d, build, f"row {kind}, score double, threshold double, toxic boolean")


def held_out(col: str) -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(training_sample(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id")))
    out = score(docs, model)
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= DEFAULT_THRESHOLD).cast("int").alias("predicted"),
        F.col("row.lang").alias("lang"),
        "threshold",
        F.col("toxic").cast("int").alias("by_language"),
    )
