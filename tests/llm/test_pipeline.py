"""The pipeline's stages on sf0.001 and their decisions against brute force."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

from dwell.llm import mixing, sentencepiece_nbest, toxicity
from dwell.llm.common import write_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row", F.lit("extra"))
    kept = {}
    for name, stage in P.STAGES:
        out = write_table(stage(spark, docs, SF), "pipe-test")
        if name != "sentencepiece":
            assert out.columns == docs.columns
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept[name] <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = docs if name == "sentencepiece" else out
    lat = sentencepiece_nbest.load()
    texts = {r.doc_id: r.text for r in docs.collect()}
    import numpy as np

    assert all(lat.decode(np.array(r.ids, dtype="<i4").tobytes()) == texts[r.doc_id] for r in out.collect())
    assert len(kept["line_dedup"]) > 0.5 * len(kept["toxicity"])


def test_near_duplicates_leave_one(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(3, base), (1, base + " x"), (2, base), (9, "other words that stand alone here"), (None, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.one_of_each_group(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "5", "9", "None"]


def test_each_component_keeps_one_whatever_its_ids(spark):
    text = lambda w, n=40: " ".join(f"{w}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, ""), (None, None), (None, None), (None, " \n")]  # unrelated, no id
    rows += [(7, text("p")), (7, text("q")), (7, text("q")), (7, "")]  # one id, two texts, one of them twice
    for k in range(16):  # rows (i, X), (i, Y) and (j, X'): whichever of X and Y has the smaller hash
        rows += [(100 + k, text(f"x{k}_")), (100 + k, text(f"y{k}_")), (200 + k, text(f"x{k}_") + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in P.one_of_each_group(spark, docs, SF).collect())
    want = [r for i, r in enumerate(rows) if i != 9 and not (r[0] or 0) >= 200]
    assert got == sorted((str(i), str(t)) for i, t in want)


def test_mixing_draws_rare_cells_up_to_their_target(spark):
    rows = [(i, "big" if i >= 9 else "rare", "en", " ".join(["word"] * 50)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    target = (share := 0.01**0.5) / (share + 0.99**0.5)  # exponent 0.5 of the observed shares
    n = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert all(n[i] in (5, 6) for i in range(9))  # 0.6 x 9.1 each
    got = [r.doc_id for r in P.sample_mix(spark, docs, SF).select("doc_id").collect()]
    assert all(got.count(i) == k for i, k in n.items())
    assert abs(sum(i < 9 for i in got) / len(got) - target) < 0.015


def test_line_dedup_stage_keeps_every_document(spark):
    rows = [(1, "a\nb\nc\nd", 7), (2, "p\nq\nr", 5), (3, "a\nb\nc\np\nq\nr", 11), (4, "a\nb\nc\nd", 7), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {tuple(r) for r in P.drop_repeated_lines(spark, docs, SF).collect()}
    # 3 consists of passages of 1 and 2, but is a copy of neither
    assert got == {rows[0], rows[1], (3, "", 0), (4, "", 0), rows[4]}


LOW = -(2**63)


def _kept_by_classifier(rows, model):
    """(rows kept for sure, rows that may stay): the net in plain steps, texts at the very threshold left open."""
    sure, may = Counter(), Counter()
    feats = toxicity.Features()
    for r in rows:
        f = feats.of(None if r.text is None else r.text.encode())
        x = np.concatenate([model.emb[f].sum(axis=1).reshape(-1, toxicity.DIM), np.zeros((3 if not len(f) else 2, toxicity.DIM))])
        top = [max(0.0, max(float(x[p : p + w].reshape(-1) @ k[:, c] + b[c]) for p in range(len(x) - 2))) for w, k, b in zip(toxicity.WIDTHS, model.kernels, model.biases, strict=True) for c in range(toxicity.FILTERS)]
        s = 1 / (1 + math.exp(-(model.scale * (np.dot(top, model.out) + model.out_bias) + model.shift)))
        cut = model.thresholds.get(r.lang, model.thresholds[None])
        sure[r[:]] += s < cut - 1e-4
        may[r[:]] += s < cut + 1e-4
    return +sure, +may


def _line_dedup(rows, hashes):
    place = lambda r: (LOW if r.doc_id is None else r.doc_id, hashes[r.text])
    first, lines = {}, {place(r): r.text.split("\n") if r.text else [] for r in rows}
    for at in sorted(lines):
        for j in range(len(lines[at]) - 2):
            first.setdefault(tuple(lines[at][j : j + 3]), (at, j))
    out = Counter()
    for r in rows:
        ls = lines[place(r)]
        gone = {j + k for j in range(len(ls) - 2) if "".join(ls[j : j + 3]).encode().strip() and first[tuple(ls[j : j + 3])] != (place(r), j) for k in range(3)}
        text = "\n".join(x for j, x in enumerate(ls) if j not in gone) if gone else r.text
        out[r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars] += 1
    return out


def _one_of_each(rows, hashes):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, comp = [grams(r.text) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if comp[a] != comp[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    best = {}
    for i, r in enumerate(rows):
        key = (LOW if r.doc_id is None else r.doc_id, hashes[r.text])
        best[comp[i]] = min(best.get(comp[i], (key, i)), (key, i))
    return Counter((rows[i].doc_id, rows[i].text) for _, i in best.values())


def _mixed(rows):
    def topic(t):
        low = (t or "").lower()
        return "empty" if not t else "license" if "license" in low or "copyright" in low else "table" if " | " in t else "contact" if "@" in t or "://" in t else "prose"

    cell = [(r.source, r.lang, topic(r.text)) for r in rows]
    n = [len((r.text or "").encode().split()) for r in rows]
    w = defaultdict(float)
    for c, k in zip(cell, n, strict=True):
        w[c] += k
    w, total = {c: v for c, v in w.items() if v}, sum(n)
    share = lambda x, d: {k: sum(v for c, v in x.items() if c[d] == k) for k in {c[d] for c in x}}
    targets = []
    for d, power in enumerate((0.5, 0.7, 0.8)):
        raw = {k: (v / total) ** power for k, v in share(w, d).items()}
        targets.append({k: v / sum(raw.values()) for k, v in raw.items()})
    x = dict(w)
    for _ in range(60):
        for d in range(3):
            now = share(x, d)
            x = {c: v * targets[d][c[d]] / now[c[d]] for c, v in x.items()}
    out = Counter()
    for r, c, k in zip(rows, cell, n, strict=True):
        times = x[c] * total / w[c] * 0.6 if k else 1.0
        key = str(r.doc_id) if r.doc_id is not None else hashlib.md5(r.text.encode()).hexdigest() if r.text is not None else ""
        u = int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:13], 16) / 16**13
        whole = math.floor(times + 1e-9)
        out[r[:]] += whole + (u < times - whole)
    return +out


def test_every_stage_equals_plain_python(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("length(text) > 300").orderBy("doc_id").limit(4).collect()
    unlike = lambda w: " ".join(f"{w}{i}" for i in range(30))
    odd = [(None, unlike("a"), "en", "web", 1), (None, unlike("b"), None, "web", 1), (None, unlike("c"), "de", None, 1), (None, "", "en", "web", 0), (None, None, None, None, None)]
    odd += [(some[0].doc_id, unlike("d"), "en", "rare", 1), (some[0].doc_id, unlike("e"), "en", "rare", 1), (9001, unlike("d") + " x", "en", "rare", 1), tuple(some[1]), tuple(some[1])]
    odd += [(9002, some[2].text, "en", "web", 1), (9003, some[2].text + "\n" + some[3].text, "en", "web", 1), (9004, "k1\nk2\nk3\nk4", "en", "web", 11), (9005, "k2\nk3\nk4", "en", "web", 8), (9006, " \n\t", "en", "web", 3)]
    docs = write_table(docs.unionByName(spark.createDataFrame(odd, docs.schema)), "pipe-odd")
    models = []
    monkeypatch.setattr(toxicity, "train", lambda rows, f=toxicity.train: models.append(f(rows)) or models[-1])
    for name, stage in P.STAGES:
        rows = docs.collect()
        hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
        docs = write_table(stage(spark, docs, SF), "pipe-odd")
        out = docs.collect()
        got = Counter(r[:] for r in out) if name != "sentencepiece" else None
        if name == "toxicity":
            sure, may = _kept_by_classifier(rows, models[0])
            assert sure <= got <= may and sum(sure.values()) < len(rows)
        elif name == "line_dedup":
            assert got == _line_dedup(rows, hashes)
        elif name == "ngram_join":
            words = [r for r in rows if (r.text or "").encode().split()]
            bare = Counter((r.doc_id, r.text) for r in rows if not (r.text or "").encode().split())
            assert Counter((r.doc_id, r.text) for r in out) == _one_of_each(words, hashes) + bare
            assert got <= Counter(r[:] for r in rows)
        elif name == "mixing":
            assert got == _mixed(rows) and max(got.values()) > 1
        else:
            lat = sentencepiece_nbest.load()
            assert Counter((r.doc_id, lat.decode(np.array(r.ids, dtype="<i4").tobytes())) for r in out) == Counter((r.doc_id, r.text or "") for r in rows)
