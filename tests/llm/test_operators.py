"""The dealt operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import heapq
import math
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.llm import embed_dedup, line_dedup, mixing, ngram_join, sentencepiece_nbest, substring_dedup, token_files, topk_search, toxicity, url_filter
from dwell.llm.common import connected_components
from dwell.session import scratch_path

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, _id string, row string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, one id with two texts, clashing names."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, LONG, "en", "a", len(LONG)),
        (5, LONG, None, "a", len(LONG)), (6, "one two", "en", None, 7), (6, "one two", "en", None, 7), (None, "three four five six seven", "de", "b", 1),
        (7, "a\nb\nc\nd", "en", "b", 7), (7, "x\ny\nz\nd", "en", "b", 7), (8, "a\nb\nc\ne", "en", "b", 7), (9, "ünï \u2581 cöde \U0001f600 \x00", "xx", "b", 3),
    ]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOC)


def no_docs(spark):
    return spark.createDataFrame([], DOC)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(i, i + 1) for i in range(400, 460)] + [(500, 600 + i) for i in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got}
    assert {x for e in edges if e[0] != e[1] for x in e} == set(got)


# --- url filter -------------------------------------------------------------


def test_url_filter_rules_and_edges(spark):
    urls = [None, "", "no scheme", "http://com/x", "https://WWW.Example.COM/en/1?q=/", "http://example.com/en/a#b", "http://a.net/fr/", "http://a.net/fr",
            "ftp://x.example.com/en", "http://notexample.com/en/", "http://net", "http://example.com?/en/", "http://a.b://c/d", "http://x.org/" + "a/" * 3000]
    rows = [(i % 9, u, "clash") for i, u in enumerate(urls)] + [(None, urls[4], None), (None, urls[4], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect())

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        top = max(fits, default=(0, None, "allow"))
        return host, path, top[1], top[2]

    assert got == sorted((str(i), *want(u)) for i, u, _ in rows)
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_filter_general_rules(spark):
    rules = [("block", "b.com", "/x"), ("allow", "b.com", "/xy/z"), ("block", "a.b.com", ""), ("block", "c.com", "/p/q/"), ("allow", "c.com", "/p/q/")]
    df = spark.createDataFrame([(1, "http://a.b.com/xy/zz"), (2, "http://b.com/xy/zz"), (3, "http://b.com/y"), (4, "http://q.a.b.com"), (5, "http://c.com/p/q/r")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {1: ("b.com/xy/z", "allow"), 2: ("b.com/xy/z", "allow"), 3: (None, "allow"), 4: ("a.b.com", "block"), 5: ("c.com/p/q/", "block")}


# --- mixing -----------------------------------------------------------------


def test_mixing_meets_margins_and_edges(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = mixing.mix(docs, {"source": 0.5, "lang": {"en": 0.4, "de": 0.2, "fr": 0.3, "es": 0.1}, "topic": 0.8}, sweeps=20).toPandas()
    tot = (rows.n_tokens * rows.weight).sum()
    share = (rows.n_tokens * rows.weight).groupby(rows.lang).sum() / tot
    assert abs(tot / rows.n_tokens.sum() - 1) < 1e-6
    assert all(abs(share[k] - v) < 1e-4 for k, v in {"en": 0.4, "de": 0.2, "fr": 0.3, "es": 0.1}.items())
    assert ((rows.prob - np.minimum(1, rows.weight * mixing.KEEP_FRACTION)).abs() < 1e-8).all()
    assert abs(rows.sampled.mean() - rows.prob.mean()) < 0.05
    odd = mixing.mix(odd_docs(spark), carry=True).toPandas()
    assert len(odd) == 12 and odd.weight.notna().all() and odd[odd.n_tokens == 0].sampled.all()
    assert odd.n_tokens.sum() == sum(len((r.text or "").encode().split()) for r in odd_docs(spark).collect())
    assert mixing.mix(no_docs(spark)).count() == 0


def test_mixing_sample_meets_the_margins(spark):
    """With default parameters the expected sample's shares are the targets, rows that ask for more than one place included."""
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = mixing.mix(docs).toPandas()
    times = np.where(rows.n_tokens > 0, rows.weight * mixing.KEEP_FRACTION, 1.0)
    assert ((rows.copies - times).abs() < 1).all() and (times > 1).any()
    for dim, power in mixing.TARGETS.items():
        want = rows.n_tokens.groupby(rows[dim]).sum() / rows.n_tokens.sum()
        want = want**power / (want**power).sum()
        got = (rows.n_tokens * times).groupby(rows[dim]).sum() / (rows.n_tokens * times).sum()
        assert (got - want).abs().max() < 1e-6


def test_mixing_rakes_until_the_margins_are_met(spark):
    n = {("a", "en"): 900, ("a", "de"): 1, ("b", "en"): 1, ("b", "de"): 100}  # source all but gives the language: 2 % off after 10 sweeps
    rows = [(s, l, "word " * k) for (s, l), k in n.items()]
    out = mixing.mix(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, text string")).toPandas()
    for dim, power in (("source", 0.5), ("lang", 0.7)):
        want = out.n_tokens.groupby(out[dim]).sum() / 1002
        want = want**power / (want**power).sum()
        got = (out.n_tokens * out.weight).groupby(out[dim]).sum() / 1002
        assert ((got - want).abs() < 1e-5).all()


# --- top-k ------------------------------------------------------------------


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_equals_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    vecs = [(int(i), [float(x) for x in rng.integers(-2, 3, 4) / 7 * scale]) for i in range(300)]
    vecs += [(i, [0.5 * scale] * 4) for i in range(300, 500)]  # ties
    odd = [(1000, None), (1100, []), (1200, [float("nan")] * 4), (1300, [1.0, None, 1.0, 1.0]), (1400, [1.0, 2.0]), (None, [1.0] * 4), (200, [1.0] * 4)]
    df = spark.createDataFrame(vecs + odd, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk_search.top_k(df.where("vec_id % 100 = 0"), df, block_rows=3).select("query_id", "rank", "vec_id", "score").collect()]
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in vecs + [(1400, [1.0, 2.0]), (200, [1.0] * 4)]]
    want = []
    for qi, q in good:
        if qi % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in good if i != qi and len(v) == len(q))[:10]
            want += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert sorted(got) == sorted(want)
    assert topk_search.top_k(df.limit(0), df).count() == 0 and topk_search.top_k(df, df.limit(0)).count() == 0


# --- embedding near duplicates ----------------------------------------------


def brute_links(vecs, t=0.9):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in vecs if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    m = np.stack([v / math.sqrt((v * v).sum()) for _, v in good])
    s = m @ m.T
    return {(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(s >= t)) if a < b}


def test_embedding_near_duplicates(spark):
    df = spark.read.parquet(f"{MID}/embeddings.parquet").select("vec_id", "embedding")
    links = brute_links([tuple(r) for r in df.collect()])
    got = {r.vec_id: r for r in embed_dedup.embedding_near_duplicates(df, block_rows=16).collect()}
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.9 * len(links) <= found <= len(links)
    comp = brute_components(got, links)
    assert sum(comp[i] == r.component_id for i, r in got.items()) >= 0.97 * len(got)
    assert all(find(comp, r.component_id) == comp[i] for i, r in got.items())  # never joins what brute force keeps apart
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_embedding_recall_on_planted_links(spark):
    """Families of near copies around random vectors, cosines on both sides of the threshold."""
    rng = np.random.default_rng(17)
    rows = []
    for _ in range(150):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 9)):
            v = base + rng.standard_normal(32) * rng.choice([0.1, 0.3, 0.4])
            rows.append((len(rows), [float(x) for x in v * 10.0 ** rng.integers(-3, 4)]))
    links = brute_links(rows)
    assert len(links) > 400
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.embedding_near_duplicates(df, block_rows=16).collect()}
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.95 * len(links) <= found <= len(links)
    comp = brute_components(got, links)
    assert sum(comp[i] == r.component_id for i, r in got.items()) >= 0.95 * len(got)


def test_embedding_extreme_norms(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 1.0]), (4, [2e200, 1.0]), (5, [1e308, 1e308]), (6, [1e-308, 1e-308]), (7, [0.0, 5e-324])]
    out = embed_dedup.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [None, 1.0]), (9, [])]
    out = embed_dedup.embedding_near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, n long"))
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in out.collect())
    want = [("1", 2, 1, True), ("2", 2, 1, False), ("3", 2, 1, False), ("3", 0, 1, False), ("4", 0, 4, True), ("5", 0, 5, True), ("6", 0, 6, True), ("7", 0, 7, True), ("8", 0, 8, True), ("9", 0, 9, True), ("None", 0, None, True)]
    assert got == sorted(want)
    assert embed_dedup.embedding_near_duplicates(out.select("vec_id", F.lit(None).cast("array<float>").alias("embedding")).limit(0)).count() == 0


# --- token files --------------------------------------------------------------


def test_encoder_takes_many_pieces_in_one_text():
    """New pieces are encoded together, and their ids parted at the space that leads each;
    where the vocabulary doesn't show it, one by one."""
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer_path()
    words = [f"w{chr(97 + i % 26)}{i}x" for i in range(300)] + ["Ġ", "'s", "é'", "Ñandú", "日本", "a\u0301", "x;y", "end.", "(a)", "’t", "🙂"]
    text = " ".join(words) + "\nnext line"
    want = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids).tolist()

    class Counted:
        def __init__(self, tok):
            self.tok, self.n = tok, 0

        def encode_batch_fast(self, texts, **kw):
            self.n += len(texts)
            return self.tok.encode_batch_fast(texts, **kw)

    for blind in (False, True):
        enc = token_files.Encoder(path)
        enc._tok = Counted(enc._tok)
        if blind:
            enc._spaced[:] = False
        assert np.frombuffer(enc.encode([text])[0], dtype=enc.dtype).tolist() == want
        assert (enc._tok.n > 300) if blind else (enc._tok.n < 30)


def test_encoder_equals_one_call():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer_path())
    enc = token_files.Encoder(token_files.default_tokenizer_path(), cache_items=20)
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "1", "é", "ß", "\u00a0", "\u3000", "中", "!", "...", "\t", "\x00", "\u200b", "😀", "'"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(800)] + [LONG, " ", "a <|endoftext|> b", "x" * 5000]
    # texts that are cut: lone spaces and newlines only, words with punctuation behind and in them
    words = ["foo", "foo,", "Foo.", "don't", "'s", "été,%%%", "a-b", "--", "x_1.", "9,", "中.", "ß'!", "²", "y" * 70 + "."]
    texts += ["".join(w + rng.choice(" \n") for w in rng.choices(words, k=rng.randrange(1, 30))).strip() for _ in range(300)]
    for i in range(0, len(texts), 7):
        for t, b in zip(texts[i : i + 7], enc.encode(texts[i : i + 7]), strict=True):
            assert np.frombuffer(b, dtype=enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer_path())
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd_docs(spark)):
        folder = scratch_path(spark, "tok-test")
        parts = token_files.write_token_files(docs, folder)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(parts, folder).collect())
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
        start = 0
        for (_, i, t), g in zip(rows, got, strict=True):
            ids = tok.encode(t, add_special_tokens=False).ids + [0]
            assert g == (start, i if g[1] is not None else None, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
            start += len(ids)
    assert token_files.write_token_files(no_docs(spark), scratch_path(spark, "tok-test")).count() == 0


# --- line dedup ---------------------------------------------------------------


def brute_lines(rows, size=3):
    """rows: (id, text hash, text), null ids as the smallest."""
    first = {}
    for i, h, t in sorted(set(rows), key=lambda r: r[:2]):
        ls = (t or "").split("\n")
        for p in range(len(ls) - size + 1):
            if any(x.strip(" \t\n\r\x0b\f") for x in ls[p : p + size]):
                first.setdefault(tuple(ls[p : p + size]), (i, h, p))
    out = {}
    for i, h, t in rows:
        ls = (t or "").split("\n")
        gone = {p + k for p in range(len(ls) - size + 1) for k in range(size) if first.get(tuple(ls[p : p + size]), (i, h, p)) != (i, h, p)}
        out[i, h] = (t if not gone else "\n".join(x for p, x in enumerate(ls) if p not in gone), len(gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.randrange(12)))) for i in range(120)]
    for df in (spark.createDataFrame(docs, "doc_id long, text string"), odd_docs(spark)):
        keyed = df.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.xxhash64("text").alias("h"), "text")
        want = brute_lines([tuple(r) for r in keyed.collect()])
        got = line_dedup.dedup_lines(df).select(F.coalesce("row.doc_id", F.lit(-(2**63))).alias("i"), F.xxhash64("row.text").alias("h"), "text", "n_removed").collect()
        assert len(got) == df.count()
        assert all(want[r.i, r.h] == (r.text, r.n_removed) for r in got)
    assert line_dedup.dedup_lines(no_docs(spark)).count() == 0


# --- toxicity -----------------------------------------------------------------


def test_toxicity_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.score(docs.select("doc_id", "text", "lang"), toxicity.train(toxicity.training_rows(docs, labels, ~toxicity.held_out("doc_id"))))
    r = out.select("row", "score").join(labels, F.col("row.doc_id") == labels.doc_id).where(toxicity.held_out("row.doc_id")).select("score", F.col("toxic").alias("y")).toPandas()
    hit = r.score >= 0.3
    assert (hit & (r.y == 1)).sum() >= 0.8 * (r.y == 1).sum()
    assert (hit & (r.y == 1)).sum() >= 0.85 * hit.sum()


def test_toxicity_edges(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, none, F.lit(True))
    assert rows == [] and {r.score for r in toxicity.score(docs, toxicity.train(rows)).collect()} == {0.0}
    labels = spark.createDataFrame([(4, 1), (6, 0), (6, 0), (7, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(docs, labels, F.lit(True)))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs(spark), model).count() == 0
    one = toxicity.train([(np.zeros((1, toxicity.SUBWORDS), np.int32), 0, None)])
    assert one.score(np.zeros((0, toxicity.SUBWORDS), np.int32)) == 0.0


# --- sentencepiece ------------------------------------------------------------


def brute_segmentations(lat, s):
    out = []

    def go(i, score, enc):
        if i == len(s):
            out.append((score, enc))
            return
        for j in range(i + 1, len(s) + 1):
            sc = lat.score.get(s[i:j])
            if sc is not None or j == i + 1:
                go(j, score + (lat.unknown if sc is None else sc), enc + lat._pack([s[i:j]]))

    go(0, 0.0, b"")
    return heapq.nlargest(lat.n, out, key=lambda r: r[0])


def test_n_best_equals_brute_force():
    rng = random.Random(4)
    sp = sentencepiece_nbest.SPACE
    for _ in range(300):
        pieces = {sp: (900, -20.0), sp + sp: (901, -25.0)}
        for k in range(14):
            w = (sp if rng.random() < 0.4 else "") + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
            pieces.setdefault(w, (k, -float(rng.randrange(1, 30))))
        lat = sentencepiece_nbest.Lattice(pieces, list(range(1000, 1256)), 4)
        text = "".join(rng.choice("abc  x") for _ in range(rng.randrange(1, 10)))
        got = lat.n_best(text)
        assert [g[0] for g in got] == [w[0] for w in brute_segmentations(lat, sp + text.replace(" ", sp))]
        assert len({g[1] for g in got}) == len(got) and all(lat.decode(g[1]) == text for g in got)


def test_sentencepiece_round_trip(spark):
    import sentencepiece

    lat = sentencepiece_nbest.load()
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_nbest.default_model_path())
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + ["", " ", "  a  b ", "\t\n", "é😀\u2581x", LONG, "a" * 3000, "\u2581", " \u2581 "]
    for t in texts:
        best = lat.n_best(t)
        assert all(lat.decode(e) == t for _, e in best)
        assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)
        if "\u2581" not in t:
            assert lib.decode(np.frombuffer(best[0][1], dtype="<i4").tolist()) == t
    out = sentencepiece_nbest.encode(odd_docs(spark)).collect()
    assert len(out) == 12 and all(r.decoded == (r.row.text or "") and len(r.nbest_ids) == len(r.scores) and r.nbest_ids[0] == r.ids for r in out)
    assert sentencepiece_nbest.encode(no_docs(spark)).count() == 0
    assert all(r.round_trip for r in sentencepiece_nbest.summarize(odd_docs(spark)).collect())


# --- substring dedup ------------------------------------------------------------


def brute_substrings(rows, k):
    first, out = {}, {}
    for i, h, t in sorted(set(rows), key=lambda r: r[:2]):
        w = (t or "").encode().split()
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), (i, h, p))
    for i, h, t in rows:
        w = (t or "").encode().split()
        gone = {p + x for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] != (i, h, p) for x in range(k)}
        out[i, h] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


@pytest.mark.parametrize("k,m", [(20, 6), (6, 3)])
def test_substring_dedup(spark, k, m):
    rng = random.Random(k)
    parts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(5)))) for i in range(90)] + [(200, "a " * 300), (201, "a b " * 200)]
    for df in (spark.createDataFrame(docs, "doc_id long, text string"), odd_docs(spark)):
        keyed = df.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.xxhash64("text").alias("h"), "text")
        want = brute_substrings([tuple(r) for r in keyed.collect()], k)
        got = substring_dedup.dedup_substrings(df, k, m).select(F.coalesce("row.doc_id", F.lit(-(2**63))).alias("i"), F.xxhash64("row.text").alias("h"), "text", "n_words", "n_removed").collect()
        assert len(got) == df.count()
        assert all(want[r.i, r.h] == (r.n_words, r.n_removed, r.text) for r in got)
    assert substring_dedup.dedup_substrings(no_docs(spark), k, m).count() == 0


# --- n-gram join ----------------------------------------------------------------


def grams(t, n=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_near(rows, percent=75):
    sets = [(i, grams(t)) for i, t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and sets[b][1] and 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1])]
    comp = brute_components(range(len(sets)), links)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[comp[k]] = min(least.get(comp[k], i), i)
    return sorted((i, len(s), least[comp[k]]) for k, (i, s) in enumerate(sets))


def test_ngram_join(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 3)
    rng = random.Random(9)
    passage = " ".join(rng.choice("abcdefghij") for _ in range(50))
    rows = []
    for f in range(14):
        base = [rng.choice("klmnopqrstuvwxyz") + rng.choice("abcdef") for _ in range(rng.randrange(4, 90))]
        for _ in range(rng.randrange(1, 9)):
            w = base.copy()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice("KLMN")
            rows.append((len(rows), " ".join(w) + (" " + passage if f % 3 == 0 else "")))
    rng.shuffle(rows)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_near(rows)


def test_ngram_join_edges(spark):
    got = ngram_join.near_duplicates(odd_docs(spark)).collect()
    want = brute_near([(-1 if r.doc_id is None else r.doc_id, r.text) for r in odd_docs(spark).collect()])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert ngram_join.near_duplicates(no_docs(spark)).count() == 0
