"""Language identification, ranked search and conversation repair against brute force and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.llm import conversation_repair as CR
from dwell.llm import language_id as LI
from dwell.llm import lexical_search as LS

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, _id string, row string, _text string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def odd_docs(spark):
    rows = [
        (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, LONG, "en"), (5, LONG, None), (6, "one two", "en"), (6, "one two", None),
        (None, "three four five", "de"), (7, "12 34 ½ ²", "en"), (8, "ünï ▁ cöde \U0001f600 \x00", "xx"), (9, "日本語", "en"), (-4, "one ONE one", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", "clash", "clash", "clash") for i, t, lang in rows], DOC)


# --- language identification ----------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    out = LI.op11_language_id(spark, MID).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() >= 0.98
    assert out.score.between(0, 1).all() and set(out.lang_pred) <= {"en", "de", "fr", "es"}


def test_language_of_mixed_documents(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = LI.train(docs, F.lit(True))
    by = {lang: [r.text for r in docs.where(F.col("lang") == lang).where("length(text) > 2000").limit(12).collect()] for lang in ("en", "de", "fr")}
    rng, rows = random.Random(5), []
    for i in range(30):
        a, b = rng.sample(["en", "de", "fr"], 2)
        words = (rng.choice(by[a]).split()[:300], rng.choice(by[b]).split()[:100])
        rows.append((i, " ".join(words[0] + words[1]), a, b))
    out = LI.identify(spark.createDataFrame(rows, "doc_id long, text string, a string, b string"), model).collect()
    assert sum(r.lang_pred == r.row.a for r in out) >= 29
    both = [r for r in out if set(r.langs) == {r.row.a, r.row.b}]
    assert len(both) >= 26 and all(abs(r.shares[0] - 0.75) < 0.15 for r in both)
    assert all(r.n_langs == len(r.langs) and r.score == r.shares[0] for r in out)


def test_em_finds_the_maximum():
    """Proportions of two languages against a fine grid, and the set by its penalised likelihood."""
    rng = np.random.default_rng(1)
    model = LI.Model(["a", "b"], np.zeros((3, 1, 2)))
    for share in (0.5, 0.3, 0.0):
        like = np.where(rng.random((400, 1)) < share, [[-9.0, -3.0]], [[-3.0, -9.0]]) + rng.normal(0, 1, (400, 2))
        got, n = LI.infer(model, like, np.zeros(400, dtype=np.int64), 1)
        rel = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), LI.FLOOR))
        grid = np.linspace(0, 1, 2001)
        value = np.array([np.log(rel[:, 0] * (1 - g) + rel[:, 1] * g).sum() for g in grid])
        two = value.max() - max(value[0], value[-1]) > LI.PENALTY * math.log(401)
        assert n[0] == 1 + two
        assert abs(got[0][1] - (grid[value.argmax()] if two else grid[[0, -1]][value[[0, -1]].argmax()])) < 0.02


def test_language_edges(spark):
    docs = odd_docs(spark)
    model = LI.train(docs, F.lit(True))
    assert model.langs == ["de", "en", "xx"]
    out = LI.identify(docs, model).collect()
    und = {1, 2, 3, 7}
    assert len(out) == 12
    assert all((r.lang_pred == "und" and r.score == 0.0 and r.langs == []) == (r.row.doc_id in und) for r in out)
    assert {r.lang_pred for r in out if r.row.doc_id == 6} == {"en"} and all(r.row.row == "clash" for r in out)
    none = LI.train(docs, F.lit(False))
    assert {(r.lang_pred, r.score) for r in LI.identify(docs, none).collect()} == {("und", 0.0)}
    empty = spark.createDataFrame([], DOC)
    assert LI.identify(empty, model).count() == 0 and LI.train(empty, F.lit(True)).langs == []
    one = LI.train(docs.where("lang = 'de'"), F.lit(True))
    assert {r.lang_pred for r in LI.identify(docs, one).collect()} == {"de", "und"}


# --- ranked search -----------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        hits = []
        for i, b, n in bags:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(TERM.findall(text.translate(LOWER))) if t in b)
            if s > 0:
                hits.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("terms,k", [(40, 10), (200, 3)])
def test_search_equals_brute_force(spark, monkeypatch, terms, k):
    """Items of more than 64 terms as well, many copies and ties, several blocks of items."""
    monkeypatch.setattr(LS, "ITEM_ROWS", 4)
    rng = random.Random(terms)
    words = [f"t{i}" for i in range(terms)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)] + [(7, docs[7][1]), (None, docs[8][1])]
    items = [(i, " ".join(rng.sample(words, rng.randrange(1, terms)))) for i in range(9)] + [(3, "t1, T2; é"), (3, "t1, T2; é"), (None, "t5"), (12, "none of these"), (13, None)]
    got = LS.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=repr) == brute_search(docs, items, k)


def test_search_leaves_masks_out():
    """The masks are evaluated in descending order of their maximum, and not all of them."""
    rng = random.Random(3)
    vocab, size = 30, 4000
    ids, tfs, n = [], [], []
    for _ in range(size):
        own = sorted(rng.sample(range(vocab), rng.randrange(1, 12)))
        ids.append(np.array(own, dtype=np.uint32).tobytes())
        tfs.append(np.array([rng.randrange(1, 4) for _ in own], dtype=np.uint32).tobytes())
        n.append(len(own) + 20)
    s = LS.Searcher([np.arange(vocab)], np.arange(100, 100 + vocab, dtype=np.int64), size, sum(n), 10)
    s.block(np.arange(size), n, ids, tfs)
    assert 10 <= s.scored < s.groups / 4 and len(s.best[0]) == 10


def test_search_edges(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "one TWO", "x"), (2, "日本語 cöde", "x"), (3, "", "x"), (4, None, "x"), (5, "w1x1 " * 5000, "x")], "item_id long, text string, doc_id string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in LS.search(docs, items).collect()), key=repr)
    assert got == brute_search(rows, [(r.item_id, r.text) for r in items.collect()], 10)
    assert LS.search(spark.createDataFrame([], DOC), items).count() == 0
    assert LS.search(docs, items.limit(0)).count() == 0
    assert LS.terms("Ünï-Cöde_ß9\x7fA\x00b".encode()) == ["Ünï".encode(), "cöde".encode(), "ß9".encode(), b"a", b"b"]


# --- conversation repair ---------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """rows: (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        last = WORDS.findall(text)[-1:]
        out.append("b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every choice of edits, with up to two inserts in each gap; a longer run of inserts only costs more."""
    found, best = faults(rows), None
    gaps = ["", "u", "a", "ua", "au"]
    per_row = [["D"] if f in ("b", "d") else ["D", "K", "u", "a"] for f in found]
    for edits in itertools.product(*per_row):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            roles = audit = ""
            cost, lines = 0, []
            for g, choice in enumerate([*edits, None]):
                for r in ins[g]:
                    roles, audit, cost = roles + r, audit + "I", cost + 3
                    lines.append(("user" if r == "u" else "assistant") + ":")
                if choice is None:
                    continue
                _, role, text = rows[g]
                if choice == "D":
                    audit, cost = audit + "D", cost + 4
                    continue
                cost += 3 * (found[g] == "t")
                if choice == "K":
                    roles, audit = roles + (role[:1] or "?"), audit + "K"
                    lines.append(f"{role}:{text}")
                else:
                    roles, audit, cost = roles + choice, audit + "R", cost + 3
                    lines.append(("user" if choice == "u" else "assistant") + f":{text}")
            if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def dp(rows):
    """The least (cost, audit) by an ordinary DP over pairs, for conversations too long to enumerate."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    keep = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def inserts(v):
        for _ in range(3):
            v = {s: min([v[s]] + ([(v[step[s]][0] + 3, "I" + v[step[s]][1])] if step[s] in v else [])) if s in v else (v[step[s]][0] + 3, "I" + v[step[s]][1]) for s in step if s in v or step[s] in v}
        return v

    v = inserts({"": (0, ""), "a": (0, "")})
    for (_, role, _), f in reversed(list(zip(rows, faults(rows), strict=True))):
        own = {}
        for s in step:
            opts = [(v[s][0] + 4, "D" + v[s][1])] if s in v else []
            if f not in ("b", "d"):
                add = 3 * (f == "t")
                if (s, role[:1]) in keep and role[:1] in v:
                    opts.append((v[role[:1]][0] + add, "K" + v[role[:1]][1]))
                if step[s] in v:
                    opts.append((v[step[s]][0] + 3 + add, "R" + v[step[s]][1]))
            if opts:
                own[s] = min(opts)
        v = inserts(own)
    return v[""]


def damage(rows):
    """rows: (conv, turn, role, text) -> conversation -> its rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out.setdefault(conv, [])
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out[conv] += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest())) for c, r in out.items()}


def report(rows):
    turns = [t for t, _, _ in rows if t is not None]
    roles = [r[:1] for _, r, _ in rows]
    f = Counter(faults(rows))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f["b"], f["d"], f["t"], illegal)


def test_repair_equals_enumeration(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(130):
        for _ in range(rng.randrange(1, 4)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 5]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["a.", "b", " ", None, "c!", "a. \n"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    applied = CR._apply(CR.damaged(df), CR.reports(CR.damaged(df))[0])
    got = {r.conv_id: r for r in CR.digests(applied).collect()}
    convs = damage(rows)
    assert set(got) == set(convs)
    for c, own in convs.items():
        cost, audit, lines = cheapest(own) if len(own) <= 3 else (*dp(own), None)
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == report(own)
        assert (r.cost, r.audit) == (cost, audit)
        if lines is not None:
            assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("block_rows,block_turns", [(3, 5), (512, 4096)])
def test_long_conversations_in_blocks(spark, block_rows, block_turns):
    """One conversation holds most rows; cut into small blocks or one, the audit is the same."""
    rng = random.Random(12)
    rows = [(1, t // 2 if t % 3 else t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", "c!", "d?", f"x{t}."])) for t in range(260)]
    rows += [(2, None, "user", "same.")] * 40 + [(2, 7, "assistant", "same.")] * 30 + [(None, 1, "user", "hi."), (None, 2, "assistant", "ho.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clean = CR.untouched(df)
    got = {r.conv: r for r in CR.reports(clean, block_rows, block_turns)[0].collect()}
    for c in (1, 2, None):
        own = sorted(((t, r, x) for i, t, r, x in rows if i == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == report(own)
        assert (r.cost, r.audit) == dp(own)
    out = CR.repair(clean).where("conv_id IS NULL").orderBy("pos").collect()
    assert [(r.pos, r.edit, r.turn, r.role, r.text) for r in out] == [(1, "K", 1, "user", "hi."), (2, "K", 2, "assistant", "ho.")]


def test_weights_order_paths():
    """Integers order paths as (cost, audit) pairs do, whatever the lengths."""
    w = CR.Weights(9)
    rng = random.Random(2)
    paths = []
    for _ in range(300):
        x, cost, audit = 0, 0, ""
        for _ in range(rng.randrange(9)):
            letter, c = rng.choice("DIKR"), rng.randrange(3)
            x, cost, audit = w.put(letter, c, x), cost + c, letter + audit
        assert w.read(x) == (cost, audit) and w.join(cost, audit, 0) == x
        paths.append((x, cost, audit))
    assert [p[1:] for p in sorted(paths)] == sorted(p[1:] for p in paths)


def test_repair_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert CR.reports(CR.damaged(empty))[0].count() == 0 and CR.repair(CR.damaged(empty)).count() == 0
    long = spark.createDataFrame([(1, 0, "user", LONG + "."), (1, 1, "assistant", LONG), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    out = CR.repair(CR.untouched(long)).orderBy("conv_id", "pos").collect()
    assert [(r.conv_id, r.edit, r.role, len(r.text)) for r in out] == [(1, "K", "user", len(LONG) + 1), (1, "K", "assistant", len(LONG))]
    got = {r.conv: r for r in CR.reports(CR.untouched(long))[0].collect()}
    assert (got[2].cost, got[2].audit, got[2].blank, got[2].gaps) == (4, "D", 1, 0) and got[1].truncated == 1
