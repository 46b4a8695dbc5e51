"""The n-gram join's entries and pairs, on rows built here."""

from __future__ import annotations

import random

import numpy as np
import pytest

from dwell.llm import ngram_join


def family(rng, size, words=90):
    """Copies of one text of which some have every few words changed, so that part of the pairs link."""
    base = [f"b{i}" for i in range(words)]
    return [" ".join(w if rng.random() > rng.choice([0.0, 0.01, 0.03, 0.06]) else f"x{rng.random()}" for w in base) for _ in range(size)]


def brute(texts):
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    comp = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 75 * len(x | y) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return comp


def test_ngram_pairs_are_whole_beyond_the_heads(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAD", 2)
    rng = random.Random(2)
    texts = family(rng, 60) + family(rng, 30, 40)
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == brute(texts)


def test_one_ngram_stands_for_those_of_the_same_groups(spark, monkeypatch):
    """Two texts with one long passage meet at one n-gram, not at each of the passage."""
    seen, write = {}, ngram_join.write_table
    monkeypatch.setattr(ngram_join, "write_table", lambda df, name: seen.setdefault(name, []).append(t := write(df, name)) or t)
    kept = []
    monkeypatch.setattr(ngram_join, "discard", kept.append)
    passage = " ".join(f"p{i}" for i in range(300))
    texts = [passage + "".join(f" {c}{i}" for i in range(300)) for c in "ab"]
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in got) == [0, 1]
    held = seen["ngram-shared"][0]
    assert held.count() > 10
    assert seen["ngram-met"][0].count() == 2 and {r.w for r in seen["ngram-met"][0].collect()} == {held.count()}


def tables(monkeypatch):
    """name -> the tables written under it, which stay."""
    seen, write = {}, ngram_join.write_table
    monkeypatch.setattr(ngram_join, "write_table", lambda df, name: seen.setdefault(name, []).append(t := write(df, name)) or t)
    monkeypatch.setattr(ngram_join, "discard", lambda df: None)
    return seen


def test_a_long_passage_forms_its_pairs_once(spark, monkeypatch):
    """Texts that each share rarer n-grams of their own with others: the first 16 don't tell where a pair begins."""
    seen = tables(monkeypatch)
    passage = " ".join(f"p{i}" for i in range(120))
    own = [" ".join(f"o{i}w{j}" for j in range(60)) for i in range(3)]
    ends = [" ".join(f"e{i}w{j}" for j in range(40)) for i in range(6)]
    odd = [" ".join(passage.split()[: 20 * i + 20]) for i in range(6)]  # so that no two n-grams' groups are the same
    texts = [f"{passage} {own[i % 3]} {ends[i]}" for i in range(6)] + [f"{x} {own[i % 3]}" for i, x in enumerate(odd)]
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == brute(texts)
    formed = ngram_join._formed(seen["ngram-sides"][0], 75).select("g1", "g2")
    assert formed.count() == formed.distinct().count() > 0


def test_large_unlike_sets_are_not_read_again(spark, monkeypatch):
    """Half of their n-grams are the same: 512 parities can't tell, those of a larger sketch can."""
    seen = tables(monkeypatch)
    texts = [" ".join([f"p{i}" for i in range(1500)] + [f"{c}{i}" for i in range(700)]) for c in "abc"]
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in got) == [0, 1, 2]
    assert [t.count() for t in seen["ngram-texts"]] == [0, 0]


@pytest.mark.parametrize("percent", [75, 30])
def test_sketches_of_any_sizes_never_rule_out_a_link(spark, percent):
    rng = np.random.default_rng(percent)
    rows, links = [], []
    for _ in range(120):
        n = int(rng.integers(1, 3000))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        share = int(n * rng.uniform(0.25, 1))
        b = np.concatenate([a[:share], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 4)), dtype=np.uint64)])
        if rng.random() < 0.5:
            a, b = b, a
        if not len(a) or not len(b):
            continue
        both = len(np.intersect1d(a, b))
        links.append(100 * both >= percent * (len(a) + len(b) - both))
        rows.append((len(rows), len(a), len(b), ngram_join.sketch(a).tolist(), ngram_join.sketch(b).tolist()))
    df = spark.createDataFrame(rows, "i long, n1 int, n2 int, sk1 array<long>, sk2 array<long>")
    close = {r.i: r.c for r in df.select("i", ngram_join._close("1", "2", percent).alias("c")).collect()}
    assert any(links) and all(close[i] for i, x in enumerate(links) if x)
    if percent == 75:
        assert sum(not close[i] for i, x in enumerate(links) if not x) > 0.5 * (len(links) - sum(links))
