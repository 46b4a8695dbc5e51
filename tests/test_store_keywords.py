"""Label store and keyword-learning vectors."""

import datetime as dt

from pyspark.sql import functions as F

from dwell.operators import keywords as K
from dwell.operators import labels as L
from dwell.streaming.keywords import CappedIndex


def test_valid_events(spark):
    ev = spark.createDataFrame([(1, 10.0, 12.5), (2, 10.0, None), (3, 10.0, 9.0), (4, 5.0, 5.0)], "id long, start_ts double, end_ts double")
    assert sorted(r.id for r in L.valid_events(ev).collect()) == [1, 4]


def test_upsert_latest_wins(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [(1, "rules-v1", "work", 0.7, None, '{"source":"engine"}', t, 1),
         (1, "rules-v1", "focus", 0.95, "r1", '{"source":"override-pass"}', t, 2)],
        "event_id long, engine_version string, category_id string, confidence double, rule_id string, meta_json string, created_at timestamp_ntz, seq long",
    )
    rows = L.latest_classification(log).collect()
    assert len(rows) == 1 and rows[0].category_id == "focus" and rows[0].meta_json == '{"source":"override-pass"}'


def test_override_set_twice_then_clear(spark):
    ops = spark.createDataFrame(
        [(1, "set", "focus", None, 1), (1, "set", "deep-work", "adjusted", 2)], "event_id long, op string, category_id string, note string, seq long"
    )
    r = L.current_overrides(ops).collect()
    assert [(x.category_id, x.note) for x in r] == [("deep-work", "adjusted")]
    cleared = ops.unionByName(spark.createDataFrame([(1, "clear", None, None, 3)], ops.schema))
    assert L.current_overrides(cleared).count() == 0


def test_sequential_ids_dense(spark):
    df = spark.range(0, 500).select(((F.col("id") * 37) % 500).alias("x"))
    out = L.sequential_ids(df, ["x"], num_partitions=7).collect()
    assert sorted((r.x, r.id) for r in out) == [(i, i + 1) for i in range(500)]


def _hits(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [("ctx", t0 + dt.timedelta(seconds=s), i, "Cat", kw) for i, (s, kw) in enumerate(rows)],
        "context_key string, ts timestamp_ntz, seq long, category string, matched_keyword string",
    )


def test_keyword_sessions(spark):
    def news(rows):
        out = K.keyword_sessions(_hits(spark, rows), reset_seconds=120).orderBy("seq").collect()
        return [r.is_new for r in out]

    assert news([(0, "a"), (119, "a"), (238, "a")]) == [True, False, False]
    assert news([(0, "a"), (120, "a")]) == [True, True]
    assert news([(0, "a"), (10, "b"), (20, "a")]) == [True, True, True]
    counts = K.keyword_counts(K.keyword_sessions(_hits(spark, [(0, "a"), (10, "b"), (20, "a")]), 120)).collect()
    assert {r.keyword: r["count"] for r in counts} == {"a": 2, "b": 1}
    # same context and keyword twice at once -> stored count 1 -> 2 in the reference; here one session
    assert news([(0, "a"), (0, "a")]) == [True, False]


def test_capped_replacement():
    def after(entries, words):
        index = CappedIndex(entries, 3)
        for w in words:
            index.add(w)
        return index.entries()

    assert after([["a", 3], ["b", 1], ["c", 1]], ["d"]) == [["a", 3], ["d", 1], ["c", 1]]
    assert after([["a", 1]], ["a", " B ", None, ""]) == [["a", 2], ["b", 1]]
    # equal counts: the first position; a replaced word starts over
    assert after([], ["a", "b", "c", "c", "d", "a", "b"]) == [["a", 1], ["b", 2], ["c", 2]]


def test_top_k_ties(spark):
    t = dt.datetime(2024, 1, 1)
    counts = spark.createDataFrame(
        [("C", "x", 5, t), ("C", "y", 5, t - dt.timedelta(days=1)), ("C", "z", 1, t), ("D", "w", 1, t)],
        "category string, keyword string, count long, first_seen timestamp_ntz",
    )
    out = K.keyword_top_k(counts, k=2, salt_buckets=3).orderBy("category", "rank").collect()
    assert [(r.category, r.keyword) for r in out] == [("C", "y"), ("C", "x"), ("D", "w")]


def test_backlog_and_suggestions_follow_the_index(spark):
    """A row that an app or idle rule decided still takes the index's label on an
    ambiguous host; candidates are tried one after the other, the index before the
    accepted suggestions."""
    from dwell.operators.classify import RuleSet, classify

    rs = RuleSet.build(spark, keyword_index={"Shopping": [{"keyword": "google maps", "count": 1}], "Coding": [{"keyword": "last words", "count": 1}]})
    g = "https://www.google.com/x"
    rows = [
        (1, "Slack", "Google Maps", g), (2, "Idle", "Google Maps", g), (3, "Slack", "Google Maps", "https://example.org/"), (4, "Nope", "Other thing", ""),
        (5, "Slack", "First thing and last words", g), (6, "Slack", "Other thing", g), (7, "Nope", "Asked twice some time", ""), (8, "Nope", "abc", ""), (9, "Nope", None, None),
    ]
    df = spark.createDataFrame([(*r, dt.datetime(2024, 1, 1), r[0]) for r in rows], "i int, app string, title string, url string, ts timestamp_ntz, seq long")
    cl = classify(df, rs, variant="legacy")
    assert {r.keyword for r in K.label_backlog(cl).collect()} == {"other thing", "asked twice"}
    sg = spark.createDataFrame([("first thing", "Research", True), ("other thing", "Unknown", True), ("some time", "Meetings", None), ("google maps", "Never", True)], "keyword string, category string, productive boolean")
    out = {r.i: (r.category, r.label_source, r.hit_keyword) for r in K.apply_suggestions(cl, sg).collect()}
    assert out == {
        1: ("Shopping", "index", "google maps"), 2: ("Shopping", "index", "google maps"), 3: ("Communication", "rules", None), 4: ("Unknown", "rules", None),
        5: ("Research", "suggestion", "first thing"), 6: ("Communication", "rules", None), 7: ("Meetings", "suggestion", "some time"), 8: ("Unknown", "rules", None), 9: ("Unknown", "rules", None),
    }
    out = {r.i: (r.category, r.label_source) for r in K.apply_suggestions(cl, sg.limit(0)).collect()}
    assert out[5] == ("Coding", "index") and out[7] == ("Unknown", "rules")


def test_labeller_is_asked_once_over_all_runs(spark, tmp_path):
    from dwell.operators import suggestions as SG
    from dwell.session import scratch_path
    from dwell.streaming.store import Store

    calls = str(tmp_path / "calls")

    def labeller(app, title, url):
        with open(calls, "a") as f:
            f.write(f"{title}\n")
        if title == "bad":
            raise ValueError("down")
        return {"category": {"a": "Research", "b": "Unknown"}.get(title), "productive": 1}

    def asked():
        with open(calls) as f:
            lines = f.read().split()
        open(calls, "w").close()
        return sorted(lines)

    def backlog(*words):
        return spark.createDataFrame([(w, "app", w, None) for w in words], "keyword string, app string, title string, url string")

    store = Store(spark, scratch_path(spark, "sugg-test"))
    assert SG.ask(store, backlog("a", "b", "bad"), labeller, "r1") and asked() == ["a", "b", "bad"]
    assert not SG.ask(store, backlog("a", "z"), labeller, "r1") and asked() == []
    for n in (2, 3):
        store.compact()
        assert SG.ask(store, backlog("a", "b", "bad", "c"), labeller) and asked() == (["bad", "c"] if n == 2 else ["bad"])
    SG.ask(store, backlog("bad", "c"), labeller)
    assert asked() == []  # failed three times
    got = {r.keyword: (r.category, r.ok, r.attempt) for r in store.suggestions().collect()}
    assert got == {"a": ("Research", True, 1), "b": ("Unknown", True, 1), "c": ("Unknown", True, 1), "bad": (None, False, 3)}
    assert [(r.keyword, r.productive) for r in SG.accepted(store).collect()] == [("a", True)]
