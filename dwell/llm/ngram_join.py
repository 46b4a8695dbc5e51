"""N-gram Jaccard join: near-duplicate texts by a grouped prefix join.

A document's set holds its distinct hashed word n-grams. In a fixed global order
of the n-grams two sets of Jaccard similarity t share one within their prefixes
(the first |x| - ceil(t|x|) + 1), so only prefixes meet:

1. Order: n-grams of the lower half of the hashes come first, by hash; those of
   them that are common anywhere in the corpus after these, the rarest first;
   the upper half last. A prefix is a quarter of a set, so it hardly ever leaves
   the lower half.
2. Equal sets collapse into one node; nodes of equal prefix and size into one
   group. Groups meet on their prefix n-grams; n-grams of one group drop out.
3. Each group is first held against one hub of its n-grams and its members
   against one of them, so that a large family of copies becomes one component
   after linear work.
   Of n-grams that the very same groups hold one stands for all (``w`` of them).
4. Groups that do not yet lie in one component form group pairs on their rarest
   prefix n-grams, by the number of groups that hold them, as a rule once: at the
   first that they share. Sizes, parity bits and, where a group has several members,
   the number of shared prefix n-grams filter these; what is left expands to its
   members, whose sketches (parity bits that grow with the set) and then whole sets
   are compared.

Any set of common n-grams gives a valid order, so how they are found bears on
the speed alone, never on the result (they are counted with repeats, chunk by
chunk, over all documents).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwell.llm.common import NULL_ID, arrow_map, as_bytes, connected_components, discard, keyed_texts, mix64, odd_constants, rolling, slices, table, u64_as_i64, word_hash, write_table

N = 5
PERCENT = 75
COMMON_SHARE = 0.001  # an n-gram is common if it is in this share of the documents of some chunk
COMMON_LEAST = 8
CHUNK_GRAMS = 2_000_000
MAX_COMMON = 200_000  # most common ones kept for the order (3.2 MB, broadcast)
BITS = [f"s{i}" for i in range(8)]  # parities of a set's n-grams in 512 cells
HEAD = 16  # n-grams that come before an entry's own in its group, which it carries to pair two groups once
LOWER_HALF = np.uint64(1 << 63)
BITMAP_WORDS = 1 << 17
_SEED = 404


def gram_sets(texts: list[bytes | None], n: int = N) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes per text: A-Z lower-cased, words between
    ASCII white space; with fewer than n words the whole sequence counts as one."""
    consts = odd_constants(_SEED, n)
    split = [(t or b"").lower().split() for t in texts]
    w = word_hash().of([x for ws in split for x in ws])
    h = rolling(w, consts)
    out, at = [], 0
    for ws in split:
        k = len(ws)
        if k >= n:
            out.append(np.unique(h[at : at + k - n + 1]))
        elif k:
            out.append(mix64((w[at : at + k] * consts[:k]).sum(keepdims=True, dtype=np.uint64) + np.uint64(k)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += k
    return out


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of a set's n-grams in twice as many cells or more (a power of two),
    as 64-bit integers. Halves folded by XOR are the sketch of half as many cells."""
    cells = max(64 * len(BITS), 1 << max(0, 2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(cells - 1)).view(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - (percent * size + 99) // 100 + 1


def end_key(gram: int, last: np.ndarray, rank: np.ndarray) -> int:
    """Place of an n-gram in the global order, as a signed 64-bit integer: never
    descending along the order (neighbours may be equal)."""
    if gram >= int(LOWER_HALF):
        return (1 << 62) + (1 << 61) + (gram >> 3)
    at = min(int(np.searchsorted(last, np.uint64(gram))), len(last) - 1)
    return (1 << 62) + int(rank[at]) if int(last[at]) == gram else gram >> 2


def _common(n: int):
    consts = odd_constants(_SEED, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = docs = 0

        def flush() -> pa.RecordBatch:
            g, c = np.unique(np.concatenate(held), return_counts=True)
            hit = c >= max(COMMON_LEAST, COMMON_SHARE * docs)
            return pa.RecordBatch.from_arrays([u64_as_i64(g[hit]), pa.array(c[hit].astype(np.int64))], names=["tok", "c"])

        for b in batches:
            for s in slices(b, "_text"):
                # all runs of n words of the slice; the few that cross two texts don't matter to an order
                # (in the order by hash, prefixes lie in the lower half unless that is common throughout)
                h = rolling(word_hash().of(b" ".join([t or b"" for t in as_bytes(s.column(0))]).lower().split()), consts)
                h = h[h < LOWER_HALF]
                held.append(h)
                size, docs = size + len(h), docs + s.num_rows
                if size >= CHUNK_GRAMS:
                    yield flush()
                    held, size, docs = [], 0, 0
        if size:
            yield flush()

    return run


def _signatures(n: int, percent: int, common):
    def build():
        last, rank = common.value

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, keys, prefixes, sketches, ends = [], [], [], [], [], []
            for g in gram_sets(as_bytes(b.column(2)), n):
                sizes.append(len(g))
                sketches.append(sketch(g))
                digests.append(blake2b(g.tobytes(), digest_size=16).digest())
                p = prefix_length(len(g), percent) if len(g) else 0
                if len(last) and len(g):
                    half = np.searchsorted(g, LOWER_HALF)
                    low, at = g[:half], np.minimum(np.searchsorted(last, g[:half]), len(last) - 1)
                    late = last[at] == low
                    g = np.concatenate([low[~late], low[late][np.argsort(rank[at[late]])], g[half:]])
                    ends.append(end_key(int(g[p - 1]), last, rank))
                else:
                    ends.append(0)  # no set, or no common n-gram in the corpus: either prefix may end first
                prefixes.append(g[:p].view(np.int64))
                keys.append(blake2b(g[:p].tobytes(), digest_size=8).digest())
            d = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, len(BITS))) for x in sketches])
            lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)), pa.array(np.concatenate(xs)))
            return pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(sizes, pa.int32()),
                    pa.array(d[:, 0].copy()),
                    pa.array(d[:, 1].copy()),
                    pa.array(np.frombuffer(b"".join(keys), dtype=np.int64)),
                    pa.array(ends, pa.int64()),
                    lists(prefixes),
                    lists(sketches),
                    *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(BITS))],
                ],
                names=["_id", "_th", "n", "d1", "d2", "gk", "fin", "toks", "sk", *BITS],
            )

        return work

    return build


def _similar(n: int, percent: int):
    def build():
        kept: list = [None, None]

        def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
            hits = []
            for i, (hub, ta, tb) in enumerate(zip(b.column(1).to_pylist(), as_bytes(b.column(2)), as_bytes(b.column(3)), strict=True)):
                if hub != kept[0]:  # rows of one hub come together
                    kept[:] = hub, gram_sets([tb], n)[0]
                x, y = gram_sets([ta], n)[0], kept[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    hits.append(i)
            if not hits:
                return None
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hits)), b.column(1).take(pa.array(hits))], names=["a", "b"])

        return work

    return build


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _near(side1: str, side2: str, percent: int) -> Column:
    """False only where the parity bits rule a link out: cells of unequal parity
    hold at least one n-gram of one set alone."""
    apart = sum((F.bit_count(F.col(f"{x}_{side1}").bitwiseXOR(F.col(f"{x}_{side2}"))) for x in BITS), F.lit(0))
    return apart * (100 + percent) <= (F.col(f"n{side1}") + F.col(f"n{side2}")) * (100 - percent)


def _close(side1: str, side2: str, percent: int) -> Column:
    """As :func:`_near`, by the sketches: the one of more cells is folded to the other's."""
    a, b = F.col(f"sk{side1}"), F.col(f"sk{side2}")
    more = F.size(a) >= F.size(b)
    long, short = F.when(more, a).otherwise(b), F.when(more, b).otherwise(a)
    folds = F.sequence(F.lit(0), (F.size(long) / F.size(short)).cast("int") - 1)
    odd = F.aggregate(folds, short, lambda x, i: F.zip_with(x, F.slice(long, i * F.size(short) + 1, F.size(short)), lambda p, q: p.bitwiseXOR(q)))
    apart = F.aggregate(odd, F.lit(0), lambda x, p: x + F.bit_count(p))
    n1, n2 = F.col(f"n{side1}"), F.col(f"n{side2}")
    return _sizes_fit(n1, n2, percent) & (apart * (100 + percent) <= (n1 + n2) * (100 - percent))


def _side(i: str) -> list[Column]:
    return [F.col(c).alias(f"{c}{i}") for c in ("v", "n", "sk")]


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts link; b is the side that many pairs share."""
    pairs = write_table(pairs, "ngram-pairs")
    who = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    who = write_table(who.join(nodes.select("v", "_id", "_th"), "v"), "ngram-who")
    # a bitmap of fixed size (2 MB) spares most texts the shuffle; the join decides
    cell = F.pmod(F.xxhash64("_id", "_th"), F.lit(64 * BITMAP_WORDS))
    at = lambda d: d.withColumn("bit", (cell % 64).cast("int")).withColumn("word", F.floor(cell / 64).cast("int"))
    bitmap = at(who).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    some = at(texts).join(F.broadcast(bitmap), "word").where(F.getbit("bits", "bit") == 1).drop("word", "bit", "bits")
    held = write_table(some.join(who, ["_id", "_th"]).select("v", "_text").dropDuplicates(["v"]), "ngram-texts")
    discard(who)
    ta = held.select(F.col("v").alias("a"), F.col("_text").alias("ta"))
    tb = held.select(F.col("v").alias("b"), F.col("_text").alias("tb"))
    j = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    links = write_table(arrow_map(j, _similar(n, percent), "a long, b long", text_col="ta"), "ngram-links")
    discard(pairs)
    discard(held)
    return links


def _need(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of linked sets of these sizes."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - F.lit(1e-9))


def _hub_pairs(met: DataFrame, groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the first member of each group with that of the hub group that it
    shares most prefix n-grams with, and the other members with the first. A hub
    is, per n-gram and size class, the group with most n-grams that occur
    elsewhere (``cw``): of a family of copies one that is near to all."""
    e = met.withColumn("sc", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int"))
    hubs = e.groupBy("tok", "sc").agg(F.max(F.struct("cw", "rep", "n")).alias("h"))
    at_hub = e.join(hubs, ["tok", "sc"]).where(F.col("rep") != F.col("h.rep"))
    at_hub = at_hub.where(_sizes_fit(F.col("n"), F.col("h.n"), percent))
    c = at_hub.groupBy("rep", F.col("h.rep").alias("hub")).agg(F.sum("w").alias("c"))
    best = c.groupBy("rep").agg(F.max(F.struct("c", "hub")).alias("m")).select(F.col("rep").alias("v1"), F.col("m.hub").alias("v2"))
    several = groups.where("members > 1").select("gk", "n", "rep")
    inside = nodes.select("gk", "n", "v").join(several, ["gk", "n"]).where("v <> rep").select(F.col("v").alias("v1"), F.col("rep").alias("v2"))
    pairs = best.unionByName(inside)
    pairs = pairs.join(nodes.select(*_side("1")), "v1").join(nodes.select(*_side("2")), "v2").where(_close("1", "2", percent))
    return pairs.select(F.col("v1").alias("a"), F.col("v2").alias("b"))


def _formed(e: DataFrame, percent: int) -> DataFrame:
    """(g1, g2, several): a row for each n-gram at which two groups form a pair."""
    side = lambda i: ["tok", *[F.col(c).alias(f"{c}{i}") for c in ("g", "n", "rank", "fin", "lo", "hi", "in_big", "members", "before")], *[F.col(c).alias(f"{c}_{i}") for c in BITS]]
    x, y = e.where(~F.col("in_big")).select(*side(1)), e.select(*side(2))
    apart = ~((F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo1") == F.col("lo2")))
    once = F.col("in_big2") | (F.col("g1") < F.col("g2"))
    need = _need(F.col("n1"), F.col("n2"), percent)
    rare = ((F.col("fin1") <= F.col("fin2")) & (F.col("rank1") <= F.col("n1") - need)) | ((F.col("fin2") <= F.col("fin1")) & (F.col("rank2") <= F.col("n2") - need))
    fits = _sizes_fit(F.col("n1"), F.col("n2"), percent) & rare & F.coalesce(_near("1", "2", percent), F.lit(True))
    first = ~F.arrays_overlap("before1", "before2")
    several = (F.col("members1") > 1) | (F.col("members2") > 1)
    pairs = x.join(y, "tok").where(apart & once & fits & first)
    return pairs.select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2"), several.alias("several"))


def _group_pairs(met: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(g1, g2): pairs of groups that may hold a link between components; a group
    of several components with itself. ``groups`` has the least and greatest
    component of each. Within an n-gram the groups outside its largest component
    meet the others, so copies that already lie together never meet each other.

    Linked sets overlap in ``_need`` n-grams. Of the prefix that ends first (by
    ``fin``) at most n - need n-grams are then not in the other prefix, so that
    of any n - need + 1 of them one is shared: those that the fewest groups hold
    (``rank`` from 0; n-grams of one group come first). Groups that share less,
    such as texts with a widespread passage, never meet. Groups of one member are
    also held against parity bits (else null). A pair is not formed at an n-gram that
    another shared one comes before, as far as the last HEAD before it (``before``)
    show: all ranks are of one order, so that if any shared n-gram is rare enough, the
    first is, and a shared passage forms its pair once. For pairs of which a group has
    several members all shared prefix n-grams are then counted: beyond the prefix that
    ends first at most n - |prefix| remain."""
    e = met.join(groups.select("g", "lo", "hi"), "g")
    per = e.where("lo = hi").groupBy("tok", "lo").agg(F.count(F.lit(1)).alias("c"))
    big = per.groupBy("tok").agg(F.max(F.struct("c", "lo")).alias("m")).select("tok", F.col("m.lo").alias("big"))
    span = e.groupBy("tok").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("tok")
    span = write_table(span.join(big, "tok", "left"), "ngram-open")
    in_big = F.coalesce((F.col("lo") == F.col("big")) & (F.col("hi") == F.col("big")), F.lit(False))
    slim = write_table(e.join(span, "tok").select("tok", "g", "rank", in_big.alias("in_big")), "ngram-entries")
    discard(span)
    before = Window.partitionBy("g").orderBy("rank").rowsBetween(-HEAD, -1)  # one prefix
    e = slim.withColumn("before", F.collect_list("tok").over(before))
    # written, so that the join has plain shuffles on both sides and a hot n-gram can be split
    e = write_table(e.join(groups.select("g", "n", "fin", "lo", "hi", "members", *BITS), "g"), "ngram-sides")
    discard(slim)
    pairs = write_table(_formed(e, percent).distinct(), "ngram-group-pairs")
    discard(e)
    counted = pairs.where("several").select("g1", "g2")
    who = write_table(counted.select(F.col("g1").alias("g")).unionByName(counted.select(F.col("g2").alias("g"))).distinct(), "ngram-counted")
    held = groups.join(who, "g")
    of = lambda i: held.select(*[F.col(c).alias(f"{c}{i}") for c in ("g", "n", "toks")])
    both = counted.join(of(1), "g1").join(of(2), "g2")
    beyond = F.greatest(F.col("n1") - F.size("toks1"), F.col("n2") - F.size("toks2"))
    enough = F.size(F.array_intersect("toks1", "toks2")) + beyond >= _need(F.col("n1"), F.col("n2"), percent)
    rest = pairs.where("NOT several").select("g1", "g2")
    alone = groups.where("lo <> hi").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    kept = write_table(both.where(enough).select("g1", "g2").unionByName(rest).unionByName(alone), "ngram-kept-pairs")
    discard(pairs)
    discard(who)
    return kept


def _member_pairs(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The members of the group pairs that lie in different components and that
    their sketches do not rule out."""
    x = members.select(F.col("g").alias("g1"), F.col("comp").alias("c1"), *_side("1"))
    y = members.select(F.col("g").alias("g2"), F.col("comp").alias("c2"), *_side("2"))
    once = (F.col("g1") < F.col("g2")) | (F.col("v1") < F.col("v2"))
    j = pairs.join(x, "g1").join(y, "g2").where((F.col("c1") != F.col("c2")) & once & _close("1", "2", percent))
    return j.select(F.col("v1").alias("a"), F.col("v2").alias("b"))


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, component): one row per input row.

    Two texts link when 100 |both| >= percent |either| over their distinct word
    n-grams; the component is the smallest id reachable by links. Texts that
    are null, empty or without words have no n-grams and link with nothing. Equal sets
    link (repeated rows, too); rows of one id with different texts are
    separate nodes, so ``component_id`` may stand for several components;
    ``component`` is a key of one alone (null without n-grams).
    A null id sorts before every other, and is null in both id columns.
    Clashing columns are not touched. An empty table gives an empty result."""
    spark = docs.sparkSession
    texts = keyed_texts(docs, id_col, text_col)
    common = texts.select("_text").mapInArrow(_common(n), "tok long, c long").groupBy("tok").agg(F.sum("c").alias("c"))
    common = common.orderBy(F.desc("c"), "tok").limit(MAX_COMMON).toArrow()  # two arrays on the driver; the tasks' shares meet in a task
    last = common["tok"].to_numpy()[np.lexsort([common[x].to_numpy() for x in ("tok", "c")])].view(np.uint64)
    order = np.argsort(last)
    last = spark.sparkContext.broadcast((last[order], order))
    sigs = write_table(
        arrow_map(texts, _signatures(n, percent, last), "_id long, _th long, n int, d1 long, d2 long, gk long, fin long, toks array<long>, sk array<long>, " + ", ".join(f"{x} long" for x in BITS)), "ngram-sigs"
    )
    last.unpersist()
    some = sigs.where("n > 0")
    nodes = some.groupBy("d1", "d2").agg(F.min(F.struct("_id", "_th")).alias("r"), F.first("n").alias("n"), F.first("gk").alias("gk"), F.first(F.struct("sk", *BITS)).alias("bits"))
    nodes = write_table(nodes.select("d1", "d2", "n", "gk", F.xxhash64("gk", "n").alias("g"), "r.*", "bits.*", F.xxhash64("r._id", "r._th").alias("v")), "ngram-nodes")
    slim = write_table(sigs.select("_id", "_th", "n", "d1", "d2"), "ngram-slim")

    alone = F.struct(*[F.when(F.count(F.lit(1)) == 1, F.first(x)).alias(x) for x in BITS])
    first = nodes.groupBy("gk", "n").agg(F.min("v").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("g").alias("g"), alone.alias("alone"))
    prefix = some.groupBy("gk", "n").agg(F.first("toks").alias("toks"), F.first("fin").alias("fin"))
    groups = write_table(prefix.join(first, ["gk", "n"]).select("*", F.size("toks").alias("p"), "alone.*").drop("alone"), "ngram-groups")
    discard(sigs)
    met = groups.select("g", F.explode("toks").alias("tok"))  # what else a group has is joined to the few shared ones
    shared = met.groupBy("tok").agg(F.count(F.lit(1)).alias("held"), F.bit_xor("g").alias("by")).where("held > 1")
    same = Window.partitionBy("held", "by")  # n-grams of the same groups: the first stands for all
    w = F.when(F.col("tok") == F.min("tok").over(same), F.count(F.lit(1)).over(same))
    shared = write_table(shared.select("tok", "held", w.alias("w")), "ngram-shared")
    one = Window.partitionBy("g")  # one prefix
    met = met.join(shared.hint("shuffle_hash"), "tok").withColumn("cw", F.count(F.lit(1)).over(one))
    met = met.withColumn("at", F.row_number().over(one.orderBy("held", "tok"))).where("w IS NOT NULL")
    rank = F.col("p") - F.col("cw") + F.col("at") - 1
    met = write_table(met.join(groups.select("g", "n", "rep", "p"), "g").select("tok", "g", "n", "rep", "cw", "w", rank.alias("rank")), "ngram-met")
    discard(shared)
    links = _verified(_hub_pairs(met, groups, nodes, percent), texts, nodes, n, percent)

    labels = connected_components(links, "ngram-hub-cc").select(F.col("node").alias("v"), F.col("component").alias("comp"))
    members = write_table(nodes.join(labels, "v", "left").select("g", "v", "n", "sk", F.coalesce("comp", "v").alias("comp")), "ngram-members")
    spans = members.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    pairs = _group_pairs(met.select("tok", "g", "rank"), groups.select("g", "n", "fin", "toks", "members", *BITS).join(spans, "g"), percent)
    links = links.unionByName(_verified(_member_pairs(pairs, members, percent), texts, nodes, n, percent))
    for done in (met, groups, members, pairs):
        discard(done)
    comp = connected_components(links, "ngram-cc")
    sig_nodes = nodes.select("d1", "d2", "v", "_id").join(comp.select(F.col("node").alias("v"), "component"), "v", "left")
    sig_nodes = write_table(sig_nodes.select("d1", "d2", "_id", F.coalesce("component", "v").alias("component")), "ngram-labels")
    # both written, so that a large component, or the copies of one text, can be split
    least = write_table(sig_nodes.groupBy("component").agg(F.min("_id").alias("least")), "ngram-least")
    sig_nodes = write_table(sig_nodes.join(least, "component").select("d1", "d2", "least", "component"), "ngram-components")
    linked = slim.where("n > 0").join(sig_nodes, ["d1", "d2"]).select("_id", "_th", "n", "least", "component")
    out = linked.unionByName(slim.where("n = 0").select("_id", "_th", "n", F.col("_id").alias("least"), F.lit(None).cast("long").alias("component")))
    return out.select(
        F.nullif("_id", F.lit(NULL_ID)).alias("doc_id"),
        F.col("_th").alias("text_hash"),
        F.col("n").cast("long").alias("n_shingles"),
        F.nullif("least", F.lit(NULL_ID)).alias("component_id"),
        "component",
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
