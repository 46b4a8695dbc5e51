"""Mixing sources to target weights by iterative proportional fitting (native).

Documents are aggregated once into token totals per (source, language, topic)
cell. The cell totals are raked, margin after margin, until each margin's
shares meet its targets; a cell's raked total over its own total is the weight
of its documents, and weight x keep_fraction is the number of times a document
is expected in the sample: its whole part as copies, the rest as the probability
of one more. Only the cell table is iterated on; the documents are read
for the totals and once more for the result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwell.llm.common import discard, table, write_table

SWEEPS = 5  # between two looks at the margins; a job each
MAX_SWEEPS = 500
TOLERANCE = 1e-10  # largest difference of a margin's share from its target at which raking ends
KEEP_FRACTION = 0.6
SEED = "mix-1"
#: Per margin: an exponent (target share ~ observed share ** exponent), or a
#: dict of level -> target share; levels it doesn't name keep their observed share.
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.5, "lang": 0.7, "topic": 0.8}
DIMS = ("source", "lang", "topic")
CELLS_PER_FILE = 200_000
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words separated by ASCII white space; null text: 0."""
    ends = F.when(F.regexp_like(text, F.lit(r"\A[\x20\x09-\x0D]")), 1).otherwise(0) + F.when(F.regexp_like(text, F.lit(r"[\x20\x09-\x0D]\z")), 1).otherwise(0)
    n = F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, SPACE, -1)) - ends)
    return F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of the whole text."""
    low = F.lower(text)
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(low.contains("license") | low.contains("copyright"), "license")
        .when(text.contains(" | "), "table")
        .when(text.contains("@") | text.contains("://"), "contact")
        .otherwise("prose")
    )


def _level(c: Column) -> Column:
    """A margin's level as a non-null string: null is a level of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def margin_targets(cells: DataFrame, dim: str, spec: float | dict[str, float]) -> DataFrame:
    """(dim, target): target shares of one margin over the observed levels with tokens, summing to 1."""
    m = cells.groupBy(dim).agg(F.sum("w").alias("mw"))
    tot = m.agg(F.sum("mw").alias("tot"))
    m = m.join(F.broadcast(tot)).select(dim, (F.col("mw") / F.col("tot")).alias("share"))
    if isinstance(spec, dict):
        raw = F.col("share")
        for level, v in spec.items():
            raw = F.when(F.col(dim) == F.lit("null" if level is None else f"={level}"), F.lit(float(v))).otherwise(raw)
    else:
        raw = F.pow("share", F.lit(float(spec)))
    m = m.select(dim, raw.alias("raw"))
    tot = m.agg(F.sum("raw").alias("tot"))
    return m.join(F.broadcast(tot)).select(dim, (F.col("raw") / F.col("tot")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], sweeps: int = SWEEPS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """``cells(dims..., w > 0)`` -> the same with ``x``: raked shares summing to
    1. Each sweep scales the cells once per margin by a window sum over its level;
    ``sweeps`` sweeps make one job, whose cells are written and reread.

    Raking ends when every share is within ``tolerance`` of its target; targets not
    met in MAX_SWEEPS (infeasible ones: a level whose cells can't hold its share)
    are reported by a warning. No tolerance: ``sweeps`` sweeps."""
    dims = list(targets)
    files = 1 + cells.count() // CELLS_PER_FILE
    ts = [f"t_{d}" for d in dims]
    cur = cells.withColumn("x", F.col("w"))
    for d, t in zip(dims, ts, strict=True):
        cur = cur.join(margin_targets(cells, d, targets[d]).withColumnRenamed("target", t), d)
    cur = write_table(cur.select(*dims, "w", "x", *ts).coalesce(files), "mix-cells")
    done, worst = 0, 0.0
    while True:
        before = cur
        for _ in range(sweeps):
            for d, t in zip(dims, ts, strict=True):
                cur = cur.withColumn("x", F.col("x") * (F.col(t) / F.sum("x").over(Window.partitionBy(d))))
        cur = write_table(cur.coalesce(files), "mix-cells")
        discard(before)
        done += sweeps
        if tolerance is None:
            return cur
        worst = margin_error(cur, dims)
        if worst <= tolerance:
            return cur
        if done >= MAX_SWEEPS:
            warnings.warn(f"mixing: a margin is {worst:.2g} off its target after {done} sweeps", stacklevel=2)
            return cur


def margin_error(cells: DataFrame, dims: list[str]) -> float:
    """The largest difference of a raked share from its target over all margins."""
    sums = cells.groupingSets([[F.col(d)] for d in dims], *dims).agg(F.sum("x").alias("sx"), *[F.max(f"t_{d}").alias(f"t_{d}") for d in dims])
    target = F.coalesce(*[F.when(F.col(d).isNotNull(), F.col(f"t_{d}")) for d in dims])
    return sums.agg(F.max(F.abs(F.col("sx") - target))).first()[0] or 0.0


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of seed and key: 52 bits, exact in a double."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix(
    docs: DataFrame,
    targets: dict[str, float | dict[str, float]] = TARGETS,
    keep_fraction: float = KEEP_FRACTION,
    sweeps: int = SWEEPS,
    tolerance: float | None = TOLERANCE,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, source, lang, topic, n_tokens, weight,
    prob, sampled, copies`` (with ``carry``: the whole input row as struct ``row``, too).

    weight: raked over observed tokens of the document's cell; prob =
    min(1, weight x keep_fraction); sampled: the id's hash falls below prob (a
    null id: the text's hash), so repeated rows share a decision. copies: how often
    the sample holds the document; floor(weight x keep_fraction), and one more if the
    hash falls below what is left, so that the cells' expected tokens are the raked
    ones even where prob is cut at 1. Null source or
    lang are levels of their own. Documents without tokens (null, empty or blank text) weigh
    nothing in any margin: weight 1, prob 1, kept once. An empty table gives an empty result."""
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit(""))
    text = F.col(text_col)
    extra = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col("source").alias("o_source"),
        F.col("lang").alias("o_lang"),
        _level(F.col("source")).alias("source"),
        _level(F.col("lang")).alias("lang"),
        topic_of(text).alias("o_topic"),
        n_words(text).alias("n_tokens"),
        F.round(uniform(key, seed), 15).alias("u"),
        *extra,
    ).withColumn("topic", _level(F.col("o_topic")))
    cells = d.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("w")).where("w > 0")
    cells = write_table(cells, "mix-cells0")
    raked = rake(cells, targets, sweeps, tolerance)
    tot = cells.agg(F.sum("w").alias("tot"))
    ratio = raked.join(F.broadcast(tot)).select(*DIMS, F.round(F.col("x") * F.col("tot") / F.col("w"), 9).alias("ratio"))
    j = d.join(ratio, list(DIMS), "left")
    weight = F.when(F.col("n_tokens") > 0, F.col("ratio")).otherwise(F.lit(1.0))
    j = j.withColumn("weight", weight).withColumn("times", F.when(F.col("n_tokens") > 0, F.round(F.col("weight") * F.lit(float(keep_fraction)), 9)).otherwise(F.lit(1.0)))
    j = j.withColumn("prob", F.least(F.lit(1.0), F.col("times")))
    whole = F.floor("times")
    return j.select(
        "doc_id",
        F.col("o_source").alias("source"),
        F.col("o_lang").alias("lang"),
        F.col("o_topic").alias("topic"),
        "n_tokens",
        "weight",
        "prob",
        (F.col("u") < F.col("prob")).alias("sampled"),
        (whole + (F.col("u") < F.col("times") - whole).cast("long")).alias("copies"),
        *(["row"] if carry else []),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), "sampled", "copies")


#: sweeps of the SQL: more than any scale of the test tables needs for TOLERANCE
ORACLE_SWEEPS = 20


def oracle(src: str = "documents", head: str = "", select: str | None = None) -> str:
    """DuckDB SQL of :func:`mix` with the default parameters over relation ``src``."""
    ctes = [
        f"""d AS MATERIALIZED (SELECT *, coalesce('=' || source, 'null') AS k_source, coalesce('=' || lang, 'null') AS k_lang, '=' || o_topic AS k_topic,
  ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13))::BIGINT::DOUBLE / {16**13}.0 AS u
  FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'license'
         WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '@') OR contains(text, '://') THEN 'contact' ELSE 'prose' END AS o_topic FROM {src}))""",
        "x0 AS MATERIALIZED (SELECT k_source, k_lang, k_topic, sum(n_tokens)::DOUBLE AS w, sum(n_tokens)::DOUBLE AS x FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for dim, a in TARGETS.items():
        ctes.append(f"r_{dim} AS MATERIALIZED (SELECT k_{dim}, pow(sum(w) / (SELECT sum(w) FROM x0), {a}) AS raw FROM x0 GROUP BY ALL)")
        ctes.append(f"t_{dim} AS MATERIALIZED (SELECT k_{dim}, raw / (SELECT sum(raw) FROM r_{dim}) AS target FROM r_{dim})")
    i = 0
    for _ in range(ORACLE_SWEEPS):
        for dim in TARGETS:
            ctes.append(
                f"x{i + 1} AS MATERIALIZED (SELECT c.k_source, c.k_lang, c.k_topic, c.w, c.x * (t.target / s.sx) AS x FROM x{i} c JOIN t_{dim} t USING (k_{dim}) JOIN (SELECT k_{dim}, sum(x) AS sx FROM x{i} GROUP BY ALL) s USING (k_{dim}))"
            )
            i += 1
    ctes.append(
        f"""m AS (SELECT d.*, CASE WHEN n_tokens > 0 THEN round(c.x * (SELECT sum(w) FROM x0) / c.w, 9) ELSE 1.0 END AS weight FROM d LEFT JOIN x{i} c USING (k_source, k_lang, k_topic))"""
    )
    ctes.append(
        f"p AS (SELECT *, least(1.0, times) AS prob FROM (SELECT *, CASE WHEN n_tokens > 0 THEN round(weight * {KEEP_FRACTION}, 9) ELSE 1.0 END AS times FROM m))"
    )
    select = select or (
        "SELECT doc_id, source, lang, o_topic AS topic, n_tokens, round(weight, 6) AS weight, round(prob, 6) AS prob, u < prob AS sampled, "
        "floor(times)::BIGINT + (u < times - floor(times))::BIGINT AS copies FROM p"
    )
    return "WITH " + head + ",\n".join(ctes) + "\n" + select
