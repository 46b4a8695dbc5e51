"""The corpus pipeline: documents -> toxicity -> line dedup -> near duplicates ->
mixing -> SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes each result as Parquet under the shared checkpoint folder and rereads it
as the next stage's docs. All but the last return the columns of ``documents``
as they came (extra columns included), with the stage's decisions applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm import line_dedup, mixing, ngram_join, sentencepiece_nbest, toxicity
from dwell.llm.common import id_key, table, write_table

#: The classifier, mixing weights and n-gram components are not expressible in
#: SQL; the tests hold every stage against a brute-force version instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier's threshold for their language rejects go."""
    model = toxicity.train(toxicity.training_sample(docs, table(spark, sf_dir, "labels"), F.lit(True)))
    return toxicity.score(docs, model).where(~F.col("toxic")).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated three-line windows, and ``n_chars`` to
    match; a document that loses all its lines stays, with an empty text."""
    out = line_dedup.dedup_lines(docs)
    text = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text").cast("long"))}
    return out.select(*[text[c].alias(c) if c in text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays
    (of rows that repeat its id: the smallest text hash; of rows that repeat both:
    any one). Documents without words link with nothing: all stay."""
    words = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    near = ngram_join.near_duplicates(docs.where(words)).where(F.col("component").isNotNull())
    first = near.groupBy("component").agg(F.min(F.struct(id_key("doc_id").alias("_id"), F.col("text_hash").alias("_th"))).alias("f")).select("f.*")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.where(words).select(row, id_key("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    kept = keyed.join(first, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("row.*")
    return kept.unionByName(docs.where(~words))


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated weights, each as often as it has copies."""
    return mixing.mix(docs, carry=True).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_pieces, ids, scores): the best segmentation's ids
    and the scores of the N best."""
    out = sentencepiece_nbest.encode(docs.select("doc_id", "source", "lang", "text"))
    return out.select("row.doc_id", "row.source", "row.lang", F.size("ids").cast("long").alias("n_pieces"), "ids", "scores")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("mixing", sample_mix),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
