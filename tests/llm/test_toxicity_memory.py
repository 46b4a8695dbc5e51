"""The classifier's module and the memory of its training."""

from __future__ import annotations

import ast
import inspect
import pickle
import tracemalloc

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from dwell.llm import ngram_join, toxicity


def test_training_functions_are_defined_once():
    names = [n.name for n in ast.parse(inspect.getsource(toxicity)).body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
    assert len(names) == len(set(names))


def test_embeddings_are_drawn_in_blocks():
    tracemalloc.start()
    try:
        model = toxicity.train([])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * model.emb.nbytes


def test_the_driver_never_holds_the_sample(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} {'bad' * (i % 2)}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    here = toxicity.train(toxicity.training_rows(docs, labels, F.lit(True)))
    assert pickle.dumps(here) == pickle.dumps(toxicity.train(toxicity.training_sample(docs, labels, F.lit(True))))
    none = toxicity.train(toxicity.training_sample(docs, labels, F.lit(False)))
    assert none.constant == 0.0
    monkeypatch.setattr(toxicity, "training_rows", lambda *a, **b: pytest.fail("the sample came to the driver"))
    assert toxicity.op2_toxicity(spark, str(tmp_path)).count() == 60
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() <= 60


def test_common_ngrams_come_as_arrays(spark, monkeypatch):
    """Not as a Python object for each of up to MAX_COMMON n-grams."""
    kind, sizes = type(spark.range(0)), []
    monkeypatch.setattr(kind, "collect", lambda self, f=kind.collect: sizes.append(len(r := f(self))) or r)
    docs = spark.createDataFrame([(i, "a b c d e f g h" + f" x{i // 2}" * 9) for i in range(40)], "doc_id long, text string")
    assert ngram_join.near_duplicates(docs).select("component_id").distinct().count() == 20
    assert max(sizes) <= 1  # the fingerprints of components
