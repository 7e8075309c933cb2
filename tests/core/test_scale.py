"""What keeps searches bounded: parts of batches, weights looked up without a shuffle, matrix products in place of joined pairs."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellane.functions import text
from tessellane.operators import index, retrieval, search

ODD = ["", "The deploy_x of V2", "什么是回滚流程，V2 一下", "部署かな検索 Deploy_x", "한국어 AI、㐀㐁是", " İstanbul K9 ,,", "か", "a回b滚"]


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{i % 7} w{i % 3} v{i} deep sea 回滚{i % 2}" for i in range(40)]
    return spark.createDataFrame(list(enumerate([*words, "", "w1"])) + [(50, None)], "chunk_id int, text string").repartition(3)


def test_lists_equal_columns(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "text string")
    got = df.select("text", *[f(F.col("text")).alias(k) for k, f in text.TOKENIZERS.items()], text.feat_kit(F.col("text"), 2).alias("features")).collect()
    for r in got:
        assert {k: r[k] for k in text.LISTS} == {k: f(r.text) for k, f in text.LISTS.items()}
        assert r.features == text.list_features(r.text)


def test_slices_are_bounded():
    batch = pa.record_batch([pa.array(range(6)), pa.array(["a" * 10, "b" * 10, None, "c" * 90, "d", ""])], ["k", "t"])
    parts = list(index.slices(iter([batch, batch.slice(0, 0)]), 1, 20, 2))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5]]


@pytest.mark.parametrize("vocabulary", [None, 4])
def test_rare_terms_are_joined(spark, docs, monkeypatch, vocabulary):
    asked = spark.createDataFrame([(1, "w1 v3 sea"), (2, "nowhere")], "query_id int, text string")
    want = {(r.query_id, r.chunk_id): r.score for r in retrieval.tfidf_cosine(docs, asked, vocabulary=vocabulary).collect()}
    whole = sorted(map(tuple, retrieval.hash_embedding(docs).select("chunk_id", "idx", F.round("w", 9)).collect()))
    monkeypatch.setattr(index, "HEAD", 3)
    monkeypatch.setattr(search, "HEAD", 3)
    got = {(r.query_id, r.chunk_id): r.score for r in search.lexical(index.build(docs, "lab", "lab", vocabulary), asked, 99, ("vector",)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert sorted(map(tuple, retrieval.hash_embedding(docs).select("chunk_id", "idx", F.round("w", 9)).collect())) == whole


@pytest.mark.parametrize("find", [retrieval.hashed_search, retrieval.embedding_search])
def test_hashed_searches_join_no_pairs(spark, docs, find):
    asked = spark.createDataFrame([(1, "w1 v3 sea"), (2, "nowhere 回滚"), (3, "")], "query_id int, text string")
    few = find(docs, asked, pool=3)
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    keys = lambda df: [tuple(r) for r in retrieval.ranked(df, 3).select("query_id", "chunk_id", "rank", F.round("score", 9)).orderBy("query_id", "rank").collect()]
    assert keys(few) == keys(find(docs, asked))


def test_bm25_needs_no_vectors(spark, docs):
    made = index.build(docs)
    assert index.with_vectors(made, "lab", 4).chunks is made.chunks
    assert made.chunks.where("norm is not null").count() == 0


def test_tokens_are_made_once_a_row(spark):
    df = spark.createDataFrame([("回滚流程 v2",)], "text string").repartition(1)
    plan = df.select(text.tok_pro(F.col("text")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 2


def test_ngrams_of_any_text(spark):
    texts = ["", "a", "ab", "a\nb", "𠀀か𠀁 回", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.ngrams(F.col("t"), 1), text.ngrams(F.col("t"), 2)).collect()
    assert [list(r) for r in got] == [[None if t is None else [t[i : i + n] for i in range(len(t) - n + 1)] for n in (1, 2)] for t in texts]


def test_long_runs_are_cut_in_one_pass(spark):
    run = "回滚流程" * 15_000
    df = spark.createDataFrame([(f"v2 {run} the end",)], "text string").repartition(1)
    began = time.perf_counter()
    got = df.select(*[f(F.col("text")).alias(k) for k, f in text.TOKENIZERS.items()], text.feat_kit(F.col("text"), 2).alias("features")).first()
    assert time.perf_counter() - began < 12  # by substrings it took 30 s and more, four times as much for twice the length
    assert got.asDict() == {k: f(f"v2 {run} the end") for k, f in text.LISTS.items()} | {"features": text.list_features(f"v2 {run} the end")}
