"""Registered queries against their SQL twins on the smallest tables, and what the twins can't say against plain Python."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellane.operators import retrieval
from tessellane.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["bm25_topk", "fnv_tfidf", "hybrid_rrf", "dense_topk", "pack_break", "eval_hit_mrr", "documents_listing", "largest_remainder", "counter_rate", "next_token", "xref_resolve", "citation_check", "rerank_weighted", "rerank_coverage", "rerank_overlap", "hash_embedding", "fnv_topk", "expand_query", "tier_counts", "tokenizers", "cjk_tokens", "markdown_rows", "stream_rates", "chunk_lab", "chunk_easy", "chunk_kit", "chunk_pro", "mmr_select", "pack_skip", "extractive_answer", "key_sentences"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF)
    theirs = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert normal([tuple(r) for r in ours.collect()], ours.columns) == normal(theirs.fetchall(), names)


def test_chunks_keep_their_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cut = catalog.QUERIES["chunk_lab"](spark, SF).join(docs, "doc_id")
    wrong = cut.where(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("chunk"))
    assert cut.count() > docs.count() and wrong.count() == 0


def test_pushdown_reaches_the_scan(spark):
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    scores = retrieval.bm25_scores(retrieval.scoped(catalog.corpus(spark, SF), good), catalog.questions(spark, SF))
    for df in (scores, catalog.QUERIES["delete_cascade"](spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in plan or "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in plan
        assert "CartesianProduct" not in plan and "Python" not in plan


def test_searches_read_the_documents_once(spark):
    catalog.indexed(spark, SF)
    plan = catalog.QUERIES["hybrid_rrf"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 0 and plan.count("MapInArrow") == 1 and "NestedLoop" not in plan
    plan = catalog.QUERIES["eval_hit_mrr"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
