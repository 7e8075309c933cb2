"""Retrieval quality: all cases of an evaluation are one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hits(cases: DataFrame, ranking: DataFrame, correct: Column) -> DataFrame:
    """query_id, hit_rank (null if no ranked row is ``correct``), n_candidates: one row a case."""
    joined = cases.join(ranking, "query_id", "left")
    return joined.groupBy("query_id").agg(F.min(F.when(correct, F.col("rank"))).alias("hit_rank"), F.count("rank").alias("n_candidates"))


def quality(hits: DataFrame, k: int) -> DataFrame:
    """One row: n_cases, hit_rate, mrr (null when there is no case)."""
    found = F.col("hit_rank") <= k
    return hits.agg(
        F.count("*").alias("n_cases"), F.avg(F.coalesce(found.cast("double"), F.lit(0.0))).alias("hit_rate"),
        F.avg(F.coalesce(F.when(found, 1 / F.col("hit_rank")), F.lit(0.0))).alias("mrr"),
    )


def no_candidate_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("n_cases"), F.avg((F.col("n_candidates") == 0).cast("double")).alias("no_candidate_rate"))


def keyword_hits(cases: DataFrame, ranking: DataFrame) -> DataFrame:
    """query_id, hit: whether a ranked text holds the case's keyword. ``cases`` (query_id, keyword), ``ranking`` (query_id, text)."""
    return cases.join(ranking, "query_id", "left").groupBy("query_id").agg(F.coalesce(F.max(F.contains(F.col("text"), F.col("keyword"))), F.lit(False)).alias("hit"))
