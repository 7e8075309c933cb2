"""A training corpus in four stages: toxicity, near-duplicates, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one starts.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellane.llm import mixing, packing, simhash, toxicity
from tessellane.llm.shared import store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, learned from ``labels`` on the documents at hand.

    Null and empty texts are scored as texts without words; repeated rows are scored alike; without labels all stay.
    """
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one of the smallest doc_id.

    Null and empty texts are one group; rows without doc_id come last in theirs; rows that repeat in doc_id and text are one.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as its source's target asks for.

    Null sources are one source; documents without words come in whole epochs only; repeated rows count each.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences.

    Null and empty texts are the end id alone; repeated rows are packed each. In all stages an empty table gives an empty table.
    """
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_duplicates", drop_near_duplicates), ("source_mix", mix_sources), ("best_fit_packing", pack)]
#: The classifier's arithmetic is no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
