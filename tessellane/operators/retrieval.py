"""Postings, statistics, lexical and vector ranking for a whole table of questions at once.

A corpus is a DataFrame (chunk_id, text, ...), questions are a DataFrame (query_id, text). A term statistic needed by a
question is computed for the questions' terms only: tokens are joined with the (distinct) question terms right after
they are split off, before anything is shuffled, so what is shuffled grows with the matches and not with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellane.functions.numeric import bm25, idf_bm25
from tessellane.functions.text import TOKENIZERS

RANK_DIGITS = 9


def tokens(corpus: DataFrame, tokenizer: str = "lab", key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, tokens array."""
    return corpus.select(key, TOKENIZERS[tokenizer](F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def postings(tokenized: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, term, tf."""
    return tokenized.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_freq(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(tokenized: DataFrame) -> DataFrame:
    """One row: n, mean_length (1 if there is nothing), total."""
    return tokenized.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg(F.size("tokens")), F.lit(0.0)), F.lit(1.0)).alias("mean_length"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total"))


def scoped(corpus: DataFrame, doc_ids: list | DataFrame | None, key: str = "doc_id") -> DataFrame:
    """The corpus of some documents, before any statistic: ``None`` means all, an empty list none."""
    if doc_ids is None:
        return corpus
    if isinstance(doc_ids, DataFrame):
        return corpus.join(doc_ids.select(key).distinct(), key, "left_semi")
    return corpus.where(F.col(key).isin(list(doc_ids))) if doc_ids else corpus.where(F.lit(False))


def question_terms(queries: DataFrame, tokenizer: str = "lab") -> DataFrame:
    """query_id, term, qtf."""
    return postings(tokens(queries, tokenizer, "query_id"), "query_id").withColumnRenamed("tf", "qtf")


def matches(tokenized: DataFrame, terms: DataFrame) -> DataFrame:
    """chunk_id, length, term, tf for the questions' terms only."""
    wanted = terms.select("term").distinct()
    split = tokenized.select("chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return split.join(wanted, "term").groupBy("chunk_id", "length", "term").agg(F.count("*").alias("tf"))


def bm25_scores(corpus: DataFrame, queries: DataFrame, tokenizer: str = "lab", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score, for all chunks that share a term with the question; question terms count once."""
    tokenized = tokens(corpus, tokenizer)
    terms = question_terms(queries, tokenizer)
    tf = matches(tokenized, terms)
    weighed = tf.join(doc_freq(tf), "term").crossJoin(F.broadcast(corpus_stats(tokenized)))
    part = weighed.select("term", "chunk_id", bm25(F.col("tf"), idf_bm25(F.col("n"), F.col("df")), F.col("length"), F.col("mean_length"), k1, b).alias("part"))
    return part.join(terms.select("query_id", "term"), "term").groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


def ranked(scores: DataFrame, pool: int | None = None, score: str = "score", key: str = "chunk_id", rank: str = "rank", digits: int = RANK_DIGITS) -> DataFrame:
    """1-based rank in each question: score to ``digits`` places, then key. ``pool`` keeps the first ranks only."""
    order = Window.partitionBy("query_id").orderBy(F.round(F.col(score), digits).desc(), F.col(key))
    out = scores.withColumn(rank, F.row_number().over(order))
    return out if pool is None else out.where(F.col(rank) <= pool)


def anchors(queries: DataFrame, tokenizer: str = "lab") -> DataFrame:
    """query_id, term: question terms of two characters or more or of ASCII; all terms where there is none."""
    terms = question_terms(queries, tokenizer)
    strong = (F.length("term") >= 2) | F.rlike("term", F.lit("^[a-z0-9_]+$"))
    any_strong = F.max(strong).over(Window.partitionBy("query_id"))
    return terms.withColumn("any_strong", any_strong).where(strong | ~F.col("any_strong")).select("query_id", "term")


def lexical_gate(corpus: DataFrame, queries: DataFrame, tokenizer: str = "lab") -> DataFrame:
    """query_id, chunk_id of the chunks that share an anchor with the question."""
    anchor = anchors(queries, tokenizer)
    split = tokens(corpus, tokenizer).select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return split.join(anchor, "term").select("query_id", "chunk_id").distinct()


def sparse_weights(postings: DataFrame, df: DataFrame, n: Column, kind: str, key: str = "chunk_id") -> DataFrame:
    """key, term, w: ``lab`` (1 + ln tf)(ln((N+1)/(df+1)) + 1), ``pro`` tf(1 + ln((N+1)/(df+1)))."""
    idf = 1 + F.log((n + 1) / (F.col("df") + 1))
    tf = 1 + F.log("tf") if kind == "lab" else F.col("tf")
    return postings.join(df, "term").select(key, "term", (tf * idf).alias("w"))


def tfidf_cosine(corpus: DataFrame, queries: DataFrame, tokenizer: str = "lab", kind: str = "lab", vocabulary: int | None = None) -> DataFrame:
    """query_id, chunk_id, score: cosine of TF-IDF vectors over the corpus vocabulary (its ``vocabulary`` most frequent terms)."""
    tokenized = tokens(corpus, tokenizer)
    all_postings = postings(tokenized)
    df = doc_freq(all_postings)
    if vocabulary:
        df = df.orderBy(F.col("df").desc(), "term").limit(vocabulary)
    stats = F.broadcast(tokenized.agg(F.count("*").alias("n")))
    df = df.crossJoin(stats)
    docs = sparse_weights(all_postings, df, F.col("n"), kind)
    asked = sparse_weights(question_terms(queries, tokenizer).withColumnRenamed("qtf", "tf"), df, F.col("n"), kind, "query_id")
    return sparse_cosine(docs, asked)


def sparse_cosine(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Cosine of (chunk_id, term, w) with (query_id, term, w), pairs with a common term only."""
    doc_norm = docs.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    ask_norm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    products = docs.join(asked.withColumnRenamed("w", "qw"), "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    joined = products.join(doc_norm, "chunk_id").join(ask_norm, "query_id")
    return joined.where("dn > 0 and qn > 0").select("query_id", "chunk_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score"))


def _single(rows: DataFrame) -> DataFrame:
    """An index's rows with one a chunk_id: where a chunk_id repeats, its rows are taken together."""
    if not rows.groupBy("chunk_id").count().where("count > 1").limit(1).count():
        return rows
    split = rows.select("chunk_id", F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("chunk_id", F.col("p.terms").alias("term")).agg(F.sum("p.counts").cast("int").alias("tf"))
    return split.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("p")).select("chunk_id", F.col("p.term").alias("terms"), F.col("p.tf").alias("counts"))


def _fnv(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def _buckets(hashed, buckets: int):
    """A pass over rows that begin with (term, w): idx is the term's bucket, and w changes sign as the hash says, if it does."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(t) for t in batch.column("term").to_pylist()]
            idx = np.array([h for h, _ in found], np.int64) % buckets
            w = batch.column("w").to_numpy(zero_copy_only=False) * np.array([sign for _, sign in found], float)
            yield pa.record_batch([batch.column("term"), batch.column("df"), pa.array(idx.astype(np.int32)), pa.array(w)], ["term", "df", "idx", "w"])

    return run


def _vectors(corpus: DataFrame, queries: DataFrame | None, tokenizer: str, buckets: int, hashed, idf, unit: bool, unknown: bool) -> tuple[DataFrame, DataFrame | None]:
    """chunk_id, idx, w (arrays) of the corpus, and query_id, idx, w (arrays) of the questions; terms that the corpus lacks have a frequency of 0 if ``unknown``."""
    from tessellane.operators import index

    made = index.build(corpus, tokenizer)
    plain = made.chunks.select("chunk_id", "terms", "counts")
    rows = _single(plain)
    # A frequency is a number of chunk_ids.
    frequencies = made.terms if rows is plain else rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(made.n)
    weights = lambda df: df.select("term", "df", idf(n, F.col("df")).alias("w")).mapInArrow(_buckets(hashed, buckets), "term string, df long, idx int, w double")
    known = index.materialized(weights(frequencies), "weights")
    docs = index.summed(index.looked_up(rows, known, "lab"), buckets, unit)
    if queries is None:
        return docs, None
    asked = _single(index.forward(queries, tokenizer, "query_id"))
    split = asked.select("chunk_id", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("chunk_id", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))
    if unknown:
        lacking = split.select("term").distinct().join(known, "term", "left_anti").select("term", F.lit(0).cast("long").alias("df"))
        known = known.join(split.select("term").distinct(), "term", "left_semi").unionByName(weights(lacking))
    parts = split.join(known, "term").select("chunk_id", F.array("idx").alias("idx"), F.array((1 + F.log("tf")) * F.col("w")).alias("w"))
    return docs, index.summed(parts, buckets, unit).withColumnRenamed("chunk_id", "query_id")


def _exploded(vectors: DataFrame) -> DataFrame:
    return vectors.select("chunk_id", F.explode(F.arrays_zip("idx", "w")).alias("p")).select("chunk_id", F.col("p.idx").cast("long").alias("idx"), F.col("p.w").alias("w"))


def _hashed_vectors(corpus: DataFrame, queries: DataFrame | None, buckets: int, n: int) -> tuple[DataFrame, DataFrame | None]:
    idf = lambda total, df: F.log((total + 1) / (df + 1)) + 1
    return _vectors(corpus, queries, ("features", n), buckets, lambda t: (_fnv(t), 1.0), idf, False, True)


def hashed_tfidf(corpus: DataFrame, buckets: int = 4096, n: int = 2) -> DataFrame:
    """chunk_id, idx, w: (1 + ln tf)(ln((N+1)/(df+1)) + 1) added up in FNV buckets."""
    return _exploded(_hashed_vectors(corpus, None, buckets, n)[0])


def hashed_search(corpus: DataFrame, queries: DataFrame, buckets: int = 4096, n: int = 2, pool: int | None = None) -> DataFrame:
    """query_id, chunk_id, score: cosine of FNV-hashed vectors; question terms that the corpus lacks have a frequency of 0. With ``pool``
    only rows that may be among a question's first ones."""
    from tessellane.operators import search

    return search.bucketed(*_hashed_vectors(corpus, queries, buckets, n), buckets, pool, unit=True)


def hash_embedding(corpus: DataFrame, buckets: int = 2048, tokenizer: str = "easy") -> DataFrame:
    """chunk_id, idx, w: signed CRC buckets of (1 + ln tf) idf, of length 1."""
    return _exploded(_embedded(corpus, None, buckets, tokenizer)[0])


def _signed_crc(term: str) -> tuple[int, float]:
    h = zlib.crc32(term.encode())
    return h, 1.0 if h & 2 else -1.0


def _embedded(corpus: DataFrame, queries: DataFrame | None, buckets: int, tokenizer: str) -> tuple[DataFrame, DataFrame | None]:
    # A term that the corpus lacks weighs nothing, so it is left out.
    return _vectors(corpus, queries, tokenizer, buckets, _signed_crc, idf_bm25, True, False)


def embedding_search(corpus: DataFrame, queries: DataFrame, buckets: int = 2048, tokenizer: str = "easy", pool: int | None = None) -> DataFrame:
    """query_id, chunk_id, score: inner product of signed hashed embeddings of length 1, of pairs that share a bucket. With ``pool``
    only rows that may be among a question's first ones."""
    from tessellane.operators import search

    return search.bucketed(*_embedded(corpus, queries, buckets, tokenizer), buckets, pool)


def fused(channels: list[DataFrame], k: int = 60, key: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """Reciprocal-rank fusion of ranked channels: query_id, key, score, and rank_1, rank_2, ... (null where not ranked)."""
    rows = None
    for i, channel in enumerate(channels):
        part = channel.select("query_id", key, F.col(rank).alias("r"), F.lit(i).alias("c"))
        rows = part if rows is None else rows.unionByName(part)
    ranks = [F.max(F.when(F.col("c") == i, F.col("r"))).alias(f"rank_{i + 1}") for i in range(len(channels))]
    return rows.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("r"))).alias("score"), *ranks)


#: Candidates of a channel before fusion, by profile; ``None`` is all.
POOLS = {
    "pro": lambda top_k: (20, 20), "easy": lambda top_k: (20, 20), "kit": lambda top_k: (max(5 * top_k, 20), None), "lab": lambda top_k: (max(4 * top_k, 20),) * 2,
}


def checked_mode(mode: str, top_k: int) -> int:
    """The candidate pool of scoped retrieval."""
    if mode not in ("hybrid", "bm25", "vector"):
        raise ValueError(f"unknown mode {mode}")
    if not 1 <= top_k <= 12:
        raise ValueError("top_k must be 1 to 12")
    return POOLS["lab"](top_k)[0]


def checked_questions(queries: DataFrame, longest: int = 2000) -> DataFrame:
    """``queries``; reading it fails where a question is blank or longer than ``longest`` characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fine = (F.trim(text) != "") & (F.length(text) <= longest)
    return queries.withColumn("text", F.when(fine, text).otherwise(F.raise_error(F.lit(f"a question must have 1 to {longest} characters")).cast("string")))


def checked_capacity(chunks: DataFrame, most: int = 3000) -> DataFrame:
    """``chunks``, or a ValueError if there are more than ``most``; an optional guard for small stores."""
    if chunks.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} chunks")
    return chunks


def hybrid(corpus: DataFrame, queries: DataFrame, top_k: int = 4, mode: str = "hybrid", tokenizer: str = "lab", k: int = 60) -> DataFrame:
    """Scoped retrieval from a corpus that has no index yet: see ``search.hybrid``."""
    from tessellane.operators import index, search

    checked_mode(mode, top_k)
    return search.hybrid(index.build(corpus, tokenizer, "lab"), queries, top_k, mode, k)


def related_terms(corpus: DataFrame, terms: DataFrame, n: int = 5, tokenizer: str = "pro") -> DataFrame:
    """term, other, together, rank of a corpus that has no index yet: see ``search.related``."""
    from tessellane.operators import index, search

    return search.related(index.build(corpus, tokenizer), terms, n)


def expanded(corpus: DataFrame, queries: DataFrame, n: int = 4, tokenizer: str = "pro", made=None) -> DataFrame:
    """query_id, text: the question with up to ``n`` related terms, taken term by term in question order. ``made`` is the corpus's index, if there is one."""
    from tessellane.operators import index, search

    own = tokens(queries, tokenizer, "query_id").select("query_id", F.posexplode("tokens").alias("pos", "term")).where(F.length("term") > 1)
    related = search.related(made or index.build(corpus, tokenizer), own.select("term"), n).where(F.length("other") > 1)
    first = own.join(related, "term").groupBy("query_id", "other").agg(F.min(F.struct("pos", "rank")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.pos", "at.rank")
    few = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    added = few.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "other"))), lambda x: x["other"]), " ").alias("added"))
    return queries.join(added, "query_id", "left").select("query_id", F.when(F.col("added").isNull(), F.col("text")).otherwise(F.concat_ws(" ", "text", "added")).alias("text"))
