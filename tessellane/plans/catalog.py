"""Registered queries over whole tables, each with its SQL twin where SQL can say it.

Documents are chunks by themselves here (chunk_id = doc_id), benchmark passages are the questions. The SQL tokenizers are those of
texts without Han, kana or Hangul, which is what the tables hold; the tests cover the other scripts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellane.functions import numeric, text
from tessellane.operators import chunking, evaluate, index, rerank, retrieval, search, stats, store
from tessellane.sources import files, sinks
from tessellane.streaming import counters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


_INDEXES: dict[tuple, index.Index] = {}


def indexed(spark: SparkSession, sf_dir: str, tokenizer: str = "lab", kind: str | None = None, vocabulary: int | None = None) -> index.Index:
    """The index of all documents, made by the first query of a session that asks for it; vectors are made on top by the first that needs them."""
    key = (spark.sparkContext.applicationId, sf_dir, tokenizer, kind, vocabulary)
    if key not in _INDEXES or not index.is_there(_INDEXES[key]):
        _INDEXES[key] = index.with_vectors(indexed(spark, sf_dir, tokenizer), kind, vocabulary) if kind else index.build(corpus(spark, sf_dir), tokenizer)
    return _INDEXES[key]


_STOP = ", ".join(f"'{w}'" for w in text.ENGLISH_STOP)
TOK = {
    "lab": f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda w: NOT list_contains([{_STOP}], w))",
    "pro": "list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+'), lambda w: lower(w))",
    "easy": "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')",
    "kit": "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')",
}


def base(tok: str = "lab", docs: str = "documents") -> str:
    t = TOK[tok]
    return f"""WITH d AS (SELECT doc_id AS chunk_id, text, {t} AS toks FROM {docs}),
q AS (SELECT item_id AS query_id, coalesce(text, '') AS text, {t} AS toks FROM benchmark),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, coalesce(nullif(avg(len(toks)), 0), 1) AS ml FROM d),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(toks) AS term FROM q) GROUP BY ALL),
bm AS (SELECT qt.query_id, tf.chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.toks) / ml))) AS score
  FROM qt JOIN tf ON qt.term = tf.term JOIN df ON df.term = tf.term JOIN d ON d.chunk_id = tf.chunk_id, st GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm)"""


def tfidf(kind: str = "lab", vocabulary: int | None = None) -> str:
    w = "(1 + ln(tf)) * (1 + ln((n + 1) / (df + 1)))" if kind == "lab" else "tf * (1 + ln((n + 1) / (df + 1)))"
    voc = f"(SELECT * FROM df ORDER BY df DESC, term LIMIT {vocabulary})" if vocabulary else "df"
    return f""", voc AS {'MATERIALIZED ' if vocabulary else ''}(SELECT * FROM {voc}),
dw AS (SELECT chunk_id, term, {w} AS w FROM tf JOIN voc USING (term), st),
qw AS (SELECT query_id, term, {w.replace('tf', 'qtf')} AS w FROM qt JOIN voc USING (term), st),
dn AS (SELECT chunk_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY 1),
vs AS (SELECT query_id, chunk_id, dot / (dn * qn) AS score
  FROM (SELECT qw.query_id, dw.chunk_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw ON qw.term = dw.term GROUP BY ALL) JOIN dn USING (chunk_id) JOIN qn USING (query_id) WHERE dn > 0 AND qn > 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs)"""


_TOP = "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM {} WHERE rank <= {}"


def top(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Tokens, postings, statistics


@query(f"SELECT doc_id, CAST(len({TOK['lab']}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({TOK['lab']})) AS BIGINT) AS n_terms FROM documents")
def tokens(spark, sf_dir):
    got = retrieval.tokens(corpus(spark, sf_dir))
    return got.select(F.col("chunk_id").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


@query("SELECT doc_id, " + ", ".join(f"CAST(len({TOK[k]}) AS BIGINT) AS {k}, md5(array_to_string({TOK[k]}, ' ')) AS {k}_tokens" for k in TOK) + " FROM documents")
def tokenizers(spark, sf_dir):
    """How many tokens, and which (a digest of them, in order)."""
    cols = []
    for k, f in text.TOKENIZERS.items():
        got = f(F.col("text"))
        cols += [F.size(got).cast("long").alias(k), F.md5(F.array_join(got, " ")).alias(f"{k}_tokens")]
    return corpus(spark, sf_dir).select("doc_id", *cols)


_CJK_RUN = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]+"
_RUN_PARTS = "list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda i: r[i : i + 1]))"
_HAN_STOP = ", ".join(f"'{w}'" for w in text.HAN_STOP)


@query(rf"""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') || ' ' || ['什么是回滚流程，V2 一下', '部署かな検索 Deploy_x', '한국어 AI、㐀㐁是'][turn % 3 + 1] AS t FROM conversations),
p AS (SELECT *, list_transform(regexp_extract_all(t, '[a-zA-Z0-9]+|[\x{{4e00}}-\x{{9fff}}]'), lambda x: lower(x)) AS w FROM m)
SELECT conv_id, turn, role, list_concat(w, list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN w[i] >= '一' AND w[i + 1] >= '一' THEN w[i] || w[i + 1] END), lambda x: x IS NOT NULL)) AS pro,
  list_filter(flatten(list_transform(regexp_extract_all(lower(t), '[a-z0-9_]+|[\x{{3400}}-\x{{9fff}}]+'), lambda r: CASE WHEN r < '㐀' THEN [r] ELSE {_RUN_PARTS} END)), lambda x: NOT list_contains([{_STOP}, {_HAN_STOP}], x)) AS lab,
  list_concat(regexp_extract_all(lower(t), '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(t, '{_CJK_RUN}'), lambda r: {_RUN_PARTS}))) AS easy,
  regexp_extract_all(lower(t), '[a-z0-9]+|[\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}]') AS kit FROM p""")
def cjk_tokens(spark, sf_dir):
    """Conversations hold no Han, kana or Hangul, so some is added, by turn."""
    added = F.get(F.array(*map(F.lit, ("什么是回滚流程，V2 一下", "部署かな検索 Deploy_x", "한국어 AI、㐀㐁是"))), (F.col("turn") % 3).cast("int"))
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), added)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", *[f(t).alias(k) for k, f in text.TOKENIZERS.items()])


@query(base() + " SELECT chunk_id, term, tf FROM tf")
def term_freq(spark, sf_dir):
    return retrieval.postings(retrieval.tokens(corpus(spark, sf_dir)))


@query(base() + " SELECT term, df FROM df")
def doc_freq(spark, sf_dir):
    return retrieval.tokens(corpus(spark, sf_dir)).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(base() + " SELECT n, round(ml, 6) AS mean_length, (SELECT CAST(sum(len(toks)) AS BIGINT) FROM d) AS total FROM st")
def corpus_stats(spark, sf_dir):
    return retrieval.corpus_stats(retrieval.tokens(corpus(spark, sf_dir))).select("n", F.round("mean_length", 6).alias("mean_length"), "total")


# Lexical, vector and hybrid ranking


@query(base() + " " + _TOP.format("bmr", 10))
def bm25_topk(spark, sf_dir):
    return top(search.lexical(indexed(spark, sf_dir), questions(spark, sf_dir), 10))


@query(base(docs="(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))") + " " + _TOP.format("bmr", 5))
def bm25_scoped(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return top(search.lexical(index.scoped(indexed(spark, sf_dir), good, vectors=False), questions(spark, sf_dir), 5))


@query(base() + tfidf() + " " + _TOP.format("vr", 10))
def tfidf_topk(spark, sf_dir):
    return top(search.lexical(indexed(spark, sf_dir, "lab", "lab"), questions(spark, sf_dir), 10, ("vector",)))


@query(base("pro") + tfidf("pro", 4096) + " " + _TOP.format("vr", 10))
def tfidf_vocabulary_topk(spark, sf_dir):
    return top(search.lexical(indexed(spark, sf_dir, "pro", "pro", 4096), questions(spark, sf_dir), 10, ("vector",)))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, len(hex(encode(term))) + 1, 2), lambda i: ('0x' || hex(encode(term))[i:i+1])::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query(base("kit") + f", ix AS (SELECT term, df, {_FNV} % 4096 AS idx FROM df) SELECT chunk_id, idx, round(sum((1 + ln(tf)) * (1 + ln((n + 1) / (df + 1)))), 6) AS w FROM tf JOIN ix USING (term), st GROUP BY chunk_id, idx")
def fnv_tfidf(spark, sf_dir):
    return retrieval.hashed_tfidf(corpus(spark, sf_dir)).select("chunk_id", "idx", F.round("w", 6).alias("w"))


@query(base("kit") + f""", ix AS (SELECT term, df, {_FNV} % 4096 AS idx FROM (SELECT term, coalesce(df, 0) AS df FROM (SELECT term FROM tf UNION SELECT term FROM qt) LEFT JOIN df USING (term))),
dv AS (SELECT chunk_id, idx, sum((1 + ln(tf)) * (1 + ln((n + 1) / (df + 1)))) AS w FROM tf JOIN ix USING (term), st GROUP BY ALL),
qv AS (SELECT query_id, idx, sum((1 + ln(qtf)) * (1 + ln((n + 1) / (df + 1)))) AS w FROM qt JOIN ix USING (term), st GROUP BY ALL),
dn AS (SELECT chunk_id, sqrt(sum(w * w)) AS dn FROM dv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qv GROUP BY 1),
vs AS (SELECT query_id, chunk_id, sum(qv.w * dv.w) / any_value(dn) / any_value(qn) AS score FROM qv JOIN dv USING (idx) JOIN dn USING (chunk_id) JOIN qn USING (query_id) GROUP BY 1, 2),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs) """ + _TOP.format("vr", 5))
def fnv_topk(spark, sf_dir):
    return top(retrieval.ranked(retrieval.hashed_search(corpus(spark, sf_dir), questions(spark, sf_dir), pool=5), 5))


# CRC-32 byte by byte, from a table of 256 entries that is made here.
_CRC = """, crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS tbl),
ht AS (SELECT term, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(term))) + 1, 2), lambda i: ('0x' || hex(encode(term))[i:i+1])::BIGINT)),
  lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h FROM (SELECT DISTINCT term FROM df) t, crc),
hw AS (SELECT ht.term, h % 2048 AS idx, CASE WHEN h & 2 <> 0 THEN 1 ELSE -1 END * ln(1 + (n - df + 0.5) / (df + 0.5)) AS signed FROM ht JOIN df ON ht.term = df.term, st),
raw AS (SELECT chunk_id, idx, sum((1 + ln(tf)) * signed) AS w FROM tf JOIN hw USING (term) GROUP BY ALL), dl AS (SELECT chunk_id, sqrt(sum(w * w)) AS dn FROM raw GROUP BY 1),
emb AS (SELECT chunk_id, idx, w / dn AS w FROM raw JOIN dl USING (chunk_id) WHERE dn > 0),
qraw AS (SELECT query_id, idx, sum((1 + ln(qtf)) * signed) AS w FROM qt JOIN hw USING (term) GROUP BY ALL), ql AS (SELECT query_id, sqrt(sum(w * w)) AS dn FROM qraw GROUP BY 1),
qemb AS (SELECT query_id, idx, w / dn AS w FROM qraw JOIN ql USING (query_id) WHERE dn > 0)"""


@query(base("easy") + _CRC + " SELECT chunk_id, CAST(idx AS BIGINT) AS idx, round(w, 6) AS w FROM emb")
def hash_embedding(spark, sf_dir):
    return retrieval.hash_embedding(corpus(spark, sf_dir)).select("chunk_id", F.col("idx").cast("long").alias("idx"), F.round("w", 6).alias("w"))


@query(base("easy") + _CRC + """, vs AS (SELECT query_id, chunk_id, sum(q.w * e.w) AS score FROM emb e JOIN qemb q USING (idx) GROUP BY 1, 2),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs) """ + _TOP.format("vr", 5))
def embedding_topk(spark, sf_dir):
    return top(retrieval.ranked(retrieval.embedding_search(corpus(spark, sf_dir), questions(spark, sf_dir), pool=5), 5))


_DENSE = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, list_cosine_similarity(q.vec, d.vec) AS score FROM v q JOIN v d ON {} WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) """


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


@query(_DENSE.format("TRUE") + _TOP.format("r", 5))
def dense_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    return top(search.dense(v, asked, 5, skip_own=True))


@query(_DENSE.format("q.label = d.label") + _TOP.format("r", 5))
def dense_scoped_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vec", "label")
    return top(search.dense(v, asked, 5, scope="label", skip_own=True))


_GATE = """, an AS (SELECT query_id, term FROM (SELECT *, max((length(term) >= 2 OR regexp_matches(term, '^[a-z0-9_]+$'))::INT) OVER (PARTITION BY query_id) AS s FROM qt)
  WHERE s = 0 OR length(term) >= 2 OR regexp_matches(term, '^[a-z0-9_]+$')),
gate AS (SELECT DISTINCT query_id, chunk_id FROM an JOIN tf USING (term))"""
_HYBRID = base() + tfidf() + _GATE + """, b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM bm JOIN gate USING (query_id, chunk_id)),
v AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM vs JOIN gate USING (query_id, chunk_id)),
u AS (SELECT query_id, chunk_id, r, 0 AS c FROM b WHERE r <= 20 UNION ALL SELECT query_id, chunk_id, r, 1 FROM v WHERE r <= 20),
f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + r)) AS score, max(CASE WHEN c = 0 THEN r END) AS bm25_rank, max(CASE WHEN c = 1 THEN r END) AS vector_rank FROM u GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f) """


@query(_HYBRID + "SELECT query_id, chunk_id, round(score, 6) AS score, bm25_rank, vector_rank, rank FROM h WHERE rank <= 4")
def hybrid_rrf(spark, sf_dir):
    got = search.hybrid(indexed(spark, sf_dir, "lab", "lab"), questions(spark, sf_dir), 4)
    return got.select("query_id", "chunk_id", F.round("score", 6).alias("score"), *[F.col(c).cast("long").alias(c) for c in ("bm25_rank", "vector_rank", "rank")])


@query(_HYBRID + "SELECT query_id, chunk_id, r AS rank FROM v WHERE r <= 4")
def mode_vector(spark, sf_dir):
    got = search.hybrid(indexed(spark, sf_dir, "lab", "lab"), questions(spark, sf_dir), 4, "vector")
    return got.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(_HYBRID + "SELECT query_id, chunk_id, r AS rank FROM b WHERE r <= 4")
def mode_bm25(spark, sf_dir):
    got = search.hybrid(indexed(spark, sf_dir), questions(spark, sf_dir), 4, "bm25")
    return got.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(base() + _GATE + " SELECT query_id, count(*) AS n_chunks FROM gate GROUP BY 1")
def lexical_gate(spark, sf_dir):
    return retrieval.lexical_gate(corpus(spark, sf_dir), questions(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n_chunks"))


_RELATED = base("pro") + """, e AS (SELECT DISTINCT chunk_id, term FROM tf), w AS (SELECT DISTINCT lower(regexp_extract(text, '[a-zA-Z0-9]+')) AS term FROM q),
c AS (SELECT a.term, b.term AS other, count(*) AS together FROM e a JOIN w ON a.term = w.term JOIN e b ON a.chunk_id = b.chunk_id AND a.term <> b.term GROUP BY 1, 2)
SELECT term, other, together, rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY together DESC, other) AS rank FROM c) WHERE rank <= 5"""


@query(_RELATED)
def related_terms(spark, sf_dir):
    """Of each passage's first word, in all documents."""
    first = questions(spark, sf_dir).select(F.lower(F.regexp_extract("text", "[a-zA-Z0-9]+", 0)).alias("term"))
    return search.related(indexed(spark, sf_dir, "pro"), first, 5).withColumn("rank", F.col("rank").cast("long"))


@query(base("pro") + """, a AS (SELECT item_id AS query_id, string_split(coalesce(text, ''), ' ')[1] || ' ' || string_split(coalesce(text, ''), ' ')[2] AS asked FROM benchmark),
o AS (SELECT query_id, asked, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM (SELECT query_id, asked, list_transform(regexp_extract_all(asked, '[a-zA-Z0-9]+'), lambda x: lower(x)) AS toks FROM a)),
e AS (SELECT DISTINCT chunk_id, term FROM tf), w AS (SELECT DISTINCT term FROM o WHERE length(term) > 1),
c AS (SELECT x.term, y.term AS other, count(*) AS together FROM e x JOIN w ON x.term = w.term JOIN e y ON x.chunk_id = y.chunk_id AND x.term <> y.term GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY together DESC, other) AS rank FROM c) WHERE rank <= 4 AND length(other) > 1),
f AS (SELECT query_id, other, min((pos, rank)) AS place FROM o JOIN r USING (term) WHERE length(term) > 1 GROUP BY 1, 2),
k AS (SELECT query_id, string_agg(other, ' ' ORDER BY n) AS added FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM f) WHERE n <= 4 GROUP BY 1)
SELECT query_id, asked || coalesce(' ' || added, '') AS text FROM a LEFT JOIN k USING (query_id)""")
def expand_query(spark, sf_dir):
    """The first two words of each passage, with terms of all documents."""
    parts = F.split("text", " ")
    asked = questions(spark, sf_dir).select("query_id", F.concat(F.get(parts, F.lit(0)), F.lit(" "), F.get(parts, F.lit(1))).alias("text"))
    return retrieval.expanded(corpus(spark, sf_dir), asked, 4, made=indexed(spark, sf_dir, "pro"))


# Reranking, selection, packing, answers


def candidates(spark, sf_dir, tokenizer: str, k: int = 20) -> DataFrame:
    """The first ``k`` by BM25 with their texts: query_id, chunk_id, score, rank, text, lang, source, query."""
    found = search.lexical(indexed(spark, sf_dir, tokenizer), questions(spark, sf_dir), k)
    return _with_texts(spark, sf_dir, found.drop("channel"))


def _with_texts(spark, sf_dir, found: DataFrame) -> DataFrame:
    docs, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    return found.join(docs.select("chunk_id", "text", "lang", "source"), "chunk_id").join(asked.withColumnRenamed("text", "query"), "query_id")


def channels(spark, sf_dir, tokenizer: str, kind: str, vocabulary: int | None = None) -> DataFrame:
    """The first 20 of either channel: query_id, chunk_id, lexical, vector (0 where a channel hasn't found it), with texts."""
    both = search.lexical(indexed(spark, sf_dir, tokenizer, kind, vocabulary), questions(spark, sf_dir), 20, ("bm25", "vector"))
    score = lambda c: F.coalesce(F.max(F.when(F.col("channel") == c, F.col("score"))), F.lit(0.0))
    return _with_texts(spark, sf_dir, both.groupBy("query_id", "chunk_id").agg(score("bm25").alias("lexical"), score("vector").alias("vector")))


_SHARE = """, o AS (SELECT c.*, CASE WHEN len(list_distinct(q.toks)) > 0 THEN len(list_intersect(list_distinct(q.toks), d.toks)) / len(list_distinct(q.toks)) ELSE 0 END AS share,
  d.text, z.lang, z.source FROM c JOIN d USING (chunk_id) JOIN q USING (query_id) JOIN documents z ON z.doc_id = c.chunk_id) """


def _first(tok: str) -> str:
    return base(tok) + ", c AS (SELECT query_id, chunk_id, score AS base FROM bmr WHERE rank <= 20)" + _SHARE


def _both(tok: str, kind: str, vocabulary: int | None = None) -> str:
    return base(tok) + tfidf(kind, vocabulary) + """, u AS (SELECT query_id, chunk_id, score AS l, NULL AS v FROM bmr WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, NULL, score FROM vr WHERE rank <= 20),
c AS (SELECT query_id, chunk_id, coalesce(max(l), 0) AS lexical, coalesce(max(v), 0) AS vector FROM u GROUP BY 1, 2)""" + _SHARE


_RANKED = "SELECT query_id, chunk_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM ({})"


def _reranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_both("pro", "pro", 4096) + _RANKED.format("SELECT *, 0.35 * CASE WHEN max(lexical) OVER w > 0 THEN greatest(0, lexical / max(lexical) OVER w) ELSE 0 END + 0.35 * CASE WHEN max(vector) OVER w > 0 THEN greatest(0, vector / max(vector) OVER w) ELSE 0 END + 0.10 / (1 + 0.01 * chunk_id) + 0.20 * share AS s FROM o WINDOW w AS (PARTITION BY query_id)"))
def rerank_weighted(spark, sf_dir):
    return _reranked(rerank.weighted(channels(spark, sf_dir, "pro", "pro", 4096).withColumn("ordinal", F.col("chunk_id"))))


@query(_first("kit") + _RANKED.format("SELECT *, base + 0.6 * share - 0.3 * CASE WHEN length(text) = 0 THEN 1 ELSE least(1, abs(log2(length(text) / 300)) / 5) END + CASE WHEN lang = 'en' AND source <> '' THEN 0.05 ELSE 0 END AS s FROM o"))
def rerank_coverage(spark, sf_dir):
    """English documents have their source for a heading here."""
    found = candidates(spark, sf_dir, "kit").withColumns({"base": F.col("score"), "heading": F.when(F.col("lang") == "en", F.col("source")).otherwise("")}).drop("score", "rank")
    return _reranked(rerank.covered(found))


@query(_both("easy", "lab") + _RANKED.format("SELECT *, 0.7 * share + 0.3 * greatest(0, vector) AS s FROM o"))
def rerank_overlap(spark, sf_dir):
    return _reranked(rerank.overlapped(channels(spark, sf_dir, "easy", "lab").withColumnRenamed("vector", "cosine")))


def _greedy(found: str, likeness: str, k: int = 5, lam: float = 0.7) -> str:
    """``k`` picks one after the other from ``found`` (query_id, chunk_id, score, x): each the best by score less likeness to those before."""
    steps = [f"""m AS MATERIALIZED ({found}), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM m),
k1 AS (SELECT query_id, chunk_id, score, x, 1 AS pick FROM i WHERE place = 1)"""]
    for n in range(2, k + 1):
        steps.append(f"""k{n} AS (SELECT * FROM k{n - 1} UNION ALL SELECT query_id, chunk_id, score, x, {n} FROM (
  SELECT i.query_id, i.chunk_id, any_value(i.score) AS score, any_value(i.x) AS x,
    row_number() OVER (PARTITION BY i.query_id ORDER BY round({lam} * round(any_value(i.score), 9) - {round(1 - lam, 9)} * max({likeness}), 9) DESC, any_value(i.place)) AS r
  FROM i JOIN k{n - 1} p ON i.query_id = p.query_id WHERE i.chunk_id NOT IN (SELECT chunk_id FROM k{n - 1} o WHERE o.query_id = i.query_id) GROUP BY i.query_id, i.chunk_id) WHERE r = 1)""")
    return ",\n".join(steps) + f" SELECT query_id, chunk_id, round(score, 6) AS score, CAST(pick AS BIGINT) AS pick FROM k{k}"


_JACCARD = "CASE WHEN len(list_distinct(list_concat(i.x, p.x))) = 0 THEN 0 ELSE len(list_intersect(i.x, p.x)) / len(list_distinct(list_concat(i.x, p.x))) END"


@query(base("pro") + ", " + _greedy("SELECT b.query_id, b.chunk_id, b.score, list_distinct(d.toks) AS x FROM bmr b JOIN d USING (chunk_id) WHERE rank <= 20", _JACCARD))
def mmr_select(spark, sf_dir):
    found = candidates(spark, sf_dir, "pro").withColumn("terms", F.array_distinct(text.tok_pro(F.col("text"))))
    return rerank.mmr(found.select("query_id", "chunk_id", "score", "terms"), 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("pick").cast("long").alias("pick"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, list_cosine_similarity(q.vec, d.vec) AS score, d.vec AS x FROM v q JOIN v d ON q.vec_id % 20 = 0), """ + _greedy("SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 15", "list_cosine_similarity(i.x, p.x)"))
def mmr_cosine_select(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    best = search.dense(v, asked, 15).join(v.select("chunk_id", F.col("vec").cast("array<double>").alias("vec")), "chunk_id")
    return rerank.mmr(best.select("query_id", "chunk_id", "score", "vec"), 5, 0.7, "cosine").select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("pick").cast("long").alias("pick"))


@query(base("pro") + ", h AS (SELECT b.query_id, b.chunk_id, rank, len(d.toks) AS cost FROM bmr b JOIN d USING (chunk_id) WHERE rank <= 20), u AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM h) SELECT query_id, chunk_id, rank, used FROM u WHERE used <= 1800 OR rank = 1")
def pack_break(spark, sf_dir):
    found = candidates(spark, sf_dir, "pro")
    return rerank.pack_until_full(found, 1800, text.estimate_tokens(F.col("text"))).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("used").cast("long").alias("used"))


def _chunk_hits(spark, sf_dir, k: int = 12) -> DataFrame:
    cut = chunking.chunks(read(spark, sf_dir, "documents"), "lab").select(F.concat_ws("-", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "start", "end", F.col("chunk").alias("text"))
    cut = index.materialized(cut, "cut")
    asked = questions(spark, sf_dir)
    best = search.lexical(index.build(cut), asked, k).drop("channel")
    return best.join(cut, "chunk_id").join(asked.withColumnRenamed("text", "query"), "query_id")


@query("""WITH m AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 4 = 0 THEN '' WHEN turn % 4 = 1 THEN ' [S1] and [S3].' ELSE ' [S' || turn || '] [S2]' END AS t FROM conversations),
c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(t, '\\[S(\\d+)\\]', 1), lambda n: n::INT) AS marks FROM m)
SELECT conv_id, turn, CAST(len(marks) AS BIGINT) AS n_cited, len(marks) > 0 AND len(list_filter(marks, lambda n: n < 1 OR n > 3)) = 0 AS holds FROM c""")
def citation_check(spark, sf_dir):
    """Conversations cite nothing, so marks that depend on the turn are added: none, good ones, and ones that no source has."""
    turn = F.col("turn")
    mark = F.when(turn % 4 == 0, "").when(turn % 4 == 1, " [S1] and [S3].").otherwise(F.concat(F.lit(" [S"), turn.cast("string"), F.lit("] [S2]")))
    t = F.concat(F.coalesce("text", F.lit("")), mark)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.cited(t)).cast("long").alias("n_cited"), text.citations_hold(t, F.lit(3)).alias("holds"))


# Evaluation

_GOLD = base() + """, gold AS (SELECT q.query_id, d.chunk_id FROM q JOIN d ON contains(coalesce(d.text, ''), q.text)),
hit AS (SELECT q.query_id, min(CASE WHEN g.chunk_id IS NOT NULL THEN b.rank END) AS hit_rank, count(b.rank) AS n_candidates FROM q LEFT JOIN (SELECT * FROM bmr WHERE rank <= 4) b USING (query_id) LEFT JOIN gold g ON g.query_id = b.query_id AND g.chunk_id = b.chunk_id GROUP BY 1),
pos AS (SELECT hit.* FROM hit WHERE query_id IN (SELECT query_id FROM gold)), neg AS (SELECT hit.* FROM hit WHERE query_id NOT IN (SELECT query_id FROM gold)) """


def _hits(spark, sf_dir):
    asked = questions(spark, sf_dir)
    # Asked for twice: a row for each passage found, so it is stored.
    gold = index.materialized(search.containing(corpus(spark, sf_dir), asked), "gold").withColumnRenamed("chunk_id", "gold_id")
    best = search.lexical(indexed(spark, sf_dir), asked, 4).select("query_id", "chunk_id", "rank")
    right = best.join(gold, (best["query_id"] == gold["query_id"]) & (best["chunk_id"] == gold["gold_id"]), "left").select(best["query_id"], "chunk_id", "rank", "gold_id")
    return evaluate.first_hits(asked.select("query_id"), right, F.col("gold_id").isNotNull()), gold


@query(_GOLD + "SELECT count(*) AS n_cases, round(avg(CASE WHEN hit_rank <= 4 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN hit_rank <= 4 THEN 1.0 / hit_rank ELSE 0 END), 6) AS mrr FROM pos")
def eval_hit_mrr(spark, sf_dir):
    hits, gold = _hits(spark, sf_dir)
    return evaluate.quality(hits.join(gold.select("query_id").distinct(), "query_id", "left_semi"), 4).select("n_cases", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@query(_GOLD + "SELECT count(*) AS n_cases, avg((n_candidates = 0)::INT::DOUBLE) AS no_candidate_rate FROM neg")
def eval_negative_rate(spark, sf_dir):
    hits, gold = _hits(spark, sf_dir)
    return evaluate.no_candidate_rate(hits.join(gold.select("query_id").distinct(), "query_id", "left_anti"))


@query(base() + ", k AS (SELECT query_id, string_split(text, ' ')[1] AS keyword FROM q) SELECT k.query_id, coalesce(bool_or(contains(d.text, keyword)), FALSE) AS hit FROM k LEFT JOIN (SELECT * FROM bmr WHERE rank <= 4) b USING (query_id) LEFT JOIN d USING (chunk_id) GROUP BY 1")
def eval_keyword_hit(spark, sf_dir):
    asked = questions(spark, sf_dir)
    cases = asked.select("query_id", F.get(F.split("text", " "), F.lit(0)).alias("keyword"))
    return evaluate.keyword_hits(cases, candidates(spark, sf_dir, "lab", 4).select("query_id", "text"))


# Chunkers


@query("SELECT doc_id, CAST(i AS BIGINT) + 1 AS ordinal, substring(text, CAST(i * 500 + 1 AS BIGINT), 500) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents WHERE text IS NOT NULL)")
def hard_split(spark, sf_dir):
    return chunking.fixed_chunks(read(spark, sf_dir, "documents")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk")


# What Python calls white space; the expressions of SQL know the ASCII part only.
_WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _window_end(start: str) -> str:
    """The end of a window: the last cut that stands in its second half, found by a greedy expression."""
    cut = f"length(regexp_extract(substring(text, {start} + 251, 250), '(?s)^.*(?:\\n|[。！？.!?][{_WS}])'))"
    return f"CASE WHEN {start} + 500 >= length(text) THEN length(text) WHEN {cut} > 0 THEN {start} + 250 + {cut} ELSE {start} + 500 END"


#: cut: doc_id, ordinal, start, stop, chunk, by following each document from window to window.
_LAB_CUT = f"""walk(doc_id, text, s, e) AS (SELECT doc_id, text, 0::BIGINT, ({_window_end("0")})::BIGINT FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, ns, ({_window_end("ns")})::BIGINT FROM (SELECT doc_id, text, greatest(s + 1, e - 80) AS ns FROM walk WHERE e < length(text))),
cut AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS ordinal, s AS start, e AS stop, substring(text, s + 1, e - s) AS chunk FROM walk WHERE regexp_matches(substring(text, s + 1, e - s), '[^{_WS}]'))"""


def _cut(spark, sf_dir, name: str) -> DataFrame:
    return chunking.chunks(read(spark, sf_dir, "documents"), name).withColumns({c: F.col(c).cast("long") for c in ("ordinal", "start", "end")})


@query(f'WITH RECURSIVE {_LAB_CUT} SELECT doc_id, ordinal, start, stop AS "end", NULL::VARCHAR AS heading, chunk FROM cut')
def chunk_lab(spark, sf_dir):
    return _cut(spark, sf_dir, "lab")


_STRIPPED = f"regexp_replace(regexp_replace(x, '^[{_WS}]+', ''), '[{_WS}]+$', '')"


@query(f"""WITH RECURSIVE parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;])[{_WS}]*', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIPPED}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
walk(doc_id, p, i, held, made) AS (SELECT doc_id, p, 0::BIGINT, '', []::VARCHAR[] FROM parts
  UNION ALL SELECT doc_id, p, i + 1,
    CASE WHEN i = len(p) THEN '' WHEN length(p[i + 1]) > 500 THEN '' WHEN length(held) + length(p[i + 1]) <= 500 THEN held || p[i + 1] ELSE right(held, 100) || p[i + 1] END,
    CASE WHEN i = len(p) THEN [held] WHEN length(p[i + 1]) > 500 THEN list_prepend(held, list_transform(range((length(p[i + 1]) + 499) // 500), lambda k: substring(p[i + 1], k * 500 + 1, 500)))
      WHEN length(held) + length(p[i + 1]) <= 500 THEN [] ELSE [held] END
  FROM walk WHERE i <= len(p)),
flat AS (SELECT doc_id, i, unnest(made) AS chunk, generate_subscripts(made, 1) AS k FROM walk)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS ordinal, NULL::BIGINT AS start, NULL::BIGINT AS "end", NULL::VARCHAR AS heading, chunk FROM flat WHERE regexp_matches(chunk, '[^{_WS}]')""")
def chunk_easy(spark, sf_dir):
    return _cut(spark, sf_dir, "easy")


def _parts(marks: str, text: str) -> str:
    """The stripped parts of a text that end after one of ``marks``, without empty ones."""
    return f"list_filter(list_transform(string_split(regexp_replace({text}, '([{marks}])[{_WS}]*', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIPPED}), lambda x: x <> '')"


_PARAGRAPHS = f"""paras AS (SELECT doc_id, p, row_number() OVER () AS pos FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '\\n[{_WS}]*\\n', chr(1), 'g'), chr(1)), lambda x: {_STRIPPED}), lambda x: x <> '')) AS p FROM documents WHERE text IS NOT NULL))"""


def _sums(parts: str, each: str) -> str:
    """0 and the running totals of an expression over a list."""
    return f"list_transform(range(len({parts}) + 1), lambda k: coalesce(list_sum(list_transform({parts}[1:k], lambda x: {each})), 0)::BIGINT)"


def _groups(walk: str, source: str, key: str, size: int, overlap: int) -> str:
    """Groups of parts with whole-part overlap: ``walk`` (key, parts, cum, s, e) follows each row of ``source`` (key, parts, cum)."""
    stop = lambda s, e: f"greatest({e} + 1, len(list_filter(cum, lambda x: x <= cum[{s} + 1] + {size})) - 1)"
    return f"""{walk}({key}, parts, cum, s, e) AS (SELECT {key}, parts, cum, 0::BIGINT, ({stop("0", "0")})::BIGINT FROM {source} WHERE len(parts) > 0
  UNION ALL SELECT {key}, parts, cum, ns, ({stop("ns", "e")})::BIGINT FROM (SELECT *, least(e - 1, greatest(s, len(list_filter(cum, lambda x: x < cum[e + 1] - {overlap})))) AS ns FROM {walk} WHERE e < len(parts)))"""


@query(f"""WITH RECURSIVE {_PARAGRAPHS},
sent AS (SELECT doc_id, pos, list_filter(string_split(regexp_replace(p, '([。．！？!?])', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^{_WS}]')) AS parts FROM paras WHERE length(p) > 400),
sums AS (SELECT doc_id, pos, parts, {_sums("parts", "length(x)")} AS cum FROM sent),
{_groups("inner_", "sums", "doc_id, pos", 400, 50)},
whole AS (SELECT doc_id, pos, s, array_to_string(parts[s + 1 : e], '') AS w FROM inner_),
small AS (SELECT doc_id, pos, 0 AS s, 0 AS k, p AS part FROM paras WHERE length(p) <= 400
  UNION ALL SELECT doc_id, pos, s, k, substring(w, k + 1, 400) FROM (SELECT doc_id, pos, s, w, unnest(CASE WHEN length(w) <= 400 THEN [0] ELSE range(0, length(w), 350) END) AS k FROM whole)),
docs AS (SELECT doc_id, list(part ORDER BY pos, s, k) AS parts FROM small GROUP BY 1),
dsum AS (SELECT doc_id, parts, {_sums("parts", "length(x)")} AS cum FROM docs),
{_groups("outer_", "dsum", "doc_id", 400, 50)}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS ordinal, NULL::BIGINT AS start, NULL::BIGINT AS "end", array_to_string(parts[s + 1 : e], chr(10)) AS chunk,
  coalesce(list_filter(parts[1 : least(e + 1, len(parts))], lambda x: regexp_matches(x, '^(?:#{{1,6}}[{_WS}]|【[^】]+】)'))[-1], '') AS heading FROM outer_""")
def chunk_kit(spark, sf_dir):
    return _cut(spark, sf_dir, "kit")


@query(f"""WITH RECURSIVE {_PARAGRAPHS},
sent AS (SELECT doc_id, pos, CASE WHEN length(p) <= 400 THEN [p] ELSE {_parts("。！？!?；;", "p")} END AS parts FROM paras),
sums AS (SELECT doc_id, pos, parts, {_sums("parts", "length(x) + 1")} AS cum FROM sent),
walk(doc_id, pos, parts, cum, s, e) AS (SELECT doc_id, pos, parts, cum, 0::BIGINT, least(len(list_filter(cum, lambda x: x < 400)), len(parts))::BIGINT FROM sums
  UNION ALL SELECT doc_id, pos, parts, cum, ns, least(len(list_filter(cum, lambda x: x < cum[ns + 1] + 400)), len(parts))::BIGINT FROM (SELECT *, greatest(s + 1, len(list_filter(cum, lambda x: x <= cum[e + 1] - 60)) - 1) AS ns FROM walk WHERE e < len(parts))),
made AS (SELECT doc_id, pos, s, list_transform([array_to_string(parts[s + 1 : e], '')], lambda x: {_STRIPPED})[1] AS chunk FROM walk)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, s) AS ordinal, NULL::BIGINT AS start, NULL::BIGINT AS "end", NULL::VARCHAR AS heading, chunk FROM made WHERE chunk <> ''""")
def chunk_pro(spark, sf_dir):
    return _cut(spark, sf_dir, "pro")


def _packed(budget: int, most: int) -> str:
    """Rows of hits (query_id, rank, doc_id, s, e, text) one rank after the other, with what is taken so far."""
    clash = "len(list_filter(taken, lambda t: t.d = h.doc_id AND 2 * (least(t.e, h.e) - greatest(t.s, h.s)) > greatest(1, least(t.e - t.s, h.e - h.s)))) > 0"
    steps = ["p0 AS (SELECT DISTINCT query_id, 0 AS rank, NULL::VARCHAR AS chunk_id, 0::BIGINT AS used, []::STRUCT(d BIGINT, s BIGINT, e BIGINT)[] AS taken, NULL::VARCHAR AS reason FROM hits)"]
    for k in range(1, most + 1):
        steps.append(f"""p{k} AS (SELECT query_id, rank, chunk_id, CASE WHEN reason IS NULL THEN used + n ELSE used END AS used, CASE WHEN reason IS NULL THEN list_append(taken, own) ELSE taken END AS taken, reason
  FROM (SELECT h.query_id, h.rank, h.chunk_id, used, taken, length(h.text) AS n, {{'d': h.doc_id, 's': h.s, 'e': h.e}} AS own, CASE WHEN {clash} THEN 'overlap' WHEN used + length(h.text) > {budget} THEN 'budget' END AS reason
    FROM p{k - 1} p JOIN hits h ON h.query_id = p.query_id AND h.rank = {k}))""")
    rows = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, most + 1))
    return ",\n".join(steps) + f" SELECT query_id, chunk_id, rank, CASE WHEN reason IS NULL THEN 'S' || len(taken) END AS citation, reason FROM ({rows})"


_OVER_CHUNKS = base(docs="(SELECT doc_id || '-' || ordinal AS doc_id, chunk AS text FROM cut)").replace("WITH d AS", f"WITH RECURSIVE {_LAB_CUT}, d AS", 1)


@query(_OVER_CHUNKS + """, hits AS MATERIALIZED (SELECT b.query_id, b.rank, b.chunk_id, c.doc_id, c.start AS s, c.stop AS e, c.chunk AS text FROM bmr b JOIN cut c ON c.doc_id || '-' || c.ordinal = b.chunk_id WHERE rank <= 12),
""" + _packed(2000, 12))
def pack_skip(spark, sf_dir):
    hits = _chunk_hits(spark, sf_dir).select("query_id", "rank", "chunk_id", "doc_id", "start", "end", "text")
    return rerank.pack_skipping(hits, 2000).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "citation", "reason")


def _tokens(x: str, tok: str) -> str:
    return TOK[tok].replace("coalesce(text, '')", x)


def _cut_at(mark: str) -> str:
    """How much of the first 220 characters ends with the last ``mark``."""
    return f"220 - instr(reverse(left(flat, 220)), '{mark}') + 1"


_KEYS = base("pro") + f""", c AS (SELECT b.query_id, b.chunk_id, z.text, q.text AS query FROM bmr b JOIN documents z ON z.doc_id = b.chunk_id JOIN q USING (query_id) WHERE rank = 1),
p AS (SELECT *, {_parts("。！？!?；;", "text")} AS parts, list_filter(list_distinct({_tokens("query", "pro")}), lambda t: length(t) > 1) AS wanted, list_distinct({_tokens("query", "kit")}) AS kit,
  list_filter(string_split(replace(text, chr(10), '。'), '。'), lambda x: regexp_matches(x, '[^{_WS}]')) AS around FROM c),
n AS (SELECT *, list_transform(around, lambda x: len(list_intersect(kit, {_tokens("x", "kit")}))) AS hits FROM p),
a AS (SELECT *, list_position(hits, list_max(hits)) AS place FROM n),
f AS (SELECT *, trim(regexp_replace(CASE WHEN len(around) = 0 THEN text ELSE array_to_string(around[greatest(1, place - 1) : place + 1], '。') END, '[{_WS}]+', ' ', 'g')) AS flat FROM a)
SELECT query_id, chunk_id, list_filter(parts, lambda x: len(list_intersect(wanted, {_tokens("x", "pro")})) > 0)[1:3] AS sentences,
  CASE WHEN length(flat) <= 220 THEN flat {" ".join(f"WHEN instr(left(flat, 220), '{m}') > 0 AND {_cut_at(m)} - 1 > 110 THEN left(flat, {_cut_at(m)})" for m in "。．.!？")} ELSE left(flat, 220) || '…' END AS snippet FROM f"""


@query(_KEYS)
def key_sentences(spark, sf_dir):
    found = candidates(spark, sf_dir, "pro", 1)
    return found.select("query_id", "chunk_id", rerank.key_sentences(F.col("query"), F.col("text")).alias("sentences"), rerank.snippet(F.col("query"), F.col("text")).alias("snippet"))


_ANSWERS = _OVER_CHUNKS + """, hits AS MATERIALIZED (SELECT b.query_id, b.rank, b.chunk_id, c.doc_id, c.start AS s, c.stop AS e, c.chunk AS text FROM bmr b JOIN cut c ON c.doc_id || '-' || c.ordinal = b.chunk_id WHERE rank <= 4),
""" + _packed(6000, 4).replace(" SELECT query_id, chunk_id, rank, CASE", ", packed AS (SELECT query_id, chunk_id, rank, CASE", 1) + f"""),
src AS (SELECT p.query_id, p.rank, p.citation, h.text, list_distinct(q.toks) AS asked FROM packed p JOIN hits h USING (query_id, rank) JOIN q USING (query_id) WHERE citation IS NOT NULL),
anc AS (SELECT *, CASE WHEN len(list_filter(asked, lambda t: length(t) >= 2 OR regexp_matches(t, '^[a-z0-9_]+$'))) > 0 THEN list_filter(asked, lambda t: length(t) >= 2 OR regexp_matches(t, '^[a-z0-9_]+$')) ELSE asked END AS anchor,
  {_parts("。！？.!?", "regexp_replace(text, '" + chr(92) + "n+', chr(1), 'g')")} AS parts FROM src),
each AS (SELECT query_id, rank, citation, anchor, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM anc),
scored AS (SELECT *, len(list_intersect(anchor, {_tokens("part", "lab")})) AS n FROM each),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY n DESC, i) AS r FROM scored),
ex AS (SELECT query_id, rank, citation, max(n) AS score, string_agg(part, ' ' ORDER BY i) AS excerpt FROM best WHERE r <= 2 GROUP BY ALL),
good AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM ex QUALIFY score >= greatest(1, 0.6 * max(score) OVER (PARTITION BY query_id)) OR (max(score) OVER (PARTITION BY query_id) < 1 AND rank = min(rank) OVER (PARTITION BY query_id))),
few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM good)
SELECT query_id, string_agg('“' || excerpt || '” [' || citation || ']', chr(10) || chr(10) ORDER BY rank) AS answer FROM few WHERE nth <= 3 GROUP BY 1"""


@query(_ANSWERS)
def extractive_answer(spark, sf_dir):
    hits = _chunk_hits(spark, sf_dir, 4)
    packed = rerank.pack_skipping(hits.select("query_id", "rank", "chunk_id", "doc_id", "start", "end", "text", "query"), 6000).where("citation is not null")
    return rerank.extractive_answers(packed.select("query_id", "query", "rank", "citation", "text"))


# Store


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, left(sha256(text), 20) AS id FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_digest(spark, sf_dir):
    docs = store.digested(read(spark, sf_dir, "documents").where("text is not null"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.substring("digest", 1, 20).alias("id"))


_CHUNKS = "(SELECT doc_id, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS chars, count(c.i) AS chunks, count(CASE WHEN c.i % 2 = 0 THEN 1 END) AS embedded FROM documents d LEFT JOIN {_CHUNKS} c USING (doc_id) GROUP BY 1, 2")
def documents_listing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = chunking.fixed_chunks(docs).withColumn("embedding", F.when(F.col("ordinal") % 2 == 1, F.array(F.lit(1.0))))
    return store.listing(docs, cut).select("doc_id", F.col("chars").cast("long").alias("chars"), "chunks", "embedded")


@query(f"SELECT doc_id, CAST(i AS BIGINT) + 1 AS ordinal FROM {_CHUNKS} WHERE i % 2 = 1 OR i % 3 = 0")
def reindex_pending(spark, sf_dir):
    cut = chunking.fixed_chunks(read(spark, sf_dir, "documents"))
    i = F.col("ordinal") - 1
    cut = cut.withColumn("embedding", F.when(i % 2 == 0, F.array(F.lit(1.0)))).withColumn("embedding_key", F.when(i % 3 == 0, "old").otherwise("new"))
    return store.pending(cut, "new").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"SELECT doc_id, count(*) AS chunks FROM {_CHUNKS} WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def delete_cascade(spark, sf_dir):
    toxic = read(spark, sf_dir, "labels").where("toxic = 1")
    return store.without(chunking.fixed_chunks(read(spark, sf_dir, "documents")), toxic).groupBy("doc_id").agg(F.count("*").alias("chunks"))


# Sources


@query()
def html_nodes(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", files.html_text(F.col("html")).alias("text"), files.html_text(F.col("html"), True).alias("visible"))


def _as_csv(df: DataFrame) -> DataFrame:
    """``df`` written as CSV files and read by the engine's reader."""
    path = f"{index.working_dir(df.sparkSession)}/tessellane-csv-{uuid.uuid4().hex}"
    df.write.csv(path, header=True)
    return files.read_csv(df.sparkSession, path)


@query("SELECT CAST(n_nationkey AS VARCHAR) || ' | ' || trim(n_name) || ' | ' || CAST(n_regionkey AS VARCHAR) AS text FROM nation")
def csv_rows(spark, sf_dir):
    return files.rows_as_text(_as_csv(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")))


@query("SELECT 'r_regionkey: ' || CAST(r_regionkey AS VARCHAR) || chr(10) || 'r_name: ' || r_name AS text FROM region")
def csv_records(spark, sf_dir):
    return files.records_as_text(_as_csv(read(spark, sf_dir, "region").select("r_regionkey", "r_name")))


@query("""SELECT 'nations' AS path, n_nationkey + 3 AS line, 'Nations of the world' AS heading, [n_name, CAST(n_regionkey AS VARCHAR)] AS cells FROM nation""")
def markdown_rows(spark, sf_dir):
    """Rows of a Markdown page that the sink's row function writes, read back by the source."""
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 3).cast("int").alias("line"), sinks.markdown_row(F.col("n_name"), F.col("n_regionkey")).alias("text"))
    head = spark.createDataFrame([(0, "## Nations of the world"), (1, "| name | region |"), (2, "|---|:-:|"), (1000, "no row"), (1001, "| no | row")], "line int, text string")
    return files.markdown_tables(head.unionByName(n).withColumn("path", F.lit("nations"))).select("path", "line", "heading", "cells")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1")
def last_user_turn(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'user' and text is not null").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


@query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS messages FROM conversations GROUP BY 1")
def message_assembly(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("messages"))


# Batch statistics


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT lang, n, n * 100 / (sum(n) OVER ()) AS share FROM c),
r AS (SELECT *, 100 - CAST(sum(floor(share)) OVER () AS BIGINT) AS short, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, lang) AS place FROM s)
SELECT lang, n, CAST(floor(share) AS BIGINT) + (place <= short)::BIGINT AS percent FROM r""")
def largest_remainder(spark, sf_dir):
    return stats.largest_remainder(read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang")


@query("""WITH t AS (SELECT ['0', '少', '多'][l_linenumber % 3 + 1] AS money, ['少', '中', '多'][CAST(l_quantity AS BIGINT) % 3 + 1] AS time, ['否', '些', '是'][l_suppkey % 3 + 1] AS will, ['大', '中', '小'][l_partkey % 3 + 1] AS benefit FROM lineitem),
c AS (SELECT benefit, list_position(['0', '少', '多'], money) + list_position(['少', '中', '多'], time) + list_position(['否', '些', '是'], will) - 3 AS cost FROM t)
SELECT CASE WHEN benefit = '大' THEN CASE WHEN cost = 0 THEN '极高' WHEN cost <= 2 THEN '高' ELSE '一般' END WHEN benefit = '中' AND cost = 0 THEN '高' ELSE '一般' END AS tier, count(*) AS n FROM c GROUP BY 1""")
def tier_counts(spark, sf_dir):
    tag = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % 3).cast("int"))
    tags = (tag(stats.MONEY, F.col("l_linenumber")), tag(stats.TIME, F.col("l_quantity").cast("long")), tag(stats.WILL, F.col("l_suppkey")), tag("大中小", F.col("l_partkey")))
    return read(spark, sf_dir, "lineitem").groupBy(stats.tier(*tags).alias("tier")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT c_custkey AS source, unnest(list_concat([c_custkey], range(c_custkey + 2, c_custkey + 6))) AS target FROM customer)
SELECT source, CAST(target AS BIGINT) AS target, c_name AS title FROM t LEFT JOIN customer ON target = c_custkey""")
def xref_resolve(spark, sf_dir):
    c, key = read(spark, sf_dir, "customer"), F.col("c_custkey")
    named = F.concat(F.lit("见 "), key.cast("string"), F.lit("、"), (key + 2).cast("string"), F.lit("到"), (key + 5).cast("string"))
    got = stats.resolved(c.select(key.alias("source"), named.alias("text")), c.select(key.alias("entry"), F.col("c_name").alias("title")))
    return got.select("source", F.col("target").cast("long").alias("target"), "title")


@query("""WITH b AS (SELECT list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || h[i:i+1])::BIGINT) AS ids FROM (SELECT hex(encode(p_name)) AS h FROM part)),
p AS (SELECT unnest(list_zip(ids[:-2], ids[2:])) AS z FROM b WHERE len(ids) > 1) SELECT z[1] AS "left", z[2] AS "right", count(*) AS n FROM p GROUP BY 1, 2""")
def bpe_pairs(spark, sf_dir):
    raw = F.hex(F.encode("p_name", "UTF-8"))
    ids = read(spark, sf_dir, "part").select(F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long")).alias("ids"))
    return stats.pair_counts(ids)


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean_quantity, max(l_extendedprice) AS max_price, round(sum(l_discount), 4) AS sum_discount, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2")
def record_stats(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.max("l_extendedprice").alias("max_price"), F.round(F.sum("l_discount"), 4).alias("sum_discount"), F.countDistinct("l_suppkey").alias("suppliers")
    )


@query("""WITH l AS (SELECT vec_id AS query_id, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS logit, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, token) AS k FROM l), e AS (SELECT query_id, token, exp((logit - max(logit) OVER (PARTITION BY query_id)) / 0.5) AS e FROM r WHERE k <= 5)
SELECT query_id, CAST(token AS BIGINT) AS token, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS p FROM e""")
def next_token(spark, sf_dir):
    logits = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.posexplode("embedding").alias("token", "x")).select("query_id", "token", F.col("x").cast("double").alias("logit"))
    return stats.next_token(logits, 5, 0.5).select("query_id", F.col("token").cast("long").alias("token"), F.round("p", 6).alias("p"))


@query("""WITH s AS (SELECT label, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)
SELECT label, round(avg(-ln(greatest(e[1] / list_sum(e), 1e-300))), 6) AS loss FROM s GROUP BY 1""")
def text_loss(spark, sf_dir):
    p = F.element_at(numeric.softmax(F.transform("embedding", lambda x: x.cast("double"))), 1)
    return read(spark, sf_dir, "embeddings").select("label", p.alias("p")).groupBy("label").agg(F.round(numeric.cross_entropy(F.col("p")), 6).alias("loss"))


# Counters over time

_RATES = """WITH s AS (SELECT event_id, user_id, ts, value, lag(value) OVER w AS b, lag(ts) OVER w AS bt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN value >= b THEN value - b ELSE 0 END AS delta, (epoch_us(ts) - epoch_us(bt)) / 1e6 AS sec FROM s) """


@query(_RATES + "SELECT event_id, round(delta, 6) AS delta, round(CASE WHEN sec > 0 THEN delta / sec END, 6) AS rate FROM r")
def counter_rate(spark, sf_dir):
    got = counters.rates(read(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")
    return got.select("event_id", F.round("delta", 6).alias("delta"), F.round("rate", 6).alias("rate"))


@query(_RATES + "SELECT event_id, round(sum(coalesce(delta, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM r")
def session_total(spark, sf_dir):
    got = counters.rates(read(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")
    return counters.running_total(got, "user_id", "ts", "delta", "event_id").select("event_id", F.round("total", 4).alias("total"))


@query(_RATES + """, t AS (SELECT user_id, ts, delta, CASE WHEN sec > 0 THEN delta / sec END AS rate FROM r)
SELECT user_id, ts, round(delta, 6) AS delta, round(rate, 6) AS rate, round(sum(coalesce(delta, 0)) OVER w, 4) AS total,
  round(avg(rate) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) AS recent_mean FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def stream_rates(spark, sf_dir):
    """The stateful stream over all events, as a stream of files; its sink is read back."""
    path = f"{index.working_dir(spark)}/tessellane-stream-{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events").select("user_id", "ts", "value")
    events.write.parquet(f"{path}/in")  # a stream of files reads folders
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
    out = counters.stream_rates(stream, "user_id", "ts", "value")
    out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows").select("user_id", "ts", *[F.round(c, n).alias(c) for c, n in (("delta", 6), ("rate", 6), ("total", 4), ("recent_mean", 6))])


@query("SELECT event_id, round(sum(value) OVER w, 4) AS recent_sum, max(value) OVER w AS recent_max, count(value) OVER w AS recent_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def last_60(spark, sf_dir):
    got = counters.recent(read(spark, sf_dir, "events"), "user_id", "ts", "value", tie="event_id")
    return got.select("event_id", F.round("recent_sum", 4).alias("recent_sum"), "recent_max", "recent_n")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_windows(spark, sf_dir):
    got = counters.windowed(read(spark, sf_dir, "events"), "ts", "1 hour", "1 hour", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

