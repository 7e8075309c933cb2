"""A lexical index: made once from a corpus, read by many searches.

The index is forward: a row a chunk with its distinct terms, how often each occurs, and the lengths of its vectors. It is made
in one pass without a shuffle; only document frequencies and vector lengths need one. Searches read it in one pass.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellane.functions.text import LISTS, list_features

_FALLBACK_DIR = "/tmp/checkpoints/tessellane"
_PREFIX = "tessellane-index-"


def working_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _FALLBACK_DIR).rstrip("/")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read back."""
    spark: SparkSession = df.sparkSession
    path = f"{working_dir(spark)}/{_PREFIX}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialized`` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith(_PREFIX):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class Index:
    """``chunks``: chunk_id, length, terms, counts, norm (null where searches make it, or without ``kind``); ``terms``: term, df, in_vectors; n chunks of ``mean_length`` tokens."""

    chunks: DataFrame
    terms: DataFrame
    n: int
    mean_length: float
    tokenizer: str
    kind: str | None = None
    vocabulary: int | None = None

    def discard(self) -> None:
        discard(self.chunks, self.terms)

    def statistics(self) -> DataFrame:
        """One row: chunks, terms, tokens, mean_length."""
        words = self.terms.agg(F.count("*").alias("terms"))
        return self.chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).crossJoin(words).withColumn("mean_length", F.lit(self.mean_length))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and about ``most`` bytes in a column of strings, a row at least: what Spark makes a
    batch grows with the files until it is 64 MB, and what Python makes of it is many times that."""
    for whole in batches:
        if not whole.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        s = 0
        while s < whole.num_rows:
            e = min(s + rows, max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right"))))
            yield whole.slice(s, e - s)
            s = e


#: Characters (bytes) and texts that a task turns into terms at a time.
TEXTS, TEXT_ROWS = 1 << 20, 512


def forward(corpus: DataFrame, tokenizer: str | tuple[str, int] = "lab", key: str = "chunk_id", text: str = "text") -> DataFrame:
    """chunk_id, length, terms, counts: the distinct tokens of each text and how often each occurs; no shuffle.

    ``tokenizer`` is one of ``text.LISTS``, or ``("features", n)``.
    """
    kind = corpus.schema[key].dataType.simpleString()
    split = LISTS[tokenizer] if isinstance(tokenizer, str) else partial(list_features, n=tokenizer[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, TEXTS, TEXT_ROWS):
            terms, counts, lengths, at = [], [], [], [0]
            for t in batch.column(1).to_pylist():
                found = Counter(split(t))
                terms += found
                counts += found.values()
                lengths.append(found.total())
                at.append(len(terms))
            places = pa.array(at, pa.int32())
            yield pa.record_batch(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(places, pa.array(terms, pa.string())), pa.ListArray.from_arrays(places, pa.array(counts, pa.int32()))],
                ["chunk_id", "length", "terms", "counts"],
            )

    texts = corpus.select(F.col(key).alias("chunk_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"chunk_id {kind}, length long, terms array<string>, counts array<int>")


def weight(kind: str, tf, df, n):
    """``lab`` (1 + ln tf)(ln((N+1)/(df+1)) + 1), ``pro`` tf(1 + ln((N+1)/(df+1)))."""
    return (1 + F.log(tf) if kind == "lab" else tf) * (1 + F.log((n + 1) / (df + 1)))


def build(corpus: DataFrame, tokenizer: str | tuple[str, int] = "lab", kind: str | None = None, vocabulary: int | None = None, key: str = "chunk_id") -> Index:
    """The index of ``corpus`` (chunk_id, text). ``kind`` (lab, pro) adds TF-IDF vectors over the ``vocabulary`` most frequent terms
    (all, if it is None)."""
    rows = materialized(forward(corpus, tokenizer, key), "chunks")
    return _complete(rows, tokenizer, kind, vocabulary)


def scoped(index: Index, chunk_ids: DataFrame, vectors: bool = True) -> Index:
    """The index of some chunks only (chunk_id), with statistics of those; without ``vectors`` for BM25 alone."""
    # Read for terms, statistics and each search: joined once.
    rows = materialized(index.chunks.drop("norm").join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi"), "scoped")
    return _complete(rows, index.tokenizer, index.kind if vectors else None, index.vocabulary)


def is_there(index: Index) -> bool:
    """Whether the files of an index are still in the shared folder."""
    spark = index.chunks.sparkSession
    for file in (*index.chunks.inputFiles()[:1], *index.terms.inputFiles()[:1]):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return False
    return True


def _complete(rows: DataFrame, tokenizer: str, kind: str | None, vocabulary: int | None) -> Index:
    terms = materialized(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.lit(True).alias("in_vectors")), "terms")
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    plain = Index(rows.withColumn("norm", F.lit(None).cast("double")), terms, stats["n"], stats["mean"] or 1.0, tokenizer)
    return with_vectors(plain, kind, vocabulary) if kind else plain


#: Of how many of the most frequent terms the tasks are told what they weigh. The others are rare, and their few postings are joined.
HEAD = 1 << 16


def with_vectors(index: Index, kind: str, vocabulary: int | None = None) -> Index:
    """The index with TF-IDF vectors of a kind. Searches over at most ``HEAD`` terms make the lengths of vectors themselves; else they are made here."""
    rows = index.chunks.drop("norm")
    if vocabulary:
        most = index.terms.orderBy(F.col("df").desc(), "term").limit(vocabulary).select("term", F.lit(True).alias("in_vectors"))
        terms = materialized(index.terms.drop("in_vectors").join(most, "term", "left").fillna(False, ["in_vectors"]), "terms")
        made = Index(index.chunks, terms, index.n, index.mean_length, index.tokenizer, kind, vocabulary)
        if vocabulary <= HEAD:
            return made
        index = made
    idf = weight("pro", F.lit(1.0), F.col("df"), F.lit(index.n))
    weights = index.terms.where("in_vectors").select("term", "df", F.lit(0).alias("idx"), idf.alias("w"))
    norms = summed(looked_up(rows, weights, kind, squared=True), 1).select("chunk_id", F.sqrt(F.get("w", F.lit(0))).alias("norm"))
    return Index(materialized(rows.join(norms, "chunk_id", "left"), "norms"), index.terms, index.n, index.mean_length, index.tokenizer, kind, vocabulary)


def head_of(weights: DataFrame) -> list:
    """The first ``HEAD`` rows of ``weights`` (term, df, ...) by frequency."""
    return weights.orderBy(F.col("df").desc(), "term").limit(HEAD).collect()


def looked_up(rows: DataFrame, weights: DataFrame, kind: str, squared: bool = False) -> DataFrame:
    """chunk_id, idx (array), w (array), in one or more rows a chunk: what the terms of ``rows`` (chunk_id, terms, counts) weigh by
    ``weights`` (term, df, idx, w), times 1 + ln tf for ``lab`` and tf for ``pro``; squares of it on demand.

    The ``HEAD`` most frequent terms, with most of all postings, are looked up where the rows are read, without a shuffle; the
    postings of all other terms are joined. Terms without a weight count nothing.
    """
    key = rows.schema["chunk_id"].dataType.simpleString()
    head = head_of(weights)
    terms, idx, w = pa.array([r["term"] for r in head], pa.string()), np.array([r["idx"] for r in head], np.int32), np.array([r["w"] for r in head], float)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
        for whole in batches:
            for s in range(0, whole.num_rows, TEXT_ROWS):
                batch = whole.slice(s, TEXT_ROWS)
                lists, counts = (pa.concat_arrays([batch.column(k)]).take(pa.array(np.arange(batch.num_rows))) for k in (1, 2))
                flat = lists.flatten()
                at = pc.index_in(flat, terms).fill_null(-1).to_numpy(zero_copy_only=False)
                yield batch, np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), at, flat, counts.flatten()

    def places(row: np.ndarray, n: int) -> pa.Array:
        return pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, at, _, counts in hits(batches):
            hit = at >= 0
            tf, own = counts.to_numpy()[hit].astype(float), at[hit]
            part = (1 + np.log(tf) if kind == "lab" else tf) * w[own]
            starts = places(row[hit], batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(starts, pa.array(idx[own])), pa.ListArray.from_arrays(starts, pa.array(part * part if squared else part))], ["chunk_id", "idx", "w"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, at, flat, counts in hits(batches):
            rest = pa.array(np.flatnonzero(at < 0))
            yield pa.record_batch([batch.column(0).take(pa.array(row[at < 0])), flat.take(rest), counts.take(rest)], ["chunk_id", "term", "tf"])

    rows = rows.select("chunk_id", "terms", "counts")
    found = rows.mapInArrow(frequent, f"chunk_id {key}, idx array<int>, w array<double>")
    if len(head) < HEAD:
        return found
    rare = rows.mapInArrow(others, f"chunk_id {key}, term string, tf int").join(weights, "term")
    part = (1 + F.log("tf") if kind == "lab" else F.col("tf")) * F.col("w")
    return found.unionByName(rare.select("chunk_id", F.array(F.col("idx").cast("int")).alias("idx"), F.array(part * part if squared else part).alias("w")))


def summed(parts: DataFrame, buckets: int, unit: bool = False) -> DataFrame:
    """chunk_id, idx (array, ascending), w (array): the sums of ``parts`` (chunk_id, idx, w) by chunk and bucket, without chunks that have
    none; vectors of length 1 on demand, without those of length 0."""
    key = parts.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(TEXT_ROWS, (1 << 20) // buckets))
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                batch = whole.slice(s, step)
                idx, w = (pa.concat_arrays([batch.column(k)]).take(pa.array(np.arange(batch.num_rows))) for k in (1, 2))
                row = np.repeat(np.arange(batch.num_rows), np.diff(idx.offsets.to_numpy()))
                cell = row * buckets + idx.flatten().to_numpy()
                there = np.flatnonzero(np.bincount(cell, minlength=batch.num_rows * buckets))
                total = np.bincount(cell, w.flatten().to_numpy(), batch.num_rows * buckets)[there]
                row = there // buckets
                if unit:
                    length = np.sqrt(np.bincount(row, total * total, batch.num_rows))[row]
                    row, there, total = row[length > 0], there[length > 0], total[length > 0] / length[length > 0]
                starts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                some = pa.array(np.flatnonzero(np.diff(starts)))
                lists = (pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in ((there % buckets).astype(np.int32), total))
                yield pa.record_batch([batch.column(0).take(some), *(x.take(some) for x in lists)], ["chunk_id", "idx", "w"])

    whole = parts.groupBy("chunk_id").agg(F.collect_list(F.struct("idx", "w")).alias("p")).select("chunk_id", F.flatten("p.idx").alias("idx"), F.flatten("p.w").alias("w"))
    return whole.mapInArrow(run, f"chunk_id {key}, idx array<int>, w array<double>")
