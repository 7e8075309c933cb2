"""A document and chunk store on Parquet: add, list, delete, reindex, embed what is pending."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellane.operators.chunking import chunks
from tessellane.operators.retrieval import tokens


def digested(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with digest (SHA-256 of the text) and id (its first 20 characters)."""
    return docs.withColumn("digest", F.sha2(F.col(text), 256)).withColumn("id", F.substring("digest", 1, 20))


def new_documents(incoming: DataFrame, stored: DataFrame, order: str = "doc_id") -> DataFrame:
    """Incoming documents whose digest isn't stored, the first of each digest."""
    first = incoming.groupBy("digest").agg(F.min(order).alias(order))
    return incoming.join(first, ["digest", order], "left_semi").join(stored.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])


def listing(docs: DataFrame, chunk_table: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chars, chunks, embedded: documents without chunks stay."""
    counts = chunk_table.groupBy(key).agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    return docs.select(key, F.length("text").alias("chars")).join(counts, key, "left").fillna(0, ["chunks", "embedded"])


def ordered(listed: DataFrame) -> DataFrame:
    """A listing (created_at, name) in its order: the latest first, then by name."""
    return listed.orderBy(F.col("created_at").desc(), "name")


def without(table: DataFrame, doc_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a cascading delete leaves of a table of documents, chunks or postings."""
    return table.join(doc_ids.select(key), key, "left_anti")


def pending(chunk_table: DataFrame, embedding_key: str) -> DataFrame:
    """Chunks whose embedding is missing or was made under another key."""
    return chunk_table.where(F.col("embedding").isNull() | ~F.col("embedding_key").eqNullSafe(F.lit(embedding_key)))


def reindexed(docs: DataFrame, chunker: str = "lab", tokenizer: str = "lab", **options: int) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text) made anew: id, offsets, text, terms, and no embedding, as the old ones are void."""
    made = chunks(docs, chunker, **options)
    terms = tokens(made.withColumnRenamed("chunk", "text").withColumn("id", F.concat_ws("-", "doc_id", "ordinal")), tokenizer, "id")
    return made.withColumn("id", F.concat_ws("-", "doc_id", "ordinal")).join(terms, "id").select(
        "id", "doc_id", "ordinal", "start", "end", F.col("chunk").alias("text"), F.col("tokens").alias("terms"),
        F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("string").alias("embedding_key"),
    )


def attached(chunk_table: DataFrame, made: DataFrame, embedding_key: str) -> DataFrame:
    """``chunk_table`` with the embeddings of ``made`` (id, embedding) written in under ``embedding_key``."""
    fresh = made.select("id", F.col("embedding").alias("fresh"))
    joined = chunk_table.join(fresh, "id", "left")
    return joined.withColumn("embedding_key", F.when(F.col("fresh").isNotNull(), embedding_key).otherwise(F.col("embedding_key"))).withColumn("embedding", F.coalesce("fresh", "embedding")).drop("fresh")


DOCUMENTS = "id string, digest string, name string, text string, created_at timestamp, batch long"
CHUNKS = "id string, doc_id string, ordinal int, start int, end int, text string, terms array<string>, embedding array<double>, embedding_key string"


class DocumentStore:
    """Documents, chunks and embeddings in a folder, changed by versions.

    A version names the folders of Parquet files that each table consists of. A change writes new folders first and its version
    last, so readers see all of a change or nothing, and a change that is cut off leaves the version before it. Adding
    writes only what is new; deleting and reindexing write the tables they touch anew. One writer at a time.
    """

    SCHEMAS = {"documents": DOCUMENTS, "chunks": CHUNKS}

    def __init__(self, spark: SparkSession, path: str, chunker: str = "lab", tokenizer: str = "lab", **options: int) -> None:
        self.spark, self.path, self.chunker, self.tokenizer, self.options = spark, path.rstrip("/"), chunker, tokenizer, options

    def _versions(self) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        found = [s.getPath() for s in files.listStatus(where)]
        done = [p.getName() for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(name) for name in done)

    def _version(self) -> dict:
        known = self._versions()
        if not known:
            return {"documents": [], "chunks": [], "batch": -1}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{known[-1]}").first()[0])

    def _commit(self, version: dict) -> None:
        known = self._versions()
        self.spark.createDataFrame([(json.dumps(version),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/versions/{known[-1] + 1 if known else 0}")

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def table(self, name: str) -> DataFrame:
        folders = self._version()[name]
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def _cut(self, docs: DataFrame) -> DataFrame:
        made = reindexed(docs.select(F.col("id").alias("doc_id"), "text"), self.chunker, self.tokenizer, **self.options)
        return made.select(*[c.split()[0] for c in CHUNKS.split(", ")])

    def add(self, docs: DataFrame, batch: int | None = None) -> int:
        """Add ``docs`` (name, text) whose text isn't there yet, with their chunks; return how many. A ``batch`` that was added
        already, or one before it, adds nothing."""
        version = self._version()
        if batch is not None and batch <= version["batch"]:
            return 0
        fresh = new_documents(digested(docs.where("text is not null")), self.table("documents"), "name")
        rows = fresh.select("id", "digest", "name", "text", F.current_timestamp().alias("created_at"), F.lit(batch).cast("long").alias("batch"))
        folder = self._write("documents", rows)
        written = self.spark.read.schema(DOCUMENTS).parquet(f"{self.path}/{folder}")
        chunk_folder = self._write("chunks", self._cut(written))
        self._commit({"documents": [*version["documents"], folder], "chunks": [*version["chunks"], chunk_folder], "batch": version["batch"] if batch is None else batch})
        return written.count()

    def delete(self, ids: DataFrame) -> None:
        """Delete the documents ``ids`` (id) and their chunks."""
        docs = self._write("documents", without(self.table("documents"), ids, "id"))
        cut = self._write("chunks", without(self.table("chunks"), ids.select(F.col("id").alias("doc_id")), "doc_id"))
        self._commit(self._version() | {"documents": [docs], "chunks": [cut]})

    def reindex(self, **options: int) -> None:
        """Cut all documents anew; embeddings are void then."""
        self.options = options or self.options
        self._commit(self._version() | {"chunks": [self._write("chunks", self._cut(self.table("documents")))]})

    def embed(self, model, round_size: int = 10_000) -> int:
        """Embed the chunks that have no embedding under the model's key (see ``remote.Embedder``) and write them back; return how many.

        Rounds of about ``round_size`` chunks are kept as they are done, so after a failure the next call goes on from there.
        """
        todo = pending(self.table("chunks"), model.key).select("id", "text")
        total = todo.count()
        rounds = max(1, -(-total // round_size))
        for k in range(rounds):
            part = todo.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k)
            made = self.spark.read.parquet(f"{self.path}/{self._write('embedded', model.embedded(part, 'id', 'text'))}")
            self._commit(self._version() | {"chunks": [self._write("chunks", attached(self.table("chunks"), made, model.key))]})
        return total

    def listing(self) -> DataFrame:
        """id, name, created_at, chars, chunks, embedded, the latest first."""
        docs = self.table("documents")
        counts = self.table("chunks").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
        return ordered(docs.select("id", "name", "created_at", F.length("text").alias("chars")).join(counts, "id", "left").fillna(0, ["chunks", "embedded"]))

    def statistics(self) -> DataFrame:
        """One row: n_chunks, n_terms, n_docs_src."""
        cut = self.table("chunks")
        words = cut.select(F.explode("terms").alias("t")).agg(F.countDistinct("t").alias("n_terms"))
        return cut.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs_src")).crossJoin(words)
