"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed once, left to right, into the phrases of a growing dictionary (each is the shortest string that isn't in
the dictionary yet). A phrase is a known phrase and one more character, so the dictionary is a tree, phrases of any length
cost one look-up a character, and a phrase's hash follows from that of the phrase it continues. The fingerprint is the
``KEPT`` smallest distinct hashes. The share of equal values among the smallest of two fingerprints' union estimates the
Jaccard likeness of the phrase sets: texts that compress each other share phrases.

A second text that agrees with the first up to some place has the same phrases up to there, so an edited copy is
parsed from that place on only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellane.llm.shared import small_batches, whole_text

KEPT = 128
#: A polynomial hash of code points, modulo a prime.
_PRIME, _BASE, _CODES = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1), 0x110000
#: Texts, in code points, that a range of neighbouring documents holds on average, and the most ranges there are.
RANGE_CHARS, MOST_RANGES = 16_000_000, 100_000
#: Texts, in code points, that a task reads on average at most, as long as there are no more than MOST_RANGES tasks.
TASK_CHARS = 64_000_000


class Parse:
    """A parse so far: the phrases' tree, their hashes, and the phrase that the unfinished end of the text is."""

    def __init__(self) -> None:
        # A phrase is its place in ``hashes`` times ``_CODES``; a phrase plus a character's code -> the longer phrase. 0 is the empty phrase.
        self.tree: dict[int, int] = {}
        self.hashes = [0]
        self.begun = 0

    def go_on(self, text: str) -> None:
        tree, hashes, phrase = self.tree, self.hashes, self.begun
        known, keep, fresh = tree.get, hashes.append, len(hashes) * _CODES
        for code in np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).tolist():
            longer = known(phrase + code)
            if longer:
                phrase = longer
            else:
                tree[phrase + code] = fresh
                fresh += _CODES
                keep((hashes[phrase // _CODES] * _BASE + code + 1) % _PRIME)
                phrase = 0
        self.begun = phrase

    def mark(self) -> tuple[int, int]:
        return len(self.tree), self.begun

    def back(self, mark: tuple[int, int]) -> None:
        """Forget what was parsed after ``mark``."""
        size, self.begun = mark
        while len(self.tree) > size:
            self.tree.popitem()
        del self.hashes[size + 1 :]

    def smallest(self) -> np.ndarray:
        """The smallest distinct hashes of the phrases, ascending."""
        h = np.array(self.hashes[1:], np.uint64)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        h = ((h ^ (h >> np.uint64(33))) >> np.uint64(32)).astype(np.uint32)
        if len(h) > 4 * KEPT:
            h = h[h <= np.partition(h, 2 * KEPT)[2 * KEPT]]
        return np.unique(h)[:KEPT]


def smallest(text: str) -> np.ndarray:
    own = Parse()
    own.go_on(text)
    return own.smallest()


def fingerprint(text: str) -> str:
    """Hexadecimal digits, eight for each kept hash; empty for the empty text. Equal texts have equal fingerprints."""
    return show(smallest(text))


def show(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def read(shown: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(shown), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness; 1 for two empty texts, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, times = np.unique(np.concatenate([a, b]), return_counts=True)
    if max(len(a), len(b)) == KEPT:  # beyond that, not all values of the larger set are known
        times = times[:KEPT]
    return float((times == 2).mean())


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint: the operator on texts alone, in one pass without a shuffle.

    Null and empty texts have the empty fingerprint; repeated rows stay; an empty table gives an empty table; doc_id may be of any
    type; other columns aren't read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t) for t in texts])], ["doc_id", "n_chars", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


class _Doc:
    """A document while its fingerprint and its edited copy's are made."""

    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.head, self.parse = len(text) - len(text) // 2, Parse()
        self.parse.go_on(text[: self.head])
        shared = self.parse.mark()
        self.parse.go_on(text[self.head :])
        self.hashes = self.parse.smallest()
        self.parse.back(shared)

    def beside(self, after: _Doc) -> tuple:
        edited = self.text[: self.head] + after.text[: len(self.text) - self.head]
        own = self.hashes
        if edited != self.text:
            self.parse.go_on(edited[self.head :])
            own = self.parse.smallest()
        return (
            self.doc_id, len(self.text), hashlib.sha256(edited.encode()).hexdigest(), show(self.hashes), show(own),
            likeness(self.hashes, own), likeness(self.hashes, after.hashes),
        )


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, tail, doc_id, text); a range's last row, its tail, only serves the one before."""
    before, at = None, None
    kinds = (None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    for batch in batches:
        rows = []
        for where, tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            now = _Doc(doc_id, text)
            if before is not None and at == where:
                rows.append(before.beside(now))
            before, at = (None if tail else now), where
        cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        yield pa.record_batch([pa.array(c, k or batch.column(2).type) for c, k in zip(cols, kinds, strict=True)], _NAMES)


def with_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document beside its edited text and the next document.

    The edited text is the document's with its last ``n_chars // 2`` code points replaced by as many first ones (or all)
    of the next document in ascending order of doc_id (null first, then by text), after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text is empty; a single document is its own next; repeated rows stay, side by side; an empty table gives an empty
    table; texts are read whole; other columns aren't read; doc_id must be a whole number (the order of documents is cut by its
    quantiles), else a TypeError. The documents are dealt over ranges of doc_id by quantiles, in
    one shuffle of the texts; a range gets, besides its own, the first document of the next range, so a worker holds two
    documents and a batch.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be a whole number, not {kind}")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    order = docs.select(F.col("doc_id"), whole_text(text).alias("text"))
    chars = docs.select("doc_id", F.length(whole_text(text)).alias("n"))
    total = chars.agg(F.sum("n")).first()[0] or 0
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1, min(MOST_RANGES, total // TASK_CHARS)))
    # Several ranges a task even out what chance deals to the tasks.
    n = int(min(MOST_RANGES, max(4 * parts, total // RANGE_CHARS)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("q")).first()["q"] if n > 1 else None
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right").astype(np.int32))

    placed = order.withColumn("range", range_of(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))))
    # The first document of each range, as the one before it must see it; the driver holds an id a range, MOST_RANGES at most.
    least = F.when(F.count("*") > F.count("doc_id"), F.lit(None)).otherwise(F.min("doc_id")).alias("doc_id")
    firsts = [tuple(r) for r in placed.groupBy("range").agg(least).orderBy("range").collect()]
    if not firsts:
        return spark.createDataFrame([], schema)
    goes = spark.createDataFrame([(r, i, firsts[k - 1][0]) for k, (r, i) in enumerate(firsts)], f"own int, first {kind}, goes int")
    heads = placed.join(F.broadcast(goes), (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first")))
    tails = heads.groupBy("goes", "doc_id").agg(F.min("text").alias("text")).select(F.col("goes").alias("range"), F.lit(True).alias("tail"), "doc_id", "text")
    rows = placed.select("range", F.lit(False).alias("tail"), "doc_id", "text").unionByName(tails)
    dealt = rows.repartition(parts, "range").sortWithinPartitions("range", "tail", "doc_id", "text")
    return dealt.mapInArrow(_neighbours, schema)
