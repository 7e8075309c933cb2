"""SimHash near-duplicates: exact links at a few differing bits, found with vantage-point trees inside bit segments.

Fingerprints are points of Hamming space. Over all 64 bits, distances to a vantage point crowd around 32, so a ball of four bits
straddles nearly every boundary and a tree alone prunes little: the README has figures of that. So the first cut isn't
a tree. The bits are cut into ``m`` segments; two fingerprints within ``r`` bits agree, by counting, on some ``m - r`` whole
segments, so each choice of ``m - r`` segments deals the fingerprints to shards (those that agree there), and every link is
inside a shard. ``m`` follows the number of distinct fingerprints, so that a shard holds about ``LEAF`` of them; every choice
of ``m`` is exact.

Vantage-point trees do the rest:

* A shard of more than ``SPLIT`` fingerprints (many near copies, say) is split, in Spark: by Hamming distance to a vantage point
  chosen from it, at the radius that leaves the larger side smallest. By the triangle inequality a fingerprint outside
  the radius can only link into it from at most ``r`` further out; those visit the inner shard too. Shards of which no vantage
  point prunes enough, as all are near each other, are cut into blocks, and each two blocks are a shard.
* Inside a shard, fingerprints are sorted by distance to a vantage point, and only a window of +-r around a query (the triangle
  bound) is compared. A shard never holds more than two blocks of about ``SPLIT``.

Equal fingerprints are one point (exact copies, however many, cost nothing), and a shard hands out a spanning forest of its
links, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellane.llm.components import components
from tessellane.llm.shared import small_batches, store, whole_text

BITS = 64
SEED = 42
#: Distinct fingerprints that a leaf should hold at most, on average.
LEAF = 256
#: Distinct fingerprints of a shard beyond which it is split; rounds of splitting, after which blocks do the rest.
SPLIT, ROUNDS = 8192, 12
#: Vantage points tried for a split.
PIVOTS = 4
#: A split is worth it if both sides together have at most so many times the rows, and the larger one at most this share.
OVERLAP, SHARE = 1.15, 0.9
#: Shingles hashed at a time; bounds a worker's memory on very long texts.
CHUNK = 200_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, width: int = 4, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; fewer words than ``width`` are one shingle, none is 0."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall(text.encode().translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    if n == 1:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashed = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], ">u8")
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed 64-bit number, one row a document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(bits, pa.int64())], ["doc_id", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text(text).alias("text")).mapInArrow(run, f"doc_id {kind}, bits long")


def segments(n: int, radius: int) -> list[int]:
    """Masks of the segments for ``n`` distinct fingerprints: all choices of m - radius out of m segments."""
    for m in range(radius + 1, BITS):
        edges = [round(i * BITS / m) for i in range(m + 1)]
        if (m - radius) * BITS // m >= np.log2(max(n, 2) / LEAF) or m >= radius + 6:
            parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
            return [sum(c) for c in combinations(parts, m - radius)]
    raise AssertionError


def forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links (at most ``radius`` differing bits) among distinct points.

    The points are in order of distance to the first one, and only those inside the triangle bound are compared. Points
    reached leave the search, and it ends when all have, so a dense cluster costs few comparisons a point.
    """
    if len(points) < 2:
        return []
    far = np.bitwise_count(points ^ points[0]).astype(np.int16)
    order = np.argsort(far, kind="stable")
    points, far = points[order], far[order]
    open_, left = np.ones(len(points), bool), len(points)
    out = []
    for first in range(len(points)):
        if not open_[first]:
            continue
        open_[first] = False
        left -= 1
        todo = [first]
        while todo and left:
            i = todo.pop()
            lo, hi = np.searchsorted(far, far[i] - radius, "left"), np.searchsorted(far, far[i] + radius, "right")
            near = lo + np.flatnonzero(open_[lo:hi] & (np.bitwise_count(points[lo:hi] ^ points[i]) <= radius))
            if len(near):
                open_[near] = False
                left -= len(near)
                todo += near.tolist()
                out += [(int(order[i]), int(order[j])) for j in near]
    return out


def _leaves(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each shard; rows come sorted by (shard, tile), then bits, and a shard may span batches."""
    key, held = None, []

    def links() -> pa.RecordBatch:
        bits = np.concatenate(held)
        at = np.array(forest(bits.view(np.uint64), radius), np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(bits[at[:, 0]]), pa.array(bits[at[:, 1]])], ["a", "b"])

    for batch in batches:
        shard, tile, bits = (np.asarray(batch.column(i)) for i in range(3))
        if not len(shard):
            continue
        cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(tile) != 0)) + 1).tolist(), len(shard)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if (shard[s], tile[s]) != key:
                if sum(map(len, held)) > 1:
                    yield links()
                key, held = (shard[s], tile[s]), []
            held.append(bits[s:e].copy())
    if sum(map(len, held)) > 1:
        yield links()


def _large(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)


def split_once(rows: DataFrame, radius: int, number: int) -> DataFrame:
    """``rows`` (shard, home, bits) with pivot, mu (its radius) and d (the distance to it); all null where no vantage point prunes enough.

    Of ``PIVOTS`` members drawn by hash, the one is taken whose best radius leaves the larger side smallest. Links are looked
    for between members that are at home and all members.
    """
    drawn = [F.min_by("bits", F.xxhash64("bits", F.lit(number), F.lit(i))) for i in range(PIVOTS)]
    pivots = rows.where("home").groupBy("shard").agg(F.array_distinct(F.array(*drawn)).alias("pivots")).select("shard", F.explode("pivots").alias("pivot"))
    far = lambda pairs: pairs.withColumn("d", F.bit_count(F.col("bits").bitwiseXOR(F.col("pivot"))))
    # At most 65 distances a pivot, and as many radii.
    counts = far(rows.join(pivots, "shard")).groupBy("shard", "pivot", "d").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    radii = counts.withColumn("mu", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))))
    inner = F.sum(F.when(F.col("d") <= F.col("mu") + radius, F.col("all")).otherwise(0))
    outer = F.sum(F.when(F.col("d") > F.col("mu"), F.col("homes")).otherwise(0) + F.when(F.col("d") > F.col("mu") - radius, F.col("all") - F.col("homes")).otherwise(0))
    sides = radii.groupBy("shard", "pivot", "mu").agg(inner.alias("inner"), outer.alias("outer"), F.sum("all").alias("total"))
    worth = (F.col("inner") + F.col("outer") <= OVERLAP * F.col("total")) & (F.greatest("inner", "outer") <= SHARE * F.col("total"))
    best = sides.where(worth).groupBy("shard").agg(F.min(F.struct(F.greatest("inner", "outer").alias("larger"), "mu", "pivot")).alias("best"))
    return far(rows.join(best.select("shard", "best.pivot", "best.mu"), "shard", "left"))


def split(shards: DataFrame, radius: int) -> DataFrame:
    """shard, tile, bits: ``shards`` (shard, bits) cut so that none is much larger than two blocks of ``SPLIT``; every link is still inside one."""
    hot = store(_large(shards), "hot")
    if hot.isEmpty():
        return shards.select("shard", F.lit(0).cast("long").alias("tile"), "bits")
    out = shards.join(hot, "shard", "left_anti").select("shard", F.lit(0).cast("long").alias("tile"), "bits")
    todo = store(shards.join(hot, "shard", "left_semi").select("shard", F.lit(True).alias("home"), "bits"), "split")
    for number in range(ROUNDS):
        cut = store(split_once(todo, radius, number), "cut")
        inner = F.when(F.col("d") <= F.col("mu") + radius, F.struct(F.lit(0).alias("side"), (F.col("home") & (F.col("d") <= F.col("mu"))).alias("home")))
        outer = F.when(F.when(F.col("home"), F.col("d") > F.col("mu")).otherwise(F.col("d") > F.col("mu") - radius), F.struct(F.lit(1).alias("side"), F.col("home").alias("home")))
        halves = cut.where("mu is not null").select("shard", "bits", F.explode(F.array_compact(F.array(inner, outer))).alias("to"))
        made = store(halves.select(F.xxhash64("shard", "to.side", F.lit(number)).alias("shard"), "to.home", "bits"), "split")
        large = store(_large(made), "hot")
        out = out.unionByName(made.join(large, "shard", "left_anti").select("shard", F.lit(0).cast("long").alias("tile"), "bits"))
        out = out.unionByName(_blocks(cut.where("mu is null")))
        todo = made.join(large, "shard", "left_semi")
        if large.isEmpty():
            return out
    return out.unionByName(_blocks(todo))


def _blocks(rows: DataFrame) -> DataFrame:
    """Each shard of ``rows`` (shard, bits) cut into blocks of about SPLIT; every two of them are a tile."""
    n = store(rows.groupBy("shard").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("n")), "blocks")
    block = F.pmod(F.xxhash64("bits"), F.greatest(F.col("n"), F.lit(2))).cast("long")
    placed = rows.join(n, "shard").withColumn("block", block)
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n"), F.lit(2)).cast("long") - 1), lambda k: k != F.col("block")))
    paired = placed.select("shard", "block", "n", "bits", other.alias("other"))
    return paired.select("shard", (F.least("block", "other") * F.col("n") + F.greatest("block", "other") + 1).alias("tile"), "bits")


def near_duplicates(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(bits, group, smallest): each distinct fingerprint of ``prints`` (doc_id, bits) with its group and the group's smallest doc_id.

    A group is named by the smallest fingerprint that can be reached over links of at most ``radius`` bits.
    """
    spark = prints.sparkSession
    points = store(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "points")
    masks = segments(points.count(), radius)
    masked = lambda m: F.col("bits").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))
    keys = F.array(*[F.xxhash64(F.lit(i), masked(m)) for i, m in enumerate(masks)])
    shards = split(points.select(F.explode(keys).alias("shard"), "bits"), radius)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    dealt = shards.repartition(parts, "shard", "tile").sortWithinPartitions("shard", "tile", "bits")
    links = dealt.mapInArrow(lambda b: _leaves(b, radius), "a long, b long")
    groups = components(links)
    named = points.join(groups, points["bits"] == groups["node"], "left").select("bits", "least", F.coalesce("component", "bits").alias("group"))
    named = store(named, "named")
    return named.join(named.groupBy("group").agg(F.min("least").alias("smallest")), "group").select("bits", "group", "smallest")


def clusters(docs: DataFrame, text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (smallest doc_id reachable), one row a document.

    Null text is empty; texts without words have fingerprint zero and link like any other; documents with null doc_id
    link too, but name no component (it is null if no other document is in it); repeated rows stay; an empty table gives an empty table; texts are read whole; other columns aren't read.
    """
    prints = store(fingerprints(docs, text, width), "prints")
    groups = store(near_duplicates(prints, radius), "groups")
    return prints.join(groups, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("smallest").alias("component_id")
    )


def one_of_each(docs: DataFrame, text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, but one of each group of near-duplicates: the one of the smallest doc_id.

    Rows with null doc_id come after all others in their group; among rows of one doc_id the smallest hash of the text
    decides; rows that repeat in doc_id and text are one. Groups are those of ``clusters``.
    """
    small_batches(docs.sparkSession)
    prints = store(_with_hash(docs, text, width), "prints")
    groups = near_duplicates(prints.select("doc_id", "bits"), radius)
    keys = prints.join(groups, "bits").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "h")).alias("k"))
    keep = keys.select(F.col("k.doc_id").alias("kept_id"), F.col("k.h").alias("kept_h"))
    times = prints.groupBy("doc_id", "h").agg(F.count("*").alias("times")).where("times > 1").select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h"), "times")
    same = lambda a, b: a["kept_id"].eqNullSafe(b["kept_id"]) & (a["kept_h"] == b["kept_h"])
    chosen = store(keep.join(times, same(keep, times), "left").select(keep["kept_id"], keep["kept_h"], F.col("times").isNotNull().alias("repeats")), "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own_id"), F.xxhash64(whole_text(text)).alias("own_h"))
    on = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_h") == F.col("kept_h"))
    lone = rows.join(chosen.where("not repeats"), on, "left_semi").select("row")
    again = rows.join(chosen.where("repeats"), on, "left_semi").dropDuplicates(["own_id", "own_h"]).select("row")
    return lone.unionByName(again).select("row.*")


def _with_hash(docs: DataFrame, text: str, width: int) -> DataFrame:
    """doc_id, h (hash of the text), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bits, pa.int64())], ["doc_id", "h", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(whole_text(text)).alias("h"), whole_text(text).alias("text")).mapInArrow(run, f"doc_id {kind}, h long, bits long")
