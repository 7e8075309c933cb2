"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to blocks of eight dimensions and each block is decoded to its nearest point of the
E8 lattice; the points of a table's blocks, with the label, name a cell. A vector lives in its home cell of each table
and visits the neighbouring cells that are next nearest; two vectors meet where one lives and the other lives or visits.
All pairs that meet are verified by cosine in double precision, so no wrong link is made; links are missed only between
vectors that meet in no table (``recall`` measures that against brute force).

Equal vectors are one point with a weight, so exact copies cost nothing. Names of cells are shuffled first, without the vectors:
where nobody meets, no vector goes. A point's vector is fetched once and sent to the cells that are left. A pair that meets
more than once is counted in the first table and cell only, which each row can tell by itself as it carries its cells; so no
pair is ever shuffled. What leaves a cell is a number of links for each member and a spanning forest. Cells of more than
``TILE`` rows are cut into blocks, and each pair of blocks is a task's work of its own.

The number of E8 blocks of a table follows the size of the label, label by label, so that chance brings few vectors together;
with three blocks and more there are more tables (``tables_of``), so that recall doesn't fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellane.llm.components import components
from tessellane.llm.shared import small_batches, store

THRESHOLD = 0.98
VISITS, SCALE = 3, 4.0
#: A label of at most so many vectors has one E8 block a table; each further block takes so many times more.
ONE_BLOCK, CELLS_OF_BLOCK, MOST_BLOCKS = 250, 200, 4
TILE = 4096


def tables_of(blocks: int) -> int:
    """Tables for a number of blocks: recall at the threshold stays above 0.99 (tested)."""
    return 4 if blocks <= 2 else 4 * (blocks - 1)


def _roots() -> np.ndarray:
    """The 240 neighbours of a point of E8, in halves."""
    whole = [v for v in product((-2, 0, 2), repeat=8) if sum(x != 0 for x in v) == 2]
    half = [v for v in product((-1, 1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half, np.int64)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    near = np.round(x)
    odd = near.sum(axis=1) % 2 != 0
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(odd)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, in halves (twice the coordinates), of the rows of ``x``."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.round(2 * np.where(closer[:, None], a, b)).astype(np.int64)


@lru_cache(maxsize=8)
def _projection(dims: int, tables: int, blocks: int) -> np.ndarray:
    """tables x blocks x dims x 8, with orthonormal columns where ``dims`` allows."""
    rng = np.random.default_rng(20_177)
    out = rng.normal(size=(tables, dims, 8 * blocks))
    if dims >= 8 * blocks:
        out = np.linalg.qr(out)[0]
    else:
        out /= np.sqrt(dims)
    return out.reshape(tables, dims, blocks, 8).transpose(0, 2, 1, 3) * (dims / 64) ** 0.5


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit names of lattice points (... x 8), told apart by ``salt``."""
    h = (points.astype(np.uint64) * _MIX).sum(axis=-1, dtype=np.uint64) ^ salt
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def cells(unit: np.ndarray, salt: np.ndarray, tables: int | None = None, blocks: int = 1, visits: int = VISITS, scale: float = SCALE) -> np.ndarray:
    """rows x tables x (1 + visits) cell names, never 0: the home cell first. ``salt`` names each row's label."""
    n, dims = unit.shape
    tables = tables or tables_of(blocks)
    out = np.zeros((n, tables, 1 + visits), np.uint64)
    for t, by_block in enumerate(_projection(dims, tables, blocks)):
        base = salt * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t + 1)
        names, moves, gains = [], [], []
        for b in range(blocks):
            y = unit @ by_block[b] * scale
            p = decode(y)
            gain = (y - p / 2) @ (ROOTS.T / 2)  # the larger, the nearer is the neighbour
            best = np.argpartition(-gain, visits, axis=1)[:, :visits] if visits else np.zeros((n, 0), int)
            names.append(_mixed(p, np.full(n, b + 1, np.uint64)))
            moves.append(_mixed(p[:, None, :] + ROOTS[best], np.full((n, visits), b + 1, np.uint64)))
            gains.append(np.take_along_axis(gain, best, axis=1))
        home = np.add.reduce(names)
        visit = np.concatenate([home[:, None] - names[b][:, None] + moves[b] for b in range(blocks)], axis=1)
        pick = np.argsort(-np.concatenate(gains, axis=1), axis=1, kind="stable")[:, :visits]
        out[:, t, 0] = home + base
        out[:, t, 1:] = np.take_along_axis(visit, pick, axis=1) + base[:, None]
    return np.maximum(out, 1)


def valid(vector: Column, label: Column) -> Column:
    """Vectors that can link: label and vector not null, no null or non-finite component, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _meet(a: np.ndarray, b: np.ndarray, table: int, cell: np.uint64) -> np.ndarray:
    """Whether (table, cell) is the first place where the rows of ``a`` and ``b`` (pairs x tables x cells; 0 is no cell) meet."""
    first = np.ones(len(a), bool)
    for t in range(table + 1):
        ha, hb = a[:, t, 0], b[:, t, 0]
        at_a, at_b = (ha != 0) & (b[:, t] == ha[:, None]).any(axis=1), (hb != 0) & (a[:, t] == hb[:, None]).any(axis=1)
        if t < table:
            first &= ~(at_a | at_b)
        else:
            top = np.uint64(0xFFFFFFFFFFFFFFFF)
            first &= np.minimum(np.where(at_a, ha, top), np.where(at_b, hb, top)) == cell
    return first


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, without overflow."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _links(rep, weight, unit, names, home, block, left: int, right: int, table: int, cell: np.uint64, threshold: float):
    """(links of each row, index pairs of a spanning forest) in one tile."""
    rows, cols = np.flatnonzero(block == left), np.flatnonzero(block == right)
    count = np.zeros(len(rep), np.int64)
    near: list[np.ndarray] = []
    for s in range(0, len(rows), 512):
        r = rows[s : s + 512]
        hit = (unit[r] @ unit[cols].T >= threshold) & (home[r][:, None] | home[cols][None, :])
        hit &= (r[:, None] < cols[None, :]) if left == right else True
        i, j = np.nonzero(hit)
        i, j = r[i], cols[j]
        for k in range(0, len(i), 100_000):
            p, q = i[k : k + 100_000], j[k : k + 100_000]
            own = rep[p] != rep[q]
            p, q = p[own], q[own]
            first = _meet(names[p], names[q], table, cell)
            np.add.at(count, p[first], weight[q[first]])
            np.add.at(count, q[first], weight[p[first]])
        near.append(np.stack([i, j]))
    i, j = np.concatenate(near, axis=1) if near else np.zeros((2, 0), np.int64)
    # A spanning forest: smallest neighbour hooking, repeated until all links are inside a tree.
    root = np.arange(len(rep))
    forest = []
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        if not len(i):
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((low, high))
        once = order[np.r_[True, np.diff(high[order]) > 0]]
        forest.append(np.stack([i[once], j[once]]))
        root[high[once]] = low[once]
        while (root[root] != root).any():
            root = root[root]
    return count, np.concatenate(forest, axis=1) if forest else np.zeros((2, 0), np.int64)


def _tiles(batches: Iterator[pa.RecordBatch], threshold: float, width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tbl, cell, left, right): + block, point, weight, home, v, places, names. Out: a, b (a link) or a, n (links of a)."""
    key, held = None, []

    def made() -> Iterator[pa.RecordBatch]:
        block, point, weight, home = (np.concatenate([h[k] for h in held]) for k in range(4))
        if len(point) < 2 or not home.any():
            return
        places, names = ([x for h in held for x in h[k]] for k in (5, 6))
        shown = np.zeros((len(point), (max(p[-1] for p in places) // width + 1) * width), np.uint64)
        for row, p, own in zip(shown, places, names, strict=True):
            row[p] = own.view(np.uint64)
        v = unit_rows(np.concatenate([h[4] for h in held]))
        count, tree = _links(point, weight, v, shown.reshape(len(point), -1, width), home, block, key[2], key[3], key[0], np.int64(key[1]).view(np.uint64), threshold)
        some = np.flatnonzero(count)
        if len(some) or tree.shape[1]:
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([point[some], point[tree[0]]])),
                    pa.array(np.concatenate([np.zeros(len(some), np.int64), point[tree[1]]]), mask=np.r_[np.ones(len(some), bool), np.zeros(tree.shape[1], bool)]),
                    pa.array(np.concatenate([count[some], np.zeros(tree.shape[1], np.int64)])),
                ],
                ["a", "b", "n"],
            )

    def lists(column) -> tuple[np.ndarray, np.ndarray]:
        return column.flatten().to_numpy(), np.cumsum(np.r_[0, pc.list_value_length(column).to_numpy()])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(k)) for k in range(4)]
        cols = [np.asarray(batch.column(k)) for k in (4, 5, 6)] + [batch.column(7).to_numpy(zero_copy_only=False).astype(bool)]
        (values, ends), (places, cuts_of), (names, _) = map(lists, (batch.column(8), batch.column(9), batch.column(10)))
        cuts = [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            own = tuple(int(k[s]) for k in keys)
            if own != key:
                if held:
                    yield from made()
                key, held = own, []
            # A cell's name has the vectors' length in it, so the vectors of a cell are of one length.
            ragged = [[x[cuts_of[i] : cuts_of[i + 1]].copy() for i in range(s, e)] for x in (places, names)]
            held.append([*(c[s:e].copy() for c in cols), values[ends[s] : ends[e]].reshape(e - s, -1).copy(), *ragged])
    if held:
        yield from made()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, visits: int = VISITS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector.

    Vectors are compared when their labels are equal and not null and their lengths are equal. Null or zero vectors and
    those with null or non-finite components link with nothing: 0 links, own component. Equal vectors link with each
    other. vec_id may be of any type that has an order; rows that repeat a vec_id count as vectors of their own, and so do
    rows without one, which name no component (it is null where no other vector is in it, and the row is kept). An
    empty table gives an empty table; other columns aren't read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    width = 1 + visits
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"), F.col(label).cast("string").alias("label"))
    good = valid(F.col("v"), F.col("label"))
    # Equal vectors of a label are one point. Two hashes stand for (label, vector) later on, so that vectors aren't shuffled for it again.
    hashed = [F.xxhash64("label", "v").alias("h1"), F.xxhash64("v", "label", F.lit(1)).alias("h2")]
    valid_rows = rows.where(good).select("vec_id", "v", "label", *hashed)
    sizes = valid_rows.groupBy("label").agg(F.count("*").alias("n"))
    more = F.ceil(F.log(F.greatest(F.col("n") / ONE_BLOCK, F.lit(1.0))) / float(np.log(CELLS_OF_BLOCK)))
    blocks = sizes.select("label", F.least(1 + more, F.lit(MOST_BLOCKS)).cast("int").alias("blocks"))
    points = valid_rows.groupBy("label", "h1", "h2", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).join(blocks, "label")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts, depth = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))
            data = batch.column(2).to_pylist()
            lengths = np.array([len(x) for x in data])
            for dims, deep in sorted(set(zip(lengths.tolist(), depth.tolist(), strict=True))):  # vectors of other lengths are other spaces
                own = np.flatnonzero((lengths == dims) & (depth == deep))
                at = cells(unit_rows(np.array([data[i] for i in own])), salts[own] + np.uint64(dims), None, deep, visits).reshape(len(own), -1).view(np.int64)
                pick = pa.array(own)
                yield pa.record_batch([*(batch.column(k).take(pick) for k in range(2, 7)), pa.array(at.tolist(), pa.list_(pa.int64()))], ["v", "least", "weight", "h1", "h2", "names"])

    named = points.select(F.xxhash64("label").alias("salt"), "blocks", "v", "least", "weight", "h1", "h2")
    named = named.mapInArrow(place, f"v {kinds['v']}, least {kinds['least']}, weight long, h1 long, h2 long, names array<long>")
    placed = store(named.withColumn("point", F.monotonically_increasing_id()), "cells")
    spread = placed.select("point", F.posexplode("names").alias("i", "cell"))
    table, home = F.floor(F.col("i") / width).cast("int"), F.col("i") % width == 0
    # Cells where two meet, one of them at home. Spark broadcasts the table if its files are small enough.
    met = spread.groupBy(table.alias("tbl"), "cell").agg(F.count("*").alias("rows"), F.count_if(home).alias("homes")).where("rows > 1 and homes > 0")
    met = store(met.select("tbl", "cell", F.ceil(F.col("rows") / TILE).cast("int").alias("n_blocks")), "met")
    left = spread.select("point", "i", table.alias("tbl"), "cell").join(met, ["tbl", "cell"])
    # At most a row for each of a point's cells.
    cells_of = left.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("i", "cell", "n_blocks"))).alias("at"))
    fetched = placed.select("point", "weight", "v").join(cells_of, "point")
    sent = fetched.select("point", "weight", "v", F.col("at.i").alias("places"), F.col("at.cell").alias("names"), F.explode("at").alias("own"))
    i, n_blocks = F.col("own.i"), F.col("own.n_blocks")
    tiled = (
        sent.withColumn("block", F.pmod(F.xxhash64("point"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .select(
            F.floor(i / width).cast("int").alias("tbl"), F.col("own.cell").alias("cell"), F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
            "block", "point", "weight", (i % width == 0).alias("home"), "v", "places", "names",
        )
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    dealt = tiled.repartition(parts, "tbl", "cell", "left", "right").sortWithinPartitions("tbl", "cell", "left", "right")
    found = store(dealt.mapInArrow(lambda b: _tiles(b, threshold, width), "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("other_links"))
    groups = store(components(found.where("b is not null").select("a", "b")), "groups")
    least = placed.select("point", "least").join(groups, F.col("point") == F.col("node")).groupBy("component").agg(F.min("least").alias("smallest"))
    in_groups = groups.join(least, "component").select("node", "smallest")
    known = placed.select("point", "h1", "h2", "weight", "least").join(counts, F.col("point") == F.col("a"), "left").join(in_groups, F.col("point") == F.col("node"), "left").select(
        "h1", "h2", (F.coalesce("other_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id")
    )
    linked = valid_rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    lone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def recall(unit: np.ndarray, labels: np.ndarray, threshold: float = THRESHOLD, tables: int | None = None, visits: int = VISITS, blocks: int = 1) -> tuple[int, int]:
    """(links found, links there are) among the rows of ``unit``, by brute force: for tests and for choosing parameters."""
    found = there = 0
    for lab in np.unique(labels):
        own = np.flatnonzero(labels == lab)
        at = cells(unit[own], np.full(len(own), 1, np.uint64), tables, blocks, visits)
        i, j = np.nonzero(np.triu(unit[own] @ unit[own].T >= threshold, 1))
        there += len(i)
        for s in range(0, len(i), 100_000):
            a, b = at[i[s : s + 100_000]], at[j[s : s + 100_000]]
            found += int(((a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)).any(axis=1).sum())
    return found, there


#: By brute force; for tables of some thousands of vectors.
ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS other FROM reach GROUP BY 1),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(least.other, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(least.other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts ON e.vec_id = counts.a LEFT JOIN least ON e.vec_id = least.node
"""
