"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration.

Documents become token ids; those longer than a sequence are cut into full pieces, the first piece taking the remainder.
Full pieces are sequences by themselves. The others are dealt at random to islands of about ``ISLAND`` pieces. Each island evolves
a small population whose genes are whole sequences: crossover injects full sequences of one parent into the other, sequences
that hold one of their pieces again are dissolved (and so are some that aren't full, and some of many small pieces), and the
displaced pieces are put together by best fit: the largest opens a sequence and draws the others that fill it best. The
fittest have the fewest sequences, then the least even fill: what space there is should be in few sequences.

Migration between islands is by whole sequences, in stored rounds. An island's full sequences of few pieces are final; all
others, also the full ones of many small pieces, which are what makes others full, move on to the fewer islands of the
next round. They stay whole on the way and are one individual of the population that they meet there. No island ever
holds more than about ``ISLAND`` pieces, and the last round is one island unless there are more than ``ROUNDS`` rounds.
"""

from __future__ import annotations

import base64
import os
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellane.llm.shared import small_batches, store, whole_text
from tessellane.llm.tokens import tokenizer_path

MODEL = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024
ISLAND = 4096
ROUNDS = 6
#: Individuals of an island, its generations, sequences injected by a crossover, those dissolved that aren't full and that hold many pieces.
PEOPLE, GENERATIONS, INJECTED, DISSOLVED, MIXED = 3, 100, 2, 10, 3
#: Full sequences of at most so many pieces are final; where they are fewer than this share, all are but the emptiest ones, this many.
FEW_PIECES, SETTLED, LOOSE = 3, 0.2, 0.05
#: Texts of characters under U+0250 without these have the same ids from either library.
_SEPARATORS, _OTHER = "\x1c\x1d\x1e\x1f", re.compile("[\u0250-\U0010ffff]")


class Encoder:
    """Ids of texts as the library of the vocabulary file ``path`` gives them.

    Where the same vocabulary lies beside it as ranks, texts go to the faster library for ranks, which gives the same ids;
    texts with special tokens' strings or with characters of other scripts go to the vocabulary's own library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.fast = _ranks_encoder(path.removesuffix(".json") + ".tiktoken")

    def __call__(self, text: str) -> bytes:
        if self.fast is None or (not text.isascii() and _OTHER.search(text)) or any(c in text for c in _SEPARATORS) or ("<" in text and self.special.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        return np.array(ids, "<u4").tobytes()


def _ranks_encoder(path: str):
    if not os.path.exists(path):
        return None
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter than a sequence."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for): one row a piece, in one pass over the texts."""
    small_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            owner, out, ids = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                got = encode(t) + end
                for k, (s, n) in enumerate(cut(len(got) // 4, capacity)):
                    own = got[4 * s : 4 * (s + n)]
                    owner.append(i)
                    out.append((k, s, n, zlib.crc32(own)))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").tolist())
            cols = [batch.column(0).take(pa.array(owner, pa.int64()))]
            cols += [pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            cols += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.record_batch(cols, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", whole_text(text).alias("text")).mapInArrow(run, schema)


class _Open:
    """Sequences by the space they have left, for best fit in constant time."""

    def __init__(self, capacity: int) -> None:
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, space: int, i: int) -> None:
        self.by_space[space].append(i)
        self.mask |= 1 << space

    def take(self, size: int) -> tuple[int, int] | None:
        """The sequence with the least space that is enough."""
        fit = self.mask >> size
        if not fit:
            return None
        space = size + (fit & -fit).bit_length() - 1
        i = self.by_space[space].pop()
        if not self.by_space[space]:
            self.mask ^= 1 << space
        return space, i


def best_fit(sizes: list[int], groups: list[list[int]], loose: list[int], capacity: int) -> list[list[int]]:
    """Put the pieces ``loose`` into ``groups`` (changed in place) or new ones, in the order given."""
    free = _Open(capacity)
    for i, g in enumerate(groups):
        space = capacity - sum(sizes[x] for x in g)
        if space:
            free.add(space, i)
    for x in loose:
        got = free.take(sizes[x])
        if got is None:
            got = capacity, len(groups)
            groups.append([])
        groups[got[1]].append(x)
        if got[0] > sizes[x]:
            free.add(got[0] - sizes[x], got[1])
    return groups


#: An individual: sequences as (fill, pieces).
Individual = list[tuple[int, tuple[int, ...]]]


def fitness(people: Individual) -> tuple[int, int]:
    """Fewer sequences first, then the unevenness of their fill."""
    return -len(people), sum(fill * fill for fill, _ in people)


def measured(sizes: list[int], groups: list[list[int]]) -> Individual:
    return [(sum(map(sizes.__getitem__, g)), tuple(g)) for g in groups]


def best_subset(sizes: list[int], loose: list[int], space: int) -> list[int]:
    """Places in ``loose`` of pieces whose sum comes nearest to ``space`` from below; the first ones where several do.

    Sums that can be reached are bits of a number, one number for each place.
    """
    mask, reach = (1 << (space + 1)) - 1, [1]
    for x in loose:
        reach.append((reach[-1] | reach[-1] << sizes[x]) & mask)
        if reach[-1] >> space:
            break
    total, k, out = reach[-1].bit_length() - 1, len(reach) - 1, []
    while total:
        while reach[k - 1] >> total & 1:
            k -= 1
        k -= 1
        out.append(k)
        total -= sizes[loose[k]]
    return out


def refill(sizes: list[int], loose: list[int], capacity: int) -> Individual:
    """Sequences of the pieces ``loose``: the largest one left opens a sequence and draws the others that fill it best."""
    left, out = sorted(loose, key=lambda x: (-sizes[x], x)), []
    while left:
        first, left = left[0], left[1:]
        drawn = set(best_subset(sizes, left, capacity - sizes[first]))
        group = (first, *(left[k] for k in sorted(drawn)))
        left = [x for k, x in enumerate(left) if k not in drawn]
        out.append((sum(map(sizes.__getitem__, group)), group))
    return out


def crossover(sizes: list[int], giver: Individual, taker: Individual, capacity: int, rng: random.Random) -> Individual:
    well_filled = [g for fill, g in giver if fill == capacity] or [max(giver)[1]]
    injected = rng.sample(well_filled, min(INJECTED, len(well_filled)))
    placed = {x for g in injected for x in g}
    kept, displaced = [], []
    for gene in taker:
        if placed.isdisjoint(gene[1]):
            kept.append(gene)
        else:
            displaced += [x for x in gene[1] if x not in placed]
    # Mutation: the emptiest and some others that aren't full are dissolved, and of a few others those of most pieces.
    open_ = [i for i, gene in enumerate(kept) if gene[0] < capacity]
    out = set(rng.sample(open_, min(DISSOLVED, len(open_))))
    out.update(sorted(open_, key=lambda i: kept[i][0])[:1])
    out.update(sorted(rng.sample(range(len(kept)), min(len(kept), 8 * MIXED)), key=lambda i: -len(kept[i][1]))[:MIXED])
    displaced += [x for i in out for x in kept[i][1]]
    child = [gene for i, gene in enumerate(kept) if i not in out] + measured(sizes, injected) + refill(sizes, displaced, capacity)
    # The emptiest sequence goes, where best fit finds room for all its pieces elsewhere.
    last = min(range(len(child)), key=lambda i: child[i][0])
    if child[last][0] <= (len(child) - 1) * capacity - sum(fill for fill, _ in child) + child[last][0]:
        groups = [list(g) for i, (_, g) in enumerate(child) if i != last]
        tried = best_fit(sizes, groups, sorted(child[last][1], key=lambda x: -sizes[x]), capacity)
        if len(tried) < len(child):
            return measured(sizes, tried)
    return child


def evolve(sizes: list[int], capacity: int = CAPACITY, seed: int = 0, immigrants: list[list[int]] | None = None) -> list[list[int]]:
    """An island: groups of indices of ``sizes``, each of at most ``capacity`` in sum. ``immigrants`` are such groups already."""
    if not sizes:
        return []
    rng = random.Random(seed)
    falling = sorted(range(len(sizes)), key=lambda x: -sizes[x])
    first = [best_fit(sizes, [], falling, capacity), *([immigrants] if immigrants else [])]
    while len(first) < PEOPLE:
        first.append(best_fit(sizes, [], sorted(falling, key=lambda x: -sizes[x] * rng.uniform(0.95, 1.05)), capacity))
    people = sorted(((fitness(p), p) for p in (measured(sizes, g) for g in first)), key=lambda t: t[0], reverse=True)
    for _ in range(GENERATIONS):
        if sum(fill < capacity for fill, _ in people[0][1]) <= 1:
            break  # no better individual can be
        best, i = people[0][1], rng.randrange(1, len(people))
        other = people[i][1]
        for giver, taker, place in ((other, best, 0), (best, other, i)):
            child = crossover(sizes, giver, taker, capacity, rng)
            value = fitness(child)
            if value >= people[place][0]:
                people[place] = value, child
            elif value > people[-1][0]:
                people[-1] = value, child
        people.sort(key=lambda t: t[0], reverse=True)
    return [list(g) for _, g in people[0][1]]


def _settled(groups: list[list[int]], fills: list[int], capacity: int) -> list[bool]:
    """Which sequences of an island are final."""
    final = [f == capacity and len(g) <= FEW_PIECES for f, g in zip(fills, groups, strict=True)]
    if sum(final) >= SETTLED * len(groups):
        return final
    # Pieces of which few full sequences can be made: other islands won't do better by much.
    emptiest = set(sorted(range(len(groups)), key=lambda i: fills[i])[: max(1, int(LOOSE * len(groups)))])
    return [i not in emptiest for i in range(len(groups))]


def _island(capacity: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        came = rows.groupby("gene", sort=True).indices if (rows["gene"] >= 0).all() else {}
        groups = evolve(sizes, capacity, int(rows["island"].iloc[0]), [g.tolist() for g in came.values()])
        fills = [sum(sizes[x] for x in g) for g in groups]
        final = [True] * len(groups) if last else _settled(groups, fills, capacity)
        slot, offset, moves = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for i, g in enumerate(groups):
            slot[g], moves[g] = i, not final[i]
            offset[g] = np.cumsum([0, *(sizes[x] for x in g[:-1])])
        return rows.drop(columns="gene").assign(slot=slot, offset=offset, moves=moves)

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    ``length`` must be 1 to ``capacity``. Repeated rows are packed each, whatever is null. An empty table gives an empty table.
    ``rows`` is read several times and should be a stored table.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    base = ", ".join(f"{c} {kinds[c]}" for c in names)
    number = F.lit(ROUNDS << 58) + F.monotonically_increasing_id()
    done = rows.where(F.col("length") == capacity).select(*names, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = rows.where(F.col("length") < capacity).select(*names, F.lit(-1).cast("long").alias("gene"))
    for level in range(ROUNDS):
        n = max(1, -(-todo.count() // ISLAND))
        key = F.col("gene") if level else F.monotonically_increasing_id()
        dealt = todo.withColumn("island", F.pmod(F.xxhash64(key, F.lit(level)), F.lit(n)))
        made = dealt.groupBy("island").applyInPandas(_island(capacity, level == ROUNDS - 1 or n == 1), f"{base}, island long, slot long, offset long, moves boolean")
        out = store(made, f"round{level}")
        gene = F.shiftleft(F.col("island"), 16) + F.col("slot")
        done = done.unionByName(out.where("not moves").select(*names, (gene + F.lit(level << 58)).alias("sequence_id"), "offset"))
        if n == 1:
            break
        todo = out.where("moves").select(*names, gene.alias("gene"))
    return done


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece of each document.

    Null text is empty and is the end id alone; documents of any length are encoded whole; repeated rows are packed
    each; an empty table gives an empty table; other columns aren't read.
    """
    return pack(store(pieces(docs, path or tokenizer_path(MODEL), capacity, text), "pieces"), capacity)


def sequences(packed: DataFrame, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves; doc_id must be unique in ``docs``. A sequence is bounded by ``capacity``."""
    own = pieces(docs, path or tokenizer_path(MODEL), capacity, with_ids=True).select("doc_id", "piece", "ids")
    placed = packed.join(own, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return placed.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
