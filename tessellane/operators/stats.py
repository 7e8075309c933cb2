"""Batch statistics: tiers, percentages that add up to 100, reference resolution, byte-pair merges, records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellane.functions.text import reference_numbers
from tessellane.operators.index import discard, materialized


def largest_remainder(counts: DataFrame, group: str, count: str = "n", total: int = 100) -> DataFrame:
    """``counts`` with percent: whole numbers that add up to ``total``, the largest remainders rounded up."""
    share = F.col(count) * total / F.sum(count).over(Window.partitionBy())
    order = Window.orderBy(F.round(F.col("share") - F.floor("share"), 9).desc(), F.col(group))
    short = F.lit(total) - F.sum(F.floor("share")).over(Window.partitionBy())
    ranked = counts.withColumn("share", share).withColumn("short", short).withColumn("place", F.row_number().over(order))
    return ranked.withColumn("percent", (F.floor("share") + (F.col("place") <= F.col("short")).cast("int")).cast("long")).drop("share", "short", "place")


# What the cost tags weigh.
MONEY, TIME, WILL = {"0": 0, "少": 1, "多": 2}, {"少": 0, "中": 1, "多": 2}, {"否": 0, "些": 1, "是": 2}


def _weight(tag: Column, weights: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[tag], F.lit(0))


def tier(money: Column, time: Column, will: Column, benefit: Column) -> Column:
    """The tier of an entry: what it costs (unknown tags weigh 0) against its benefit; null where it has no benefit tag.

    A great benefit (大) at no cost is 极高, at a cost of 1 or 2 高; a middling one (中) at no cost is 高; all else is 一般.
    """
    cost = _weight(money, MONEY) + _weight(time, TIME) + _weight(will, WILL)
    great, middling = benefit == "大", benefit == "中"
    named = F.when(great & (cost == 0), "极高").when((great & (cost <= 2)) | (middling & (cost == 0)), "高").otherwise("一般")
    return F.when(benefit.isNotNull(), named)


def resolved(references: DataFrame, entries: DataFrame) -> DataFrame:
    """``references`` (source, text) to rows (source, target, title): each number named, title null where no entry has it.

    ``entries`` has (entry, title).
    """
    named = references.select("source", F.explode(reference_numbers(F.col("text"))).alias("target"))
    return named.join(entries.select(F.col("entry").alias("target"), "title"), "target", "left").select("source", "target", "title")


def marked(lines: DataFrame, heading: Column, order: str, group: str) -> DataFrame:
    """``lines`` with the nearest heading above each line of its group."""
    above = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("heading", F.last(heading, ignorenulls=True).over(above))


def pair_counts(ids: DataFrame) -> DataFrame:
    """left, right, n of neighbouring ids in the arrays ``ids``."""
    at = F.transform(F.when(F.size("ids") > 1, F.sequence(F.lit(0), F.size("ids") - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get("ids", i).alias("left"), F.get("ids", i + 1).alias("right")))
    return ids.select(F.explode(at).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("n"))


def merged(ids: Column, left: int, right: int, new: int) -> Column:
    """Neighbours (left, right) replaced by ``new``, from the left."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1) == left) & (x == right), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(new)))
    ).otherwise(F.concat(acc, F.array(x)))
    return F.when(F.array_contains(ids, left) & F.array_contains(ids, right), F.aggregate(ids, F.array().cast("array<int>"), step)).otherwise(ids)


def train_merges(texts: DataFrame, merges: int, text: str = "text") -> list[tuple[int, int, int]]:
    """(left, right, new) of a byte-pair vocabulary: in each round the most frequent pair, then the smallest. The driver sees a pair a round.

    Words are counted first, so rounds work on distinct words and their weights.
    """
    words = texts.select(F.explode(F.split(F.coalesce(text, F.lit("")), r"(?<=\s)")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("weight"))
    raw = F.hex(F.encode("w", "UTF-8"))
    state = words.select("weight", F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int")).alias("ids"))
    out: list[tuple[int, int, int]] = []
    state = materialized(state, "words")
    for new in range(256, 256 + merges):
        at = F.transform(F.when(F.size("ids") > 1, F.sequence(F.lit(0), F.size("ids") - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get("ids", i).alias("left"), F.get("ids", i + 1).alias("right")))
        best = state.select("weight", F.explode(at).alias("p")).groupBy("p.left", "p.right").agg(F.sum("weight").alias("n")).orderBy(F.desc("n"), "left", "right").first()
        if best is None or best["n"] < 2:
            break
        out.append((best["left"], best["right"], new))
        # The words as they are now, so that a round costs the same however many came before.
        before, state = state, materialized(state.withColumn("ids", merged(F.col("ids"), *out[-1])), "words")
        discard(before)
    discard(state)
    return out


def encode(text: str, merges: list[tuple[int, int, int]]) -> list[int]:
    """Ids of one text, merges applied in the order they were learned."""
    ids = list(text.encode())
    for left, right, new in merges:
        out: list[int] = []
        i = 0
        while i < len(ids):
            if i + 1 < len(ids) and (ids[i], ids[i + 1]) == (left, right):
                out.append(new)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def decode(ids: list[int], merges: list[tuple[int, int, int]]) -> str:
    pieces = {i: bytes([i]) for i in range(256)}
    for left, right, new in merges:
        pieces[new] = pieces[left] + pieces[right]
    return b"".join(pieces[i] for i in ids).decode("utf-8", "replace")


def encoded(text: Column, merges: list[tuple[int, int, int]]) -> Column:
    """``encode`` of a column; null stays null."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else encode(t, merges))

    return run(text)


def decoded(ids: Column, merges: list[tuple[int, int, int]]) -> Column:
    """``decode`` of a column; null stays null."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else decode(list(r), merges))

    return run(ids)


def last_put(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A map filled in ``order``: the last value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def next_token(logits: DataFrame, k: int, temperature: float = 1.0) -> DataFrame:
    """query_id, token, p: the ``k`` likeliest tokens of ``logits`` (query_id, token, logit) with probabilities among themselves."""
    order = Window.partitionBy("query_id").orderBy(F.desc("logit"), "token")
    top = logits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    e = F.exp((F.col("logit") - F.max("logit").over(Window.partitionBy("query_id"))) / temperature)
    return top.withColumn("e", e).select("query_id", "token", (F.col("e") / F.sum("e").over(Window.partitionBy("query_id"))).alias("p"))
