"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within each source the documents are ordered by that key, and a prefix sum of
their sizes says where the source's budget ends. The prefix sum is distributed: the key space of each source is cut into
``RANGES`` ranges by the key's leading digits, the ranges' totals (at most ``RANGES`` rows a source) get their own
prefix sum, and inside each range a window adds up the single documents. So no source, however large, is ordered in one
task: a source with a third of all rows is spread over ``RANGES`` ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellane.llm.shared import store

#: Hexadecimal digits of the key that name its range; 16 ** RANGE_DIGITS ranges a source.
RANGE_DIGITS = 3
RANGES = 16**RANGE_DIGITS
#: Sources in code-point order, null last, take these weights in turn.
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A key that looks random but is the same in each run and in each engine that has MD5. The text is part of it, so that rows
    without an id, or with one and the same, don't all have one key."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit("")))))


def targets(by_source: DataFrame, share: float, most: int) -> DataFrame:
    """Targets of the sources, from their sizes (source, source_size): one row a source in and out.

    ``share`` times all sizes is dealt out by weight; no target passes ``most`` times its source's size, and what is
    above goes to the others by weight. That is water-filling, solved in closed form: with the sources in order of
    ``cap / weight``, a source is full when a level of ``cap / weight`` for it and all later ones costs no more than
    what is left. The table of sources has a row each, so the windows here see sources, never documents.
    """
    n = len(WEIGHTS)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    with_caps = by_source.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        with_caps.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("level", (F.lit(float(share)) * F.col("total") - F.col("filled")) / F.col("open_weight"))
        .withColumn("is_full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("open_level", F.min(F.when(~F.col("is_full"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(whole)["level"])
    )
    target = F.when(F.col("is_full"), F.col("cap").cast("double")).otherwise(F.col("open_level") * F.col("weight"))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def _named(source: Column) -> Column:
    """The source without null, so that windows and joins ask for one and the same partitioning and texts are shuffled once."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _keyed(docs: DataFrame, seed: str, *more: Column, text: str = "text") -> DataFrame:
    """doc_id, source, named, size, key, range: what mixing needs of each document."""
    sized = docs.select(F.col("doc_id"), F.col("source"), _named(F.col("source")).alias("named"), word_count(F.col(text)).alias("size"), random_key(F.col("doc_id"), F.col(text), seed).alias("key"), *more)
    return sized.withColumn("range", F.conv(F.substring("key", 1, RANGE_DIGITS), 16, 10).cast("int"))


def _plan(sized: DataFrame, share: float, most: int) -> DataFrame:
    """named, range, range_start, source_size, target: at most RANGES rows a source."""
    ranges = sized.groupBy("named", "range").agg(F.min("source").alias("source"), F.sum("size").alias("range_size"))
    per_range = Window.partitionBy("named").orderBy("range")
    goals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), share, most)
    offsets = ranges.withColumn("range_start", F.sum("range_size").over(per_range) - F.col("range_size"))
    made = offsets.join(goals.select(_named(F.col("source")).alias("named"), "source_size", "target"), "named")
    return store(made.select("named", "range", "range_start", "source_size", "target"), "ranges")


def _taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with source_size, target, epochs (whole repeats that all documents of the source get) and last (words of one more)."""
    within = Window.partitionBy("named", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("upto", F.sum("size").over(within)).join(plan, ["named", "range"])
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("range_start") - F.col("upto") + F.col("size")))
    return placed.select(*sized.columns, "source_size", "target", epochs.cast("long").alias("epochs"), last.cast("long").alias("last"))


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, seed: str = "mix", text: str = "text") -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    Budgets are whole words (the target's floor), cut exactly: each source's ``taken`` adds up to its budget. Full epochs
    come first; the rest of the budget goes to the documents with the smallest keys, the last of which is cut.

    Null text and text without words have size 0 and take 0; null sources are one source, the last; an empty table
    gives an empty table; repeated rows count as often as they occur; ties of the key (rows that repeat in doc_id and text, which
    share a range) fall to doc_id and size.
    Other columns of ``docs`` are not read, so they can't clash.
    """
    sized = store(_keyed(docs, seed, text=text), "sizes")
    got = _taken(sized, _plan(sized, share, most))
    return got.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, share: float = 1.5, most: int = 2, seed: str = "mix", text: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken.

    As ``mix``, but documents stay whole: the one in which the budget ends is taken if half of it or more fits. A
    document without words is taken in full epochs. Texts are shuffled once, by (source, range).
    """
    sizes = store(_keyed(docs, seed, text=text), "sizes")
    plan = _plan(sizes, share, most)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    got = _taken(_keyed(docs, seed, row, text=text), plan)
    copies = F.col("epochs") + ((F.col("last") > 0) & (2 * F.col("last") >= F.col("size"))).cast("long")
    return got.where(copies > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy")).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix:' || md5(coalesce(text, ''))) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM src),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM weighted),
open_level AS (SELECT level AS lv FROM levels WHERE NOT cap <= level * weight ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * weight THEN cap::DOUBLE ELSE (SELECT lv FROM open_level) * weight END AS target
  FROM levels),
placed AS (
  SELECT s.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s),
budgets AS (
  SELECT p.doc_id, p.size, p.upto, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         CASE WHEN g.source_size > 0 THEN floor(g.target)::BIGINT // g.source_size ELSE 0 END AS epochs
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - upto + size)) AS BIGINT) AS taken
FROM budgets
"""
