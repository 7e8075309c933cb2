"""Connected components of a table of links, in Spark, without ever bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellane.llm.shared import discard, store

#: Rounds halve the longest path to a root at least, so this covers any graph that fits a cluster.
MOST_ROUNDS = 60
#: A node with fewer rows is no hub.
LEAST_HUB = 128


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node either names one other node or is named, never both."""
    uses = edges.select(F.col("u").alias("node"), F.lit(1).alias("names"), F.lit(0).alias("named"))
    uses = uses.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("names"), F.lit(1).alias("named")))
    per_node = uses.groupBy("node").agg(F.sum("names").alias("names"), F.max("named").alias("named"))
    return per_node.where((F.col("names") > 1) | ((F.col("names") > 0) & (F.col("named") > 0))).isEmpty()


def _beside(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v, m of ``rows`` (u, v) and ``nodes`` (u, m, n rows of u).

    Nodes with more rows than a quarter of what a task should get are hubs; there are fewer than four for each task. A
    hub's rows are dealt over salts, and its one row of ``nodes`` is repeated for each.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    sized = store(nodes, "nodes")
    most = F.greatest(F.lit(LEAST_HUB), F.lit(-(-(sized.agg(F.sum("n")).first()[0] or 0) // (4 * parts))))
    hubs = sized.where(F.col("n") > most).select("u", F.ceil(F.col("n") / most).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(F.broadcast(hubs), "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), salts).cast("int").alias("salt"))
    right = sized.join(F.broadcast(hubs), "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return left.join(right, ["u", "salt"]).select("u", "v", "m")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has a link to another; component is the smallest node reachable.

    Alternating large-star and small-star steps: in each, a node's neighbours are linked to its smallest neighbour, so
    the table never has more rows than links it began with. A star's centre never gathers its neighbours: steps are
    ``min`` by key (combined before the shuffle) joined back on the key, where the rows of a hub are salted. Each round is
    written to the shared folder; the loop ends when all links lead straight to their component's smallest node, and a
    RuntimeError is raised if they don't after ``MOST_ROUNDS``.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = store(edges, "links")
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _beside(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours meet at the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = _beside(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(edges)
        edges = after
        if _is_star_forest(edges):
            break
    else:
        raise RuntimeError(f"components aren't settled after {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
