"""URL filters as a sort-merge range join, with DataFrame operations only.

A rule (host, path) fits its host and all subdomains, on paths that start with the rule's. Hosts are read from the
right (``com.example.www``), so that a URL is looked up under each suffix of its host that some rule names. The
canonical key under one suffix is the reversed suffix followed by the path, and the rules there are intervals of keys,
nested or disjoint. One sorted sweep over all keys meets rule starts and URLs; each rule start brings the stack of rules that
are active there, and the innermost rule of the latest stack that still holds the URL is the one that fits.

The sweep is cut into ranges of keys of about ``SWEEP_ROWS`` rows each, wherever suffixes begin and end, so a suffix such as
``com`` with most of all rows isn't swept by one task. A range begins with the stack that was open at its start: the last one
of the ranges before it, which is a running value over one row a range. URLs are swept as distinct (host, path); no rule
and no URL is repeated.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellane.llm.shared import store

#: Rows that a range of keys holds, on average, at most.
SWEEP_ROWS = 100_000
#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("verdict", "host", "path"), r, strict=True)]) for r in rules]
    if not rows:
        return spark.createDataFrame([], "verdict string, host string, path string")
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def stacked(rules: DataFrame) -> DataFrame:
    """Each rule start with the stack of rules active there: all rules of its host whose path starts its own path.

    Rules with the same host and path are one; ``block`` wins over other verdicts among them.
    """
    clean = rules.where("host <> '' and path is not null and verdict is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict"
    )
    one = clean.groupBy("host", "path").agg(F.coalesce(F.min(F.when(F.col("verdict") == "block", F.col("verdict"))), F.min("verdict")).alias("verdict"))
    prefixes = one.select("host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring(F.col("path"), F.lit(1), i))).alias("outer_path"))
    held = prefixes.join(one.select(F.col("host"), F.col("path").alias("outer_path"), "verdict"), ["host", "outer_path"])
    entry = F.struct(F.length("outer_path").alias("depth"), F.col("outer_path").alias("path"), F.col("verdict"))
    return held.groupBy("host", "path").agg(F.sort_array(F.collect_set(entry)).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule (host and path of the rule that fits, or null), verdict.

    The longest rule text wins, then the longer host. A URL that no rule fits gets ``default``. A null or empty URL and
    one without ``://`` have empty host and path and fit no rule. Repeated rows stay; an empty table, or no rules, is
    fine. Other columns of ``pages`` aren't read.
    """
    spark = pages.sparkSession
    parsed = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    starts = store(stacked(rules), "rules")
    hosts = starts.select(F.col("host").alias("suffix")).distinct()
    urls = parsed.where("host <> ''").select("host", "path").distinct().withColumn("suffix", F.explode(_suffixes(F.col("host")))).join(hosts, "suffix")
    lookups = urls.select(_reversed(F.col("suffix")).alias("domain"), "path", F.lit(1).alias("kind"), "host", "suffix", F.lit(None).cast(starts.schema["stack"].dataType).alias("stack"))
    opened = starts.select(_reversed(F.col("host")).alias("domain"), "path", F.lit(0).alias("kind"), F.lit("").alias("host"), F.col("host").alias("suffix"), "stack")
    met = store(opened.unionByName(lookups), "urls")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1, -(-met.count() // SWEEP_ROWS))
    # No two rows have one key, so ranges are even whatever repeats in suffixes or paths.
    key = ["domain", "path", "kind", "host"]
    ranged = store(met.repartitionByRange(n, *key).withColumn("range", F.spark_partition_id()), "sweep")
    stack = F.when(F.col("kind") == 0, F.struct("domain", "stack"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    lasts = ranged.groupBy("range").agg(F.max_by(stack, F.when(F.col("kind") == 0, F.struct("domain", "path"))).alias("last"))
    carried = lasts.select("range", F.last("last", ignorenulls=True).over(before).alias("carried"))
    order = Window.partitionBy("range").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("latest", F.last(stack, ignorenulls=True).over(order)).where("kind = 1").join(carried, "range")
    swept = swept.withColumn("latest", F.coalesce("latest", "carried")).where(F.col("latest.domain") == F.col("domain")).withColumn("active", F.col("latest.stack"))
    fits = F.element_at(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])), -1)
    found = swept.withColumn("fit", F.when(F.size(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))) > 0, fits)).where("fit is not null")
    rank = F.struct((F.length("suffix") + F.col("fit.depth")).alias("n"), F.length("suffix").alias("h"), F.concat("suffix", "fit.path").alias("rule"), F.col("fit.verdict").alias("verdict"))
    best = found.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


ORACLE = """
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT u.page_id, u.host, u.path,
       (SELECT rhost || rpath FROM r WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)
        ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM r WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)
        ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""
