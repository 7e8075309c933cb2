"""What the operators of this package share: the working folder, stored tables and input columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch brings to a Python worker; keeps a worker's memory bounded when texts are long.
BATCH_ROWS = 500
_FALLBACK_DIR = "/tmp/checkpoints/tessellane"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own, but only on a
    local master: a machine's folder is of no use to a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _FALLBACK_DIR).rstrip("/")


#: Folders of the tables that ``store`` has written and nobody has deleted, by application.
_stored: dict[str, list[str]] = {}


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the running tasks only, never the work that led here. The table stays until
    ``discard`` or ``discard_all``, as what an operator returns is read later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessellane-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``store`` once nothing reads it any more."""
    names = _folders(df)
    _delete(df.sparkSession, lambda path: path.rsplit("/", 1)[-1] in names)


def discard_all(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete all tables that this session has stored but ``keep``: when the results of the operators have been written."""
    names = {n for df in keep for n in _folders(df)}
    _delete(spark, lambda path: path.rsplit("/", 1)[-1] not in names)


def _delete(spark: SparkSession, which) -> None:
    made = _stored.get(spark.sparkContext.applicationId, [])
    for path in [p for p in made if which(p)]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        made.remove(path)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's number of rows in an Arrow batch, if it is higher: plans read it when they run, after the operator returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
