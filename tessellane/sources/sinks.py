"""Sinks: index tables as Parquet with a manifest, JSON export, Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below ``path``, and last the manifest, whose presence says that the index is whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n, df.schema.json()) for n, df in tables.items()], "name string, schema string").write.mode("overwrite").json(f"{path}/_manifest_json")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = [r["name"] for r in spark.read.schema("name string, schema string").json(f"{path}/_manifest_json").collect()]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def as_json(df: DataFrame) -> DataFrame:
    """One column, json: each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def from_json(rows: DataFrame, schema: str, json: str = "json") -> DataFrame:
    """The columns of ``schema`` from a column of JSON objects; null where one can't be read."""
    return rows.select(F.from_json(json, schema).alias("row")).select("row.*")


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def write_markdown(df: DataFrame, path: str) -> None:
    """Rows as lines of a Markdown table, in the order of ``df``."""
    df.select(markdown_row(*[F.col(c) for c in df.columns]).alias("value")).write.mode("overwrite").text(path)
