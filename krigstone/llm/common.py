"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import _new_table as new_table
from ..storage import materialize, shared_dir

__all__ = ["SPACE", "WORD", "bucketed", "by_bytes", "materialize", "partitions", "shared_dir", "slices", "table", "texts", "unused"]

#: White space that separates words, and its complement, as Java and RE2 regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text, a null one as the empty text; other columns only if named."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def unused(docs: DataFrame, name: str) -> str:
    """name, or with underscores before it, so that docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches, rows: int = 500):
    """Parts of Arrow batches, so that a task holds Python objects for so many rows only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(batches, column: str, most: int):
    """Parts of Arrow batches with at most so many bytes in a string or binary column, or one row."""
    for batch in batches:
        values = batch.column(column)
        bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
        at = 0
        while at < len(values):
            end = max(at + 1, int(np.searchsorted(bounds, int(bounds[at]) + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def bucketed(df: DataFrame, n: int, by: str) -> DataFrame:
    """df as a table in the shared folder with n buckets, so that joins and groups by this column don't move it.

    Spark knows buckets of tables in the catalog only; the name is taken out again at once, and the
    files stay until ``remove_tables``.
    """
    spark, name = df.sparkSession, f"buckets_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, by).option("path", new_table(spark)).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found
