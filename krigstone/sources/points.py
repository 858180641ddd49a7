"""Point sets: a table with point_id and scalar coordinates x0, x1, ... in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_DIMENSIONS = 6
MOST_NEIGHBORS = 64


def coordinates(df: DataFrame) -> list[str]:
    """The coordinate columns, in order; raises ValueError unless there are 1 to 6."""
    found = sorted((c for c in df.columns if c[0] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    if not 1 <= len(found) <= MOST_DIMENSIONS or found != [f"x{i}" for i in range(len(found))]:
        raise ValueError(f"points need coordinates x0 to x5 at most, without gaps; got {found}")
    return found


def check_neighbors(k: int) -> int:
    if not 1 <= k <= MOST_NEIGHBORS:
        raise ValueError(f"k must be from 1 to {MOST_NEIGHBORS}; got {k}")
    return k


def read_points(df: DataFrame, point_id: Column | str, *values: Column | str) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    columns = [as_column(v).cast("double").alias(f"x{i}") for i, v in enumerate(values)]
    return df.select(as_column(point_id).cast("long").alias("point_id"), *columns)


def embedding_points(spark: SparkSession, sf_dir: str, dimensions: int = 3) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return read_points(table, "vec_id", *(F.col("embedding")[i] for i in range(dimensions)))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and day of each order, scaled to similar spreads."""
    table = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return read_points(table, "o_orderkey", F.col("o_totalprice") / 500000.0, day / F.lit(2500.0))
