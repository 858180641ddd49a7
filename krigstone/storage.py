"""Tables in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}
#: Tables that this process has written.
_written: list[str] = []
#: How often tables have been removed, so that what refers to earlier ones can tell.
removals = 0
#: A growing table is merged after so many additions.
MERGE = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a session on one machine without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def _new_table(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def remove_tables(spark: SparkSession) -> int:
    """Deletes the tables that this process has put into the shared folder, once results that read them are
    written elsewhere; returns how many."""
    global removals
    removals += 1
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(hadoop).delete(path, True)
    return n


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder; ``by`` lays it out in one folder for each value."""
    spark = df.sparkSession
    path = _new_table(spark)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Growing:
    """A table in the shared folder that rounds add to, laid out by the integer column ``by``.

    Reading it is one scan, however many rounds there have been, and prunes by ``by``.  Every MERGE additions
    it is written anew as what ``merge`` makes of it, in files of an even size, so that neither its files nor its rows
    grow with the rounds; what has been read before keeps the files that it knows.
    """

    def __init__(self, spark: SparkSession, schema: str, by: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.by, self.merge, self.added = spark, by, merge, 0
        self.schema = f"{schema}, {by} int"
        self.path = _new_table(spark)
        spark.createDataFrame([], self.schema).write.partitionBy(by).parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").partitionBy(self.by).parquet(self.path)
        self.added += 1
        if self.added % MERGE == 0:
            whole = self.read()
            merged = self.merge(whole).select(*whole.columns).hint("rebalance", self.by)
            path = _new_table(self.spark)
            merged.write.partitionBy(self.by).parquet(path)
            self.path = path

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def numbered(df: DataFrame, *keys: str, name: str = "position") -> DataFrame:
    """df with each row's place, from 0, in the order of keys, which must be unique together.

    A range exchange sorts in parallel; the only table that meets in one task has a row for each
    partition.
    """
    low = (1 << 33) - 1  # the bits that monotonically_increasing_id counts in within a partition
    order = [F.col(k) for k in keys]
    stored = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(low)).drop("_part", "_offset", "_at")
