"""Row numbers of any number of rows, without a window in one task."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import shared_folder

#: monotonically_increasing_id has the row's number within its partition in this many low bits.
_LOW_BITS = 33
#: Parquet options: long numbers and texts as differences, and a codec that takes less room than the default one.
SMALL = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and it survives the loss of any executor."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables in a folder of their own in the shared one; the folder goes when the block ends, or before by `remove`.

    Nothing that is read later may still need them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/graphloom-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.remove()

    def written(self, df: DataFrame, *by: str) -> DataFrame:
        """df as a Parquet table in this folder, partitioned by the columns `by` if there are any."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.options(**SMALL).partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(rows: DataFrame, by: Sequence[Column | str], name: str = "row", start: int = 1, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """rows with their number in the order of `by`, from `start` on.

    Rows are cut into ranges of the order, sorted there and written; the sizes of ranges, a row for each partition, add
    up to where each range begins. Rows that `by` does not tell apart are numbered in any order, and share a range:
    `by` should tell rows apart.
    """
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return numbered_as_written(ordered.withColumn(name, F.lit(None).cast("long")), name, start, write)


def numbered_as_written(rows: DataFrame, name: str, start: int = 1, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """rows with numbers from `start` on where the long column `name` is null, those of a partition in a run of their own.

    Those have to come first in their partition. Rows are written once, by `write`; the counts of partitions add up to where each begins.
    """
    placed = write(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOW_BITS)
    sizes = sorted(placed.where(F.col(name).isNull()).groupBy(part.alias("part")).count().collect())  # a row for each partition
    begins, total = [], start
    for part_, size in sizes:
        begins.append((part_, total))
        total += size
    if not begins:
        return placed.drop("_at")
    begin = placed.sparkSession.createDataFrame(begins, "_part long, _begin long")
    found = placed.withColumn("_part", part).join(F.broadcast(begin), "_part", "left")
    number = F.coalesce(name, F.col("_begin") + F.col("_at").bitwiseAND((1 << _LOW_BITS) - 1))
    return found.select(*(c for c in rows.columns if c != name), number.alias(name))
