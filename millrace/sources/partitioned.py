"""Tables that are the union of their partitions, and joins with tables that each partition has a replica of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class PartitionedTable:
    """Parquet with a folder for each value of a column. Reading it is the union of the partitions, and a filter on
    the column is answered from the folders' names."""

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path, column

    def write(self, df: DataFrame, mode: str = "errorifexists", files: int = 1) -> None:
        """A large partition is dealt over up to `files` files, so that no task writes it alone."""
        salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(files))
        df.withColumn("__salt", salt).repartition(self.column, "__salt").drop("__salt").write.mode(mode).partitionBy(self.column).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def partition(self, value) -> DataFrame:
        return self.read().where(F.col(self.column) == F.lit(value))


#: A replica is sent to all tasks only if the optimiser's estimate of its size is at most this many bytes.
REPLICA_BYTES = 64 << 20


def size_of(df: DataFrame) -> int:
    """The optimiser's estimate of a DataFrame's bytes; without statistics it is an upper bound from the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def replica_join(facts: DataFrame, replica: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join within each partition of the facts, with the whole replica there; one that is too large is shuffled."""
    return facts.join(F.broadcast(replica) if size_of(replica) <= REPLICA_BYTES else replica, on, how)
