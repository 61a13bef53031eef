"""A sink for micro-batches whose rows appear once, however often a run stops and starts again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.tables import delete


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, made at once: it is there or it is not."""
    target, files = _file_system(spark, path)
    files.create(target, True).close()


def names(spark: SparkSession, path: str) -> list[str]:
    target, files = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []


class BatchSink:
    """Rows of each batch beside the final place, committed by the batch's id once they are whole; the final place is written once.

    A batch that comes again after its commit is left alone; one that was cut off before it takes the place of what is there.
    So with a checkpointed stream each batch counts once. close() gathers committed batches only, and a final place with its
    completion marker is never written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.partial, self.commits = f"{self.path}.partial", f"{self.path}.commits"

    def write(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch."""
        if not exists(self.spark, f"{self.commits}/{batch}"):
            self.save(rows, batch)
            mark(self.spark, f"{self.commits}/{batch}")

    def save(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.partial}/batch={batch}")

    def committed(self) -> list[int]:
        return sorted(int(x) for x in names(self.spark, self.commits) if x.isdigit())

    def finished(self) -> bool:
        return exists(self.spark, f"{self.path}/_SUCCESS")

    def close(self) -> DataFrame:
        """The final rows, with their batch; what no commit vouches for is left out."""
        if not self.finished():
            found = self.committed()
            if not found:
                raise ValueError(f"no batch was committed beside {self.path}")
            rows = self.spark.read.option("basePath", self.partial).parquet(*(f"{self.partial}/batch={b}" for b in found))
            rows.withColumn("batch", F.col("batch").cast("long")).write.mode("overwrite").parquet(self.path)
        return self.spark.read.parquet(self.path)

    def clear(self) -> None:
        """Drops the partial rows once the final place is whole."""
        if self.finished():
            delete(self.spark, self.partial)
            delete(self.spark, self.commits)
