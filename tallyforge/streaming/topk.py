"""Incremental top-k over a stream: the state is k rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import topk


class StreamingTopK:
    """Keeps the k largest rows of a stream in files: one version for each micro-batch.

    A batch's version is the top k of the version before and the batch, so a
    batch that runs again after a failure writes the same rows again. Progress
    lies in the store as well: a later run, also of another session, goes on
    behind the last batch.
    """

    def __init__(self, spark: SparkSession, store: str, value: str, k: int, *payload: str) -> None:
        self.spark, self.store, self.value, self.k, self.payload = spark, store, value, k, payload

    def merge(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = topk(batch, self.value, self.k, *self.payload)
        if epoch:
            rows = topk(rows.union(spark.read.schema(rows.schema).parquet(f"{self.store}/version={epoch - 1}")), self.value, self.k, *self.payload)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.store}/version={epoch}")

    def last_version(self) -> int:
        """The newest version in the store; -1 where there is none."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.store)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return max((int(n.partition("=")[2]) for n in names if n.startswith("version=")), default=-1)

    def run(self, stream: DataFrame) -> DataFrame:
        """Drain ``stream`` and return the k rows, in order."""
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.store}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        last = self.last_version()
        if last < 0:
            return topk(self.spark.createDataFrame([], stream.schema), self.value, self.k, *self.payload)
        return self.spark.read.parquet(f"{self.store}/version={last}").orderBy(F.col(self.value).desc(), *[F.col(p).asc() for p in self.payload])
