"""Live statistics as a stream over landed files: the batch upsert, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.rolling import last_per_group


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last written row of each key."""
    return last_per_group(rows, keys, order)


def upsert_stream(spark: SparkSession, landing: str, schema: str, target: str, keys: Sequence[str], version: str, checkpoint: str, partition: str) -> StreamingQuery:
    """Take what has landed since the last run and keep the newest version of each key, by partition.

    A micro-batch reads the partitions that it touches, merges them with its rows, writes the result to a
    folder of its own batch id and then replaces those partitions, so a batch that runs twice gives the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        touched = [r[0] for r in batch.select(partition).distinct().collect()]
        if not touched:
            return
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(target)
        old = batch.sparkSession.read.parquet(target).where(F.col(partition).isin(touched)).select(*batch.columns) if path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(path) else batch.limit(0)
        rows = latest(old.unionByName(batch), keys, [F.desc(version)])
        staged = f"{checkpoint}/staged/{batch_id}"
        rows.write.mode("overwrite").parquet(staged)
        batch.sparkSession.read.schema(batch.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)

    return spark.readStream.schema(schema).json(landing).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
