"""Continuous upload: each micro-batch of new files goes into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup_store import DedupStore


def ingest(spark: SparkSession, source: str, store: DedupStore, checkpoint: str, **sizes: int) -> StreamingQuery:
    """Upload the files that appear under ``source``, each once. A batch that is run again after a
    failure skips what the store has."""

    def upload(batch: DataFrame, batch_id: int) -> None:
        new = batch.select("path", "content").dropDuplicates(["path"]).join(store.recipe.select("path").distinct(), "path", "left_anti")
        if not new.isEmpty():
            store.upload(new, **sizes)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(source)
    return files.select("path", F.col("content")).writeStream.foreachBatch(upload).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
