"""Incremental refresh as a stream: new document files feed chunk tables, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textloom.plans.engine import chunks_of
from textloom.sources.corpus import from_documents


def stream_chunks(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """Chunks of every document file that appears in ``source``, appended to ``target`` by batch number.

    Runs over what is there and stops; a restart goes on where the last run ended, and a repeated batch overwrites
    its own folder, so chunks arrive exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunks_of(from_documents(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
