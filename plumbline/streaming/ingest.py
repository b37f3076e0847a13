"""Structured Streaming around the batch operators: an inbox that is scored and indexed as it fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.index import CorpusIndex


def inbox(spark: SparkSession, folder: str, schema: str = "doc_id BIGINT, label STRING, source_path STRING, text STRING, ts TIMESTAMP") -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def fresh(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Without texts seen within the watermark's delay, by content hash."""
    return rows.withWatermark("ts", delay).withColumn("content_hash", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["content_hash"])


def index_stream(rows: DataFrame, index: CorpusIndex, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends every micro-batch to a corpus index."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: index.add(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_stream(rows: DataFrame, scorer: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Scores every micro-batch by a batch operator and appends the result to Parquet; a replayed batch overwrites itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
