"""Extensions beyond the reference's surface: the additive merge of counters as a stream, and windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import upsert_add


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), 0)).alias("word"), "doc_id").groupBy("word").agg(F.count("*").alias("total"), F.max("doc_id").alias("seq"))


def merge_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the words of each micro-batch to the table at ``path``.

    Versions alternate by batch id and hold the id they were made of, so that a batch that is run again after a failure
    starts from the version before it and isn't counted twice.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        delta = word_counts(batch)
        if batch_id > 0:
            old = spark.read.parquet(f"{path}/v{batch_id - 1}")
            delta = upsert_add(old, delta, ["word"], ["total"], [], "seq")
        delta.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event type and window; rows later than the watermark are left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
