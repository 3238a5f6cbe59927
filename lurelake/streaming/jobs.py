"""Structured Streaming forms of the two incremental jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurelake import params as P
from lurelake.operators.rules import rule_layer
from lurelake.sources import upsert


SCORED = ("message_type", "sender_domain", "score", "verdict", "reason")


def stream_score_messages(messages: DataFrame, out_path: str, checkpoint: str,
                          lists: P.RuleLists | None = None, id_col: str = "msg_id",
                          blacklist: DataFrame | None = None):
    """Score a stream of messages with the batch rule layer and append the narrow result.

    The streamed rows equal the batch rows.  Without a threat feed the layer is map-only and the file sink
    commits each micro-batch once.  With one, each micro-batch is joined as a batch and written under its own
    id, so a retry overwrites what it wrote before.
    """
    def scored(rows: DataFrame) -> DataFrame:
        return rule_layer(rows, lists, blacklist, id_col=id_col).select(id_col, *SCORED)

    if blacklist is None:
        return (scored(messages).writeStream.format("parquet").option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start(out_path))

    def write(batch: DataFrame, batch_id: int) -> None:
        scored(batch).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def stream_feed_dedupe(feed: DataFrame, out_path: str, checkpoint: str,
                       delay: str = "1 hour", buckets: int = upsert.BUCKETS):
    """Drop repeated ids inside the watermark and merge each micro-batch into the table of the newest row per
    URL; see ``sources.upsert``.  A retried batch changes nothing, a late row never replaces a newer one."""
    unique = feed.withWatermark("date", delay).dropDuplicatesWithinWatermark(["id"])

    def merge(batch: DataFrame, _: int) -> None:
        upsert.merge(batch, out_path, "url", "id", buckets)

    return (unique.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def feed_latest(spark: SparkSession, out_path: str, schema) -> DataFrame:
    """Newest row per URL over all batches, as merged."""
    return upsert.read(spark, out_path, schema)


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(path))


def with_timestamp(df: DataFrame, col: str = "date") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))
