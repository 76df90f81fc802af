"""Streams: the same extraction on files as they come, and windowed counts of events. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchmint.config import Settings
from parchmint.operators.assemble import extract_receipts
from parchmint.sources.recorded import RECORDED, effective_lines


def stream_receipts(spark: SparkSession, source: str, sink: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Recorded results in `source` to receipts in `sink`, each batch once: a batch written again replaces itself."""
    rows = spark.readStream.schema(RECORDED).option("multiLine", True).json(source)
    rows = rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.ocr\.json$", "").alias("doc_id"), effective_lines().alias("lines"))

    def write(batch: DataFrame, n: int) -> None:
        extract_receipts(batch, settings).write.mode("overwrite").json(f"{sink}/batch={n}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; works on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
