"""Barcode counts of reads that keep arriving, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanewise.operators.mixing import POLY_G


def barcode_counts(reads: DataFrame, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Counts by window of ``loaded_at``, file and barcode; poly-G barcodes are left out, reads later than ``delay`` too."""
    known = reads.filter(F.col("idx").isNotNull() & ~F.col("idx").contains(POLY_G))
    timed = known.withWatermark("loaded_at", delay)
    return timed.groupBy(F.window("loaded_at", window).alias("span"), "file", "idx").agg(F.count("*").alias("Count")).select("span.start", "file", "idx", "Count")


def write(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows as Parquet files, each once; runs until what is there has been read."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_all(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All windows so far, late reads included, as a Parquet table that each batch replaces; runs until what is there has been read."""
    replace = lambda rows, _: rows.write.mode("overwrite").parquet(path)
    return counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
