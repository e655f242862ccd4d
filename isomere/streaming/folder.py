"""BED6 files that arrive in a folder, pooled and clustered anew as batches come.

The engine's operators work on complete tables; a stream only collects reads.
Each batch is appended to a table of reads by its number, so a batch that runs
twice is written once, and the units are made from the whole table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import bed


def watch_bed(spark: SparkSession, folder: str, table: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts a query that appends the reads of new files to ``table`` (a Parquet folder by batch) and calls ``on_batch`` with all reads so far."""
    lines = spark.readStream.format("text").load(folder)

    def take(batch: DataFrame, number: int) -> None:
        reads = bed.as_reads(bed.parse_bed6(batch), "bed6")
        reads.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if on_batch:
            on_batch(batch.sparkSession.read.parquet(table).drop("batch"), number)

    return lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def span_histogram(spark: SparkSession, folder: str, width: int = 10_000) -> DataFrame:
    """A streaming table of read counts by contig, strand and stretch of the contig."""
    reads = bed.as_reads(bed.parse_bed6(spark.readStream.format("text").load(folder)), "bed6")
    return reads.groupBy("contig", "strand", F.expr(f"start div {width}").alias("stretch")).agg(F.count("*").alias("n_reads"))
