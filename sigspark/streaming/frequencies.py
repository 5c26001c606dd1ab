"""Methylation frequencies while sequencing runs.

Counts per site only ever add up, so two forms are offered. ``running_frequency`` keeps the sums
in the state store. ``append_partials`` writes the frequencies of each micro-batch as its own
partition and ``merged`` sums them on read; it needs no state, and a batch that is run again
replaces its own partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sigspark.operators import frequency
from sigspark.sources import tsv


def call_stream(spark: SparkSession, directory: str, version: int = 2, files_per_trigger: int = 100) -> DataFrame:
    """Calls of the files that appear in a directory."""
    columns = tsv.CALL_COLUMNS if version == 1 else tsv.CALL_COLUMNS_V2
    schema = ", ".join(f"`{c}` {tsv.CALL_TYPES.get(c, 'string')}" for c in columns)
    rows = (spark.readStream.schema(schema).option("header", True).option("sep", "\t")
            .option("maxFilesPerTrigger", files_per_trigger).csv(directory))
    # Files in order of arrival and the read name inside one stand for the input order; a stream
    # has no row numbers.
    return rows.withColumn("line_no", F.struct(
        F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"), F.col("read_name")))


def running_frequency(calls: DataFrame, threshold: float = 2.5, split_groups: bool = False) -> DataFrame:
    """Streaming aggregate of one row per site, for the update and complete output modes."""
    return frequency.site_frequency(calls, threshold, split_groups)


def append_partials(calls: DataFrame, path: str, checkpoint: str, threshold: float = 2.5,
                    split_groups: bool = False, available_now: bool = True) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        part = frequency.site_frequency(batch, threshold, split_groups)
        part.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Frequencies of all micro-batches so far; earlier batches describe the site."""
    parts = spark.read.parquet(path).withColumnRenamed("batch", "_file")
    return frequency.merge_tagged(parts)
