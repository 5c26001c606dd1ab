"""Read status and run counters. Failed reads are flagged, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Status bits and quality limits.
FAILED_CALIBRATION, FAILED_ALIGNMENT, FAILED_QUALITY = 1, 2, 4
MAX_CALIBRATION_VAR = 2.5
MAX_EVENTS_PER_BASE = 5.0
MAX_EVENTS_PER_READ_BASE = 15.0
#: Below one event per base the chance to stay on a base would be negative, so such a read can't be scored.
MIN_EVENTS_PER_BASE = 1.0
MIN_EVENTS_TO_RESCALE = 200


def alignable(n_events: Column, read_length: Column) -> Column:
    """False for over-segmented and for empty reads; the length in bases is what counts, not the k-mers."""
    return F.coalesce(n_events / F.nullif(read_length, F.lit(0)) < MAX_EVENTS_PER_READ_BASE, F.lit(False))


def read_status(n_pairs: Column, n_match: Column, var: Column, events_per_base: Column,
                min_events: int = MIN_EVENTS_TO_RESCALE) -> Column:
    return (F.when(F.coalesce(n_pairs, F.lit(0)) == 0, F.lit(FAILED_ALIGNMENT))
            .when((F.coalesce(n_match, F.lit(0)) < min_events) | (var > MAX_CALIBRATION_VAR),
                  F.lit(FAILED_CALIBRATION))
            .when((events_per_base > MAX_EVENTS_PER_BASE) | (events_per_base < MIN_EVENTS_PER_BASE), F.lit(FAILED_QUALITY))
            .otherwise(F.lit(0)))


def run_counters(reads: DataFrame) -> DataFrame:
    """One row of totals over (status, read_length)."""
    def having(bit: int) -> Column:
        return F.sum(F.when(F.col("status").bitwiseAND(bit) != 0, 1).otherwise(0)).cast("long")

    return reads.agg(
        F.count("*").alias("total_reads"),
        having(FAILED_CALIBRATION).alias("failed_calibration"),
        having(FAILED_ALIGNMENT).alias("failed_alignment"),
        having(FAILED_QUALITY).alias("failed_quality"),
        F.sum(F.col("read_length").cast("long")).alias("total_bases"))


def status_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("status").agg(
        F.count("*").alias("n_reads"), F.sum(F.col("read_length").cast("long")).alias("bases"))
