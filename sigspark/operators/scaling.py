"""Calibration of a read against the pore model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def moments_scaling(events: DataFrame, kmers: DataFrame) -> DataFrame:
    """Method-of-moments shift and scale per read.

    ``events`` is (read_id, mean), ``kmers`` is (read_id, level_mean). Both sides are reduced to
    one row per read before they meet. The second moment around the shift is expanded so that a
    single pass suffices. Scale is a ratio of second moments, no square root is taken.
    """
    e = events.groupBy("read_id").agg(
        F.avg(F.col("mean").cast("double")).alias("e1"),
        F.avg(F.col("mean").cast("double") * F.col("mean").cast("double")).alias("e2"))
    m = kmers.groupBy("read_id").agg(
        F.avg(F.col("level_mean").cast("double")).alias("m1"),
        F.avg(F.col("level_mean").cast("double") * F.col("level_mean").cast("double")).alias("m2"))
    shift = F.col("e1") - F.col("m1")
    second = F.col("e2") - 2 * shift * F.col("e1") + shift * shift
    return e.join(m, "read_id").select("read_id", shift.alias("shift"),
                                       (second / F.col("m2")).alias("scale"))


def weighted_recalibration(rows: DataFrame, min_events: int = 200) -> DataFrame:
    """Weighted least squares of event level on model level over the match rows of each read.

    ``rows`` is (read_id, state, mean, level_mean, level_stdv). The normal equations and the
    residual variance both come from the same sums, hence one shuffle with partial aggregation.
    Reads with fewer than ``min_events`` match rows get NULL parameters.
    """
    w = 1 / (F.col("level_stdv").cast("double") * F.col("level_stdv").cast("double"))
    mu, e = F.col("level_mean").cast("double"), F.col("mean").cast("double")
    s = rows.where("state = 'M'").groupBy("read_id").agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(mu * w).alias("wm"),
        F.sum(mu * mu * w).alias("wmm"), F.sum(e * w).alias("we"),
        F.sum(mu * e * w).alias("wme"), F.sum(e * e * w).alias("wee"))
    det = F.col("w") * F.col("wmm") - F.col("wm") * F.col("wm")
    solved = s.withColumn("shift", (F.col("wmm") * F.col("we") - F.col("wm") * F.col("wme")) / det) \
        .withColumn("scale", (F.col("w") * F.col("wme") - F.col("wm") * F.col("we")) / det)
    a, b = F.col("shift"), F.col("scale")
    rss = (F.col("wee") - 2 * a * F.col("we") - 2 * b * F.col("wme") + a * a * F.col("w")
           + 2 * a * b * F.col("wm") + b * b * F.col("wmm"))
    enough = F.col("n") >= min_events
    return solved.select(
        "read_id", F.col("n").alias("n_match"),
        F.when(enough, a).alias("shift"), F.when(enough, b).alias("scale"),
        F.when(enough, F.sqrt(F.greatest(rss, F.lit(0.0)) / F.col("n"))).alias("var"))


def credited_ranges(pairs: DataFrame) -> DataFrame:
    """First and last event credited to each k-mer of an alignment.

    ``pairs`` is (read_id, pair_idx, kmer_idx, event_idx). A pair counts only when its event
    differs from that of the pair before it.
    """
    order = Window.partitionBy("read_id").orderBy("pair_idx")
    prev = F.coalesce(F.lag("event_idx").over(order), F.lit(-1))
    fresh = pairs.withColumn("_fresh", F.col("event_idx") != prev).where("_fresh")
    return fresh.groupBy("read_id", "kmer_idx").agg(
        F.min_by("event_idx", "pair_idx").alias("start_event"),
        F.max_by("event_idx", "pair_idx").alias("stop_event"))


def match_rows(ranges: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per event of each range, 'M' when the k-mer rank changes from the row before.

    ``ranked`` is (read_id, kmer_idx, kmer_rank). Inside a range all rows after the first repeat
    the rank, so the comparison is made once per k-mer, before the ranges are expanded.
    """
    order = Window.partitionBy("read_id").orderBy("kmer_idx")
    marked = ranges.join(ranked, ["read_id", "kmer_idx"]).withColumn(
        "_new", F.coalesce(F.lag("kmer_rank").over(order) != F.col("kmer_rank"), F.lit(True)))
    return marked.select(
        "read_id", "kmer_idx", "kmer_rank", "_new", "start_event",
        F.explode(F.sequence("start_event", "stop_event")).alias("event_idx")).select(
        "read_id", "kmer_idx", "kmer_rank", "event_idx",
        F.when(F.col("_new") & (F.col("event_idx") == F.col("start_event")), F.lit("M"))
        .otherwise(F.lit("E")).alias("state"))


def events_per_base(pairs: DataFrame, n_kmers: DataFrame) -> DataFrame:
    span = pairs.groupBy("read_id").agg(
        (F.max("event_idx") - F.min("event_idx")).alias("_span"))
    return span.join(n_kmers, "read_id").select(
        "read_id", (F.col("_span") / F.col("n_kmers")).alias("events_per_base"))
