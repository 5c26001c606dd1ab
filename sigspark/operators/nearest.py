"""As-of style lookups between base, event and reference coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def nearest_event(base_map: DataFrame, reach: int = 1000) -> DataFrame:
    """Event of the closest mapped base at or before each base, else at or after it.

    ``base_map`` is (read_id, k_idx, start_event) with a row for every base and NULL where a base
    has no event. The scans stop short of their limit: base 0 never answers for a later base, and
    the last base never answers for an earlier one. Both directions use running (growing) frames,
    whose cost does not depend on ``reach``; the reach is checked afterwards.
    """
    rows = base_map.withColumn("_last", F.max("k_idx").over(Window.partitionBy("read_id")))
    k = F.col("k_idx")
    mapped = F.when(F.col("start_event").isNotNull(), F.struct(k.alias("k"), F.col("start_event").alias("e")))

    def nearest(order, usable):
        frame = Window.partitionBy("read_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.last(F.when(usable, mapped), ignorenulls=True).over(frame)

    rows = rows.withColumn("_b", nearest(k.asc(), k > 0)) \
        .withColumn("_a", nearest(k.desc(), k < F.col("_last")))
    before = F.when(F.col("_b.k") > k - reach, F.col("_b.e"))
    after = F.when(F.col("_a.k") < k + reach, F.col("_a.e"))
    # the first and last base cannot start a scan in the direction that leaves the read
    return rows.select("read_id", "k_idx", F.coalesce(before, after).alias("event_idx"))


def reference_bounds(intervals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events at the first aligned base at or after each end of a reference interval.

    ``intervals`` is (read_id, lo, hi), ``pairs`` is (read_id, ref_pos, event_idx). Points and
    pairs are put on one axis per read and answered by one ordered pass, so the number of rows is
    the sum of both inputs and never their product. Intervals beginning before the first pair or
    reaching past the last one are dropped.
    """
    def points(column: str, side: int) -> DataFrame:
        return intervals.select("read_id", F.col(column).alias("at"), F.lit(side).alias("side"),
                                F.lit(None).cast("int").alias("event_idx"), "lo", "hi")

    axis = points("lo", 0).unionByName(points("hi", 1)).unionByName(pairs.select(
        "read_id", F.col("ref_pos").alias("at"), F.lit(2).alias("side"),
        F.col("event_idx").cast("int").alias("event_idx"),
        F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi")))
    is_pair = F.col("side") == 2
    down = Window.partitionBy("read_id").orderBy(F.col("at").desc(), F.col("side").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("read_id").orderBy(F.col("at").asc(), F.col("side").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    found = axis.withColumn("_next", F.last(F.when(is_pair, F.col("event_idx")), True).over(down)) \
        .withColumn("_covered", F.max(is_pair.cast("int")).over(up)).where(~is_pair)
    return found.groupBy("read_id", "lo", "hi").agg(
        F.max(F.when(F.col("side") == 0, F.col("_next"))).alias("e1"),
        F.max(F.when(F.col("side") == 1, F.col("_next"))).alias("e2"),
        F.max(F.when(F.col("side") == 0, F.col("_covered"))).alias("_left")).where(
        F.col("e1").isNotNull() & F.col("e2").isNotNull() & (F.col("_left") == 1)).drop("_left")


def aligned_events(pairs: DataFrame, nearest: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """Reference position to event, dropping bases within k of either end of the read.

    ``pairs`` is (read_id, ref_pos, read_pos, rc), ``lengths`` is (read_id, read_length). An
    alignment whose first and last event coincide is degenerate and yields nothing.
    """
    inner = pairs.join(lengths, "read_id").where(
        (F.col("read_pos") >= k) & (F.col("read_pos") + k < F.col("read_length")))
    on_read = inner.withColumn("k_idx", F.when(
        F.col("rc"), F.col("read_length") - F.col("read_pos") - k).otherwise(F.col("read_pos")))
    mapped = on_read.join(nearest.select("read_id", "k_idx", "event_idx"), ["read_id", "k_idx"])
    whole = Window.partitionBy("read_id")
    ends = mapped.withColumn("_f", F.min_by("event_idx", "ref_pos").over(whole)) \
        .withColumn("_l", F.max_by("event_idx", "ref_pos").over(whole))
    return ends.where("_f != _l").select("read_id", "ref_pos", "event_idx")
