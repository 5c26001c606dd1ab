"""Ordered computations over raw samples in long form (read_id, i, v).

A read is one window partition. Its size is bounded by the length of a single molecule, so no
partition can grow with the data set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sigspark.functions import stats

# smallest positive normal single precision number
TINY_VARIANCE = 1.1754943508222875e-38


def prefix_sums(samples: DataFrame) -> DataFrame:
    """Sums of v and v*v over all earlier samples of the read."""
    before = Window.partitionBy("read_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return samples.select(
        "read_id", "i", "v",
        F.coalesce(F.sum("v").over(before), zero).alias("sum_before"),
        F.coalesce(F.sum(F.col("v") * F.col("v")).over(before), zero).alias("sumsq_before"))


def windowed_tstat(samples: DataFrame, width: int) -> DataFrame:
    """|mean2 - mean1| / sqrt((var1 + var2) / width) of the windows before and from each sample.

    Zero where either window is incomplete. Differences of two running sums keep the cost per
    sample independent of ``width``.
    """
    by_read = Window.partitionBy("read_id").orderBy("i")
    upto = by_read.rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("v").cast("double")
    sums = samples.select(
        "read_id", "i", "v",
        F.coalesce(F.sum(x).over(upto), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(x * x).over(upto), F.lit(0.0)).alias("q"))
    s, q, w = F.col("s"), F.col("q"), float(width)
    # the running sum up to and including sample i+width-1
    last = F.lead(F.struct("s", "q", "v"), width - 1).over(by_read)
    first = F.lag(F.struct("s", "q"), width).over(by_read)
    framed = sums.select("read_id", "i", s, q, last.alias("b"), first.alias("a"))
    bv = F.col("b.v").cast("double")
    s1, q1 = s - F.col("a.s"), q - F.col("a.q")
    s2, q2 = F.col("b.s") + bv - s, F.col("b.q") + bv * bv - q
    m1, m2 = s1 / w, s2 / w
    var = F.greatest(q1 / w - m1 * m1 + q2 / w - m2 * m2, F.lit(TINY_VARIANCE))
    complete = F.col("a").isNotNull() & F.col("b").isNotNull()
    return framed.select(
        "read_id", "i",
        F.when(complete, F.abs(m2 - m1) / F.sqrt(var / w)).otherwise(F.lit(0.0)).alias("tstat"))


def segment_events(samples: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Cut each read at its boundary positions and summarise the pieces.

    A read without boundaries is one event. ``boundaries`` is (read_id, i); both sides meet on
    (read_id, i) and stay partitioned by read for the numbering and the aggregation.
    """
    marks = boundaries.where("i > 0").select("read_id", "i", F.lit(1).alias("mark")).distinct()
    upto = Window.partitionBy("read_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    numbered = samples.join(marks, ["read_id", "i"], "left").select(
        "read_id", "i", "v", F.coalesce(F.sum("mark").over(upto), F.lit(0)).alias("event_idx"))
    return event_statistics(numbered)


def event_statistics(numbered: DataFrame) -> DataFrame:
    """start, length, mean and population stdv of each (read_id, event_idx)."""
    v = F.col("v").cast("double")
    n, s, q = F.count("*"), F.sum(v), F.sum(v * v)
    var = q / n - (s / n) * (s / n)
    return numbered.groupBy("read_id", "event_idx").agg(
        F.min("i").alias("start"), n.alias("length"), (s / n).alias("mean"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("stdv"))


def chunk_mads(samples: DataFrame, chunk: int) -> DataFrame:
    """MAD of each complete chunk of ``chunk`` samples; a group holds ``chunk`` values at most."""
    return (samples.withColumn("chunk", F.expr(f"i div {chunk}"))
            .groupBy("read_id", "chunk")
            .agg(F.array_sort(F.collect_list(F.col("v").cast("double"))).alias("_v"))
            .where(F.size("_v") == chunk)
            .select("read_id", "chunk", stats.mad(F.col("_v")).alias("mad")))


def mad_trim(samples: DataFrame, chunk: int = 100) -> DataFrame:
    """Range of samples left after dropping the quiet chunks at both ends of a read.

    The threshold is the smallest MAD of the read. Event detection runs on the whole signal and
    does not use this range; it is reported for inspection.
    """
    mads = chunk_mads(samples, chunk)
    low = mads.withColumn("_low", F.min("mad").over(Window.partitionBy("read_id")))
    loud = F.when(F.col("mad") > F.col("_low"), F.col("chunk"))
    return low.groupBy("read_id").agg(
        F.count("*").alias("n_chunks"), F.min(loud).alias("_a"), F.max(loud).alias("_b")).select(
        "read_id",
        F.when(F.col("_a").isNull(), F.lit(None)).otherwise(F.col("_a") * chunk).alias("trim_start"),
        F.when(F.col("_b").isNull(), F.lit(None)).otherwise((F.col("_b") + 1) * chunk).alias("trim_end"))
