"""Operators on event-to-reference rows (read_id, idx, ref_pos, event_idx, state, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F


def by_read() -> WindowSpec:
    return Window.partitionBy("read_id").orderBy("idx")


def alignment_summary(rows: DataFrame) -> DataFrame:
    """Events, steps, skips, stays, total length and sum of z-scores per read.

    ``rows`` also carries ``length`` (samples) and ``z``. A backward move counts as a skip; the
    first row of a read is neither a step nor a skip.
    """
    move = F.col("ref_pos") - F.lag("ref_pos").over(by_read())
    marked = rows.select("read_id", "length", "state", "z", move.alias("move"))

    def count(condition):
        return F.sum(F.when(condition, 1).otherwise(0)).cast("long")

    return marked.groupBy("read_id").agg(
        F.count("*").alias("num_events"),
        count(F.col("move") == 1).alias("num_steps"),
        count((F.col("move") > 1) | (F.col("move") < 0)).alias("num_skips"),
        count(F.col("move") == 0).alias("num_stays"),
        F.sum("length").alias("total_samples"),
        F.sum(F.when(F.col("state") == "M", F.col("z")).otherwise(F.lit(0))).alias("sum_z"))


def islands(rows: DataFrame) -> DataFrame:
    """Number the runs of consecutive rows at one reference position."""
    changed = F.coalesce((F.col("ref_pos") != F.lag("ref_pos").over(by_read())).cast("int"), F.lit(1))
    upto = by_read().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_new", changed).withColumn("island", F.sum("_new").over(upto)).drop("_new")


def collapse_events(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Merge consecutive rows at one reference position.

    ``rows`` carries ``start``, ``length``, ``mean`` and ``stdv`` of its event; ``signals`` is
    (read_id, raw array). A merged row spans the samples of its first and last event, and its
    level is recomputed from them; single rows keep their event statistics.
    """
    end = F.col("start") + F.col("length")
    ordered = F.struct("idx", "event_idx", "start", end.alias("end"), "mean", "stdv")
    runs = islands(rows).groupBy("read_id", "island").agg(
        F.min("ref_pos").alias("ref_pos"), F.count("*").alias("n"),
        F.min(ordered).alias("a"), F.max(ordered).alias("b"))
    spans = runs.select(
        "read_id", "island", "ref_pos", "n", F.col("a.event_idx").alias("event_idx"),
        F.least("a.start", "b.start").cast("int").alias("start_idx"),
        F.greatest("a.end", "b.end").cast("int").alias("end_idx"),
        F.col("a.mean").alias("mean"), F.col("a.stdv").alias("stdv"))
    cut = F.slice("raw", F.col("start_idx") + 1, F.col("end_idx") - F.col("start_idx"))
    joined = spans.join(signals.select("read_id", "raw"), "read_id").withColumn(
        "_s", F.when(F.col("n") > 1, cut)).drop("raw")
    total = F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + x)
    level = total / F.size("_s")
    joined = joined.withColumn("_m", level)
    spread = F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + (x - F.col("_m")) * (x - F.col("_m")))
    return joined.select(
        "read_id", "ref_pos", "n", "event_idx", "start_idx", "end_idx",
        F.when(F.col("n") > 1, F.col("_m")).otherwise(F.col("mean")).alias("event_mean"),
        F.when(F.col("n") > 1, F.sqrt(spread / F.size("_s"))).otherwise(F.col("stdv")).alias("event_stdv"))


def event_cigars(rows: DataFrame) -> DataFrame:
    """CIGAR of each read in event space: clip, matches, jumps as D and stays as I.

    Every window and aggregation is partitioned by read, so one shuffle serves all of them.
    """
    steps = rows.select(
        "read_id", "idx", "event_idx",
        F.abs(F.col("ref_pos") - F.lag("ref_pos").over(by_read())).alias("r"))

    def op(kind: str, length):
        return F.struct(F.lit(kind).alias("op"), length.cast("long").alias("len"))

    one = F.lit(1)
    nothing = F.array(op("M", one))
    emitted = (F.when(F.col("r").isNull() & (F.col("event_idx") > 0),
                      F.array(op("S", F.col("event_idx")), op("M", one)))
               .when(F.col("r").isNull() | (F.col("r") == 1), nothing)
               .when(F.col("r") > 1, F.array(op("D", F.col("r") - 1), op("M", one)))
               .otherwise(F.array(op("I", one))))
    ops = steps.select("read_id", "idx", F.posexplode(emitted).alias("sub", "o")).select(
        "read_id", "idx", "sub", "o.op", "o.len")
    order = Window.partitionBy("read_id").orderBy("idx", "sub")
    change = F.coalesce((F.col("op") != F.lag("op").over(order)).cast("int"), F.lit(1))
    runs = ops.withColumn("_c", change).withColumn(
        "run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("read_id", "run").agg(F.sum("len").alias("len"), F.first("op").alias("op"))
    return merged.groupBy("read_id").agg(F.concat_ws("", F.transform(
        F.array_sort(F.collect_list(F.struct("run", F.concat(F.col("len").cast("string"), "op").alias("t")))),
        lambda x: x["t"])).alias("event_cigar"))
