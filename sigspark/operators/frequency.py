"""Per-site methylation frequencies and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sigspark.functions.stats import fixed

SPLIT_GROUP = "split-group"


def confident_calls(calls: DataFrame, threshold: float = 2.5) -> DataFrame:
    return calls.where(F.abs("log_lik_ratio") >= F.lit(threshold))


def split_group_calls(calls: DataFrame) -> DataFrame:
    """One row per CpG of a multi-site call, placed relative to the first CpG of its sequence.

    Single-site calls pass through. Both cases come out of one explode, so the input is scanned
    once and nothing is shuffled.
    """
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.length("sequence"), F.lit(1))),
                    lambda i: F.substring(F.col("sequence"), i, F.lit(2)) == "CG")
    multi = F.col("num_cpgs") > 1
    offsets = F.when(multi, F.transform(hits, lambda i: i - F.instr(F.col("sequence"), "CG"))) \
        .otherwise(F.array(F.lit(0)))
    return (calls.withColumn("_offset", F.explode(offsets))
            .withColumn("start", F.col("start") + F.col("_offset"))
            .withColumn("end", F.when(multi, F.col("start")).otherwise(F.col("end")))
            .withColumn("sequence", F.when(multi, F.lit(SPLIT_GROUP)).otherwise(F.col("sequence")))
            .withColumn("num_cpgs", F.when(multi, F.lit(1)).otherwise(F.col("num_cpgs")))
            .drop("_offset"))


def printed_ratio(part: Column, whole: Column) -> Column:
    return fixed(part / whole, 3).cast("double")


def site_frequency(calls: DataFrame, threshold: float = 2.5, split_groups: bool = False) -> DataFrame:
    """Called and methylated site counts per (chromosome, start, end).

    ``calls`` carries ``line_no``; the group size and sequence of a site are those of the first
    call seen for it. All aggregates are partial, so a hot site is combined before the shuffle.
    """
    kept = confident_calls(calls, threshold)
    if split_groups:
        kept = split_group_calls(kept)
    cpgs = F.col("num_cpgs").cast("long")
    sites = kept.groupBy("chromosome", "start", "end").agg(
        F.sum(cpgs).alias("called_sites"),
        F.sum(F.when(F.col("log_lik_ratio") > 0, cpgs).otherwise(F.lit(0))).alias(
            "called_sites_methylated"),
        F.min_by(F.struct("num_cpgs", "sequence"), F.col("line_no")).alias("_first"))
    return sites.where("called_sites > 0").select(
        "chromosome", "start", "end",
        F.col("_first.num_cpgs").alias("num_cpgs_in_group"),
        "called_sites", "called_sites_methylated",
        printed_ratio(F.col("called_sites_methylated"), F.col("called_sites")).alias(
            "methylated_frequency"),
        F.col("_first.sequence").alias("group_sequence"))


def split_frequency(freq: DataFrame) -> DataFrame:
    """Turn a grouped frequency table into the per-CpG table, without the original calls.

    Sites of one CpG keep their sequence unless an exploded group lands on the same position.
    """
    rows = (freq.withColumn("line_no", F.monotonically_increasing_id())
            .withColumnRenamed("num_cpgs_in_group", "num_cpgs")
            .withColumnRenamed("group_sequence", "sequence")
            .withColumn("_reads", F.col("called_sites") / F.col("num_cpgs"))
            .withColumn("_meth", F.col("called_sites_methylated") / F.col("num_cpgs")))
    parts = split_group_calls(rows)
    return parts.groupBy("chromosome", "start", "end").agg(
        F.lit(1).alias("num_cpgs_in_group"),
        F.sum(F.col("_reads") * F.col("num_cpgs")).cast("long").alias("called_sites"),
        F.sum(F.col("_meth") * F.col("num_cpgs")).cast("long").alias("called_sites_methylated"),
        F.min_by("sequence", "line_no").alias("group_sequence")).select(
        "chromosome", "start", "end", "num_cpgs_in_group", "called_sites",
        "called_sites_methylated",
        printed_ratio(F.col("called_sites_methylated"), F.col("called_sites")).alias(
            "methylated_frequency"), "group_sequence")


def merge_frequencies(parts: list[DataFrame]) -> DataFrame:
    """Sum the counts of equal sites over several frequency tables.

    The descriptive columns come from the first table that has the site. Sites are matched on
    their full interval: two tables that disagree on a group's extent keep both rows.
    """
    tagged = [p.withColumn("_file", F.lit(i)) for i, p in enumerate(parts)]
    return merge_tagged(reduce(DataFrame.unionByName, tagged))


def merge_tagged(rows: DataFrame) -> DataFrame:
    merged = rows.groupBy("chromosome", "start", "end").agg(
        F.min_by(F.struct("num_cpgs_in_group", "group_sequence"), F.col("_file")).alias("_first"),
        F.sum(F.col("called_sites").cast("long")).alias("called_sites"),
        F.sum(F.col("called_sites_methylated").cast("long")).alias("called_sites_methylated"))
    return merged.select(
        "chromosome", "start", "end",
        F.col("_first.num_cpgs_in_group").alias("num_cpgs_in_group"),
        "called_sites", "called_sites_methylated",
        printed_ratio(F.col("called_sites_methylated"), F.col("called_sites")).alias(
            "methylated_frequency"),
        F.col("_first.group_sequence").alias("group_sequence"))


def sort_sites(freq: DataFrame) -> DataFrame:
    """Byte order on the chromosome, numeric order on the coordinates; a range-partitioned sort."""
    return freq.orderBy("chromosome", "start", "end")


def clip_to_window(calls: DataFrame, clip_start: int, clip_end: int) -> DataFrame:
    return calls.where((F.col("start") >= clip_start) & (F.col("end") < clip_end))
