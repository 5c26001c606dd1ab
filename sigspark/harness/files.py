"""Queries that write the tables as files of the domain and read them back through the real sources."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigspark.harness import views as V
from sigspark.harness.registry import query
from sigspark.harness.views import sql
from sigspark.operators import alignments as A
from sigspark.sources import bam, fastq, sequences

CONTIGS = [(f"ctg{i}", 20_000) for i in range(5)]
_SPAN = "alignments ops spans"
_ROWS = """SELECT CAST(a.aln_id AS VARCHAR) AS read_id, flag, contig, pos, mapq, CAST(pos + span AS INTEGER) AS aln_end, CAST(k % 9 AS INTEGER) AS nm
    FROM alignments a JOIN spans s ON a.aln_id = s.aln_id"""


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sigspark-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def _bam(spark, sf) -> str:
    path = scratch(spark)
    rows = V.alignments(spark, sf).select(F.col("aln_id").cast("string").alias("read_id"), "flag", "contig", "pos", "mapq", "cigar",
                                          F.lit("*").alias("seq"), (F.col("aln_id") % 9).cast("int").alias("nm"))
    bam.write_bam(rows, path, CONTIGS)
    return path


_COLUMNS = ["read_id", "flag", "contig", "pos", "mapq", "aln_end", "nm"]


@query("bam_scan", sql(_SPAN, _ROWS))
def bam_scan(spark, sf):
    """Every file in many tasks."""
    return bam.read_bam(spark, _bam(spark, sf), split_bytes=50_000).select(_COLUMNS)


@query("bam_alignment_ids", sql("alignments", "SELECT contig, count(*) AS n, count(*) AS n_ids FROM alignments GROUP BY contig"))
def bam_alignment_ids(spark, sf):
    return sequences.with_alignment_ids(bam.read_bam(spark, _bam(spark, sf), split_bytes=50_000)).groupBy("contig").agg(
        F.count("*").alias("n"), F.count_distinct("aln_id").alias("n_ids"))


@query("bam_region_scan", sql(_SPAN, f"{_ROWS} WHERE contig = 'ctg3' AND pos < 5000 AND pos + span > 3999"))
def bam_region_scan(spark, sf):
    """A region through the binning index."""
    path = _bam(spark, sf)
    bam.index_bam(spark, path)
    return A.region_filter(bam.read_bam(spark, path), "ctg3:4000-5000").select(_COLUMNS)


@query("bam_bed_scan", sql(_SPAN, """, bed AS (SELECT o_orderkey AS region_id, concat('ctg', o_custkey % 5) AS contig, (o_orderkey * 13) % 9000 AS b,
    (o_orderkey * 13) % 9000 + 40 AS e FROM orders WHERE o_orderkey % 97 = 0)
  SELECT region_id, CAST(a.aln_id AS VARCHAR) AS read_id FROM bed JOIN alignments a ON a.contig = bed.contig JOIN spans s ON s.aln_id = a.aln_id
  WHERE pos < e AND pos + span > greatest(b - 1, 0)"""))
def bam_bed_scan(spark, sf):
    """The regions of a list through the index, then every pair of a region and an alignment."""
    path, o = _bam(spark, sf), F.col("o_orderkey")
    bam.index_bam(spark, path)
    bed: DataFrame = V.table(spark, sf, "orders").where(o % 97 == 0).select(
        o.alias("region_id"), F.concat(F.lit("ctg"), (F.col("o_custkey") % 5).cast("string")).alias("contig"),
        ((o * 13) % 9000).alias("beg"), ((o * 13) % 9000 + 40).alias("end"))
    wanted = [(r["contig"], max(r["beg"] - 1, 0), r["end"]) for r in bed.toLocalIterator()]
    return A.bed_overlap(bam.read_bam(spark, path, wanted), bed).select("region_id", "read_id")


@query("fastq_scan", sql("reads", """SELECT CAST(read_id AS VARCHAR) AS read_id, 'doc' AS comment, md5(coalesce(seq, '')) AS seq_md5,
    CAST(length(coalesce(seq, '')) AS INTEGER) AS n_bases, CAST(length(coalesce(seq, '')) AS INTEGER) AS n_quals FROM reads"""))
def fastq_scan(spark, sf):
    """The reads as FASTQ files whose quality lines look like name lines, every file in many tasks."""
    path, seq = scratch(spark), F.coalesce("seq", F.lit(""))
    V.reads(spark, sf).select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit(" doc\n"), seq, F.lit("\n+\n"),
                                       F.repeat(F.lit("@"), F.length(seq)))).write.text(path)
    return fastq.read_fastq(spark, path, split_bytes=50_000, suffix=".txt").select(
        "read_id", "comment", F.md5(F.col("seq")).alias("seq_md5"), F.length("seq").alias("n_bases"),
        F.length(F.coalesce("qual", F.lit(""))).alias("n_quals"))
