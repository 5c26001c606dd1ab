"""Pairs of regions and alignments as they are written."""

from pyspark.sql import functions as F

from sigspark.harness import signals


def test_pairs_of_neighbours_are_written_together(spark):
    """A task hands on the pairs by the place of the alignment, so that equal regions repeat."""
    data = "/root/testdata/sf0.01"
    found = signals.bed_overlap(spark, data).withColumn("task", F.spark_partition_id()).collect()
    alignments = signals.A.with_end(signals.V.alignments(spark, data))
    places = {r.aln_id: (r.contig, r.pos, r.aln_end) for r in alignments.collect()}
    assert len(found) > 5000
    for task in {r.task for r in found}:
        met = [places[r.aln_id] for r in found if r.task == task]
        assert met == sorted(met)
    plain = signals.A.bed_overlap(alignments, signals._bed(spark, data), bin_size=512).select("region_id", "aln_id")
    assert sorted((r.region_id, r.aln_id) for r in found) == sorted(map(tuple, plain.collect()))
