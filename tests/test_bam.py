"""BAM files in many tasks, regions by index, and what is read for them."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigspark.operators import alignments as A
from sigspark.sources import bam, sequences

CONTIGS = [("c1", 300_000_000), ("c2", 5_000_000), ("c3", 1000)]


def table(spark, n=6000):
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("r"), i.cast("string")).alias("read_id"), (i % 3 * 16).cast("int").alias("flag"),
        F.when(i % 50 == 0, "*").when(i % 3 == 0, "c2").otherwise("c1").alias("contig"),
        F.when(i % 50 == 0, -1).when(i % 3 == 0, (i * 7919) % 4_990_000).otherwise((i * 104_729) % 299_000_000).cast("int").alias("pos"),
        (i % 60).cast("int").alias("mapq"),
        F.when(i % 50 == 0, "*").otherwise(F.concat((1 + i % 90).cast("string"), F.lit("M2I"), (1 + (i * i) % 40_000).cast("string"), F.lit("N5M"))).alias("cigar"),
        F.when(i % 4 > 0, F.substring(F.repeat(F.lit("ACGTNGGT"), 40), 1, (i % 300).cast("int") + 1)).otherwise("*").alias("seq"),
        F.when(i % 5 > 0, (i % 100).cast("int")).alias("nm"))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    rows = table(spark).cache()
    bam.write_bam(rows.coalesce(1), path, CONTIGS)
    return path, rows


def test_any_cut_gives_the_same_rows(spark, files):
    path, rows = files
    columns = [f.name for f in bam.SCHEMA[:8]]
    want = sorted(rows.select(columns).collect(), key=str)
    for split in (700, 5_000, 40_000, 1 << 30):
        read = bam.read_bam(spark, path, split_bytes=split)
        assert split > 1 << 20 or read.rdd.getNumPartitions() > len(bam.data_files(path, ".bam")) or split == 40_000
        assert sorted(read.select(columns).collect(), key=str) == want
        ids = [r.aln_id for r in sequences.with_alignment_ids(read).orderBy("aln_id").collect()]
        assert ids == list(range(6000))
    order = [r.pos for r in sequences.with_alignment_ids(bam.read_bam(spark, path, split_bytes=5_000)).where("contig = 'c1'").orderBy("aln_id").collect()]
    assert order == sorted(order)


@settings(deadline=None, max_examples=40)
@given(st.data())
def test_ranges_partition_the_records(files, data):
    file = bam.data_files(files[0], ".bam")[0]
    size = os.path.getsize(file)
    cuts = sorted(data.draw(st.sets(st.integers(1, size - 1), max_size=5)))
    whole = [at for at, *_ in bam.range_records(file, 0, size)]
    assert [at for a, b in zip([0, *cuts], [*cuts, size]) for at, *_ in bam.range_records(file, a, b)] == whole


def test_records_longer_than_blocks(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", 0, "c1", i, 60, "4M", "ACGT" * (100_000 if i % 3 == 0 else 1), None) for i in range(9)],
                                 "read_id string, flag int, contig string, pos int, mapq int, cigar string, seq string, nm int")
    path = str(tmp_path / "long.bam")
    bam.write_bam(rows, path, CONTIGS)
    assert sorted(bam.read_bam(spark, path, split_bytes=3000).select(rows.columns).collect()) == sorted(rows.collect())
    empty = str(tmp_path / "empty.bam")
    bam.write_bam(rows.where("false").coalesce(1), empty, CONTIGS)
    assert bam.read_bam(spark, empty).count() == 0


def test_region_reads_its_blocks_only(spark, files):
    path, rows = files
    bam.index_bam(spark, path, split_bytes=20_000)
    ended = A.with_end(rows)
    for region in ("c1:1000001-3000000", "c2:1-20000", "c2", "c1:299000000-299100000", "c3", "absent:1-5"):
        found = A.region_filter(bam.read_bam(spark, path, split_bytes=5_000), region)
        want = A.region_filter(ended, region)
        assert sorted(r.read_id for r in found.select("read_id").collect()) == sorted(r.read_id for r in want.select("read_id").collect())
        # the filter reaches the source: one task looks the region up instead of one for each 5 kB
        assert found.rdd.getNumPartitions() == len(bam.data_files(path, ".bam"))
    file = max(bam.data_files(path, ".bam"), key=os.path.getsize)
    blocks = bam.Blocks(file)
    contigs = bam.read_head(blocks)
    before = blocks.fetched
    own = [bam.parsed(body, contigs, False) for _, body in bam.region_records(blocks, contigs, open(file + ".bai", "rb").read(), "c1", 150_000_000, 150_400_000)]
    chunks = bam.region_chunks(open(file + ".bai", "rb").read(), 0, 150_000_000, 150_400_000)
    assert sum((b >> 16) - (a >> 16) for a, b in chunks) <= os.path.getsize(file) / 2
    assert blocks.fetched - before <= len(chunks) * bam.FETCH and len(own) < 6000


def test_regions_of_a_list_give_an_alignment_once(spark, files):
    path, rows = files
    bam.index_bam(spark, path)
    regions = [("c1", i * 300_000, i * 300_000 + 200_000) for i in range(990)] + [("c2", 5, 100_000), ("c2", 50_000, 150_000)]
    read = bam.read_bam(spark, path, regions)
    got = sorted(r.read_id for r in read.select("read_id").collect())
    ended = A.with_end(rows)
    want = {r.read_id for r in A.bed_overlap(ended, spark.createDataFrame([(i, c, b + 1, e) for i, (c, b, e) in enumerate(regions)],
                                                                          "region_id long, contig string, beg long, end long")).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_bins():
    assert [bam.bin_of(0, 1), bam.bin_of(1 << 14, (1 << 14) + 1), bam.bin_of((1 << 14) - 1, (1 << 14) + 1), bam.bin_of(0, 1 << 29)] == [4681, 4682, 585, 0]
    with pytest.raises(ValueError):
        bam.bin_of(0, (1 << 29) + 1)


def test_damage_is_told(spark, files, tmp_path):
    data = open(max(bam.data_files(files[0], ".bam"), key=os.path.getsize), "rb").read()
    for name, bad in (("cut.bam", data[:-700]), ("flip.bam", data[:len(data) // 2] + bytes([data[len(data) // 2] ^ 255]) + data[len(data) // 2 + 1:])):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(Exception, match="damaged|truncated"):
            bam.read_bam(spark, str(tmp_path / name)).count()


def test_blocks_of_many_regions_are_read_once(spark, tmp_path, monkeypatch):
    """Regions of one bin share their blocks, and a record in regions of two tasks is given by one."""
    path = f"{tmp_path}/dense"
    rows = spark.range(2000).selectExpr("cast(id as string) read_id", "0 flag", "'c1' contig", "cast(id * 5 as int) pos", "60 mapq",
                                        "if(id = 100, '9000M', '20M') cigar", "'*' seq", "0 nm").coalesce(1)
    bam.write_bam(rows, path, [("c1", 20_000)])
    bam.index_bam(spark, path)
    regions = [("c1", i * 20, i * 20 + 5) for i in range(500)]
    ids = [r.read_id for r in bam.read_bam(spark, path, regions).collect()]
    bed = spark.createDataFrame([(i, c, b + 1, e) for i, (c, b, e) in enumerate(regions)], "region_id int, contig string, beg int, end int")
    want = {r.read_id for r in A.bed_overlap(bam.read_bam(spark, path), bed, bin_size=1 << 14).collect()}
    assert len(ids) == len(set(ids)) and set(ids) == want
    file = next(str(f) for f in (tmp_path / "dense").glob("*.bam"))
    blocks, taken = bam.Blocks(file), []
    contigs = bam.read_head(blocks)
    real = blocks.take
    monkeypatch.setattr(blocks, "take", lambda n: taken.append(n) or real(n))
    list(bam.records_of(blocks, contigs, open(file + ".bai", "rb").read(), regions))
    assert len(taken) <= 2 * 2000 + 4


def test_crowded_bins_are_made_smaller(spark):
    bed = spark.range(2000).selectExpr("id region_id", "'c1' _rc", "cast(id * 4 as int) _rb", "cast(id * 4 + 40 as int) _re")
    assert A.bin_for(bed) == 256 and A.bin_for(bed.where("region_id % 200 = 0")) == A.DEFAULT_BIN and A.bin_for(bed.where("false")) == A.DEFAULT_BIN
