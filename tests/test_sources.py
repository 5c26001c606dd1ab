import gzip
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sigspark.sources import codecs, sequences, slow5, tsv
from sigspark.sources.bam import read_bam


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-32768, 32767), max_size=300))
def test_signal_codec_round_trip(values):
    x = np.array(values, np.int16)
    assert np.array_equal(codecs.decode_signal(codecs.encode_signal(x)), x)


@pytest.mark.parametrize("codec", ["none", "zlib", "zstd"])
def test_record_codec_round_trip(codec):
    data = bytes(range(256)) * 50
    packed = codecs.compress_record(data, codec)
    assert codecs.expand_record(packed, codec) == data
    assert codecs.record_head(packed, codec, 100)[:100] == data[:100]


def records(spark, n=40):
    rows = spark.range(n).select(
        F.concat(F.lit("read-"), F.col("id").cast("string")).alias("read_id"), F.lit(0).alias("read_group"),
        F.lit(8192.0).alias("digitisation"), F.lit(10.0).alias("offset"), F.lit(1467.5).alias("range"),
        F.lit(4000.0).alias("sampling_rate"),
        F.transform(F.sequence(F.lit(1), 50 + F.col("id").cast("int")), lambda i: (
            (i * i * 37) % 1200 - 300).cast("smallint")).alias("raw_signal"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("ch"), F.col("id").cast("string"))).alias("channel_number"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("read_number"),
        F.when(F.col("id") % 4 > 0, F.lit("blue")).alias("end_reason"),
        F.array(F.lit(1.5), F.lit(2.5)).alias("medians"))
    return rows.withColumn("len_raw_signal", F.size("raw_signal").cast("long")).repartition(3)


HEADER = slow5.Header(slow5.VERSION, 1, [{"experiment_type": "rna", "run": "r1"}], [
    ("channel_number", "char*"), ("read_number", "int32_t"), ("end_reason", "enum{red,blue}"), ("medians", "double*")])


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    key = lambda r: r["read_id"]
    left, right = (sorted(d.select(*cols).collect(), key=key) for d in (a, b))
    assert left == right


@pytest.mark.parametrize("record,signal", [("zlib", "svb-zd"), ("zstd", "none"), ("none", "svb-zd")])
def test_blow5_round_trip_and_random_access(spark, tmp_path, record, signal):
    source, path = records(spark).cache(), str(tmp_path / "b")
    slow5.write_blow5(source, path, HEADER, record, signal)
    same(slow5.read_blow5(spark, path), source)
    files = slow5.data_files(path, ".blow5")
    assert len(files) == 3 and slow5.read_header(files[0]).attributes == HEADER.attributes
    assert slow5.is_rna(slow5.read_header(files[0]))
    index = slow5.index_records(spark, path)
    assert index.count() == 40
    slow5.write_indexes(index)
    # with an index the files are split into ranges; the rows stay the same
    small = slow5.read_blow5(spark, path, split_bytes=400)
    assert small.rdd.getNumPartitions() > 3
    same(small, source)
    wanted = index.where("read_id IN ('read-3', 'read-17')")
    got = slow5.fetch_records(wanted, slow5.read_header(files[0]))
    same(got, source.where("read_id IN ('read-3', 'read-17')"))
    stored = {e for f in files for e in [(x[0], f, x[1], x[2]) for x in slow5.read_index_entries(f + ".idx")]}
    assert stored == {(r.read_id, r.file.replace("file:", ""), r.offset, r["size"]) for r in index.collect()}


def test_slow5_round_trip_and_conversion(spark, tmp_path):
    source, text, binary = records(spark).cache(), str(tmp_path / "t.slow5"), str(tmp_path / "b")
    slow5.write_slow5(source.coalesce(1), text, HEADER)
    part = next(p for p in (tmp_path / "t.slow5").iterdir() if p.name.startswith("part"))
    target = tmp_path / "one.slow5"
    target.write_bytes(part.read_bytes())
    same(slow5.read_slow5(spark, str(target)), source)
    slow5.write_blow5(slow5.read_slow5(spark, str(target)), binary, slow5.read_header(str(target)))
    same(slow5.read_blow5(spark, binary), source)


def test_truncated_blow5_fails(spark, tmp_path):
    path = str(tmp_path / "b")
    slow5.write_blow5(records(spark).coalesce(1), path, HEADER)
    file = slow5.data_files(path, ".blow5")[0]
    data = open(file, "rb").read()
    open(file, "wb").write(data[:-40])
    with pytest.raises(Exception, match="truncated"):
        slow5.read_blow5(spark, path).count()


def test_fasta_and_fastq(spark, tmp_path):
    fasta = tmp_path / "r.fa"
    fasta.write_text(">a first read.fast5\nACGT\nAC\n>b\nGG\n>c\n\n")
    rows = sequences.read_fasta(spark, str(fasta)).orderBy("ordinal").collect()
    assert [(r.read_id, r.comment, r.seq) for r in rows] == [("a", "first read.fast5", "ACGTAC"), ("b", "", "GG"), ("c", "", "")]
    fastq = tmp_path / "r.fq.gz"
    with gzip.open(fastq, "wt") as f:
        f.write("@a x y\nACGT\nAC\n+\n@@@@\n@@\n@b\nGG\n+\nII\n")
    rows = sequences.read_fastx(spark, str(fastq)).orderBy("record").collect()
    assert [(r.read_id, r.comment, r.seq, r.qual) for r in rows] == [("a", "x y", "ACGTAC", "@@@@@@"), ("b", "", "GG", "II")]


def bam_bytes():
    def record(name, flag, ref, pos, cigar, seq, nm):
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0)
        body += name.encode() + b"\0" + ops + packed + b"\xff" * len(seq) + b"XXZhello\0" + b"NMC" + bytes([nm])
        return struct.pack("<i", len(body)) + body
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    return head + record("r1", 0, 0, 99, [(2, "S"), (3, "M")], "ACGTA", 7) + record("r2", 4, -1, -1, [], "ACG", 0)


def test_bam_and_sam(spark, tmp_path):
    bam = tmp_path / "x.bam"
    data = bam_bytes()
    bam.write_bytes(gzip.compress(data[:30]) + gzip.compress(data[30:]))     # several compressed blocks
    rows = read_bam(spark, str(bam)).orderBy("part", "place").collect()
    assert [(r.read_id, r.flag, r.contig, r.pos, r.cigar, r.seq, r.nm) for r in rows] == [
        ("r1", 0, "chr1", 99, "2S3M", "ACGTA", 7), ("r2", 4, "*", -1, "*", "ACG", 0)]
    sam = tmp_path / "x.sam"
    sam.write_text("@SQ\tSN:chr1\tLN:1000\nr1\t0\tchr1\t100\t60\t2S3M\t*\t0\t0\tACGTA\t*\tXX:Z:hello\tNM:i:7\n"
                   "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*\n")
    rows = sequences.with_ordinals(sequences.read_sam(spark, str(sam))).orderBy("aln_id").collect()
    assert [(r.aln_id, r.read_id, r.flag, r.contig, r.pos, r.cigar, r.nm) for r in rows] == [
        (0, "r1", 0, "chr1", 99, "2S3M", 7), (1, "r2", 4, "*", -1, "*", None)]


def test_ordinals_are_consecutive_over_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(7).select(F.col("id").cast("string")).write.text(path)
    rows = sequences.with_ordinals(spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()))
    assert sorted(r.aln_id for r in rows.collect()) == list(range(1000))


def test_model_size_is_checked(spark, tmp_path):
    rows = [f"{a}{b}\t{60 + i}\t1.5\t0\t0\t0" for i, (a, b) in enumerate((x, y) for x in "ACGT" for y in "ACGT")]
    good, bad = tmp_path / "m", tmp_path / "n"
    good.write_text("#k\t2\n#kmer\tlevel_mean\n" + "\n".join(rows) + "\n")
    bad.write_text("#k\t2\n" + "\n".join(rows[:-1]) + "\n")
    model = sequences.read_model(spark, str(good))
    assert [r["rank"] for r in model.orderBy("kmer").collect()] == list(range(16))
    with pytest.raises(ValueError, match="needs 16"):
        sequences.read_model(spark, str(bad))


def test_tables(spark, tmp_path):
    motif = tmp_path / "c.tsv"
    motif.write_text("\t".join(c if c != "num_cpgs" else "num_motifs" for c in tsv.CALL_COLUMNS_V2) + "\n"
                     + "chr1\t+\t5\t9\tr\t-3.5\t-100.0\t-96.5\t1\t2\tAACGTCGTT\n")
    row = tsv.read_calls(spark, str(motif)).first()
    assert (row["num_cpgs"], row["log_lik_ratio"], row["strand"]) == (2, -3.5, "+")
    wrong = tmp_path / "w.tsv"
    wrong.write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="incorrect header"):
        tsv.read_calls(spark, str(wrong))
    bed = tmp_path / "b.bed"
    bed.write_text("chr1\t5\t9\nchr2\t7\t3\n")
    with pytest.raises(Exception, match="malformed bed"):
        tsv.read_bed(spark, str(bed)).collect()
    summary = tmp_path / "s.tsv"
    summary.write_text("x\tfilename_fast5\tread_id\n1\ta.fast5\tr1\n")
    assert tsv.read_sequencing_summary(spark, str(summary)).first().asDict() == {"read_id": "r1", "filename": "a.fast5"}
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "q.fast5").write_bytes(b"x")
    assert [r.path.split("/")[-1] for r in tsv.list_signal_files(spark, str(tmp_path / "d")).collect()] == ["q.fast5"]
