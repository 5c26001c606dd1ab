"""Sequence, alignment and model files."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sigspark.functions.sequence import kmer_rank, kmer_rank5

FASTX_SCHEMA = "read_id string, comment string, seq string, qual string, file string, record long"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, comment, seq) of plain FASTA files.

    The text reader splits large files at record starts, so contigs and reads are found in
    parallel and in the JVM. Order inside a file is kept by ``ordinal``.
    """
    rows = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    head = F.split(record, "\n", 2)
    name = F.split(F.get(head, F.lit(0)), r"[ \t]", 2)
    return rows.where(F.trim("value") != "").select(
        F.get(name, F.lit(0)).alias("read_id"), F.coalesce(F.get(name, F.lit(1)), F.lit("")).alias("comment"),
        F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"[\n\r]", "").alias("seq"),
        F.monotonically_increasing_id().alias("ordinal"))


def _open(path: str):
    filesystem, name = pafs.FileSystem.from_uri(path.replace("file:///", "/"))
    stream = filesystem.open_input_stream(name, compression=None)
    return gzip.open(stream) if name.endswith(".gz") else stream


def fastx_records(path: str) -> Iterator[tuple]:
    """Records of a FASTA or FASTQ file; sequences and qualities may span lines."""
    name = comment = None
    seq: list[str] = []
    qual: list[str] = []
    in_qual = False
    with _open(path) as stream:
        lines = (raw.decode("ascii", "replace").rstrip("\r\n") for raw in _lines(stream))
        for line in lines:
            if in_qual and sum(map(len, qual)) < sum(map(len, seq)):
                qual.append(line)
            elif line[:1] in (">", "@"):
                if name is not None:
                    yield name, comment, "".join(seq), "".join(qual) or None
                name, _, comment = line[1:].replace("\t", " ", 1).partition(" ")
                seq, qual, in_qual = [], [], False
            elif line[:1] == "+" and name is not None and not in_qual:
                in_qual = True
            elif not in_qual:
                seq.append(line)
    if name is not None:
        yield name, comment, "".join(seq), "".join(qual) or None


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _per_file(spark: SparkSession, path: str, schema: str, records, batch_rows: int = 512) -> DataFrame:
    """Read files that cannot be split, one task per file, as a stream of batches."""
    files = spark.read.format("binaryFile").load(path).select("path")
    n = max(files.count(), 1)
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [part.strip().split(" ") for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for i, record in enumerate(records(file)):
                    rows.append((*record, file, i))
                    if len(rows) == batch_rows:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, arrow[t]) for c, (_, t) in zip(zip(*rows), fields)], [name for name, _ in fields])

    return files.repartition(min(n, 100_000), "path").mapInArrow(run, schema)


def read_fastx(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ, plain or gzipped, one task per file."""
    return _per_file(spark, path, FASTX_SCHEMA, fastx_records)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text, split and parsed in the JVM; ``pos`` becomes 0-based."""
    f = F.split("value", "\t")
    nm = F.regexp_extract("value", r"\tNM:i:(-?[0-9]+)", 1)
    return spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0)).select(
        F.get(f, F.lit(0)).alias("read_id"), F.get(f, F.lit(1)).cast("int").alias("flag"),
        F.get(f, F.lit(2)).alias("contig"), (F.get(f, F.lit(3)).cast("int") - 1).alias("pos"),
        F.get(f, F.lit(4)).cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"),
        F.when(nm != "", nm.cast("int")).alias("nm"), F.monotonically_increasing_id().alias("ordinal"))


def with_alignment_ids(rows: DataFrame, name: str = "aln_id") -> DataFrame:
    """Consecutive numbers over all files, in order of (file, part, place).

    A part is a piece of a file that one task reads. Only one count for each is ordered; its running sum is joined
    back as the offset of the part.
    """
    counts = rows.groupBy("file", "part").agg((F.max("place") + 1).alias("_n"))
    ahead = Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).cast("long").alias("_before"))
    return rows.join(offsets, ["file", "part"]).withColumn(name, F.col("_before") + F.col("place")).drop("_before")


def with_ordinals(rows: DataFrame, id_column: str = "ordinal", name: str = "aln_id") -> DataFrame:
    """Consecutive numbers in scan order from ids that only increase.

    The upper bits of such an id are the partition, the lower ones the place in it. Only one
    count per partition is ordered; its running sum is joined back as the offset of the partition.
    """
    part = F.shiftright(F.col(id_column), 33)
    counts = rows.groupBy(part.alias("_p")).agg((F.max(id_column) - F.shiftleft(F.min(part), 33) + 1).alias("_n"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.col(id_column) - F.shiftleft(part, 33)
    return rows.withColumn("_p", part).join(offsets, "_p").withColumn(
        name, F.col("_before") + place).drop("_p", "_before")


def read_model(spark: SparkSession, path: str, letters: str = "ACGT") -> DataFrame:
    """(kmer, rank, level_mean, level_stdv) of a model file with its size checked.

    Only the second and third column are used. The k-mer length comes from the ``#k`` line, else
    from the rows; every k-mer of the alphabet has to be there exactly once.
    """
    text = spark.read.text(path)
    head = text.where(F.col("value").rlike(r"^#k\s")).limit(1).first()
    f = F.split("value", r"[\t ]+")
    rank = kmer_rank if len(letters) == 4 else kmer_rank5
    rows = text.where(F.col("value").rlike(f"^[{letters}]+[\\t ]")).select(
        f[0].alias("kmer"), f[1].cast("float").alias("level_mean"), f[2].cast("float").alias("level_stdv"))
    size = rows.agg(F.count("*").alias("n"), F.countDistinct("kmer").alias("d"), F.min(F.length("kmer")).alias("lo"),
                    F.max(F.length("kmer")).alias("hi")).first()
    k = int(head[0].split()[1]) if head else size["hi"]
    if k is None or k > 6:
        raise ValueError(f"k-mers of a model may have 6 letters at most: {path}")
    if not size["n"] == size["d"] == len(letters) ** k or size["lo"] != k or size["hi"] != k:
        raise ValueError(f"{path} needs {len(letters) ** k} different {k}-mers, found {size['d']} in {size['n']} rows")
    return rows.select("kmer", rank(F.col("kmer")).alias("rank"), "level_mean", "level_stdv")
