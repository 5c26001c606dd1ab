"""SLOW5 (text) and BLOW5 (binary) signal files as Spark sources and sinks.

Text files go through Spark's own text source. Binary files are a Python data source: a file
with an index is cut into byte ranges of whole records, a file without one is one partition.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

from sigspark.sources import codecs

# Fixed values of the formats.
MAGIC, EOF = b"BLOW5\1", b"5WOLB"
INDEX_MAGIC, INDEX_EOF = b"SLOW5IDX\1", b"XDI5WOLS"
VERSION = (0, 2, 0)
COLUMNS = ["read_id", "read_group", "digitisation", "offset", "range", "sampling_rate", "len_raw_signal", "raw_signal"]
COLUMN_TYPES = ["char*", "uint32_t", "double", "double", "double", "double", "uint64_t", "int16_t*"]
# name -> (numpy type, Spark type, value that stands for a missing one)
PRIMITIVES = {
    "int8_t": ("<i1", T.ByteType(), 127), "int16_t": ("<i2", T.ShortType(), 32767),
    "int32_t": ("<i4", T.IntegerType(), 2147483647), "int64_t": ("<i8", T.LongType(), 9223372036854775807),
    "uint8_t": ("<u1", T.ShortType(), 255), "uint16_t": ("<u2", T.IntegerType(), 65535),
    "uint32_t": ("<u4", T.LongType(), 4294967295), "uint64_t": ("<u8", T.DecimalType(20, 0), 18446744073709551615),
    "float": ("<f4", T.FloatType(), None), "double": ("<f8", T.DoubleType(), None),
    "char": ("S1", T.StringType(), b"\0"), "enum": ("<u1", T.StringType(), 255),
}
BASE_SCHEMA = T.StructType([
    T.StructField("read_id", T.StringType()), T.StructField("read_group", T.IntegerType()),
    T.StructField("digitisation", T.DoubleType()), T.StructField("offset", T.DoubleType()),
    T.StructField("range", T.DoubleType()), T.StructField("sampling_rate", T.DoubleType()),
    T.StructField("len_raw_signal", T.LongType()), T.StructField("raw_signal", T.ArrayType(T.ShortType(), False))])
INDEX_SCHEMA = "read_id string, file string, offset long, size long"
SPLIT_BYTES = 128 << 20


def base_type(name: str) -> str:
    return name.split("{")[0].rstrip("*")


def labels(name: str) -> list[str]:
    return name[name.index("{") + 1:name.index("}")].split(",") if "{" in name else []


def is_array(name: str) -> bool:
    return name.split("{")[0].endswith("*")


def aux_field(name: str, kind: str) -> T.StructField:
    spark_type = PRIMITIVES[base_type(kind)][1]
    text = base_type(kind) == "char"
    return T.StructField(name, T.ArrayType(spark_type) if is_array(kind) and not text else spark_type)


@dataclass
class Header:
    version: tuple[int, int, int]
    groups: int
    attributes: list[dict[str, str]]        # one map per read group
    aux: list[tuple[str, str]]              # (name, declared type)
    record_codec: str = "none"
    signal_codec: str = "none"
    data_at: int = 0

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*BASE_SCHEMA.fields, *[aux_field(*a) for a in self.aux]])

    def text(self) -> str:
        """The part of the header that both formats share."""
        names = list(dict.fromkeys(k for group in self.attributes for k in group))
        lines = ["\t".join(["@" + n, *[g.get(n, ".") for g in self.attributes]]) for n in names]
        lines.append("#" + "\t".join(COLUMN_TYPES + [t for _, t in self.aux]))
        lines.append("#" + "\t".join(COLUMNS + [n for n, _ in self.aux]))
        return "\n".join(lines) + "\n"


def parse_text_header(lines: list[str], version, groups: int) -> Header:
    attributes: list[dict[str, str]] = [{} for _ in range(groups)]
    described = []
    for line in lines:
        cells = line[1:].split("\t")
        if line.startswith("@"):
            for group, value in zip(attributes, cells[1:]):
                if value != ".":
                    group[cells[0]] = value
        elif line.startswith("#"):
            described.append(cells)
    if len(described) < 2 or described[-1][:len(COLUMNS)] != COLUMNS:
        raise ValueError("the column header is missing or out of order")
    return Header(version, groups, attributes, list(zip(described[-1], described[-2]))[len(COLUMNS):])


def open_file(path: str):
    filesystem, name = pafs.FileSystem.from_uri(path.replace("file:///", "/"))
    return filesystem.open_input_file(name)


def read_header(path: str) -> Header:
    """Header of a text or binary file; only its first bytes are read."""
    with open_file(path) as f:
        fixed = f.read(68)
        if fixed[:6] == MAGIC:
            version, record, groups, signal = tuple(fixed[6:9]), fixed[9], struct.unpack_from("<I", fixed, 10)[0], fixed[14]
            size = struct.unpack_from("<I", fixed, 64)[0]
            header = parse_text_header(f.read(size).decode().splitlines(), version, groups)
            name = {v: k for k, v in codecs.RECORD_CODECS.items()}
            header.record_codec = name[record]
            header.signal_codec = "svb-zd" if signal and version >= (0, 2, 0) else "none"
            header.data_at = 68 + size
            return header
        text = fixed
        while b"\n#read_id" not in text or b"\n" not in text[text.index(b"\n#read_id") + 1:]:
            block = f.read(1 << 16)
            if not block:
                raise ValueError(f"no column header in {path}")
            text += block
    end = text.index(b"\n", text.index(b"\n#read_id") + 1)
    lines = text[:end].decode().splitlines()
    version = tuple(int(x) for x in lines[0].split("\t")[1].split("."))
    header = parse_text_header(lines[2:], version, int(lines[1].split("\t")[1]))
    header.data_at = end + 1
    return header


def data_files(path: str, suffix: str) -> list[str]:
    """The files under a path; a directory names its parts, so the list is short."""
    filesystem, name = pafs.FileSystem.from_uri(path.replace("file:///", "/"))
    if filesystem.get_file_info(name).type == pafs.FileType.File:
        return [path]
    found = filesystem.get_file_info(pafs.FileSelector(name, recursive=True))
    return sorted(i.path for i in found if i.path.endswith(suffix) and "/_" not in i.path[len(name):])


# ---- records

def _missing(value, kind: str):
    sentinel = PRIMITIVES[kind][2]
    return (value != value) if sentinel is None else value == sentinel


def parse_record(body: bytes, header: Header) -> tuple:
    n = struct.unpack_from("<H", body)[0]
    read_id = body[2:2 + n].decode()
    at = 2 + n
    group, digitisation, offset, range_, rate, length = struct.unpack_from("<IddddQ", body, at)
    at += 44
    if header.signal_codec == "svb-zd":
        signal = codecs.decode_signal(body[at:at + length])
        at += length
    else:
        signal = np.frombuffer(body, "<i2", length, at)
        at += 2 * length
    out = [read_id, group, digitisation, offset, range_, rate, len(signal), signal]
    for _, declared in header.aux:
        kind = base_type(declared)
        dtype = np.dtype(PRIMITIVES[kind][0])
        count = 1
        if is_array(declared):
            count = struct.unpack_from("<Q", body, at)[0]
            at += 8
        raw = np.frombuffer(body, dtype, count, at)
        at += count * dtype.itemsize
        names = labels(declared)
        if kind == "char":
            text = raw.tobytes().decode()
            out.append(None if not count or text == "\0" else text)
            continue
        values = [None if _missing(v, kind) else names[v] if names else v for v in raw.tolist()]
        out.append((values if count else None) if is_array(declared) else values[0])
    return tuple(out)


def build_record(row: dict, header: Header) -> bytes:
    name = row["read_id"].encode()
    signal = np.asarray(row["raw_signal"], np.int16)
    coded = codecs.encode_signal(signal) if header.signal_codec == "svb-zd" else signal.astype("<i2").tobytes()
    length = len(coded) if header.signal_codec == "svb-zd" else len(signal)
    parts = [struct.pack("<H", len(name)), name, struct.pack(
        "<IddddQ", row["read_group"], row["digitisation"], row["offset"], row["range"], row["sampling_rate"], length), coded]
    for column, declared in header.aux:
        kind, value, names = base_type(declared), row[column], labels(declared)
        dtype, _, sentinel = PRIMITIVES[kind]
        if kind == "char":
            data = (value or "").encode() if is_array(declared) else (value or "\0").encode()
            parts += [struct.pack("<Q", len(data)), data] if is_array(declared) else [data]
            continue
        values = (value or []) if is_array(declared) else [value]
        empty = float("nan") if sentinel is None else sentinel
        coded = [empty if v is None else names.index(v) if names else int(v) if dtype[1] in "iu" else v for v in values]
        if is_array(declared):
            parts.append(struct.pack("<Q", len(coded)))
        parts.append(np.array(coded, dtype).tobytes())
    body = codecs.compress_record(b"".join(parts), header.record_codec)
    return struct.pack("<Q", len(body)) + body


def file_head(header: Header) -> bytes:
    text = header.text().encode()
    head = MAGIC + bytes(header.version) + bytes([codecs.RECORD_CODECS[header.record_codec]]) + struct.pack(
        "<I", header.groups) + bytes([codecs.SIGNAL_CODECS[header.signal_codec]])
    return head.ljust(64, b"\0") + struct.pack("<I", len(text)) + text


def read_index_entries(path: str):
    """(read_id, offset, size) of an index file."""
    with open_file(path) as f:
        blob = f.read()
    if blob[:9] != INDEX_MAGIC or blob[-8:] != INDEX_EOF:
        raise ValueError(f"not an index: {path}")
    at = 64
    while at < len(blob) - 8:
        n = struct.unpack_from("<H", blob, at)[0]
        name = blob[at + 2:at + 2 + n].decode()
        yield name, *struct.unpack_from("<QQ", blob, at + 2 + n)
        at += 18 + n


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int | None


class Blow5Reader(DataSourceReader):
    def __init__(self, files: list[str], schema: T.StructType, index_only: bool, split_bytes: int):
        self.files, self.schema, self.index_only, self.split_bytes = files, schema, index_only, split_bytes

    def partitions(self):
        out = []
        for file in self.files:
            filesystem, name = pafs.FileSystem.from_uri(file.replace("file:///", "/"))
            if self.index_only or filesystem.get_file_info(name + ".idx").type != pafs.FileType.File:
                out.append(Range(file, -1, None))
                continue
            start = stop = None
            for _, offset, size in sorted(read_index_entries(file + ".idx"), key=lambda e: e[1]):
                if start is not None and offset + size - start > self.split_bytes:
                    out.append(Range(file, start, stop))
                    start = None
                start, stop = offset if start is None else start, offset + size
            if start is not None:
                out.append(Range(file, start, stop))
        return out

    def read(self, partition):
        header = read_header(partition.file)
        schema = to_arrow_schema(self.schema)
        with open_file(partition.file) as f:
            f.seek(header.data_at if partition.start < 0 else partition.start)
            rows, held = [], 0
            while partition.stop is None or f.tell() < partition.stop:
                offset = f.tell()
                prefix = f.read(8)
                if prefix == EOF:
                    break
                if len(prefix) < 8:
                    raise ValueError(f"truncated file {partition.file}")
                size = struct.unpack("<Q", prefix)[0]
                body = f.read(size)
                if len(body) < size:
                    raise ValueError(f"truncated file {partition.file}")
                if self.index_only:
                    head = codecs.record_head(body, header.record_codec)
                    n = struct.unpack_from("<H", head)[0]
                    if len(head) < 2 + n:
                        head = codecs.expand_record(body, header.record_codec)
                    rows.append((head[2:2 + n].decode(), partition.file, offset, size + 8))
                    held += 64
                else:
                    rows.append(parse_record(codecs.expand_record(body, header.record_codec), header))
                    held += 2 * rows[-1][6] + 256
                if held > 8 << 20:
                    yield to_batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield to_batch(rows, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    file: str


class Blow5Writer(DataSourceArrowWriter):
    """Each task writes one complete file aside; the commit moves the files of the winning tasks."""

    def __init__(self, path: str, header: Header, overwrite: bool):
        self.path, self.header, self.overwrite = path.rstrip("/"), header, overwrite
        self.aside = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator):
        filesystem, folder = pafs.FileSystem.from_uri(self.aside)
        filesystem.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.blow5"
        with filesystem.open_output_stream(f"{folder}/{name}") as out:
            out.write(file_head(self.header))
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(build_record(row, self.header))
            out.write(EOF)
        return Written(name)

    def commit(self, messages):
        filesystem, folder = pafs.FileSystem.from_uri(self.path)
        _, aside = pafs.FileSystem.from_uri(self.aside)
        filesystem.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in data_files(self.path, ".blow5"):
                if "/_writing-" not in old:
                    filesystem.delete_file(old)
        for message in messages:
            filesystem.move(f"{aside}/{message.file}", f"{folder}/{message.file}")
        self.abort(messages)

    def abort(self, messages):
        filesystem, aside = pafs.FileSystem.from_uri(self.aside)
        if filesystem.get_file_info(aside).type == pafs.FileType.Directory:
            filesystem.delete_dir(aside)


class Blow5Source(DataSource):
    """``spark.read.format("blow5").load(path)`` and ``df.write.format("blow5")``.

    Read options: ``index_only``, ``split_bytes``. Write options: ``record_codec``,
    ``signal_codec``, ``attributes`` and ``aux`` (JSON: a list of maps and a list of pairs).
    """

    @classmethod
    def name(cls):
        return "blow5"

    def _files(self):
        files = data_files(self.options["path"], ".blow5")
        if not files:
            raise ValueError(f"no .blow5 files under {self.options['path']}")
        return files

    def schema(self):
        if self.options.get("index_only", "false").lower() == "true":
            return INDEX_SCHEMA
        return read_header(self._files()[0]).schema

    def reader(self, schema):
        return Blow5Reader(self._files(), schema, self.options.get("index_only", "false").lower() == "true",
                           int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        o = self.options
        attributes = json.loads(o.get("attributes", "[{}]"))
        header = Header(VERSION, len(attributes), attributes, [tuple(a) for a in json.loads(o.get("aux", "[]"))],
                        o.get("record_codec", "zlib"), o.get("signal_codec", "svb-zd"))
        missing = [f.name for f in header.schema if f.name not in schema.names]
        if missing:
            raise ValueError(f"columns missing for a signal file: {missing}")
        return Blow5Writer(o["path"], header, overwrite)


# ---- functions

def read_blow5(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Blow5Source)
    return spark.read.format("blow5").options(**options).load(path)


def write_blow5(records: DataFrame, path: str, header: Header | None = None, record_codec: str = "zlib",
                signal_codec: str = "svb-zd", mode: str = "overwrite") -> None:
    records.sparkSession.dataSource.register(Blow5Source)
    attributes = header.attributes if header else [{}]
    aux = header.aux if header else []
    (records.write.format("blow5").mode(mode).option("record_codec", record_codec).option("signal_codec", signal_codec)
     .option("attributes", json.dumps(attributes)).option("aux", json.dumps(aux)).save(path))


def read_slow5(spark: SparkSession, path: str) -> DataFrame:
    """Text records, parsed in the JVM; a dot is a missing value."""
    header = read_header(data_files(path, ".slow5")[0])
    f = F.split("value", "\t")
    cells = [F.when(F.get(f, F.lit(i)) != ".", F.get(f, F.lit(i))) for i in range(len(COLUMNS) + len(header.aux))]
    columns = []
    for cell, field, declared in zip(cells, header.schema.fields, COLUMN_TYPES + [t for _, t in header.aux]):
        if isinstance(field.dataType, T.ArrayType):
            values = F.split(cell, ",")
            present = F.transform(values, lambda x: F.when(x != ".", x))
            columns.append(present.cast(T.ArrayType(field.dataType.elementType)).alias(field.name))
        else:
            columns.append(cell.cast(field.dataType).alias(field.name))
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("@") & (F.length("value") > 0))
    return lines.select(*columns)


def slow5_lines(header: Header):
    cells = []
    for field in header.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            cell = F.array_join(F.transform(cell, lambda x: x.cast("string")), ",", ".")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # whole numbers are written without a fraction
            cell = F.when(cell == F.floor(cell), F.floor(cell).cast("string")).otherwise(cell.cast("string"))
        cells.append(F.coalesce(cell.cast("string"), F.lit(".")))
    return F.concat_ws("\t", *cells)


def write_slow5(records: DataFrame, path: str, header: Header | None = None) -> None:
    """Text parts, each with the complete header as its first lines."""
    header = header or Header(VERSION, 1, [{}], [])
    head = "#slow5_version\t{}\n#num_read_groups\t{}\n{}".format(
        ".".join(map(str, header.version)), header.groups, header.text())

    def run(batches):
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_pydict({"value": ([head.rstrip("\n")] if first else []) + lines})
                first = False

    target = records.select(slow5_lines(header).alias("value")).mapInArrow(run, "value string")
    target.write.mode("overwrite").format("text").save(path)


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, file, offset, size) of every record, expanding only the start of each."""
    return read_blow5(spark, path, index_only="true")


def write_indexes(index: DataFrame) -> None:
    """One index file next to each signal file.

    The entries of a file are sorted by Spark and streamed through the task that writes its
    index, so the size of a file does not matter for memory.
    """
    def run(batches):
        current = out = None
        for batch in batches:
            for file, read_id, offset, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if file != current:
                    if out is not None:
                        out.write(INDEX_EOF)
                        out.close()
                    filesystem, name = pafs.FileSystem.from_uri(file.replace("file:///", "/"))
                    out, current = filesystem.open_output_stream(name + ".idx"), file
                    out.write((INDEX_MAGIC + bytes(VERSION)).ljust(64, b"\0"))
                coded = read_id.encode()
                out.write(struct.pack("<H", len(coded)) + coded + struct.pack("<QQ", offset, size))
            yield batch.slice(0, 0)
        if out is not None:
            out.write(INDEX_EOF)
            out.close()

    ordered = index.select("file", "read_id", "offset", "size").repartition("file").sortWithinPartitions("file", "offset")
    ordered.mapInArrow(run, ordered.schema).write.format("noop").mode("overwrite").save()


def fetch_records(wanted: DataFrame, header: Header) -> DataFrame:
    """Random access: rows of (file, offset, size) to records, reading only those bytes.

    Rows are hashed by file and a slice of the offset, so a large file is read by many tasks, and
    sorted within a task so that each file is opened once and read forwards.
    """
    schema = header.schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        current, stream, head = None, None, None
        for batch in batches:
            rows = []
            for file, offset, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file != current:
                    current, stream, head = file, open_file(file), read_header(file)
                stream.seek(offset + 8)
                rows.append(parse_record(codecs.expand_record(stream.read(size - 8), head.record_codec), head))
            if rows:
                yield to_batch(rows, arrow)

    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = wanted.select("file", "offset", "size").repartition(n, "file", F.shiftright("offset", 28))
    return spread.sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def signals(records: DataFrame) -> DataFrame:
    """Records as the signal table of the jobs."""
    return records.select("read_id", F.col("raw_signal").alias("raw"), "digitisation", "offset", "range", "sampling_rate")


def is_rna(header: Header) -> bool:
    """True when the experiment type of the first read group is ``rna``; DNA is assumed otherwise."""
    return header.attributes[0].get("experiment_type") == "rna"
