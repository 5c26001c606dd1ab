"""Plain FASTQ files in many tasks.

A task takes a range of bytes and reads the records whose first line begins in it. Inside a file the first record is
told by four lines together: a quality line may begin like a name line, but two lines after it stands a sequence, which
never begins with a plus. Files whose records span more than four lines are read by the task of their first range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from sigspark.sources.sequences import FASTX_SCHEMA, fastx_records
from sigspark.sources.slow5 import open_file

SUFFIXES = (".fastq", ".fq")
#: Bytes of a range, bytes read at once, and bytes of records that are handed on together.
SPLIT_BYTES, READ, HELD = 128 << 20, 1 << 20, 8 << 20
#: Ranges of one read beyond which smaller ones than SPLIT_BYTES only add tasks.
RANGES = 256


def files_of(path: str, suffixes: tuple[str, ...] = SUFFIXES) -> list[tuple[str, int]]:
    """(file, size) of a file, or of the files below a folder that end so."""
    filesystem, name = pafs.FileSystem.from_uri(path.replace("file:///", "/"))
    info = filesystem.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = filesystem.get_file_info(pafs.FileSelector(name, recursive=True))
    return sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File and i.path.endswith(suffixes))


def range_bytes(total: int, split_bytes: int) -> int:
    """Bytes of a range: those asked for, more where small ranges would be over RANGES tasks."""
    return max(split_bytes, min(-(-total // RANGES), SPLIT_BYTES))


def lines_from(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin at `at` or later."""
    if at:
        stream.seek(at - 1)
    parts: list[bytes] = []
    begin, inside = at, at > 0  # inside a line that began earlier
    while block := stream.read(READ):
        *whole, rest = block.split(b"\n")
        for piece in whole:
            line = b"".join([*parts, piece])
            parts.clear()
            if inside:
                inside, begin = False, at - 1 + len(line) + 1
                continue
            yield begin, line.rstrip(b"\r")
            begin += len(line) + 1
        parts.append(rest)
    if not inside and (line := b"".join(parts)):
        yield begin, line.rstrip(b"\r")


def is_record(four: list[bytes]) -> bool:
    """Whether four lines are a record."""
    return len(four) == 4 and four[0][:1] == b"@" and four[2][:1] == b"+" and four[1][:1] not in (b"@", b"+") and len(four[1]) == len(four[3])


def four_lines(path: str) -> bool:
    """Whether the first record of a file has four lines; a file without records has."""
    with open_file(path) as stream:
        head = [line for _, line in islice(lines_from(stream, 0), 4)]
    return not any(head) or is_record(head + [b""] if len(head) == 3 else head)


def range_records(path: str, begin: int, end: int) -> Iterator[tuple[str, str, str, str, int]]:
    """(name, comment, sequence, quality, place) of the records of four lines that begin in [begin, end)."""
    with open_file(path) as stream:
        held: list[tuple[int, bytes]] = []
        found = begin == 0
        for at, line in lines_from(stream, begin):
            if not held and (at >= end or (found and not line)):
                if at >= end:
                    return
                continue
            held.append((at, line))
            if len(held) < 4:
                continue
            if is_record([x for _, x in held]):
                found = True
                yield _record(held)
                held = []
            elif found:
                raise ValueError(f"record of other than four lines at byte {held[0][0]} of {path}; read_fastx reads such files")
            else:
                held.pop(0)
                if held[0][0] >= end:
                    return
        if len(held) == 3 and is_record([*(x for _, x in held), b""]):  # the last record is empty and without a line end
            yield _record([*held, (0, b"")])
        elif found and any(line for _, line in held):
            raise ValueError(f"record of other than four lines at byte {held[0][0]} of {path}; read_fastx reads such files")


def _record(four: list[tuple[int, bytes]]) -> tuple[str, str, str, str, int]:
    (at, head), (_, seq), _, (_, qual) = four
    name, _, comment = head[1:].decode("ascii", "replace").replace("\t", " ", 1).partition(" ")
    return name, comment, seq.decode("ascii", "replace"), qual.decode("ascii", "replace") or None, at


@dataclass
class Part(InputPartition):
    file: str
    begin: int
    end: int


class FastqReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], schema, split_bytes: int):
        self.files, self.schema, self.split_bytes = files, schema, split_bytes

    def partitions(self):
        step = range_bytes(sum(size for _, size in self.files), self.split_bytes)
        return [Part(file, begin, min(begin + step, size)) for file, size in self.files for begin in range(0, size, step)]

    def read(self, part):
        kind = to_arrow_schema(self.schema)
        if four_lines(part.file):
            records = range_records(part.file, part.begin, part.end)
        elif part.begin == 0:
            records = ((*record, i) for i, record in enumerate(fastx_records(part.file)))
        else:
            return
        rows, size = [], 0
        for name, comment, seq, qual, at in records:
            rows.append((name, comment, seq, qual, part.file, at))
            size += 2 * len(seq) + 64
            if size > HELD:
                yield _batch(rows, kind)
                rows, size = [], 0
        if rows:
            yield _batch(rows, kind)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


class FastqSource(DataSource):
    """``spark.read.format("fastq_ranges").load(path)``; options ``split_bytes`` and ``suffix``."""

    @classmethod
    def name(cls):
        return "fastq_ranges"

    def schema(self):
        return FASTX_SCHEMA

    def reader(self, schema):
        suffixes = (self.options["suffix"],) if "suffix" in self.options else SUFFIXES
        return FastqReader(files_of(self.options["path"], suffixes), schema, int(self.options.get("split_bytes", SPLIT_BYTES)))


def read_fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    """(read_id, comment, seq, qual, file, record) of plain FASTQ files; ``record`` rises within a file.

    A record of more than four lines is an error unless it is the first of its file, which is then read by one task.
    A path without FASTQ files gives no rows.
    """
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq_ranges").options(**options).load(path)
