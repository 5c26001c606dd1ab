"""BAM files: many tasks for a file, regions through the binning index, and writing.

A file is a row of small compressed blocks. A task takes a range of its bytes: it looks for the first block that begins
there, told by its header and its checksum, goes on to the first place where a chain of records is plausible, and reads
the records that begin in its range. A region is looked up in the index next to the file by the task that reads it, and
only the blocks of its bins are fetched.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, InputPartition,
                                    LessThan, WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

from sigspark.sources.sidecars import write_sidecars
from sigspark.sources.slow5 import data_files, open_file

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


SCHEMA = _schema(read_id="string", flag="int", contig="string", pos="int", mapq="int", cigar="string", seq="string", nm="int", aln_end="int",
                 file="string", part="long", place="long")
INDEX_SCHEMA = _schema(file="string", contig="int", kind="int", bin="int", begin="long", end="long")

# The first bytes of a block and of the files, the empty last block, letters of operations and bases, the
# levels of the bins (first number and size as a power of two) and the windows of the linear index.
BLOCK_MAGIC, BAM_MAGIC, INDEX_MAGIC = b"\x1f\x8b\x08\x04", b"BAM\1", b"BAI\1"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
BIN_LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29))
WINDOW = 14
REFERENCE = frozenset("MDN=X")

PAIRS = [a + b for a in BASES for b in BASES]
SPLIT_BYTES, FETCH, BLOCK = 64 << 20, 1 << 18, 0xFF00
#: Records in a row that have to be plausible where a range begins within a file.
CHAIN = 4
CHUNKS, LINEAR = 0, 1


def block_size(head: bytes) -> int | None:
    """Size of the block with this beginning, None if it is none."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC:
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 6 <= min(12 + extra, len(head)):
        tag, size = head[at:at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if tag == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def unblocked(block: bytes) -> bytes | None:
    """Content of a block, None if its checksum or size is wrong."""
    extra = struct.unpack_from("<H", block, 10)[0]
    try:
        data = zlib.decompress(block[12 + extra:-8], -15)
    except zlib.error:
        return None
    return data if struct.unpack("<II", block[-8:]) == (zlib.crc32(data), len(data)) else None


class Blocks:
    """Content of a file from the block at `at` on, read forwards; places are known by block and by offset in it."""

    def __init__(self, path: str, at: int = 0):
        self.path, self.file = path, open_file(path)
        self.size, self.next, self.raw, self.raw_at, self.fetched = self.file.size(), at, b"", 0, 0
        self.data, self.base, self.at, self.marks, self.offsets = b"", 0, 0, [0], [at]

    def close(self) -> None:
        self.file.close()

    def compressed(self, at: int, n: int) -> bytes:
        if at < self.raw_at or at + n > self.raw_at + len(self.raw):
            self.file.seek(at)
            self.raw, self.raw_at = self.file.read(max(n, min(FETCH, self.size - at))), at
            self.fetched += len(self.raw)
        return self.raw[at - self.raw_at:at - self.raw_at + n]

    def seek_block(self, begin: int, end: int) -> bool:
        """Goes to the first block that begins in [begin, end)."""
        at = begin
        while at < end:
            window = self.compressed(at, FETCH)
            found = window.find(BLOCK_MAGIC)
            if found < 0:
                if len(window) < FETCH:
                    return False
                at += len(window) - len(BLOCK_MAGIC) + 1
                continue
            at += found
            if at < end and (size := block_size(self.compressed(at, 64))) and len(block := self.compressed(at, size)) == size and unblocked(block) is not None:
                self.jump(at)
                return True
            at += 1
        return False

    def jump(self, block: int, within: int = 0) -> None:
        self.next, self.data, self.base, self.at, self.marks, self.offsets = block, b"", 0, 0, [0], [block]
        self.skip(within)

    def load(self) -> bool:
        if self.next >= self.size:
            return False
        head = self.compressed(self.next, 64)
        size = block_size(head)
        block = self.compressed(self.next, size) if size else b""
        data = unblocked(block) if size and len(block) == size else None
        if not size and head[:2] == BLOCK_MAGIC[:2]:
            data, size = self._member()
        if data is None:
            raise ValueError(f"truncated or damaged file {self.path}, byte {self.next}")
        self.marks.append(self.base + len(self.data))
        self.offsets.append(self.next)
        if self.at - self.base > 1 << 20:  # what was read is let go
            self.data, self.base = self.data[self.at - self.base:], self.at
            first = bisect_right(self.marks, self.at) - 1
            self.marks, self.offsets = self.marks[first:], self.offsets[first:]
        self.data += data
        self.next += size
        return True

    def _member(self) -> tuple[bytes | None, int]:
        """Content and size of a gzip member that is no block; such files are read whole."""
        out, member, at = [], zlib.decompressobj(31), self.next
        while not member.eof and (piece := self.compressed(at, min(FETCH, self.size - at))):
            out.append(member.decompress(piece))
            at += len(piece)
        return (b"".join(out) if member.eof else None), at - len(member.unused_data) - self.next

    def peek(self, n: int, ahead: int = 0) -> bytes:
        while self.base + len(self.data) < self.at + ahead + n and self.load():
            pass
        begin = self.at - self.base + ahead
        return self.data[begin:begin + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        if len(out) < n:
            raise ValueError(f"truncated file {self.path}")
        self.at += n
        return out

    def skip(self, n: int) -> None:
        while n:
            step = min(n, 1 << 20)
            self.take(step)
            n -= step

    def place(self) -> tuple[int, int]:
        """(block, offset in its content) of the next byte; behind the last one (size of the file, 0)."""
        if not self.peek(1):
            return self.size, 0
        i = bisect_right(self.marks, self.at) - 1
        return self.offsets[i], self.at - self.marks[i]

    def virtual(self) -> int:
        block, within = self.place()
        return block << 16 | within


def read_head(blocks: Blocks) -> list[tuple[str, int]]:
    """(name, length) of the contigs; goes to the first record."""
    if blocks.take(4) != BAM_MAGIC:
        raise ValueError(f"not a BAM file: {blocks.path}")
    blocks.skip(struct.unpack("<i", blocks.take(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.take(4))[0]):
        name = blocks.take(struct.unpack("<i", blocks.take(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.take(4))[0]))
    return out


def _plausible(blocks: Blocks, contigs: list[tuple[str, int]]) -> bool:
    """Whether CHAIN records, or all that are left, may begin at the next byte."""
    ahead, n = 0, len(contigs)
    for i in range(CHAIN):
        head = blocks.peek(36, ahead)
        if not head and i:
            return True
        if len(head) < 36:
            return False
        size, contig, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", head)
        if not (-1 <= contig < n and -1 <= mate < n and pos >= -1 and mate_pos >= -1 and l_name and l_seq >= 0):
            return False
        if (contig >= 0 and pos > contigs[contig][1]) or size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
            return False
        name = blocks.peek(l_name, ahead + 36)
        if len(name) < l_name or name[-1] or not all(32 < c < 127 for c in name[:-1]):
            return False
        ahead += 4 + size
    return True


def parsed(body: bytes, contigs: list[tuple[str, int]], bases: bool) -> tuple:
    contig, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", body)
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_cigar}I", body, at)
    packed = at + 4 * n_cigar
    tags = packed + (l_seq + 1) // 2 + l_seq
    seq = None
    if bases:
        seq = "".join(map(PAIRS.__getitem__, body[packed:packed + (l_seq + 1) // 2]))[:l_seq] or "*"
    cigar = "".join([f"{op >> 4}{OPERATIONS[op & 15]}" for op in ops]) or "*"
    span = sum(op >> 4 for op in ops if OPERATIONS[op & 15] in REFERENCE)
    return (body[32:at - 1].decode(), flag, contigs[contig][0] if contig >= 0 else "*", pos, mapq, cigar, seq, _edit_distance(body, tags), pos + span)


def _edit_distance(body: bytes, at: int) -> int | None:
    """Value of the NM tag among the typed tags at the end of a record."""
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    formats = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
    while at + 3 <= len(body):
        tag, kind = body[at:at + 2], chr(body[at + 2])
        at += 3
        if tag == b"NM" and kind in formats:
            return struct.unpack_from(formats[kind], body, at)[0]
        if kind in "ZH":
            at = body.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + sizes[chr(body[at])] * struct.unpack_from("<i", body, at + 1)[0]
        else:
            at += sizes[kind]
    return None


def range_records(path: str, begin: int, end: int) -> Iterator[tuple[int, bytes, int]]:
    """(virtual offset, record, virtual offset behind it) of the records that begin in blocks of [begin, end)."""
    blocks = Blocks(path)
    try:
        contigs = read_head(blocks)
        if blocks.place()[0] < begin:
            if not blocks.seek_block(begin, end):
                return
            while blocks.place()[0] < end and not _plausible(blocks, contigs):
                blocks.at += 1
        while blocks.place()[0] < end and (at := blocks.virtual()) is not None and blocks.peek(1):
            body = blocks.take(struct.unpack("<i", blocks.take(4))[0])
            yield at, body, blocks.virtual()
    finally:
        blocks.close()


# ---- index

def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds [begin, end)."""
    if end > 1 << 29:
        raise ValueError("the binning index reaches up to 512 Mb")
    for first, size in BIN_LEVELS:
        if begin >> size == (end - 1) >> size:
            return first + (begin >> size)
    raise AssertionError


def bins_of(begin: int, end: int) -> list[tuple[int, int]]:
    """First and last bin of each level that may hold what overlaps [begin, end)."""
    return [(first + (begin >> size), first + ((end - 1) >> size)) for first, size in BIN_LEVELS]


def _index_rows(path: str, begin: int, end: int) -> Iterator[tuple]:
    """(file, contig, kind, bin or window, begin, end) of a range: runs of records of one bin, first offset of each window."""
    chunks: dict[tuple[int, int], list[list[int]]] = {}
    linear: dict[tuple[int, int], int] = {}
    for at, body, after in range_records(path, begin, end):
        contig, pos, l_name, _, _, n_cigar = struct.unpack_from("<iiBBHH", body)
        if contig < 0 or pos < 0:
            continue
        ops = struct.unpack_from(f"<{n_cigar}I", body, 32 + l_name)
        last = pos + max(sum(op >> 4 for op in ops if OPERATIONS[op & 15] in REFERENCE), 1)
        held = chunks.setdefault((contig, bin_of(pos, last)), [])
        if held and held[-1][1] >> 16 >= at >> 16:  # within one block or behind it without a gap
            held[-1][1] = after
        else:
            held.append([at, after])
        for window in range(pos >> WINDOW, (last - 1 >> WINDOW) + 1):
            linear[contig, window] = min(at, linear.get((contig, window), at))
    yield from ((path, contig, CHUNKS, number, a, b) for (contig, number), held in chunks.items() for a, b in held)
    yield from ((path, contig, LINEAR, window, at, at) for (contig, window), at in linear.items())


def _index_bytes(n_contigs: int, entries: dict[int, tuple[dict[int, list], dict[int, int]]]) -> bytes:
    out = [INDEX_MAGIC, struct.pack("<i", n_contigs)]
    for contig in range(n_contigs):
        chunks, linear = entries.get(contig, ({}, {}))
        out.append(struct.pack("<i", len(chunks)))
        for number in sorted(chunks):
            held: list[list[int]] = []
            for a, b in sorted(chunks[number]):
                if held and held[-1][1] >> 16 >= a >> 16:
                    held[-1][1] = max(held[-1][1], b)
                else:
                    held.append([a, b])
            out.append(struct.pack("<Ii", number, len(held)) + b"".join(struct.pack("<QQ", a, b) for a, b in held))
        windows, before = [], 0
        for window in range(max(linear, default=-1) + 1):
            before = linear.get(window, before)
            windows.append(before)
        out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
    return b"".join(out)


def index_bam(spark: SparkSession, path: str, **options) -> None:
    """Writes the binning index next to each file, as `file.bai`.

    Tasks over byte ranges reduce their records to runs of a bin; what is left of a file, some thousand entries for
    each Gb of genome, is sorted into one row. The files must be in order of position.
    """
    rows = read_bam(spark, path, index_only="true", **options)

    def build(batches):
        current, entries = None, {}
        for batch in batches:
            for file, contig, kind, number, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if file != current:
                    if current is not None:
                        yield _built(current, entries)
                    current, entries = file, {}
                chunks, linear = entries.setdefault(contig, ({}, {}))
                if kind == CHUNKS:
                    chunks.setdefault(number, []).append((begin, end))
                else:
                    linear[number] = min(begin, linear.get(number, begin))
        if current is not None:
            yield _built(current, entries)

    def _built(file, entries):
        blocks = Blocks(file)
        n = len(read_head(blocks))
        blocks.close()
        return pa.RecordBatch.from_pydict({"target": [file + ".bai"], "data": [_index_bytes(n, entries)]})

    write_sidecars(rows.repartition("file").sortWithinPartitions("file").mapInArrow(build, "target string, data binary"))


def chunks_of(index: bytes, contig: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Virtual ranges that hold every record overlapping one of the spans [begin, end) of a contig; of a span in order and without overlap."""
    if index[:4] != INDEX_MAGIC:
        raise ValueError("not a binning index")
    at = 8
    for number in range(struct.unpack_from("<i", index, 4)[0]):
        bins, n_bins = {}, struct.unpack_from("<i", index, at)[0]
        at += 4
        for _ in range(n_bins):
            name, n = struct.unpack_from("<Ii", index, at)
            at += 8
            if number == contig:
                bins[name] = [struct.unpack_from("<QQ", index, at + 16 * i) for i in range(n)]
            at += 16 * n
        n = struct.unpack_from("<i", index, at)[0]
        if number == contig:
            least = struct.unpack_from(f"<{n}Q", index, at + 4)
            return list(dict.fromkeys(chunk for span in spans for chunk in _span_chunks(bins, least, *span)))
        at += 4 + 8 * n
    return []


def region_chunks(index: bytes, contig: int, begin: int, end: int) -> list[tuple[int, int]]:
    """Virtual ranges that hold every record overlapping [begin, end) of a contig, in order and without overlap."""
    return chunks_of(index, contig, [(begin, end)])


def _span_chunks(bins: dict[int, list[tuple[int, int]]], windows: tuple[int, ...], begin: int, end: int) -> list[tuple[int, int]]:
    end = min(end, 1 << 29)
    wanted = bins_of(begin, end) if begin < end else []
    names = [n for a, b in wanted for n in (range(a, b + 1) if b - a < len(bins) else [x for x in bins if a <= x <= b])]
    least = windows[min(begin >> WINDOW, len(windows) - 1)] if windows else 0
    out: list[list[int]] = []
    for a, b in sorted(c for n in names for c in bins.get(n, ()) if c[1] > least):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([max(a, least), b])
    return [(a, b) for a, b in out]


def records_of(blocks: Blocks, contigs: list[tuple[str, int]], index: bytes, regions: list[tuple[str, int, int]]) -> Iterator[tuple[int, bytes, int]]:
    """(virtual offset, record, begin of the next region) of what may overlap sorted regions without overlap.

    Regions of a contig share bins, so their blocks are joined and read once, however many regions there are. A record
    overlaps one of them if it reaches beyond the begin of the first that does not end before it.
    """
    numbers = {name: i for i, (name, _) in enumerate(contigs)}
    for contig, group in groupby(regions, key=lambda region: region[0]):
        if (number := numbers.get(contig)) is None:
            continue
        spans = [(begin, end) for _, begin, end in group]
        ends, joined = [end for _, end in spans], []
        for low, high in sorted(chunks_of(index, number, spans)):
            if joined and low <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], high)
            else:
                joined.append([low, high])
        for low, high in joined:
            blocks.jump(low >> 16, low & 0xFFFF)
            while (at := blocks.virtual()) < high:
                body = blocks.take(struct.unpack("<i", blocks.take(4))[0])
                own, pos = struct.unpack_from("<ii", body)
                if own != number or pos >= ends[-1]:  # sorted by position
                    break
                yield at, body, spans[bisect_right(ends, pos)][0]


def region_records(blocks: Blocks, contigs: list[tuple[str, int]], index: bytes, contig: str, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, record) of what may overlap a region, reading the blocks of its bins only."""
    for at, body, _ in records_of(blocks, contigs, index, [(contig, begin, end)]):
        yield at, body


# ---- source

@dataclass
class Part(InputPartition):
    file: str
    begin: int
    end: int
    regions: list[tuple[str, int, int]] | None = None
    before: tuple[str, int, int] = ("", 0, 0)  # the region ahead of these, whose records another task gives


def _intervals(regions: list) -> list[tuple[str, int, int]]:
    """Regions without overlap, in order."""
    out: list[list] = []
    for contig, begin, end in sorted((c, int(b), int(e)) for c, b, e in regions if int(b) < int(e)):
        if out and out[-1][0] == contig and begin <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([contig, begin, end])
    return [(c, b, e) for c, b, e in out]


class BamReader(DataSourceReader):
    """Filters `contig = c`, `pos < e` and `aln_end > b` select a region; they are applied again by Spark."""

    def __init__(self, files: list[str], schema: T.StructType, options: dict):
        self.files, self.schema = files, schema
        self.index_only = options.get("index_only", "false").lower() == "true"
        self.bases = options.get("bases", "true").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.regions = _intervals(json.loads(options["regions"])) if "regions" in options else None
        self.contig, self.begin, self.end = None, 0, 1 << 29

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("contig",):
                self.contig = f.value
            elif isinstance(f, LessThan) and f.attribute == ("pos",):
                self.end = min(self.end, f.value)
            elif isinstance(f, GreaterThan) and f.attribute == ("aln_end",):
                self.begin = max(self.begin, f.value)
            yield f

    def partitions(self):
        regions = self.regions
        if regions is None and self.contig is not None:
            regions = [(self.contig, self.begin, self.end)]
        out = []
        for file in self.files:
            filesystem, name = pafs.FileSystem.from_uri(file.replace("file:///", "/"))
            indexed, size = filesystem.get_file_info([name + ".bai", name])
            if regions is not None and not self.index_only and indexed.type == pafs.FileType.File:
                # neighbouring regions stay together
                out += [Part(file, i, -1, regions[i:i + 256], regions[i - 1] if i else ("", 0, 0)) for i in range(0, len(regions), 256)]
            else:
                with open_file(file) as f:
                    step = self.split_bytes if block_size(f.read(64)) else size.size
                out += [Part(file, begin, min(begin + step, size.size)) for begin in range(0, size.size, max(step, 1))]
        return out or [Part("", 0, 0)]

    def read(self, part):
        arrow = to_arrow_schema(self.schema)
        rows: list[tuple] = []
        for row in self._rows(part) if part.file else ():
            rows.append(row)
            if len(rows) == 2048:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)

    def _rows(self, part) -> Iterator[tuple]:
        if self.index_only:
            yield from _index_rows(part.file, part.begin, part.end)
            return
        blocks = Blocks(part.file)
        contigs = read_head(blocks)
        if part.regions is not None:
            with open_file(part.file + ".bai") as f:
                index = f.read()
            place, (name, _, reach) = 0, part.before
            for _, body, begin in records_of(blocks, contigs, index, part.regions):
                row = parsed(body, contigs, self.bases)
                if row[8] > begin and not (row[2] == name and row[3] < reach):
                    yield (*row, part.file, part.begin, place)
                    place += 1
        else:
            for place, (_, body, _) in enumerate(range_records(part.file, part.begin, part.end)):
                yield (*parsed(body, contigs, self.bases), part.file, part.begin, place)
        blocks.close()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# ---- writer

def record_bytes(row: dict, numbers: dict[str, int]) -> bytes:
    """A record of (read_id, flag, contig, pos, mapq, cigar, seq, nm); nulls are what the format has for missing."""
    ops, n = [], ""
    for c in row["cigar"] if row["cigar"] not in (None, "*") else "":
        if c.isdigit():
            n += c
        else:
            ops.append((int(n) << 4 | OPERATIONS.index(c), c))
            n = ""
    span = sum(op >> 4 for op, c in ops if c in REFERENCE)
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [max(BASES.find(c), 0) for c in seq.upper()] + [0] * (len(seq) % 2)
    contig, pos = numbers.get(row["contig"], -1), -1 if row["pos"] is None else row["pos"]
    name = row["read_id"].encode() + b"\0"
    where = bin_of(pos, pos + max(span, 1)) if pos >= 0 and pos + span <= 1 << 29 else 4680
    body = struct.pack("<iiBBHHHiiii", contig, pos, len(name), 255 if row["mapq"] is None else row["mapq"], where, len(ops), row["flag"] or 0,
                       len(seq), -1, -1, 0) + name + b"".join(struct.pack("<I", op) for op, _ in ops)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + b"\xff" * len(seq)
    if row["nm"] is not None:
        body += b"NMi" + struct.pack("<i", row["nm"])
    return struct.pack("<i", len(body)) + body


def block_bytes(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    return (BLOCK_MAGIC + struct.pack("<IBBHccHH", 0, 0, 255, 6, b"B", b"C", 2, len(packed) + 25) + packed
            + struct.pack("<II", zlib.crc32(data), len(data)))


@dataclass
class Written(WriterCommitMessage):
    file: str


class BamWriter(DataSourceArrowWriter):
    """Each task writes one complete file aside; the commit moves the files of the winning tasks."""

    def __init__(self, path: str, contigs: list, overwrite: bool):
        self.path, self.contigs, self.overwrite = path.rstrip("/"), [(str(n), int(size)) for n, size in contigs], overwrite
        self.aside = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator):
        filesystem, folder = pafs.FileSystem.from_uri(self.aside)
        filesystem.create_dir(folder, recursive=True)
        name, numbers = f"part-{uuid.uuid4().hex}.bam", {c: i for i, (c, _) in enumerate(self.contigs)}
        text = ("@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in self.contigs)).encode()
        held = BAM_MAGIC + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.contigs)) + b"".join(
            struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in self.contigs)
        with filesystem.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    held += record_bytes(row, numbers)
                    while len(held) >= BLOCK:
                        out.write(block_bytes(held[:BLOCK]))
                        held = held[BLOCK:]
            out.write((block_bytes(held) if held else b"") + LAST_BLOCK)
        return Written(name)

    def commit(self, messages):
        filesystem, folder = pafs.FileSystem.from_uri(self.path)
        _, aside = pafs.FileSystem.from_uri(self.aside)
        if self.overwrite:
            for old in data_files(self.path, ".bam"):
                filesystem.delete_file(old)
        for message in messages:
            filesystem.move(f"{aside}/{message.file}", f"{folder}/{message.file}")
        self.abort(messages)

    def abort(self, messages):
        filesystem, aside = pafs.FileSystem.from_uri(self.aside)
        if filesystem.get_file_info(aside).type == pafs.FileType.Directory:
            filesystem.delete_dir(aside)


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)`` and ``df.write.format("bam")``.

    Read options: ``split_bytes``, ``bases`` (false leaves seq null), ``regions`` (JSON list of contig, begin, end),
    ``index_only``. Write option: ``contigs`` (JSON list of name, length); rows keep their order within a partition.
    """

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return INDEX_SCHEMA if self.options.get("index_only", "false").lower() == "true" else SCHEMA

    def reader(self, schema):
        files = data_files(self.options["path"], ".bam")
        if not files:
            raise ValueError(f"no .bam files under {self.options['path']}")
        return BamReader(files, schema, dict(self.options))

    def writer(self, schema, overwrite):
        missing = [f.name for f in SCHEMA[:8] if f.name not in schema.names]
        if missing:
            raise ValueError(f"columns missing for an alignment file: {missing}")
        return BamWriter(self.options["path"], json.loads(self.options["contigs"]), overwrite)


def read_bam(spark: SparkSession, path: str, regions: list | None = None, **options) -> DataFrame:
    """Alignments of BAM files; ``pos`` is 0-based, ``aln_end`` is behind the last reference base.

    Files of small blocks are read by many tasks, others whole. With an index, ``regions`` or a filter on contig, pos
    and aln_end reads only the blocks of their bins; with ``regions`` an alignment is given once, however many it meets.
    Without an index ``regions`` are left to the caller's filter, which has to be applied in any case.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    if regions is not None:
        options["regions"] = json.dumps(regions)
    return spark.read.format("bam").options(**options).load(path)


def write_bam(rows: DataFrame, path: str, contigs: list[tuple[str, int]], mode: str = "overwrite") -> None:
    """One file for each partition, sorted by contig (in the order of `contigs`) and position."""
    rows.sparkSession.dataSource.register(BamSource)
    order = F.array_position(F.array(*(F.lit(c) for c, _ in contigs)), F.col("contig"))
    held = rows.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA[:8])).repartitionByRange(order, "pos").sortWithinPartitions(order, "pos")
    held.write.format("bam").mode(mode).option("contigs", json.dumps(contigs)).save(path)
