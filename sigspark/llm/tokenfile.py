"""Token ids in binary files: independent zstandard frames, a document directory and a seek table.

File format (the layout of the public seekable zstandard format, so that any zstandard reader gets all ids):
  data frames          the ids of some whole documents, little-endian unsigned 32-bit
  skippable 184D2A50   directory: zstandard frame of doc_id, n_tokens, frame number (64-bit arrays), then
                       the number of documents and the length of that frame (8 bytes each)
  skippable 184D2A5E   seek table: compressed size, plain size and low 32 bits of XXH64 for each data frame,
                       then number of frames (4), descriptor 80 hex (1) and magic 8F92EAB1 (4)
A reader fetches the tail of a file, then only the frames that hold the documents it wants.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import written
from sigspark.llm.memo import Memo, grouped

#: Plain bytes from which a frame is closed; a longer document has a frame of its own.
FRAME_BYTES = 1 << 18
_DIRECTORY, _SEEK, _FOOT = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_MEMOS: dict[tuple[str, int], Memo] = {}


def chunks(text: bytes) -> list[bytes]:
    """Blank-free pieces of a text, in lower case unless a special token might be spelled in it."""
    return (text if b"<|" in text else text.lower()).split()


def word_memo(path: str, limit: int = 700_000) -> Memo:
    """Encoder of blank-free chunks for a tokenizer that lower-cases and drops white space, kept by the worker.

    The vocabulary's normaliser and splitter never look across ASCII white space, so the ids of a text are
    those of its chunks; nor do they join a letter with the punctuation behind it, so these are
    encoded apart. A word of Latin letters is one piece and goes to the model as it is.
    """
    if (path, limit) in _MEMOS:
        return _MEMOS[path, limit]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    raw_ids = lambda x: array("I", tokenizer.encode(x.decode(), add_special_tokens=False).ids).tobytes()
    # byte-level vocabularies spell bytes without a printable sign by letters from 256 on, in byte order
    hidden = {byte: 256 + i for i, byte in enumerate([*range(33), *range(127, 161), 173])}
    byte_letters = lambda text: text.encode().decode("latin-1").translate(hidden)

    model, latin = tokenizer.model, re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
    ends: dict[bytes, bytes] = {b"": b""}

    def stem_ids(stem: bytes) -> bytes | None:
        if stem.isalpha():  # ASCII letters
            return array("I", [token.id for token in model.tokenize(stem.lower().decode())]).tobytes()
        word = stem.decode().lower()
        return array("I", [token.id for token in model.tokenize(byte_letters(word))]).tobytes() if latin(word) else None

    def known_ids(stem: bytes, end: bytes) -> bytes | None:
        """Ids of a stem that was met alone; behind a letter or digit punctuation is a piece of its own."""
        return memo.known.get(stem) if end and stem[-1:].isalnum() else None

    def encode_many(fresh: list[bytes]) -> list[bytes]:
        out = []
        for x in fresh:
            stem = x.rstrip(b".,!?;:*#$%&|()/\"-")
            end = x[len(stem):]
            if stem and b"<|" not in x and (ids := known_ids(stem, end) or stem_ids(stem)) is not None:
                if end not in ends:
                    if len(ends) > 10_000:
                        ends.clear()
                        ends[b""] = b""
                    ends[end] = raw_ids(end)
                out.append(ids + ends[end])
            else:
                out.append(raw_ids(x))
        return out

    memo = _MEMOS[path, limit] = Memo(encode_many, limit)
    return memo


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


class FrameWriter:
    """Writes documents in order; finish() ends the file."""

    def __init__(self, out: pa.NativeFile, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.held, self.size, self.frames = [], 0, []
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.places: list[int] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        if self.held and self.size + len(ids) > self.frame_bytes:
            self._close()
        self.held.append(ids)
        self.size += len(ids)
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.places.append(len(self.frames))

    def _close(self) -> None:
        plain = b"".join(self.held)
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def finish(self) -> None:
        if self.held:
            self._close()
        head = self.zstd.compress(b"".join(np.array(x, "<i8").tobytes() for x in (self.ids, self.counts, self.places)))
        head += struct.pack("<QQ", len(self.ids), len(head))
        self.out.write(struct.pack("<II", _DIRECTORY, len(head)) + head)
        table = b"".join(struct.pack("<III", *x) for x in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0x80, _FOOT)
        self.out.write(struct.pack("<II", _SEEK, len(table)) + table)


class FrameReader:
    """Directory and seek table of one file; frames are fetched when their documents are asked for."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, end = source, source.size()
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _FOOT:
            raise ValueError("not a token file: no seek table")
        table = end - 9 - 12 * n
        self.seek = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.seek[:, 0]))
        tail = table - 8
        docs, size = struct.unpack("<QQ", self._at(tail - 16, 16))
        self.zstd = zstandard.ZstdDecompressor()
        head = np.frombuffer(self.zstd.decompress(self._at(tail - 16 - size, size)), "<i8").reshape(3, docs)
        self.doc_ids, self.counts, self.places = head

    def _at(self, begin: int, size: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(size)

    def frame(self, number: int) -> bytes:
        packed, plain, check = self.seek[number].tolist()
        data = self.zstd.decompress(self._at(int(self.starts[number]), packed), max_output_size=plain) if plain else b""
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} is damaged: its checksum differs")
        return data

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, tokens of this file before it, ids) of the wanted documents, or of all, in file order."""
        before = np.append(0, np.cumsum(self.counts))
        first = np.searchsorted(self.places, np.arange(len(self.seek)))
        chosen = range(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted)))
        held, data = -1, b""
        for i in chosen:
            if self.places[i] != held:
                held = int(self.places[i])
                data = self.frame(held)
            begin = 4 * int(before[i] - before[first[held]])
            yield int(self.doc_ids[i]), int(before[i]), data[begin:begin + 4 * int(self.counts[i])]


def write_files(docs: DataFrame, folder: str, encoder: Callable[[], Callable[[list[bytes]], list[bytes]]],
                end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts below `folder` in ascending doc_id order and returns the list of files.

    Rows are dealt out by ranges of doc_id; each task writes one file under a name of its own. The list
    (part, path, docs, tokens) is stored as a table and holds only files of tasks that Spark accepted, so a
    repeated or speculative task does no harm: its file is never read.
    A null text is empty. Rows without doc_id are left out, as they have no place in the order. Rows of one
    doc_id are all written, ordered by text. An empty table gives no file.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, writer = encoder(), None, None
        part = TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            if writer is None and ids:
                system, place = _open(folder)
                system.create_dir(place, recursive=True)
                path = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
                out = system.open_output_stream(f"{place}/{path}", compression=None)
                writer = FrameWriter(out)
            at = 0
            for group in grouped([x or b"" for x in texts.to_pylist()]):
                for coded in encode(group):
                    writer.add(ids[at], coded + end)
                    at += 1
        if writer is not None:
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "part": [part], "path": [f"{folder}/{path}"], "docs": [len(writer.ids)], "tokens": [sum(writer.counts)]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(write, "part long, path string, docs long, tokens long"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path) of each document, decoded from the files.

    start counts the ids of all documents before it, over all files in order.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = _open(row["path"])
                with system.open_input_file(place) as source:
                    found = [(d, row["before"] + at, len(ids) // 4, zlib.crc32(ids))
                             for d, at, ids in FrameReader(source).documents()]
                columns = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)]
                columns.append(pa.array([row["path"]] * len(found)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "path"])

    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("path", before.cast("long").alias("before"))  # one row for each file
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def tokenized_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Encodes with a `tokenizers` vocabulary file that drops white space; see write_files."""
    def encoder() -> Callable[[list[bytes]], list[bytes]]:
        memo = word_memo(vocabulary)
        return lambda texts: memo.encode(map(chunks, texts))

    return write_files(docs, folder, encoder, end_id)
