"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is read character by character. Only the positions that a piece of the longest length can still reach
are open; as soon as the best paths to all open positions run through one boundary, the ids up to it are final
and leave the window. Where no piece crosses a boundary at all (a space, or a sign that no piece holds), paths
always converge, so the text between two such places is searched once and its ids are kept by the worker.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.memo import Memo, grouped, uncollected

SPACE = "▁"


@dataclass
class Pieces:
    """What a model file holds, as far as search and decoding need it."""

    ids: dict[str, int]
    scores: dict[str, float]
    names: list[bytes]
    bytes_of: list[int]
    unknown: int
    unknown_score: float
    longest: int
    dummy_prefix: bool = True
    prefixes: set[str] = field(default_factory=set)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, names, byte_ids = {}, {}, [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                names.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unused(i):
                names.append(b"")
            elif model.is_unknown(i):
                names.append(" ⁇ ".encode())
            else:
                ids[piece], scores[piece] = i, model.get_score(i)
                names.append(piece.replace(SPACE, " ").encode())
        prefixes = {piece[:n] for piece in ids for n in range(1, len(piece))}
        dummy = model.encode("a", out_type=str)[0].startswith(SPACE)
        return cls(ids, scores, names, byte_ids if any(byte_ids) else [], model.unk_id(), min(scores.values()) - 10.0,
                   max(map(len, ids)), dummy, prefixes)

    def separators(self) -> str:
        """Signs of which no piece holds one next to another sign, or at all."""
        inner = {c for piece in self.ids if len(piece) > 1 for c in piece}
        return "".join(c for c in map(chr, range(128)) if c not in inner and c != " ")


class Viterbi:
    """Feeds on text and hands out final ids. Equal paths: the one with the longer last piece."""

    def __init__(self, pieces: Pieces, every: int | None = None) -> None:
        self.pieces, self.every = pieces, every or 4 * pieces.longest
        self.text, self.best, self.back, self.known = "", [0.0], [0], [-1]
        self.next = 0  # first position whose pieces have not been looked up

    def feed(self, text: str, last: bool = False) -> list[int]:
        """Ids that became final. Without `last`, positions whose pieces may go on behind the text stay open."""
        pieces, out = self.pieces, []
        self.text += text
        text, best, back, known = self.text, self.best, self.back, self.known
        short = len(text) + 1 - len(best)
        best.extend([0.0] * short)
        back.extend([-1] * short)
        known.extend([-1] * short)
        find, score, prefixes = pieces.ids.get, pieces.scores, pieces.prefixes
        stop = len(text) if last else len(text) - pieces.longest + 1
        at = self.next
        while at < stop:
            single, end, base = False, at + 1, best[at]
            piece = text[at]
            while True:
                number = find(piece)
                if number is not None:
                    value = base + score[piece]
                    if back[end] < 0 or value > best[end]:
                        best[end], back[end], known[end] = value, at, number
                    single |= end == at + 1
                if piece not in prefixes or end >= len(text):
                    break
                piece = text[at:end + 1]
                end += 1
            if not single:
                value = base + pieces.unknown_score
                if back[at + 1] < 0 or value > best[at + 1]:
                    best[at + 1], back[at + 1], known[at + 1] = value, at, -1
            at += 1
            if at >= self.every and at < stop:
                done = self._converged(at)
                if done:
                    out += self._commit(done)
                    at -= done
                    stop -= done
                    text, best, back, known = self.text, self.best, self.back, self.known
        self.next = max(at, 0)
        if last:
            out += self._commit(len(self.text))
            self.next = 0
        return out

    def _converged(self, at: int) -> int:
        """The last boundary that the best paths to all open positions share, `at` being the first of them."""
        back, open_ends = self.back, {at}
        for end in range(at + 1, min(at + self.pieces.longest, len(back))):
            if back[end] >= 0:
                open_ends.add(end)
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.remove(last)
            open_ends.add(back[last])
        return open_ends.pop()

    def _commit(self, end: int) -> list[int]:
        found, at = [], end
        while at > 0:
            begin, number = self.back[at], self.known[at]
            if number >= 0:
                found.append(number)
            elif self.pieces.bytes_of:
                found += [self.pieces.bytes_of[b] for b in reversed(self.text[begin:at].encode())]
            else:
                found.append(self.pieces.unknown)
            at = begin
        base = self.best[end]
        self.text, self.best = self.text[end:], [x - base for x in self.best[end:]]
        self.back = [x - end if x >= 0 else x for x in self.back[end:]]
        self.known = self.known[end:]
        self.back[0] = 0
        return found[::-1]


def encode(text: str, pieces: Pieces, chunk: int = 4096) -> Iterator[int]:
    """Ids of one text, as they become final; the text may come from a stream in chunks."""
    if not text:
        return
    search = Viterbi(pieces)
    text = (SPACE if pieces.dummy_prefix else "") + text.replace(" ", SPACE)
    for at in range(0, len(text), chunk):
        yield from search.feed(text[at:at + chunk], at + chunk >= len(text))


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    data = b"".join(map(pieces.names.__getitem__, ids))
    if pieces.dummy_prefix and data.startswith(b" "):
        data = data[1:]
    return data.decode("utf-8", "replace")


_CODERS: dict[str, tuple[Pieces, Callable[[str], list[str]], Memo]] = {}


def coder(path: str) -> tuple[Pieces, Callable[[str], list[str]], Memo]:
    """Pieces, cutter and memo of a model file, kept by the worker."""
    if path not in _CODERS:
        pieces = Pieces.load(path)
        signs = re.escape(pieces.separators())
        crossing = any(SPACE in piece.lstrip(SPACE) for piece in pieces.ids)
        cut = (lambda text: [text]) if crossing else re.compile(f"[{signs}]| +[^ {signs}]*|[^ {signs}]+").findall

        def encode_many(units: list[str]) -> list[bytes]:
            search, out = Viterbi(pieces), []
            for unit in units:
                out.append(array("I", search.feed(unit.replace(" ", SPACE), True)).tobytes())
            return out

        _CODERS[path] = pieces, cut, Memo(encode_many)
    return _CODERS[path]


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_crc32, same) of every row: ids of the whole text, and whether they decode to it.

    The path with the largest sum of piece scores is taken; signs without a piece are spelled in bytes. A null or
    empty text has no ids. ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit numbers.
    Repeated rows give rows each; other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cut, memo = coder(model)
        names, prefix = pieces.names.__getitem__, " " if pieces.dummy_prefix else ""
        for batch in batches:
            ids = batch.column(0)
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            for group in grouped(texts):
                coded = memo.encode(cut(prefix + x.decode()) if x else [] for x in group)
                with uncollected():
                    same = []
                    for raw, plain in zip(coded, group, strict=True):
                        back = b"".join(map(names, array("I", raw)))
                        same.append((back[1:] if prefix and back else back) == plain)
                sizes = [len(x) // 4 for x in coded]
                offsets = pa.array([0, *_running(sizes)], pa.int32())
                values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(coded))])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(group)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values),
                     pa.array([zlib.crc32(x) for x in coded], pa.int64()), pa.array(same)],
                    ["doc_id", "n_tokens", "ids", "ids_crc32", "same"])
                at += len(group)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, same boolean")


def _running(sizes: list[int]) -> Iterator[int]:
    total = 0
    for size in sizes:
        total += size
        yield total
