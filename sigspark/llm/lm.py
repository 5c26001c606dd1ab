"""LM scoring with a log-frequency Bloom filter of n-gram counts.

A count c is kept as its level q, the place of c among the powers of BASE, by putting the n-gram into the filter
together with each of 1..q. Probes with 1, 2, .. until the first miss give the level back; it is never too small. The
filter is cut into segments by the hash of the n-gram, sized by what each holds, so its bits for an entry, and with
them its errors, are the same at every size. It is broadcast if it fits FILTER_BYTES; else n-grams are asked for where
their segment lies, as the exact counts of words always are, and both ways give equal scores.

The probability of a token w after h is (low(hw) + MU * p(w)) / (high(h) + MU), where low and high are the bounds of a
level (the exact count for a history of one word), and p(w) that of the shorter history, at last (c(w) + 1) / (N + V + 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm import words
from sigspark.llm.common import packed, unpacked, written

#: Words of an n-gram, growth of a level, weight of the shorter history.
ORDER, BASE, MU = 2, 1.5, 100.0
#: Bits of the filter for each n-gram and level in it, and probes for one.
BITS, PROBES = 12, 8
#: Largest filter that is broadcast; words that can be frequent enough to be broadcast with their counts.
FILTER_BYTES, HOT = 128 << 20, 1 << 18
#: Bytes of text for each segment of the counts, for each block of documents, and of one step.
SEGMENT_BYTES, BLOCK_BYTES, STEP_BYTES = 16 << 20, 4 << 20, 4 << 20
#: Keys that are looked up at a time where they lie.
ASKED = 1 << 17
#: Stand for the end of a text, and for what precedes it.
LAST, BEFORE = np.uint64(0x1D3A5C7E9B2F4681), np.uint64(0x6F0E2D4C8B1A3957)
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Smallest count of each level.
FLOORS = np.unique(np.ceil(BASE ** np.arange(106)).astype(np.uint64)).astype(np.int64)

WORDS, SEGMENT, ASKED_WORDS, ASKED_GRAMS = range(4)


def level(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(FLOORS, count, "right")


def low(levels: np.ndarray) -> np.ndarray:
    """Smallest count of a level; 0 for none."""
    return np.append(0, FLOORS)[levels].astype(np.float64)


def high(levels: np.ndarray) -> np.ndarray:
    """Largest count of a level; 0 for none."""
    return np.append(0, np.append(FLOORS[1:] - 1, np.iinfo(np.int64).max))[levels].astype(np.float64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and where each text begins (len + 1 numbers)."""
    hashes, first = words.word_hashes(column)
    begin = first + np.arange(len(first))
    out = np.full(begin[-1], LAST, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = hashes
    return out, begin


def _shifted(values: np.ndarray, place: np.ndarray, by: int) -> np.ndarray:
    """What stands `by` places earlier in the same text."""
    out = np.full(len(values), BEFORE, np.uint64)
    out[by:] = np.where(place[by:] >= by, values[:max(len(values) - by, 0)], BEFORE)
    return out


def grams(values: np.ndarray, begin: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of 2 to `order` words that end at each token."""
    place = np.arange(len(values)) - np.repeat(begin[:-1], np.diff(begin))
    out = []
    for k in range(2, order + 1):
        held = _shifted(values, place, k - 1)
        for by in range(k - 2, -1, -1):
            held = words.mix(held * _ODD + _shifted(values, place, by))
        out.append(held & ~np.uint64(0xFF))  # fewer bytes to move
    return out


def _places(keys: np.ndarray, at: int, bits: np.ndarray, some: slice = slice(0, PROBES)) -> Iterator[np.ndarray]:
    """The PROBES places of each key with level `at` in a segment of so many bits, or some of them."""
    one = words.mix(keys + np.uint64(at * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
    step = words.mix(one) | np.uint64(1)
    for i in range(PROBES)[some]:
        yield ((one + np.uint64(i) * step) % bits).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray, each: int = BITS) -> bytes:
    """The bits of a segment that holds the levels of these counts."""
    levels = level(counts)
    bits = np.uint64(max(64, -(-int(levels.sum()) * each // 8) * 8))
    out = np.zeros(int(bits), bool)
    for at in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(keys[levels >= at], at, bits):
            out[place] = True
    return np.packbits(out).tobytes()


class Filter(NamedTuple):
    """Segments in one array: their first byte, number of bits, and the bits of a hash that do not choose the segment."""

    data: np.ndarray
    first: np.ndarray
    bits: np.ndarray
    shift: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        own = (keys >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(keys), np.int64)
        out, left, at = np.zeros(len(keys), np.int64), np.flatnonzero(self.bits[own] > 0), 0
        while len(left):
            at += 1
            for some in (slice(0, 2), slice(2, PROBES)):  # most of those that miss do so at once
                bits, first = self.bits[own[left]], self.first[own[left]]
                hit = np.ones(len(left), bool)
                for place in _places(keys[left], at, bits, some):
                    hit &= (self.data[first + (place >> 3)] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                left = left[hit]
            out[left] = at
        return out


class Model(NamedTuple):
    """Counts and filter segments as a table, totals, frequent words with their counts, and the filter if it is small."""

    table: DataFrame
    shift: int
    order: int
    total: int
    distinct: int
    texts: int
    hot: Broadcast
    filter: Broadcast | None


def _text(docs: DataFrame, text: str) -> Any:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _steps(batch: pa.RecordBatch, column: int, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(size // step)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > begin:
            yield batch.slice(begin, end - begin)


def _kind(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, kind, np.int32)), *batch.columns[1:]],
                                      ["share", "kind", "n", "data"])


def _share(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)


_SHARE_ROWS = "share long, kind int, n long, data binary"
#: What answers hold: counts of words, levels of n-grams.
_VALUES = {ASKED_WORDS: np.dtype(np.int64), ASKED_GRAMS: np.dtype(np.uint8)}


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct keys of lists of distinct keys, in order."""
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The stretches of equal values of the first column."""
    first = batch.column(0).to_numpy()
    cuts = (np.flatnonzero(first[1:] != first[:-1]) + 1).tolist()
    for begin, end in zip([0, *cuts], [*cuts, len(first)], strict=True):
        if end > begin:
            yield int(first[begin]), batch.slice(begin, end - begin)


def _pressed(values: np.ndarray, kind: np.dtype) -> bytes:
    """The bytes of values by significance, compressed."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), -1)
    return pa.Codec("zstd", compression_level=1).compress(planes.T.tobytes(), asbytes=True)


def _plain(data: bytes, n: int, kind: np.dtype) -> np.ndarray:
    flat = np.frombuffer(pa.Codec("zstd").decompress(data, n * kind.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).view(kind).ravel()


def fit(docs: DataFrame, text: str = "text", order: int = ORDER, filter_bytes: int = FILTER_BYTES, bits: int = BITS) -> Model:
    """Counts the words and n-grams of whole texts; a text ends with one more token, and a null text is empty."""
    spark = docs.sparkSession
    rows = docs.select(_text(docs, text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = 64 - max(5, (size // SEGMENT_BYTES).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _steps(batch, 0, 2 * STEP_BYTES):
                values, begin = tokens(some.column(0))
                for kind, keys in ((WORDS, [values]), (SEGMENT, grams(values, begin, order))):
                    if keys:
                        key, n = np.unique(np.concatenate(keys), return_counts=True)
                        yield _kind(packed(_share(key, shift), [key.view(np.int64), n.astype(np.int64)]), kind)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def close(of: tuple) -> pa.RecordBatch:
            key, n = (np.concatenate(c) for c in zip(*held.pop(of), strict=True))
            key, inverse = np.unique(key.view(np.uint64), return_inverse=True)
            n = np.bincount(inverse.ravel(), n).astype(np.int64)
            share, kind = of
            if kind == WORDS:
                data = packed(np.zeros(len(key), np.int64), [key.view(np.int64), n]).column(2)[0].as_py()
                values = [share, kind, len(key), data, int(n.sum()), len(key), int(n[key == LAST].sum())]
            else:
                data = segment(key, n, bits)
                values = [share, kind, len(data), data, 0, 0, 0]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["share", "kind", "n", "data", "total", "distinct", "texts"]
        for batch in batches:
            for share, kind, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (share, kind) not in held:
                    yield close(next(iter(held)))
                held.setdefault((share, kind), []).append(unpacked(n, data, (np.int64, np.int64)))
        if held:
            yield close(next(iter(held)))

    counts = rows.mapInArrow(count, _SHARE_ROWS).repartition("share").sortWithinPartitions("share", "kind")
    table = written(counts.mapInArrow(tally, _SHARE_ROWS + ", total long, distinct long, texts long"), "counts")
    total, distinct, texts, filter_size = table.agg(
        F.sum("total"), F.sum("distinct"), F.sum("texts"), F.sum(F.when(F.col("kind") == SEGMENT, F.col("n")).otherwise(0))).first()
    table, total = table.select("share", "kind", "n", "data"), total or 0

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, count = unpacked(n, data, (np.int64, np.int64))
                often = count * HOT >= total  # of at most HOT words this holds
                yield pa.RecordBatch.from_arrays([pa.array(key[often]), pa.array(count[often])], ["key", "n"])

    often = table.where(F.col("kind") == WORDS).select("n", "data").mapInArrow(frequent, "key long, n long").toArrow()
    key, n = (often.column(i).to_numpy().astype(kind) for i, kind in ((0, np.int64), (1, np.int64)))
    by_key = np.argsort(key.view(np.uint64))
    hot = spark.sparkContext.broadcast((key.view(np.uint64)[by_key], n[by_key]))
    small = None
    if (filter_size or 0) <= filter_bytes:
        parts = table.where(F.col("kind") == SEGMENT).select("share", "data").toArrow()
        sizes = np.zeros(1 << (64 - shift), np.int64)
        share = parts.column(0).to_numpy()
        data = dict(zip(share.tolist(), parts.column(1), strict=True))
        for i in data:
            sizes[i] = len(data[i].as_buffer())
        flat = np.concatenate([np.frombuffer(data[i].as_buffer(), np.uint8) for i in sorted(data)]) if data else np.zeros(0, np.uint8)
        small = spark.sparkContext.broadcast(Filter(flat, np.cumsum(sizes) - sizes, (sizes * 8).astype(np.uint64), shift))
    return Model(table, shift, order, total, distinct or 0, texts or 0, hot, small)


def _found(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of keys in a sorted list, -1 for others."""
    if not len(known):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], -1)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, `keep`, n_tokens, n_known, base_score, score) of every row.

    base_score is the sum of log10((c + 1) / (N + V + 1)) of the tokens of a text, its end included, score the log10
    probability of the text by the n-grams. A null or empty text has the end as its only token. Without any training
    text all counts are 0. Repeated rows are scored alike; a null doc_id is kept.
    """
    shift, order, filter_on, hot = model.shift, model.order, model.filter, model.hot
    total, distinct, texts = model.total, model.distinct, model.texts
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, _text(docs, text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = BLOCK_BYTES if filter_on is None else BLOCK_BYTES // 2  # beside a filter, with few keys to ask for
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // block_bytes + 1)).alias("block"), "*")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                key = _distinct(parts)
                if len(key):
                    part = _kind(packed(_share(key, shift), [key.view(np.int64)]), kind)
                    yield part.append_column("block", pa.array(np.full(part.num_rows, at)))

        at, held = None, {}
        for batch in batches:
            for block, some in _runs(batch):
                if block != at:
                    yield from close()
                    at, held = block, {}
                for step in _steps(some, 1):
                    values, begin = tokens(step.column(1))
                    key = np.unique(values)
                    asked = [(ASKED_WORDS, key[_found(key, *hot.value) < 0])]
                    if filter_on is None:
                        asked += [(ASKED_GRAMS, np.unique(key)) for key in grams(values, begin, order)]
                    for kind, key in asked:
                        parts = held.setdefault(kind, [])
                        parts.append(key)
                        if sum(map(len, parts)) > 2 * max(len(parts[0]), 1 << 20):
                            parts[:] = [_distinct(parts)]
        yield from close()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[pa.RecordBatch]:
            for kind in (ASKED_WORDS, ASKED_GRAMS):
                blocks, keys = [x[1] for x in held if x[0] == kind], [x[2] for x in held if x[0] == kind]
                if not keys:
                    continue
                key = np.concatenate(keys)
                value = np.maximum(_found(key, *known), 0) if kind == ASKED_WORDS else one.levels(key) if one else np.zeros(len(key), np.int64)
                parts = np.split(value, np.cumsum([len(x) for x in keys])[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), pa.array(np.full(len(keys), at)), pa.array(np.full(len(keys), kind, np.int32)), pa.array([len(x) for x in keys], pa.int64()),
                     pa.array([_pressed(x, _VALUES[kind]) for x in parts], pa.binary())], ["block", "share", "kind", "n", "data"])

        at, known, one, held, waiting = None, (), None, [], 0
        for batch in batches:
            for share, kind, n, data, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if share != at or waiting >= ASKED:
                    yield from given()
                    held, waiting = [], 0
                if share != at:
                    at, known, one = share, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), None
                if kind == WORDS:
                    key, count = unpacked(n, data, (np.int64, np.int64))
                    known = key.view(np.uint64), count
                elif kind == SEGMENT:
                    one = Filter(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([n * 8], np.uint64), 64)
                else:
                    held.append((kind, block, unpacked(n, data, (np.int64,))[0].view(np.uint64)))
                    waiting += n
        yield from given()

    # equal keys, in the same order, are found again in a block where it is scored, so answers hold values alone
    asked = rows.select("block", "text").repartition("block").sortWithinPartitions("block").mapInArrow(ask, _SHARE_ROWS + ", block long")
    tables = model.table if filter_on is None else model.table.where(F.col("kind") == WORDS)
    answers = tables.withColumn("block", F.lit(None).cast("long")).union(asked).repartition("share").sortWithinPartitions("share", "kind")
    answers = written(answers.mapInArrow(answer, "block long, share long, kind int, n long, data binary"), "answers")
    fields = [rows.schema[name] for name in ("doc_id", *keep)]
    none = [F.lit(0).cast(kind).alias(name) for name, kind in (("share", "long"), ("kind", "int"), ("n", "long"))]
    both = rows.select("block", *none, F.col("text").cast("binary").alias("data"), *(f.name for f in fields)).unionByName(
        answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block")
    names = [f.name for f in fields]
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens long", "n_known long", "base_score double", "score double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            texts = pa.chunked_array([text for text, _ in held]).unify_dictionaries()  # repeated rows share a block
            found = measures(texts.chunk(0).dictionary.cast(pa.string()), given)
            for (_, columns), of in zip(held, texts.chunks, strict=True):
                of = of.indices.to_numpy()
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c[of]) for c in found)], [*names, "n_tokens", "n_known", "base_score", "score"])

        at, held, given = None, [], []
        for batch in batches:
            for block, some in _runs(batch):
                if block != at:
                    yield from close()
                    at, held, given = block, [], []
                is_text = pc.equal(some.column(3), 0)
                part = some.filter(is_text)
                if part.num_rows:
                    held.append((part.column(4).dictionary_encode(), part.columns[5:]))
                given += zip(*(c.to_pylist() for c in some.filter(pc.invert(is_text)).columns[1:5]), strict=True)
        yield from close()

    def answered(given: list[tuple], kind: int, n: int) -> np.ndarray:
        parts = [_plain(data, size, _VALUES[kind]) for _, of, size, data in sorted(given, key=lambda x: x[0]) if of == kind]
        out = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        if len(out) != n:
            raise ValueError(f"{len(out)} answers to {n} keys of a block")
        return out

    def measures(column: pa.Array, given: list[tuple]) -> tuple[np.ndarray, ...]:
        values, begin = tokens(column)
        key, inverse = np.unique(values, return_inverse=True)
        count = _found(key, *hot.value)
        rare = np.flatnonzero(count < 0)
        count[rare] = answered(given, ASKED_WORDS, len(rare))
        count = count[inverse.ravel()].astype(np.float64)
        single = (count + 1) / (total + distinct + 1)
        p, history = single, np.full(len(count), float(texts))
        inner = np.ones(len(count), bool)
        inner[begin[:-1]] = False
        history[inner] = count[np.flatnonzero(inner) - 1]
        longer = grams(values, begin, order)
        del key, inverse, values
        if filter_on is None and longer:
            every = _distinct([np.unique(keys) for keys in longer])
            every_level = answered(given, ASKED_GRAMS, len(every))
        for keys in longer:
            key, inverse = np.unique(keys, return_inverse=True)
            if filter_on is not None:
                levels = filter_on.value.levels(key)
            else:
                levels = every_level if len(longer) == 1 else every_level[np.searchsorted(every, key)]
            levels = levels[inverse.ravel()]
            p = (np.minimum(low(levels), history) + MU * p) / (history + MU)
            history = np.full(len(count), float(texts))
            history[inner] = high(levels)[np.flatnonzero(inner) - 1]
        sums = lambda x: np.add.reduceat(x, begin[:-1]) if len(begin) > 1 else np.zeros(0, x.dtype)
        return np.diff(begin).astype(np.int64), sums((count > 0).astype(np.int64)), sums(np.log10(single)), sums(np.log10(p))

    return both.mapInArrow(score, kind)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by those whose crc32 of doc_id is not 2 modulo 7; a null doc_id is not held out."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    model = fit(rows.where("not held_out"))
    return scored(rows, model, keep=("held_out",)).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
