"""Benchmark decontamination by spaced seeds.

A mask keeps some of the words of a window and ignores the others, so that a hash of the kept words still meets
when ignored words were replaced. The masks are such that one of them fits into every overlap, wherever its replaced
words stand. Hashes of the benchmark and of the documents are joined; every hit is a
diagonal on which benchmark item and document are compared word by word, replaced words included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm import words

#: Words that an overlap must span, and the share of them that must be equal.
OVERLAP, EQUAL = 13, 0.8
#: Seeds of the benchmark that are held at once; a larger benchmark is passed in slices of that size.
SLICE = 1 << 20


def masks(least: int, share: float) -> tuple[str, ...]:
    """Masks of which one fits into every overlap of at least `least` words with `share` of them equal.

    With r words replaced, the n - r others stand in r + 1 runs at most, so one has (n - r) / (r + 1) words or more,
    rounded up. Let g be the least of these over all n. Where it is g only if all runs have exactly g words, two
    such runs with a word between fit or a run has g + 1.
    """
    runs = []
    for n in range(least, least + 64 * (int(1 / max(1 - share, 1e-2)) + 1)):  # from there on it doesn't fall again
        r = int((1 - share) * n + 1e-6)
        runs.append((-(-(n - r) // (r + 1)), r, n - r))
    g = max(min(run for run, _, _ in runs), 1)
    if all(r and equal == g * (r + 1) for run, r, equal in runs if run <= g):
        return "1" * (g + 1), "1" * g + "0" + "1" * g
    return ("1" * g,)


def _kept(mask: str) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == ord("1"))


def seeds(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the kept words of the window at each place; short ends have none."""
    n = max(len(hashes) - len(mask) + 1, 0)
    out = np.full(n, (number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for place in _kept(mask):
        out = (out ^ hashes[place:place + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return words.mix(out)


def overlap(equal: np.ndarray, least: int, share: float) -> tuple[int, int] | None:
    """The longest stretch of at least `least` places with at least `share` of them equal, ends equal.

    With v = equal - share, a stretch qualifies if its sum is not negative: from each equal place it runs to the
    last equal place at which the running sum is as high as before the first.
    """
    if len(equal) < least or not equal.any():
        return None
    total = np.append(0.0, np.cumsum(equal - share)) + 1e-9 * np.arange(len(equal) + 1)
    high = np.maximum.accumulate(np.where(equal, total[1:], -np.inf)[::-1])[::-1]
    begins = np.flatnonzero(equal)
    ends = np.searchsorted(-high, -total[begins], "right")
    at = int((ends - begins).argmax())
    begin, end = int(begins[at]), int(ends[at])
    return (begin, end) if end - begin >= least else None


class Items:
    """Word hashes of benchmark items and a table from seeds to (item, place)."""

    def __init__(self, ids: list[int], texts: list[str], kinds: tuple[str, ...]) -> None:
        hashes, first = words.word_hashes(pa.array(texts, pa.string()))
        self.ids, self.words = ids, [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        found = [(seeds(own, mask, m), i) for i, own in enumerate(self.words) for m, mask in enumerate(kinds)]
        keys = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(x), i) for x, i in found]) if found else np.zeros(0, int)
        place = np.concatenate([np.arange(len(x)) for x, _ in found]) if found else np.zeros(0, int)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[order], owner[order], place[order]
        self.bits = max(16, int(len(keys) * 16).bit_length())
        self.mask = np.zeros(1 << self.bits, bool)
        self.mask[self.keys >> np.uint64(64 - self.bits)] = True

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in keys, place in the table) of every equal pair."""
        maybe = np.flatnonzero(self.mask[keys >> np.uint64(64 - self.bits)])
        low, high = np.searchsorted(self.keys, keys[maybe], "left"), np.searchsorted(self.keys, keys[maybe], "right")
        n = high - low
        return np.repeat(maybe, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _slices(benchmark: DataFrame, item_id: str, text: str, kinds: tuple[str, ...]) -> Iterator[Items]:
    """The items in slices of about SLICE seeds, streamed to the driver one after the other."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).where(
        F.col(item_id).isNotNull() & F.col(text).isNotNull()).distinct()
    for row in rows.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        held += len(kinds) * (row[1].count(" ") + 1)
        if held >= SLICE:
            yield Items(ids, texts, kinds)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts, kinds)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = OVERLAP, share: float = EQUAL, doc_id: str = "doc_id",
                 text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_equal, item_first_word) of the longest overlap of each document and item.

    Words are runs without white space, A-Z in lower case. An overlap spans at least `least` words of both texts on
    one diagonal, ends in equal words, and `share` of its words are equal; words that were replaced count as unequal.
    Items of fewer words than `least` have no overlap; nor have null texts. Rows that repeat a doc_id give rows each.
    The benchmark is taken in slices of bounded size, with one pass over the documents for each, so the result
    doesn't depend on its size. No documents move.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark, out, kinds = docs.sparkSession, None, masks(least, share)
    kind = "doc_id long, item_id long, first_word int, n_words int, n_equal int, item_first_word int"
    names = [part.split()[0] for part in kind.split(", ")]

    def finder(held):  # noqa: ANN001, ANN202
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items: Items = held.value
            for batch in batches:
                rows: list[tuple] = []
                for begin in range(0, batch.num_rows, 500):
                    some = batch.slice(begin, 500)
                    hashes, first = words.word_hashes(some.column(1))
                    ids, diagonals = some.column(0).to_pylist(), set()
                    for m, mask in enumerate(kinds):
                        at, place = items.hits(seeds(hashes, mask, m))
                        doc = np.searchsorted(first, at, "right") - 1
                        inside = at + len(mask) <= first[doc + 1]
                        at, place, doc = at[inside], place[inside], doc[inside]
                        shift = at - first[doc] - items.place[place]
                        diagonals.update(zip(doc.tolist(), items.owner[place].tolist(), shift.tolist(), strict=True))
                    best: dict[tuple[int, int], tuple] = {}
                    for d, i, shift in sorted(diagonals):
                        own, item = hashes[first[d]:first[d + 1]], items.words[i]
                        low, high = max(0, -shift), min(len(item), len(own) - shift)
                        equal = own[low + shift:high + shift] == item[low:high]
                        if (span := overlap(equal, least, share)) is not None:
                            a, b = span
                            row = (b - a, int(equal[a:b].sum()), -(low + shift + a), -(low + a))
                            best[d, i] = max(best.get((d, i), row), row)
                    rows += [(ids[d], items.ids[i], -x[2], x[0], x[1], -x[3]) for (d, i), x in best.items()]
                columns = [*zip(*rows, strict=True)] if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if j < 2 else pa.int32()) for j, c in enumerate(columns)], names)
        return find

    for items in _slices(benchmark, item_id, item_text, kinds):
        found = docs.mapInArrow(finder(spark.sparkContext.broadcast(items)), kind)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], kind) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an overlap with the benchmark, all columns as they are."""
    hits = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)
