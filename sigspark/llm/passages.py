"""Substring dedup: passages that stand in more than one place, small changes included.

Seeds are hashes of K words of a mask at every place, so that a passage with every fifth word replaced still shares
some. They move packed, many in a row. Each seed is tied to its owner, the smallest doc_id that has it, and not to all
documents that have it, so a passage of any frequency costs a pair for each place. The matches of a document with an
owner are chained in order of both texts, gaps at a cost, by a Fenwick tree; the words of a chain are aligned and cut
into stretches that are equal enough, and what these cover together counts as repeated if it is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm import words
from sigspark.llm.common import packed, sorted_runs, unpacked, written
from sigspark.llm.decontam import overlap

#: Places of a seed, of which the ones are compared.
MASK = "1111011"
_KEPT = [i for i, kept in enumerate(MASK) if kept == "1"]
#: Words of a seed, cost of a word between two seeds (on either side), words beside a chain that are tried at first.
K, GAP, MARGIN = len(_KEPT), 0.15, 64
#: The worth of a seed and the cost of a word in whole hundredths, so that sums are exact.
WORTH, COST = 100 * K, round(100 * GAP)
#: Places of a run of seeds of which one is chained; least bits of the share of a seed or document; bytes of text sown at
#: once, and bytes of text for which there is a share. A task packs a row for each share, so few shares make few, dense rows.
THIN, SHARES, SOWN = 8, 8, 1 << 22
#: The parts of a seed that move with it, 40 bits. As shares follow the input, a seed meets a different one of equal bits
#: with a probability below 1e-6 at every size; the words decide.
LOW = (np.uint32, np.uint8)
#: Words of a repeated passage, of one aligned stretch in it, words between two stretches, least share of equal words.
PASSAGE, STRETCH, BETWEEN, EQUAL = 50, 12, 6, 0.8
#: Pairs of a document and an owner that are taken at once, and matches that are packed together.
PAIRS, MET = 2048, 1 << 18
#: Equal words that every seed begins with; words of a stretch between two diagonals that is aligned in full.
RUN, LONG = MASK.index("0"), 200


def seeds(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, seed) of all places of all texts from which a seed lies within one text."""
    n = max(len(hashes) - len(MASK) + 1, 0)
    out = np.zeros(n, np.uint64)
    for at in _KEPT:
        out = (out ^ hashes[at:at + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    place = np.flatnonzero(words.within(first, len(MASK), len(hashes)))
    return place, words.mix(out[place])


def met(seed: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, other, place, place in other) of the matches of seeds: the first place in each text with the owner of the
    seed and with the document before it that has the seed, every further place with the first one of the same text.

    The second match finds what two documents share although the owner of each of its seeds has them scattered."""
    order = np.argsort(seed)
    same = seed[order][1:] == seed[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    order = order[np.lexsort((place[order], row[order], doc[order], seed[order]))]
    seed, doc, row, place = seed[order], doc[order], row[order], place[order]
    fresh = np.ones(len(seed), bool)
    fresh[1:] = seed[1:] != seed[:-1]
    head = fresh.copy()
    head[1:] |= (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])
    spread = lambda marks: np.maximum.accumulate(np.where(marks, np.arange(len(marks)), 0))
    target = np.where(head, spread(fresh), spread(head)) if len(seed) else order
    keep = ~head | (doc != doc[target])
    heads = np.flatnonzero(head)
    before = np.append(heads[:1], heads[:-1])  # of one seed, as the owner comes first
    near = keep[heads] & ~fresh[heads] & ~fresh[before] & (doc[heads] != doc[before])
    at, to = np.append(np.flatnonzero(keep), heads[near]), np.append(target[keep], before[near])
    return doc[at], doc[to], place[at], place[to]


def thinned(x: np.ndarray, y: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Marks the matches of each pair of texts that are enough for chains: of equal seeds side by side, as in a repeated word, one for each K
    places; of a run on one diagonal the first, the last and one for each THIN places."""
    out = np.ones(len(x), bool)
    for line, at, ends in ((y, x, False), (x - y, x, True)):
        left = np.flatnonzero(out)
        order = left[np.lexsort((at[left], line[left], pair[left]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(pair[order]) != 0) | (np.diff(line[order]) != 0) | (np.diff(at[order]) > (K if ends else 1))
        begin = at[order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        step = (at[order] - begin) // (THIN if ends else K)
        keep = fresh.copy()
        keep[1:] |= np.diff(step) != 0
        if ends:
            keep |= np.append(fresh[1:], True)
        out[order] = keep
    return out


def chains(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Chains of matches (x, y) that rise in both, the best first; each match is in one chain at most.

    A match counts K, and c * (dx + dy) is lost between two. As f(i) + c * (x + y) splits the cost, the best
    predecessor is a maximum over all smaller y, which a Fenwick tree over the ranks of y holds. x must not fall.
    """
    ranks = np.unique(y, return_inverse=True)[1].ravel() + 1
    n, top = len(x), int(ranks.max())
    value, holder = [-1e18] * (top + 1), [-1] * (top + 1)
    score, before = [0] * n, [-1] * n
    xs, ys, rank = x.tolist(), y.tolist(), ranks.tolist()
    at = 0
    while at < n:
        to = at
        while to < n and xs[to] == xs[at]:  # equal x: looked up before any is put in
            best, who, r = -1e18, -1, rank[to] - 1
            while r > 0:
                if value[r] > best:
                    best, who = value[r], holder[r]
                r -= r & -r
            gain = best - COST * (xs[to] + ys[to])
            score[to] = WORTH + max(gain, 0)
            before[to] = who if gain > 0 else -1
            to += 1
        for i in range(at, to):
            v, r = score[i] + COST * (xs[i] + ys[i]), rank[i]
            while r <= top:
                if v > value[r]:
                    value[r], holder[r] = v, i
                r += r & -r
        at = to
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda j: (-score[j], j)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def _grown(equal: np.ndarray) -> int:
    """Places to go on: the best sum of 1 for an equal word and -2 for another."""
    total = np.cumsum(np.where(equal, 1, -2))
    return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0


def _between(a: np.ndarray, b: np.ndarray, x: int, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns (place in a, place in b, equal) of two stretches from x and y on, aligned by their longest common
    subsequence; words that are not in it stand over each other. Of long stretches only both ends are compared, as no
    seed lies between them."""
    n, m = len(a), len(b)
    if n == m and (n > LONG or int((a == b).sum()) * 2 >= n):
        return x + np.arange(n), y + np.arange(n), a == b
    if max(n, m) > LONG:
        half = min(n, m, LONG) // 2
        middle, both = max(n, m) - 2 * half, np.arange(half)
        place = lambda begin, size: np.concatenate([begin + both, begin + half + np.minimum(np.arange(middle), size - 2 * half), begin + size - half + both])
        equal = np.concatenate([a[:half] == b[:half], np.zeros(middle, bool), a[n - half:] == b[m - half:]])
        return place(x, n), place(y, m), equal
    table = np.zeros((n + 1, m + 1), np.int16)
    for i, word in enumerate(a):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (b == word)))
    pairs, i, j = [(n, m)], n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    left, right, equal, i, j = [], [], [], 0, 0
    for p, q in pairs[::-1]:
        wide = max(p - i, q - j)
        left += [min(i + k, p) for k in range(wide)]
        right += [min(j + k, q) for k in range(wide)]
        equal += [False] * wide
        if (p, q) != (n, m):
            left.append(p)
            right.append(q)
            equal.append(True)
        i, j = p + 1, q + 1
    return x + np.array(left, np.int64), y + np.array(right, np.int64), np.array(equal, bool)


def columns(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, equal, of a seed) of each column of the alignment along a chain with seeds at x and y.

    Seeds on one diagonal are compared on it, what lies between two diagonals is aligned, and both ends go on along
    their diagonal as far as a and b reach. The places have one more entry, behind the last column.
    """
    turns = np.flatnonzero(np.diff(x - y)) + 1
    n = min(int(x[0]), int(y[0]))
    i, j = int(x[0]) - n, int(y[0]) - n
    parts = [(i + np.arange(n), j + np.arange(n), a[i:i + n] == b[j:j + n], np.zeros(n, bool))]
    i, j = i + n, j + n
    for begin, end in zip([0, *turns.tolist()], [*turns.tolist(), len(x)], strict=True):
        p, q, size = int(x[begin]), int(y[begin]), int(x[end - 1] - x[begin]) + RUN
        late = max(i - p, j - q, 0)  # the seed overlaps what stands before it
        if late >= size:
            continue
        p, q, size = p + late, q + late, size - late
        if p > i or q > j:
            gap = _between(a[i:p], b[j:q], i, j)
            parts.append((*gap, np.zeros(len(gap[0]), bool)))
        seed = np.zeros(size, bool)
        for at in (x[begin:end] - p).tolist():
            seed[max(at, 0):max(at + RUN, 0)] = True
        parts.append((p + np.arange(size), q + np.arange(size), a[p:p + size] == b[q:q + size], seed))
        i, j = p + size, q + size
    m = min(len(a) - i, len(b) - j)
    parts.append((i + np.arange(m + 1), j + np.arange(m + 1), np.append(a[i:i + m] == b[j:j + m], False), np.zeros(m + 1, bool)))
    left, right, equal, seed = (np.concatenate(part) for part in zip(*parts, strict=True))
    return left, right, equal[:-1], seed[:-1]


def stretches(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(begin in a, end, begin in b, end, equal words) of the stretches of a chain of which EQUAL is equal.

    That is the whole chain if it holds, else the longest stretch of its alignment, then the longest on each side of
    that, and so on; so text between two passages does not take them along. Ends beyond the seeds are left out as far
    as they hold less than two equal words of three, unless the stretch needs them to be a passage.
    """
    left, right, equal, seed = columns(a, b, x, y)

    def tight(begin: int, end: int) -> tuple[int, int]:
        held = np.flatnonzero(seed[begin:end])
        if not len(held):
            return begin, end
        low, high = begin + int(held[0]), begin + int(held[-1]) + 1
        return low - _grown(equal[begin:low][::-1]), high + _grown(equal[high:end])

    def measured(begin: int, end: int) -> tuple[int, int, int, int, int]:
        return int(left[begin]), int(left[end]), int(right[begin]), int(right[end]), int(equal[begin:end].sum())

    a0, a1, b0, b1, n = whole = measured(*tight(0, len(equal)))
    holds = a1 - a0 >= STRETCH and n >= EQUAL * max(a1 - a0, b1 - b0)
    if holds and a1 - a0 >= PASSAGE:
        return [whole]
    out, open_parts = [], [(0, len(equal))]
    while open_parts:
        begin, end = open_parts.pop()
        if (span := overlap(equal[begin:end], STRETCH, EQUAL)) is None:
            continue
        wide = begin + span[0], begin + span[1]
        low, high = tight(*wide)
        if left[high] - left[low] < PASSAGE <= left[wide[1]] - left[wide[0]]:
            low, high = wide
        a0, a1, b0, b1, n = found = measured(low, high)
        if a1 - a0 >= STRETCH and n >= EQUAL * max(a1 - a0, b1 - b0):
            out.append(found)
        open_parts += [(begin, low), (high, end)]
    if holds and all(a1 - a0 < PASSAGE for a0, a1, *_ in out):
        return [whole]
    return out


def along(equal: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """stretches() of a chain whose seeds lie in [low, high) of a diagonal, if it is one: (begin, end, equal words).

    That is so if the chain holds as a whole and either is a passage or no part of the diagonal can be one.
    """
    begin, end = low - _grown(equal[:low][::-1]), high + _grown(equal[high:])
    n, size = int(np.count_nonzero(equal[begin:end])), end - begin
    holds = size >= STRETCH and n >= EQUAL * size
    return (begin, end, n) if holds and (size >= PASSAGE or np.count_nonzero(equal) < EQUAL * PASSAGE) else None


def long_cover(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marks the stretches whose cover, gaps of up to BETWEEN words bridged, is at least PASSAGE words long."""
    order = np.argsort(begin, kind="stable")
    reach = np.maximum.accumulate(end[order])
    fresh = np.append(True, begin[order][1:] > reach[:-1] + BETWEEN)
    group = np.cumsum(fresh) - 1
    size = np.maximum.reduceat(end[order], np.flatnonzero(fresh)) - begin[order][fresh]
    out = np.zeros(len(begin), bool)
    out[order] = size[group] >= PASSAGE
    return out


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of what the stretches cover together."""
    order = np.argsort(begin, kind="stable")
    reach = np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, begin[order][1:] > reach[:-1]))
    return begin[order][first], np.maximum.reduceat(end[order], first)


def _unpacked(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[list[np.ndarray]]:
    """The columns of each share, for packed rows that are sorted by it."""
    for _, counts, data in sorted_runs(batches):
        parts = [unpacked(n, row, kinds) for n, row in zip(counts.tolist(), data, strict=True)]
        yield [np.concatenate(part) for part in zip(*parts, strict=True)]


def straight(x: list[int]) -> list[list[int]]:
    """chains() of matches on one diagonal with rising places: the best predecessor of a match is the one before it."""
    score, linked = [WORTH], [False]
    for before, place in zip(x, x[1:], strict=False):
        gain = score[-1] - 2 * COST * (place - before)
        linked.append(gain > 0)
        score.append(WORTH + max(gain, 0))
    if all(linked[1:]) and max(score) == score[-1]:
        return [list(range(len(x)))]
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda j: (-score[j], j)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = i - 1 if linked[i] else -1
        if chain:
            out.append(chain[::-1])
    return out


def chained(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Chains of the matches of two texts, sorted by x and y."""
    steps = np.diff(x)
    if (steps == np.diff(y)).all() and (steps > 0).all():
        return [np.array(found) for found in straight(x.tolist())]
    return chains(x, y)


def one_chain(x: np.ndarray, y: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Marks the pairs, of matches from `begin` on, that are one chain for sure: on one diagonal, each match nearer to
    the one before it than its worth."""
    steps = np.diff(x)
    near = np.append(True, (steps == np.diff(y)) & (steps > 0) & (2 * COST * steps < WORTH))
    near[begin] = True
    return np.logical_and.reduceat(near, begin) if len(begin) else near[:0]


def _flat(places: np.ndarray, width: np.ndarray) -> np.ndarray:
    """place, place + 1, .. of each place, so many as its width."""
    ends = np.cumsum(width)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(places - (ends - width), width)


def may_hold(equal: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Marks the runs of words, of so many each, in which a stretch may lie.

    A stretch of STRETCH words or more has a part of fewer than twice as many of which EQUAL is equal, as one of its
    halves has; and no window of STRETCH words in such a part has more unequal words than the part.
    """
    sums, ends = np.append(0, np.cumsum(equal)), np.cumsum(width)
    out = np.zeros(len(width), bool)
    run = np.repeat(np.arange(len(width)), width)
    at = np.flatnonzero(np.arange(len(equal)) + STRETCH <= ends[run])
    most = 2 * STRETCH - 1 - int(np.ceil(EQUAL * (2 * STRETCH - 1)))
    out[run[at[sums[at + STRETCH] - sums[at] >= STRETCH - most]]] = True
    at = np.flatnonzero(out[run])
    out[:] = False
    for size in range(STRETCH, 2 * STRETCH):
        at = at[at + size <= ends[run[at]]]
        held = at[sums[at + size] - sums[at] >= EQUAL * size]
        out[run[held]] = True
        at = at[~out[run[at]]]
    return out


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cover: bool = False) -> DataFrame:
    """(doc_id, first_word, n_words, other_id, other_first_word, n_equal) of every repeated stretch.

    A stretch of doc_id is repeated in other_id, a smaller doc_id, or earlier in the same text (then other_id is
    doc_id). Listed are stretches of at least STRETCH words, EQUAL of them equal, that are part of a cover of at least
    PASSAGE words. Words are runs without white space, A-Z in lower case. Null and short texts have none, nor have
    rows without doc_id. With `cover`, the words that the listed stretches of a document cover together are given
    instead, as (doc_id, first_word, n_words). Rows that repeat a doc_id are taken as one document with several texts: they are compared
    with the others, not with each other.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = np.uint64(64 - max(SHARES, (size // SOWN).bit_length()))

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40  # tells apart the texts of a doc_id that is repeated
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(size // SOWN)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                some = batch.slice(begin, end - begin)
                hashes, first = words.word_hashes(some.column(1))
                place, seed = seeds(hashes, first)
                doc = np.searchsorted(first, place, "right") - 1
                ids = some.column(0).to_numpy(zero_copy_only=False)[doc]
                low = [seed.astype(LOW[0]), (seed >> np.uint64(32)).astype(LOW[1])]
                yield packed(seed >> shift, [*low, ids, number + doc, (place - first[doc]).astype(np.int32)])
                number += some.num_rows

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def pack() -> pa.RecordBatch:
            doc, other, place, other_place = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return packed(words.mix(doc.view(np.uint64)) >> shift, [doc, other, place, other_place])

        for low, high, doc, row, place in _unpacked(batches, (*LOW, np.int64, np.int64, np.int32)):
            found = met(low.astype(np.int64) | high.astype(np.int64) << 32, doc, row, place)
            for begin in range(0, len(found[0]), MET):
                held.append(tuple(c[begin:begin + MET] for c in found))
                if sum(len(part[0]) for part in held) >= MET:  # the matches of many shares, so that packed rows are not small
                    yield pack()
        if held:
            yield pack()

    kind = "share long, n long, data binary"
    sown = rows.mapInArrow(sow, kind).repartition("share").sortWithinPartitions("share")
    matches = sown.mapInArrow(meet, kind).repartition("share").sortWithinPartitions("share")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, others, place, other_place in _unpacked(batches, (np.int64, np.int64, np.int32, np.int32)):
            order = np.lexsort((other_place, place, others, ids))
            ids, others, place, other_place = ids[order], others[order], place[order], other_place[order]
            pair = np.cumsum(np.append(False, (np.diff(others) != 0) | (np.diff(ids) != 0))[:len(ids)])
            enough = thinned(place, other_place, pair)
            ids, others, place, other_place, pair = ids[enough], others[enough], place[enough], other_place[enough], pair[enough]
            begin = np.flatnonzero(np.append(True, np.diff(pair) != 0)[:len(ids)])
            end = np.append(begin[1:], len(ids))[:len(begin)]
            simple = one_chain(place, other_place, begin)
            for low in range(0, len(begin), PAIRS):
                pairs = slice(low, min(low + PAIRS, len(begin)))
                counts, chosen, sizes, done = np.ones(pairs.stop - low, np.int64), [], [], low
                for c in [*(low + np.flatnonzero(~simple[pairs])).tolist(), pairs.stop]:
                    if c > done:  # pairs of one chain
                        chosen.append(np.arange(begin[done], end[c - 1]))
                        sizes.append(end[done:c] - begin[done:c])
                    if c < pairs.stop:
                        found = chained(place[begin[c]:end[c]], other_place[begin[c]:end[c]])
                        chosen += [begin[c] + own for own in found]
                        sizes.append(np.array([*map(len, found)]))
                        counts[c - low] = len(found)
                    done = c + 1
                sizes = np.concatenate(sizes)
                at = np.concatenate(chosen)
                outer = np.append(0, np.cumsum(counts)).astype(np.int32)
                inner = np.append(0, np.cumsum(sizes)).astype(np.int32)[outer]
                lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[begin[pairs]]), pa.array(others[begin[pairs]]), lists(outer, np.array(sizes, np.int32)),
                     lists(inner, place[at]), lists(inner, other_place[at])], ["doc_id", "other_id", "sizes", "x", "y"])

    #: One row for each document and owner, whatever the number of their chains.
    found = written(matches.mapInArrow(chain, "doc_id long, other_id long, sizes array<int>, x array<int>, y array<int>"), "chains")
    sides = found.select(F.xxhash64("doc_id", "other_id").alias("pair"), "*")
    wanted = sides.select("pair", F.col("doc_id").alias("of"), F.lit(0).alias("side"), "sizes", "x").union(
        sides.select("pair", F.col("other_id"), F.lit(1), "sizes", "y"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words that the chains of a side need, each stretch of the text once: (begin, number of words) and the words."""
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                texts = some.column(4).dictionary_encode()  # an owner stands in many rows
                hashes, first = words.word_hashes(texts.dictionary)
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                sizes = some.column(2).flatten().to_numpy()
                last = np.cumsum(sizes) - 1
                places, ends = some.column(3).flatten().to_numpy(), np.cumsum(np.diff(some.column(2).offsets.to_numpy())).tolist()
                low, high = np.maximum(places[last - sizes + 1] - MARGIN, 0), places[last] + K + MARGIN
                parts, starts, lengths, at = [], [], [], 0
                for i, end in zip(texts.indices.to_pylist(), ends, strict=True):
                    text_at, n = (int(first[i]), int(first[i + 1] - first[i])) if i is not None else (0, 0)
                    p, q = (low[at:end], high[at:end]) if end - at == 1 else merged(low[at:end], high[at:end])
                    p, at = p.tolist(), end
                    q = [max(min(b, n), a) for a, b in zip(p, q.tolist(), strict=True)]
                    starts.append(p)
                    lengths.append([b - a for a, b in zip(p, q, strict=True)])
                    parts.append(b"".join([short[text_at + a:text_at + b].tobytes() for a, b in zip(p, q, strict=True)]))
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(starts, kind), pa.array(lengths, kind), pa.array(parts, pa.binary())],
                                                 ["pair", "side", "starts", "lengths", "words"])

    cuts = (wanted.join(rows, wanted["of"] == rows["doc_id"]).select("pair", "side", "sizes", "x", "text")
            .mapInArrow(cut, "pair long, side int, starts array<int>, lengths array<int>, words binary"))
    both = sides
    cuts = written(cuts, "regions")
    for side, name in ((0, "a"), (1, "b")):
        both = both.join(cuts.where(F.col("side") == side).select("pair", F.struct("starts", "lengths", "words").alias(name)), "pair")
    both = both.select("doc_id", "other_id", "sizes", "x", "y", *(F.col(f"{name}.{part}").alias(f"{name}_{part}") for name in "ab" for part in ("starts", "lengths", "words")))

    def located(batch: pa.RecordBatch, places: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray, column: int) -> tuple[np.ndarray, ...]:
        """(words of all rows, begin of the region of each chain among them, its words, its first place in the text)."""
        starts, lengths = batch.column(column), batch.column(column + 1)
        offsets = starts.offsets.to_numpy() - starts.offsets[0].as_py()
        start, length = starts.flatten().to_numpy().astype(np.int64), lengths.flatten().to_numpy().astype(np.int64)
        begin = np.cumsum(length) - length  # the words of all rows lie behind each other
        flat = np.frombuffer(b"".join(batch.column(column + 2).to_pylist()), np.uint32)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        step = np.int64(1) << 40  # tells apart the rows
        low = np.maximum(places[first] - MARGIN, 0)
        at = np.searchsorted(of * step + start, row * step + low, "right") - 1
        inside = low - start[at]
        size = np.minimum(places[last] + K + MARGIN - low, length[at] - inside)
        return flat, begin[at] + inside, size, low

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, PAIRS):
                yield aligned(whole.slice(low, PAIRS))

    def aligned(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, others = (batch.column(i).to_numpy() for i in (0, 1))
        counts = np.diff(batch.column(2).offsets.to_numpy())
        sizes = batch.column(2).flatten().to_numpy().astype(np.int64)
        x, y = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (3, 4))
        row, last = np.repeat(np.arange(batch.num_rows), counts), np.cumsum(sizes) - 1
        first = last - sizes + 1
        a, a_at, a_size, a_low = located(batch, x, first, last, row, 5)
        b, b_at, b_size, b_low = located(batch, y, first, last, row, 8)
        ok = (a_size >= x[last] - a_low + K) & (b_size >= y[last] - b_low + K)  # else of another text with this doc_id
        turns = np.append(0, np.cumsum(np.append(False, np.diff(x - y) != 0)))
        single = ok & (turns[last + 1] == turns[first + 1])
        # all words along the diagonal of the chains that have one, at once
        lone = np.flatnonzero(single)
        back = np.minimum(x[first] - a_low, y[first] - b_low)[lone]
        span = (x[last] - x[first] + RUN)[lone]
        i, j = (x[first] - a_low)[lone] - back, (y[first] - b_low)[lone] - back
        width = np.minimum(a_size[lone] - i, b_size[lone] - j)
        width = np.maximum(width, back + span)
        equal = a[np.minimum(_flat(a_at[lone] + i, width), len(a) - 1)] == b[np.minimum(_flat(b_at[lone] + j, width), len(b) - 1)]
        todo = ok & ~single
        ends, found = np.cumsum(width), []
        for c in np.flatnonzero(may_hold(equal, width)).tolist():
            chain, own = lone[c], equal[ends[c] - width[c]:ends[c]]
            if (span_ := along(own, int(back[c]), int(back[c] + span[c]))) is None:
                todo[chain] = True
                continue
            begin, end, n = span_
            found.append((docs[row[chain]], a_low[chain] + i[c] + begin, end - begin, others[row[chain]], b_low[chain] + j[c] + begin, n))
        for c in np.flatnonzero(todo).tolist():
            own, other = a[a_at[c]:a_at[c] + a_size[c]], b[b_at[c]:b_at[c] + b_size[c]]
            places = slice(first[c], last[c] + 1)
            found += [(docs[row[c]], a0 + a_low[c], a1 - a0, others[row[c]], b0 + b_low[c], n)
                      for a0, a1, b0, b1, n in stretches(own, other, x[places] - a_low[c], y[places] - b_low[c])]
        held = [*zip(*found, strict=True)] if found else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names)

    names = ["doc_id", "first_word", "n_words", "other_id", "other_first_word", "n_equal"]
    kind = ", ".join(f"{name} long" for name in names)
    def align_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only what covers the texts: the stretches of many pairs in a row for each share, so their number makes no rows."""
        for batch in align(batches):
            doc, first, n = (c.to_numpy() for c in batch.columns[:3])
            if len(doc):
                yield packed(words.mix(doc.view(np.uint64)) >> shift, [doc, first, n])

    def covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, first, n in _unpacked(batches, (np.int64, np.int64, np.int64)):
            order = np.argsort(doc, kind="stable")
            doc, first, n = doc[order], first[order], n[order]
            cuts, found = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), []
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=True):
                begin, end = first[low:high], first[low:high] + n[low:high]
                if (keep := long_cover(begin, end)).any():
                    begin, end = merged(begin[keep], end[keep])
                    found.append((np.full(len(begin), doc[low]), begin, end - begin))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names[:3])

    if cover:
        return (both.mapInArrow(align_packed, "share long, n long, data binary").repartition("share").sortWithinPartitions("share")
                .mapInArrow(covers, ", ".join(f"{name} long" for name in names[:3])))

    def long_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in sorted_runs(batches):
            keep = long_cover(columns[1], columns[1] + columns[2])
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names)

    return both.mapInArrow(align, kind).distinct().repartition("doc_id").sortWithinPartitions("doc_id", "first_word", "n_words", "other_id").mapInArrow(
        long_ones, kind)


def without_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated stretches cut out of the texts; n_chars, if there, follows the text.

    A text of which only white space is left goes with its row, as all of it stands elsewhere.
    """
    spans = passages.groupBy(F.col("doc_id").alias("_of")).agg(F.array_sort(F.collect_set(F.struct("first_word", "n_words"))).alias("_spans"))
    held = docs.join(spans, F.col(doc_id) == F.col("_of"), "left").drop("_of")
    place, at = held.columns.index(text), held.columns.index("_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(place).cast(pa.binary()).to_pylist(), batch.column(at).to_pylist()
            for i in (i for i, x in enumerate(spans) if x and texts[i]):
                _, _, begin, end = words.word_hashes(pa.array([texts[i].decode()]), spans=True)
                out, reach = [], 0
                for span in spans[i]:
                    low, high = span["first_word"], span["first_word"] + span["n_words"]
                    if low < len(begin) and begin[low] > reach:
                        out.append(texts[i][reach:begin[low]])
                    reach = max(reach, int(end[min(high, len(end)) - 1]))
                out.append(texts[i][reach:])
                texts[i] = b"".join(out)
            columns = [pa.array([None if x is None else x.decode() for x in texts], pa.string()) if j == place else c
                       for j, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = held.mapInArrow(cut, held.schema)
    blank = F.col("_spans").isNotNull() & F.col(text).rlike(r"^[ \t-\r]*$")
    out = out.where(~blank)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
