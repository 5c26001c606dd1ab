"""Near duplicates by MinHash: banded candidates, sequential Bayesian screening, exact verification.

Texts are compared as sets of distinct word shingles; two are linked if 100 * intersection >= percent * union.
Equal word sequences are one node. A bucket of the banded signatures never gives all of its pairs: its members
are compared with a few pivots, components are contracted, and only pairs of different components that share a
bucket are left for the next step, until none is. So a group of any size costs about a pair for each member,
and no link between components is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm import words
from sigspark.llm.common import components, sorted_runs, written

#: Bands and rows of a band. A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, ROWS = 24, 4
#: Probability below which a candidate may still be similar enough and is dropped all the same.
MISS = 1e-6
#: Signature places compared at a time, and shingles hashed at a time.
STEP, BLOCK = 16, 1 << 15
#: Nodes of a block of a cluster, and tasks that write a table of ids at most.
BLOCK_NODES, TASKS = 1024, 64
#: Rows of ids that go to all tasks, so that the texts they name are found without a shuffle.
NAMED = 1 << 20

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text, and two 64-bit hashes of its whole word sequence."""
    hashes, first = words.word_hashes(column)
    grams = words.shingles(hashes, k)
    sets, marks = [], np.zeros((len(column), 2), np.uint64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= k:
            sets.append(np.unique(grams[a:b - k + 1]))
        else:
            sets.append(words.shingles(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        if b > a:
            own = hashes[a:b] * (np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            marks[i] = np.add.reduce(words.mix(own)), np.add.reduce(words.mix(own ^ _B[0]))
    return sets, marks


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """Signature of each set: the upper 16 bits of the least value under each hash function; 0 for empty sets."""
    out = np.zeros((len(sets), len(_A)), np.uint16)
    sizes = np.array([len(x) for x in sets])
    group: list[int] = []
    held = 0
    for i in range(len(sets) + 1):
        if i < len(sets) and sizes[i]:
            group.append(i)
            held += int(sizes[i])
        if group and (held >= BLOCK or i == len(sets)):
            flat = np.concatenate([sets[j] for j in group])
            starts = np.append(0, np.cumsum(sizes[group])[:-1])
            for h in range(len(_A)):
                out[group, h] = np.minimum.reduceat((flat ^ _B[h]) * _A[h], starts) >> np.uint64(48)
            group, held = [], 0
    return out


def least_matches(n: int, percent: int, miss: float) -> int:
    """Matches among n places below which the similarity reaches the threshold with less than `miss` probability.

    With a flat prior the similarity is distributed as Beta(m + 1, n - m + 1) after m matches, and it is t or
    more with the probability of m or fewer successes in n + 1 trials at t.
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def screened(left: np.ndarray, right: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Marks the pairs of signatures that outlive every step."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for begin in range(0, left.shape[1], STEP):
        end = min(begin + STEP, left.shape[1])
        matches[alive] += (left[alive, begin:end] == right[alive, begin:end]).sum(1)
        alive = alive[matches[alive] >= least_matches(end, percent, miss)]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def signatures(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, mark1, mark2, signature) of every row."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                some = batch.slice(begin, 1000)
                sets, marks = shingle_sets(some.column(1), k)
                signs = minhashes(sets).astype(">u2")
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks[:, 0].view(np.int64)),
                     pa.array(marks[:, 1].view(np.int64)), pa.array([x.tobytes() for x in signs], pa.binary())],
                    ["doc_id", "n_shingles", "mark1", "mark2", "signature"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, mark1 long, mark2 long, signature binary")


def small_side(ids: DataFrame, most: int = NAMED) -> DataFrame:
    """A written table of ids, broadcast in a join if it is small; the wide rows that it meets then stay where they are."""
    return F.broadcast(ids) if ids.count() <= most else ids


def _confirmed(pairs: DataFrame, sides: DataFrame, texts: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Only the texts of pairs that outlive the screening move, those of a once for each pair, those of b once.
    """
    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), ">u2").reshape(batch.num_rows, -1)
                               for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(screened(left, right, percent, miss)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                right_texts = some.column(3).dictionary_encode()  # a pivot stands in many rows
                left, right = shingle_sets(some.column(2), k)[0], shingle_sets(right_texts.dictionary, k)[0]
                held = []
                for x, j in zip(left, right_texts.indices.to_pylist(), strict=True):
                    y = right[j]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    held.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
                yield some.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    alive = written(pairs.join(sides.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
                    .join(sides.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
                    .select("a", "b", "sa", "sb").mapInArrow(screen, "a long, b long").distinct(), "alive")
    few = small_side(alive)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).join(few, "a")
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).join(few, "b", "left_semi")
    full = left.join(right, "b").select("a", "b", "ta", "tb")
    return written(full.mapInArrow(verify, "a long, b long").distinct(), "links")


def _sized(rows: DataFrame, by: str) -> DataFrame:
    """The rows (by, node, own) of groups with several components `own`: their largest one, and the numbers of blocks."""
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK_NODES), F.lit(1)).cast("long")
    sizes = (rows.groupBy(by, "own").agg(F.count("*").alias("n")).groupBy(by)
             .agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("own", F.struct("n", "own")).alias("main")))
    plan = sizes.where("n > most").select(by, "main", blocks(F.col("n")).alias("rows"), blocks(F.col("n") - F.col("most")).alias("columns"))
    return rows.join(plan, by)


def _blocked(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """Rows (g, side, minor, *columns): two nodes of a group, one of them outside of its largest component, share a g.

    Of such a g, rows of side 0 meet those of side 1, which are minor, and rows of side 2 meet each other.
    """
    block = lambda over: F.pmod(F.xxhash64("node"), F.col(over))
    each = lambda over: F.explode(F.sequence(F.lit(0).cast("long"), F.col(over) - 1))
    minor, single = F.col("own") != F.col("main"), (F.col("rows") == 1) & (F.col("columns") == 1)
    chosen = [F.xxhash64(by, "i", "j").alias("g"), "side", minor.alias("minor"), *columns]
    every = rows.withColumn("side", F.when(single, 2).otherwise(0)).withColumn("i", block("rows")).withColumn("j", each("columns")).select(*chosen)
    other = rows.where(minor & ~single).withColumn("side", F.lit(1)).withColumn("j", block("columns")).withColumn("i", each("rows")).select(*chosen)
    return every.union(other)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that pairs (a, b) reach."""
    label = np.arange(n)
    while True:
        least, low = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _alive_edges(held: DataFrame, sides: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b) edges that connect what pairs of different components connect that share a bucket and outlive the screening.

    held: (key, node, own). Only signatures go to the buckets. A task hands on a forest of what it has found, not pairs.
    """
    placed = written(_sized(held, "key"), "mixed")
    rows = _blocked(placed, "key", "node", "own").join(small_side(sides, NAMED >> 3), "node").select("g", "side", "minor", "node", "own", "size", "signature")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = 0

        def found() -> pa.RecordBatch:
            node, signs, one, two = (np.concatenate(c) for c in zip(*held, strict=True))
            starts = np.repeat(np.cumsum([0, *(len(x[0]) for x in held[:-1])]), [len(x[2]) for x in held])
            one, two = one + starts, two + starts
            alive = np.zeros(len(one), bool)
            for begin in range(0, len(one), BLOCK):
                part = slice(begin, begin + BLOCK)
                alive[part] = screened(signs[one[part]], signs[two[part]], percent, miss)
            root = _forest(one[alive], two[alive], len(node))
            child = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root[child]])], ["a", "b"])

        for _, side, minor, node, own, size, signature in sorted_runs(batches):
            right = np.flatnonzero(minor.astype(bool) & (side != 0))
            signs = np.frombuffer(b"".join(signature), ">u2").reshape(len(node), -1)
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in np.flatnonzero(side != 1).tolist():
                maybe = (own[right] != own[i]) & (not minor[i] or node[right] > node[i])
                maybe &= 100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i])
                at = right[maybe]
                one.append(np.full(len(at), i))
                two.append(at)
            held.append((node, signs, np.concatenate(one), np.concatenate(two)))
            waiting += len(held[-1][2]) + len(node)
            if waiting >= 1 << 17:
                yield found()
                held, waiting = [], 0
        if held:
            yield found()

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(edges, "a long, b long").where("a <> b").distinct()


def _rest_of_buckets(members: DataFrame, sides: DataFrame, texts: DataFrame, found: DataFrame, k: int, percent: int,
                     miss: float) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and are similar enough.

    In a bucket, the signatures of nodes outside of its largest component meet those of all nodes. Nodes that pairs
    connect that outlive this are a cluster; in a cluster, the full sets of the nodes outside of its largest component
    meet all. Buckets and clusters are cut into blocks of BLOCK_NODES and compared inside a task, so pairs become rows
    only where they are links. A text goes along once for each block that it meets, and not at all if no other one comes
    near it, so chance meetings in buckets, which connect ever more nodes of a larger table, move no texts. The sets are
    those by which links are confirmed, so of the links of a node to one component any is as good as all.
    """
    held = (members.select("key", "node").join(found, "node", "left")
            .select("key", "node", F.coalesce("component", "node").alias("own")))
    clusters = components(_alive_edges(held, sides, percent, miss), "clusters")
    own = clusters.join(found.withColumnRenamed("component", "own"), "node", "left").select(
        F.col("component").alias("cluster"), "node", F.coalesce("own", "node").alias("own"))
    placed = written(_sized(own, "cluster").join(sides.select("node", "signature"), "node").coalesce(TASKS), "placed")
    placed = texts.join(small_side(placed, NAMED >> 3), "node")  # with signatures, so fewer

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, side, minor, node, own, signature, text in sorted_runs(batches):
            signs = np.frombuffer(b"".join(signature), ">u2").reshape(len(node), BANDS, ROWS)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(minor.astype(bool) & (side != 0))
            if not len(left) or not len(right):
                continue
            sets = shingle_sets(pa.array(text, pa.string()), k)[0]
            sizes = np.array([len(x) for x in sets])
            names, place = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(sizes)
            flat = np.concatenate([place[ends[j] - sizes[j]:ends[j]] for j in right])
            starts = np.append(0, np.cumsum(sizes[right])[:-1])
            present, one, two = np.zeros(len(names), bool), [], []
            for i in left:
                mine = place[ends[i] - sizes[i]:ends[i]]
                maybe = (own[right] != own[i]) & ((minor[i] == 0) | (node[right] > node[i]))
                small, large = np.minimum(sizes[right], sizes[i]), np.maximum(sizes[right], sizes[i])
                at = np.flatnonzero(maybe & (100 * small >= percent * large))
                at = at[(signs[right[at]] == signs[i]).all(axis=2).any(axis=1)]
                if not len(at):
                    continue
                at = at[screened(np.broadcast_to(signs[i].reshape(-1), (len(at), BANDS * ROWS)), signs[right[at]].reshape(len(at), -1), percent, miss)]
                if not len(at):
                    continue
                present[mine] = True
                both, total = np.add.reduceat(present[flat].astype(np.int64), starts)[at], sizes[i] + sizes[right[at]]
                present[mine] = False
                at = at[100 * both >= percent * (total - both)]
                at = at[np.unique(own[right[at]], return_index=True)[1]]  # a link joins two components, so one is enough
                one += [node[i]] * len(at)
                two += node[right[at]].tolist()
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], ["a", "b"])

    groups = _blocked(placed, "cluster", "node", "own", "signature", "text").repartition("g").sortWithinPartitions("g")
    return groups.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    A component holds the documents that links of `percent` % similarity reach; its id is its smallest doc_id,
    and that document is kept. Words are runs without white space, with A-Z in lower case. A text of fewer than k
    words is one shingle; a text that is null or without words has none and is linked with nothing. Rows without
    doc_id are linked with nothing: their component is null and they are kept. Rows that repeat a doc_id are one
    document that links what any of its texts links. Other columns are not looked at.
    """
    signed = written(signatures(docs, k, doc_id, text), "signatures")
    nodes = written(signed.where("n_shingles > 0 and doc_id is not null").groupBy("mark1", "mark2")
                    .agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("size"), F.any_value("signature").alias("signature")), "nodes")
    width = 2 * ROWS
    keys = nodes.select("node", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda band: F.xxhash64(band, F.substring("signature", band * width + 1, F.lit(width))))).alias("key"))
    order = lambda seed: F.min_by("node", F.xxhash64("node", F.lit(seed)))
    bucket = Window.partitionBy("key")
    members = keys.repartition("key").select("key", "node", F.min("node").over(bucket).alias("p0"), order(1).over(bucket).alias("p1"),
                          order(2).over(bucket).alias("p2"), F.count("*").over(bucket).alias("n"))
    members = written(members.where("n > 1").drop("n"), "members")
    shared = written(members.select("node").distinct().coalesce(TASKS), "shared")
    few = small_side(shared)
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = written(texts.join(few, "node", "left_semi"), "texts")
    sides = written(nodes.select("node", "size", "signature").join(few, "node", "left_semi"), "sides")
    confirm = lambda pairs: _confirmed(pairs, sides, texts, k, percent, miss)

    first = written(members.where("node <> p0").groupBy("node").agg(F.min("p0").alias("b"))
                    .select(F.col("node").alias("a"), "b"), "pairs")
    links = confirm(first)
    found = components(links)
    stars = (members.select("node", F.explode(F.array("p0", "p1", "p2")).alias("p")).where("node <> p")
             .select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b")).distinct())
    named = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    second = written(stars.join(named, "a", "left").join(other, "b", "left")
                     .where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b").join(first, ["a", "b"], "left_anti"), "pairs")
    links = links.union(confirm(second))
    found = components(links)
    rest = _rest_of_buckets(members, sides, texts, found, k, percent, miss).join(first.union(second), ["a", "b"], "left_anti")
    placed = written(signed.drop("signature").join(nodes.select("mark1", "mark2", "node"), ["mark1", "mark2"], "left"), "placed")
    several = placed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most")
    same = placed.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")  # texts of one doc_id
    found = components(links.union(confirm(rest)).union(same))
    named = placed.join(found, "node", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"),
                        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
