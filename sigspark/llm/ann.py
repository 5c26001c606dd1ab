"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are taken at length 1, where the nearest by angle are the nearest by distance. A table cuts space into cells
by k projections on Gaussian directions, shifted and divided by a width. A query visits its own cell and the cells
around it in the order of their estimated chance of success: moving by one along a projection costs the squared
distance to that border, and sets of moves are enumerated by rising total cost. Candidates of all tables are merged
and ranked by the exact measure on the original vectors.

Equal vectors are one entry of the index. Cells are packed into groups of bounded size, a large cell into several,
and queries meet them in blocks; a block hands on every candidate that could still be among a query's nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import written

#: Tables, cells visited in each, and the cell width for projections of standard deviation 1.
TABLES, PROBES, WIDTH = 16, 150, 4.0
#: Index entries of a group, and what single precision may be off. A query gets n + 1 candidates or few more from
#: each group that it visits; these are as many as its visited cells at most, however large the index is.
GROUP, SLACK = 16_384, 1e-5


def projections(n: int) -> int:
    """Projections of a table: about half a one more for each doubling of the index."""
    return max(4, round(20 + log2(max(n, 1) / 10_000) / 2))


class Family:
    """The hash functions of all tables, made from a seed."""

    def __init__(self, dimension: int, k: int, tables: int = TABLES, width: float = WIDTH, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        self.directions = random.normal(size=(tables, dimension, k)) / width
        self.shifts = random.random((tables, k))
        self.mixers = random.integers(1, 1 << 62, (tables, k), dtype=np.int64) * 2 + 1

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return vectors @ self.directions[table] + self.shifts[table]

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        """One number for each cell; two cells of equal number only share their candidates."""
        with np.errstate(over="ignore"):
            return (cells * self.mixers[table]).sum(axis=-1) ^ np.int64(table * 0x1E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF)


def moves(place: np.ndarray, probes: int) -> np.ndarray:
    """(probes, k) moves by -1, 0 or 1 from the cell of a place, the most promising first."""
    inside = place - np.floor(place)
    cost = np.concatenate([inside ** 2, (1 - inside) ** 2])
    order = np.argsort(cost, kind="stable")
    costs, k = cost[order].tolist(), len(place)
    axis, step = (order % k).tolist(), np.where(order < k, -1, 1).tolist()
    out = np.zeros((probes, k), np.int64)
    total = lambda chosen: sum(sorted(costs[i] for i in chosen))  # noqa: E731  (equal sets of costs give equal sums)
    heap, found = [(costs[0], (0,))], 1
    while heap and found < probes:
        _, chosen = heapq.heappop(heap)
        if len({axis[i] for i in chosen}) == len(chosen):
            for i in chosen:
                out[found, axis[i]] = step[i]
            found += 1
        last = chosen[-1]
        if last + 1 < len(costs):
            for after in ((*chosen[:-1], last + 1), (*chosen, last + 1)):
                heapq.heappush(heap, (total(after), after))
    out = out[:found]
    spent = np.zeros(found)
    for i in range(k):  # in the order of the axes, which moves of equal cost may round in their own ways
        spent += np.where(out[:, i] < 0, cost[i], np.where(out[:, i] > 0, cost[k + i], 0.0))
    return out[np.argsort(spent, kind="stable")]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) with v as doubles, without nulls, zero vectors and null or non-finite components."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).distinct()


def nearest(vectors: DataFrame, n: int = 5, every: int = 50, tables: int = TABLES, probes: int = PROBES,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the n nearest found by cosine for each vec_id that `every` divides.

    Nearest first, equal scores by smaller vec_id; a query's own row is no candidate. Vectors that are null, zero or
    hold null or non-finite components take no part, nor do those of another length than most. A vec_id with
    several vectors is a candidate with each, and is listed with the nearest one. An empty table has no queries.
    A query that meets fewer than n + 1 entries in all of its cells is compared with every entry, in blocks, so each
    query has n rows, or as many as there are candidates.
    """
    spark, out_kind = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, vec_id, embedding)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], out_kind)
    dimension = length["d"]
    rows = rows.where(F.size("v") == dimension)
    # of equal vectors only the first n + 1 ids can be among the nearest of any query
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = written(rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= n + 1).groupBy("v").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v"), "vectors")
    asked = written(rows.where(F.col("vec_id") % every == 0).join(entries.select("v", "rep"), "v")
                    .select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    count = entries.count()
    family = Family(dimension, projections(count), tables)
    shared = spark.sparkContext.broadcast(family)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_vectors(batch.column(1)))
            single = [x.tobytes() for x in unit.astype("<f4")]
            for t in range(tables):
                keys = family.keys(np.floor(family.places(unit, t)).astype(np.int64), t)
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0), pa.array(single, pa.binary())],
                                                 ["key", "rep", "unit"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                some = batch.slice(begin, 64)
                unit, reps, found, owners = _unit(_vectors(some.column(1))), some.column(0).to_pylist(), [], []
                for t in range(tables):
                    for rep, place in zip(reps, family.places(unit, t), strict=True):
                        around = np.floor(place).astype(np.int64) + moves(place, probes)
                        found.append(family.keys(around, t))
                        owners += [rep] * len(around)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(owners, pa.int64())], ["key", "query"])

    index = written(entries.select("rep", "v").mapInArrow(cells, "key long, rep long, unit binary"), "cells")
    queries = asked.select("rep").distinct().join(entries.select("rep", "v"), "rep")
    visited = written(queries.select("rep", "v").mapInArrow(visits, "key long, query long").distinct(), "visits")
    groups = max(1, ceil(count * tables / GROUP))
    filled = index.groupBy("key").agg(F.ceil(F.count("*") / (GROUP / 2)).cast("int").alias("parts"))
    visited_cells = visited.groupBy("key").agg(F.ceil(F.count("*") / (GROUP / 2)).cast("int").alias("blocks"))
    plan = written(filled.join(visited_cells, "key"), "plan")
    spread = lambda column, over: F.pmod(F.xxhash64(column), F.col(over).cast("long"))
    every_one = lambda over: F.explode(F.sequence(F.lit(0).cast("long"), F.col(over).cast("long") - 1))
    group = F.pmod(F.xxhash64("key", "part", "block"), F.lit(groups)).alias("g")
    left = (index.join(plan, "key").withColumn("part", spread("rep", "parts")).withColumn("block", every_one("blocks"))
            .select(group, F.xxhash64("key", "part", "block").alias("cell"), "rep", "unit"))
    right = (visited.join(plan, "key").withColumn("block", spread("query", "blocks")).withColumn("part", every_one("parts"))
             .select(group, F.xxhash64("key", "part", "block").alias("cell"), "query"))
    left = left.select("g", "cell", "rep", "unit")
    right = right.groupBy("g", "query").agg(F.collect_list("cell").alias("cells")).join(
        queries.select(F.col("rep").alias("query"), "v"), "query").select("g", "query", "cells", "v")

    def meet(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(asked):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "near": np.zeros(0)})
        order = np.argsort(entries["cell"].to_numpy(), kind="stable")
        cell, rep = entries["cell"].to_numpy()[order], entries["rep"].to_numpy()[order]
        unit = np.frombuffer(b"".join(entries["unit"].to_numpy()[order]), "<f4").reshape(len(entries), -1)
        out = []
        for query, cells, v in zip(asked["query"], asked["cells"], asked["v"], strict=True):
            low, high = np.searchsorted(cell, cells, "left"), np.searchsorted(cell, cells, "right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
            near = unit[at] @ _unit(np.asarray(v, float)[None])[0].astype("<f4")
            reps, where = np.unique(rep[at], return_index=True)
            near = near[where]
            if len(near) > n + 1:
                keep = near >= np.partition(near, -(n + 1))[-(n + 1)] - SLACK
                reps, near = reps[keep], near[keep]
            out.append(pd.DataFrame({"query": query, "rep": reps, "near": near.astype(float)}))
        return pd.concat(out)

    meeting = "query long, rep long, near double"
    found = left.groupBy("g").cogroup(right.groupBy("g")).applyInPandas(meet, meeting)
    found = written(found.groupBy("query", "rep").agg(F.max("near").alias("near")), "found")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                single = [x.tobytes() for x in _unit(_vectors(batch.column(1))).astype("<f4")]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(single, pa.binary())], ["rep", "unit"])

    seen = found.groupBy("query").agg(F.count("*").alias("seen"))
    short = queries.select(F.col("rep").alias("query"), "v").join(seen, "query", "left").where(F.coalesce("seen", F.lit(0)) < min(n + 1, count))
    short = written(short.select("query", "v"), "short")
    if missing := short.count():
        parts, blocks = ceil(count / GROUP), ceil(missing / GROUP)
        each = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
        own = lambda column, many: F.pmod(F.xxhash64(column), F.lit(many).cast("long"))
        block, nowhere = F.xxhash64("part", "block").alias("g"), F.lit(0).cast("long")
        left = (entries.select("rep", "v").mapInArrow(units, "rep long, unit binary").withColumn("part", own("rep", parts))
                .withColumn("block", each(blocks)).select(block, nowhere.alias("cell"), "rep", "unit"))
        right = (short.withColumn("block", own("query", blocks)).withColumn("part", each(parts))
                 .select(block, "query", F.array(nowhere).alias("cells"), "v"))
        found = found.union(left.groupBy("g").cogroup(right.groupBy("g")).applyInPandas(meet, meeting)).groupBy("query", "rep").agg(
            F.max("near").alias("near"))
    ranked = Window.partitionBy("query").orderBy(F.desc("near"))
    bar = F.coalesce(F.nth_value("near", n + 1).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(-2.0))
    found = found.withColumn("bar", bar).where(F.col("near") >= F.col("bar") - SLACK).select("query", "rep")
    pairs = (found.join(entries.select("rep", "ids", F.col("v").alias("b")), "rep")
             .join(entries.select(F.col("rep").alias("query"), F.col("v").alias("a")), "query").select("query", "ids", "a", "b"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _vectors(batch.column(2)), _vectors(batch.column(3))
                a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
                score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query", "ids", "score"])

    scored = pairs.mapInArrow(measure, "query long, ids array<long>, score double")
    # the first n + 1 different ids of a query vector serve all queries that have it
    single = scored.select("query", F.explode("ids").alias("vec_id"), "score").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    single = single.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n + 1)
    lists = single.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return (asked.join(lists, asked["rep"] == lists["query"])
            .select("query_id", F.posexplode(F.slice(own, 1, n)).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    F.col("x.score").alias("score")))
