"""What the operators share: the shared folder, written tables, components of a graph of links."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links that one task of a round takes.
TASK_ROWS = 500_000

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, as the cluster names it.

    Only a session of one process may leave it unset; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="sigspark-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors take nothing along."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every linked node; the component is the smallest node that can be reached.

    links: (a, b) pairs of comparable, non-null nodes. Every round hangs each node below the smallest
    neighbour (large star, then small star), which leaves stars after about log(n) rounds. A node of
    any degree is reduced by partial minima before it moves; no group is collected.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a <> b").distinct(), name)
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, tasks = now, now[0] // TASK_ROWS + 8  # few links need few tasks
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).coalesce(tasks)
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        least = large.groupBy("a").agg(F.min("b").alias("least")).coalesce(tasks)
        small = (large.join(least, "a")
                 .select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"),
                         F.col("least").alias("b")).where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        edges = written(small, name)
    return written(edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), name)


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of the rows of each value of the first column, for batches that are sorted by it."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
        cuts = (np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1).tolist()
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            part = [c[begin:end] for c in columns]
            if held and held[-1][0][0] != part[0][0]:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def packed(key: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row (key, n, data) for each key: the entries of each column as differences, their bytes by significance, compressed."""
    codec, order = pa.Codec("zstd", compression_level=1), np.argsort(key, kind="stable")
    key = key[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(key)) + 1
    begin, end = np.append(0, cuts)[:len(key)], np.append(cuts, len(key))[:len(key)]
    planes = []
    for column in columns:
        flat = column[order]
        steps = np.diff(flat, prepend=flat[:1])
        steps[begin] = flat[begin]
        planes.append(steps.view(np.uint8).reshape(len(steps), -1))
    planes = np.concatenate(planes, axis=1)
    data = [codec.compress(planes[i:j].T.tobytes(), asbytes=True) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(key[begin]), pa.array(end - begin, pa.int64()), pa.array(data, pa.binary())], ["key", "n", "data"])


def unpacked(n: int, data: bytes, kinds: tuple) -> list[np.ndarray]:
    """The columns of one packed row."""
    sizes, out, at = [np.dtype(kind).itemsize for kind in kinds], [], 0
    flat = np.frombuffer(pa.Codec("zstd").decompress(data, n * sum(sizes), asbytes=True), np.uint8).reshape(sum(sizes), n)
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.cumsum(np.ascontiguousarray(flat[at:at + size].T).view(kind).ravel(), dtype=kind))
        at += size
    return out
