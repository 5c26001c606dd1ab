"""Centroid clustering of integer vectors by equal-average equal-variance search.

Centroids are sorted by their component sum. A vector starts at its own sum and scans outward, the nearer sum first.
With S the sum of d components and R = sqrt(d * sum((x - S / d) ** 2)), d * |x - c| ** 2 is at least
(Sx - Sc) ** 2 + (Rx - Rc) ** 2. The first term alone ends the scan, as all further sums are farther away; both terms
reject one centroid; what is left is measured exactly in integers. Bounds are floats with a slack beyond their
rounding, so they never reject a nearest centroid.

A round is one narrow pass: a task adds up its vectors by cluster and hands on k * d sums, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import written

#: Clusters, rounds, components, and what a component is multiplied by before it is floored.
CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: Share of the squares by which a bound may be off; bits of a digit of a sum that is handed on.
SLACK, DIGIT = 1e-9, 32


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: as 64-bit integers where distances of such vectors fit, else as Python's."""
    whole = np.floor(x * SCALE)
    if not whole.size or float(np.abs(whole).max()) < 2 ** 30 / np.sqrt(x.shape[1]):
        return whole.astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 2 ** 53 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def _measures(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component sum S and R of each vector."""
    flat = x.astype(np.float64)
    total = flat.sum(axis=1)
    around = flat - total[:, None] / x.shape[1]
    return total, np.sqrt(x.shape[1] * (around * around).sum(axis=1))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centre, squared distance) of each row of x, and how many distances were measured.

    Of centres at one distance the smallest number counts.
    """
    if x.dtype == object or centres.dtype == object:
        x, centres = x.astype(object), centres.astype(object)
    n, k, d = len(x), len(centres), x.shape[1]
    (sums, spread), (centre_sums, centre_spread) = _measures(x), _measures(centres)
    order = np.lexsort((np.arange(k), centre_sums))
    ranked, s, r = centres[order], centre_sums[order], centre_spread[order]
    slack = SLACK * (sums ** 2 + spread ** 2 + float((s ** 2 + r ** 2).max())) + 1
    best, near = np.full(n, 1 << 600 if x.dtype == object else np.iinfo(np.int64).max, x.dtype), np.full(n, np.inf)
    who = np.full(n, k)
    right = np.searchsorted(s, sums)
    left, active, measured = right - 1, np.arange(n), 0
    while len(active):
        low, high = left[active], right[active]
        below = np.where(low >= 0, sums[active] - s[low], np.inf)
        above = np.where(high < k, s[np.minimum(high, k - 1)] - sums[active], np.inf)
        down = below <= above
        at, gap = np.where(down, low, high), np.where(down, below, above) ** 2
        left[active] -= down
        right[active] += ~down
        limit = d * near[active] + slack[active]
        go_on = gap <= limit
        active, at, gap, limit = active[go_on], at[go_on], gap[go_on], limit[go_on]
        close = gap + (spread[active] - r[at]) ** 2 <= limit
        i, number = active[close], order[at[close]]
        apart = x[i] - ranked[at[close]]
        distance = (apart * apart).sum(axis=1) if len(i) else best[:0]
        better = (distance < best[i]) | ((distance == best[i]) & (number < who[i]))
        i = i[better]
        best[i], near[i], who[i] = distance[better], distance[better].astype(np.float64), number[better]
        measured += len(number)
        active = active[(left[active] >= 0) | (right[active] < k)]
    return who, best, measured


def _vectors(batch: pa.RecordBatch, column: int) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return integers(flat.reshape(batch.num_rows, -1))


def _assigned(batch: pa.RecordBatch, column: int, centres: np.ndarray, size: int = 1 << 14) -> Iterator[tuple]:
    """(vectors, cluster, distance) of a batch, a bounded number of vectors at a time."""
    for begin in range(0, batch.num_rows, size):
        x = _vectors(batch.slice(begin, size), column)
        yield (x, *nearest(x, centres)[:2])


def _digits(value: int) -> list[int]:
    """Digits of base 2 ** DIGIT, the lowest first, with the sign of the value."""
    sign, value, out = -1 if value < 0 else 1, abs(value), []
    while value:
        out.append(sign * (value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return out or [0]


def _moved(kept: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres after a round: exact floors of the means of their vectors; a centre without vectors stays."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centres.shape, object), [0] * len(centres)
        for batch in batches:
            for x, cluster, _ in _assigned(batch, 1, centres):
                for c in np.unique(cluster).tolist():
                    own = x[cluster == c]
                    count[c] += len(own)
                    total[c] = total[c] + own.sum(axis=0).astype(object)
        rows = [(c, place, digit, value, count[c]) for c in range(len(centres)) if count[c]
                for place in range(centres.shape[1]) for digit, value in enumerate(_digits(int(total[c, place])))]
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], pa.int64()) for i in range(5)],
                                         ["cluster", "place", "digit", "value", "n"])

    sums = kept.mapInArrow(add, "cluster long, place long, digit long, value long, n long").groupBy("cluster", "place", "digit").agg(
        F.sum("value").alias("value"), F.sum("n").alias("n"))
    total, count = np.zeros(centres.shape, object), {}
    for cluster, place, digit, value, n in sums.collect():  # k * d numbers, of a few digits each
        total[cluster, place] += value << (DIGIT * digit)
        if digit == 0:
            count[cluster] = n
    out = centres.astype(object)
    for cluster, n in count.items():
        out[cluster] = [int(t) // n for t in total[cluster]]
    return _narrow(out)


def _narrow(centres: np.ndarray) -> np.ndarray:
    small = max((abs(int(v)) for v in centres.ravel()), default=0) < 2 ** 30 / np.sqrt(max(centres.shape[1], 1))
    return centres.astype(np.int64) if small else centres


def clustered(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS,
              rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance) of the kept vectors, and the final centroids.

    Kept are vectors of `dimensions` components, none of them null or not finite; others have no row. Each row of a
    repeated vec_id is a vector of its own. Centroids start as the vectors with the smallest sha256 of `3:<vec_id>`
    (equal ids: the smaller vector first, a null id last); with fewer vectors than clusters there are fewer
    centroids, and an empty table gives none. Equal distances go to the smaller number. Components of any finite size
    are exact; a distance that no long can hold is null.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).where(
        (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    kept = written(rows, "vectors")
    first = kept.orderBy(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(clusters)
    start = [row["v"] for row in first.collect()]
    if not start:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), np.zeros((0, dimensions), np.int64)
    centres = integers(np.array(start, np.float64))
    for _ in range(rounds):
        centres = _moved(kept, centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [(cluster, distance) for _, cluster, distance in _assigned(batch, 1, centres)]
                distance = [v if v < 1 << 63 else None for part in parts for v in part[1].tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([p[0] for p in parts]).astype(np.int32)),
                                                  pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    return kept.mapInArrow(assign, kind), centres


def digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centre).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """The clusters of `clustered` with the inertia of each, of all, and the digest of each centroid.

    Inertia is null where it, or a distance in it, is beyond a long.
    """
    spark = vectors.sparkSession
    rows, centres = clustered(vectors)
    rows = written(rows, "clusters")
    held = {c: (n, known, int(total or 0)) for c, n, known, total in rows.groupBy("cluster").agg(
        F.count("*"), F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # one row for each centroid
    known = lambda parts: None if any(n != k for n, k, _ in parts) or (total := sum(t for *_, t in parts)) >= 1 << 63 else total
    each = [(c, known([held[c]]), known(list(held.values())), digest(centres[c])) for c in held]
    kind = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return rows.join(F.broadcast(spark.createDataFrame(each, kind)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    apart = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    parts = [f"""vectors AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM vectors
        ORDER BY sha256('3:' || vec_id) LIMIT {CLUSTERS})"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := {apart}, k := k)) AS best
        FROM vectors, c{i} GROUP BY vec_id)""")
        if i < ROUNDS:
            parts.append(f"""m{i} AS MATERIALIZED (SELECT k, list({floor} ORDER BY place) AS c FROM (
            SELECT k, place, sum(x)::HUGEINT AS s, count(*) AS n FROM (
                SELECT best.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY k, place) GROUP BY k)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
    (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.k = best.k"""


#: Each vector meets each centroid, eleven times; for tables whose vec_id is unique and whose distances fit a long.
SQL = _sql()
