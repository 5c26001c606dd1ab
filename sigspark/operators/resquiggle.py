"""Signal interval of every k-mer, as rows or as one compressed string per read.

Input rows are reads with ``intervals``: array<struct<start, end>> with one element per k-mer of
the read and NULLs where a k-mer has no signal. Everything below works on one row, so nothing is
shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sigspark.kernels.arrow import blocks, column


def kmer_rows(reads: DataFrame, rna: bool = False) -> DataFrame:
    """(read_id, kmer_idx, start_raw_idx, end_raw_idx), one row per k-mer."""
    rows = reads.select("read_id", F.size("intervals").alias("n"),
                        F.posexplode("intervals").alias("j", "s"))
    idx = F.col("n") - F.col("j") - 1 if rna else F.col("j")
    return rows.select("read_id", idx.alias("kmer_idx"), F.col("s.start").alias("start_raw_idx"),
                       F.col("s.end").alias("end_raw_idx"))


def paf_rows(reads: DataFrame, rna: bool = False) -> DataFrame:
    """PAF columns with the signal string.

    Per k-mer with signal the string has the k-mers skipped since the last one (``nD``), the
    samples skipped (``nI``) and the samples used (``n,``). When the first k-mer itself has no
    signal, the samples ahead of the first interval are listed as skipped. The calibration tags
    are those of the read itself. The strings of a batch of reads are made at once, column by column.
    """
    kinds = {f.name: f.dataType for f in reads.schema["intervals"].dataType.elementType.fields}
    kept = [reads.schema[c] for c in ("read_id", "n_samples")], [reads.schema[c] for c in ("scale", "shift")]
    found = [T.StructField("signal_start", kinds["start"]), T.StructField("signal_end", kinds["end"]),
             *[T.StructField(c, T.IntegerType()) for c in ("n_kmers", "kmer_start", "kmer_end", "matches")]]
    schema = T.StructType([*kept[0], *found, *kept[1], T.StructField("ss", T.StringType())])

    def run(batches):
        for batch in blocks(batches):
            at, columns = _signal_strings(column(batch, "intervals"), rna)
            if not len(at):
                continue
            own = [[column(batch, f.name).take(pa.array(at)) for f in fields] for fields in kept]
            arrays = [*own[0], *columns[:-1], *own[1], columns[-1]]
            yield pa.RecordBatch.from_arrays([x.cast(to_arrow_type(f.dataType)) for x, f in zip(arrays, schema)], schema.names)

    return reads.select("read_id", "n_samples", "scale", "shift", "intervals").mapInArrow(run, schema)


def _signal_strings(intervals: pa.Array, rna: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """Rows with signal, and their columns of ``paf_rows`` that follow from the intervals."""
    n = pc.fill_null(pc.list_value_length(intervals), 0).to_numpy().astype(np.int64)
    flat = intervals.flatten()
    parts = dict(zip((f.name for f in flat.type), flat.flatten()))     # a null interval has null ends
    there = np.flatnonzero(parts["start"].is_valid().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(n)), n)[there]
    j = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n))[there]
    ends = parts["end"].is_valid().to_numpy(zero_copy_only=False)[there]
    start, end = (pc.fill_null(parts[c], 0).to_numpy().astype(np.int64)[there] for c in ("start", "end"))

    opens = np.append(True, row[1:] != row[:-1])[:len(row)]
    before = lambda x: np.roll(x, 1)
    skipped = np.where(opens, 0, j - before(j) - 1)
    gap = start - np.where(opens, np.where(j == 0, start, 0), before(end))
    values = np.stack([skipped, gap, end - start], axis=1)
    told = np.stack([skipped > 0, (gap != 0) & (opens | before(ends)), (end != start) & ends], axis=1)
    letters = pa.array(["D", "I", ","]).take(pa.array(np.nonzero(told)[1]))
    pieces = pc.binary_join_element_wise(pa.array(values[told]).cast(pa.string()), letters, "")

    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(row))[:len(first)] - 1
    at = row[first]
    bounds = np.append(0, np.cumsum(told.sum(axis=1)))[np.append(first, len(row))]
    strings = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pieces), "")
    matches = np.bincount(row, told[:, 2], len(n)).astype(np.int64)[at]
    return at, [pa.array(start[first]), pa.array(end[last], mask=~ends[last]), pa.array(n[at]),
                pa.array(n[at] - j[first] if rna else j[first]), pa.array(n[at] - 1 - j[last] if rna else j[last] + 1),
                pa.array(matches), strings]
