"""Tab separated tables: methylation calls, frequencies, event rows, BED and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigspark.functions.stats import fixed

# The accepted headers.
CALL_COLUMNS = ["chromosome", "start", "end", "read_name", "log_lik_ratio", "log_lik_methylated",
                "log_lik_unmethylated", "num_calling_strands", "num_cpgs", "sequence"]
CALL_COLUMNS_V2 = ["chromosome", "strand", *CALL_COLUMNS[1:]]
FREQUENCY_COLUMNS = ["chromosome", "start", "end", "num_cpgs_in_group", "called_sites",
                     "called_sites_methylated", "methylated_frequency", "group_sequence"]
SUMMARY_COLUMNS = ["read_index", "read_name", "fast5_path", "model_name", "strand", "num_events",
                   "num_steps", "num_skips", "num_stays", "total_duration", "shift", "scale",
                   "drift", "var"]
CALL_TYPES = {"start": "int", "end": "int", "log_lik_ratio": "double", "log_lik_methylated": "double",
              "log_lik_unmethylated": "double", "num_calling_strands": "int", "num_cpgs": "int"}
FREQUENCY_TYPES = {"start": "int", "end": "int", "num_cpgs_in_group": "int", "called_sites": "int",
                   "called_sites_methylated": "int", "methylated_frequency": "double"}


def _motif(columns: list[str]) -> list[str]:
    return [{"num_cpgs": "num_motifs", "num_cpgs_in_group": "num_motifs_in_group"}.get(c, c) for c in columns]


def read_header(spark: SparkSession, path: str) -> list[str]:
    """First line of a table; only that line is fetched."""
    row = spark.read.text(path).limit(1).first()
    if row is None:
        raise ValueError(f"no header in {path}")
    return row[0].split("\t")


def _read(spark, path, accepted: list[list[str]], types: dict[str, str]) -> DataFrame:
    header = read_header(spark, path)
    for columns in accepted:
        if header in (columns, _motif(columns)):
            break
    else:
        raise ValueError(f"incorrect header in {path}: {header}")
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in columns)
    # A header names the columns for people; the file layout is fixed, so the schema is declared.
    rows = (spark.read.option("header", True).option("sep", "\t").option("quote", "")
            .option("enforceSchema", True).option("mode", "FAILFAST").schema(schema).csv(path))
    return rows


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Methylation calls of either version and either site name, with the input order in ``line_no``."""
    rows = _read(spark, path, [CALL_COLUMNS, CALL_COLUMNS_V2], CALL_TYPES)
    return rows.withColumn("line_no", F.monotonically_increasing_id())


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, [FREQUENCY_COLUMNS], FREQUENCY_TYPES)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(region_id, contig, beg, end); a line without three fields or with end < beg fails."""
    f = F.split("value", r"\s+")
    rows = spark.read.text(path).where(F.length("value") > 0).select(
        F.monotonically_increasing_id().alias("region_id"), F.get(f, F.lit(0)).alias("contig"),
        F.get(f, F.lit(1)).try_cast("int").alias("beg"), F.get(f, F.lit(2)).try_cast("int").alias("end"), "value")
    bad = F.col("beg").isNull() | F.col("end").isNull() | (F.col("end") < F.col("beg"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed bed entry: "), "value"))).otherwise(F.col("end"))
    return rows.withColumn("end", checked.cast("int")).drop("value")


def read_sequencing_summary(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, filename) wherever the two columns stand."""
    header = read_header(spark, path)
    name = next((c for c in ("filename_fast5", "filename") if c in header), None)
    if name is None or "read_id" not in header:
        raise ValueError(f"read_id and filename columns are required in {path}")
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    return rows.select("read_id", F.col(name).alias("filename"))


def read_path_list(spark: SparkSession, path: str) -> list[str]:
    """A file of file names. It names files, so it is small and belongs on the driver."""
    return [r[0] for r in spark.read.text(path).where(F.length("value") > 0).toLocalIterator()]


def list_signal_files(spark: SparkSession, directory: str, glob: str = "*.fast5") -> DataFrame:
    """Recursive listing; the file contents are never read because only the path is selected."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(directory).select("path"))


def read_readdb(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("read_id string, signal_path string").csv(path).fillna("")


def call_lines(version: int = 2) -> Column:
    columns = CALL_COLUMNS if version == 1 else CALL_COLUMNS_V2
    cells = [fixed(F.col(c), 2) if c.startswith("log_lik") else F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat_ws("\t", *cells)


def frequency_lines() -> Column:
    cells = [fixed(F.col("called_sites_methylated") / F.col("called_sites"), 3)
             if c == "methylated_frequency" else F.col(f"`{c}`").cast("string") for c in FREQUENCY_COLUMNS]
    return F.concat_ws("\t", *cells)


def _cells(columns: list[str], digits: dict[str, int]) -> Column:
    return F.concat_ws("\t", *[fixed(F.col(c), digits[c]) if c in digits else
                               F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def summary_lines() -> Column:
    return _cells(SUMMARY_COLUMNS, {"total_duration": 2, "shift": 3, "scale": 3, "drift": 3, "var": 3})


def eventalign_columns(read_names: bool = False, signal_index: bool = False, samples: bool = False) -> list[str]:
    return ["contig", "position", "reference_kmer", "read_name" if read_names else "read_index", "strand",
            "event_index", "event_level_mean", "event_stdv", "event_length", "model_kmer", "model_mean",
            "model_stdv", "standardized_level", *(["start_idx", "end_idx"] if signal_index else []),
            *(["samples"] if samples else [])]


def eventalign_lines(columns: list[str]) -> Column:
    return _cells(columns, {"event_level_mean": 2, "event_stdv": 3, "event_length": 5, "model_mean": 2,
                            "model_stdv": 2, "standardized_level": 2})


def resquiggle_lines() -> Column:
    """A k-mer without signal has a dot for either end."""
    dot = F.lit(".")
    return F.concat_ws("\t", F.col("read_id"), F.col("kmer_idx").cast("string"),
                       F.coalesce(F.col("start_raw_idx").cast("string"), dot),
                       F.coalesce(F.col("end_raw_idx").cast("string"), dot))


def paf_lines() -> Column:
    c = F.col
    return F.concat_ws(
        "\t", c("read_id"), c("n_samples"), c("signal_start"), c("signal_end"), F.lit("+"), c("read_id"),
        c("n_kmers"), c("kmer_start"), c("kmer_end"), c("matches"), c("n_kmers"), F.lit("255"),
        F.concat(F.lit("sc:f:"), fixed(c("scale"), 6)), F.concat(F.lit("sh:f:"), fixed(c("shift"), 6)),
        F.concat(F.lit("ss:Z:"), c("ss")))


def write_lines(rows: DataFrame, line: Column, header: list[str] | None, path: str) -> None:
    """Write text parts in the row order of ``rows``; the header starts every part.

    The parts are written in parallel and keep the order of a preceding sort from part to part.
    """
    if header is None:
        rows.select(line.alias("value")).write.mode("overwrite").text(path)
        return
    name = "\t".join(header)
    # CSV is used for its per-part header; the whole line is one unquoted field.
    (rows.select(line.alias(name)).write.mode("overwrite").option("header", True).option("quote", "")
     .option("sep", "\x01").option("escape", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path))
