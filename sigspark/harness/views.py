"""Operator inputs derived from the driver tables, in Spark and as DuckDB text.

Reads come from whole documents. Signals, alignments and event rows are cut from ``events`` by
``event_id div 100``: the id is unique, so a read has at most 100 samples however the users,
types or times are distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
IUPAC = "ACGTMRWSYKVHDBNACGTMRWSYKV"
READ_SAMPLES = 100


# tables whose rows feed expensive expressions, with the key that spreads them
SPREAD_BY = {"documents": "doc_id", "lineitem": "l_orderkey", "orders": "o_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. One stored as fewer splits than there are cores is spread over the cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SPREAD_BY and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores, SPREAD_BY[name])
    return rows


def letters(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("read_id"),
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("letters"))


def reads(spark, sf_dir) -> DataFrame:
    return letters(spark, sf_dir).select(
        "read_id", F.translate("letters", LETTERS, BASES).alias("seq"))


def signal(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {READ_SAMPLES}").alias("read_id"),
        (F.col("event_id") % READ_SAMPLES).cast("int").alias("i"),
        F.round(F.col("value") * 100).cast("long").alias("v"))


def calls(spark, sf_dir) -> DataFrame:
    site = F.expr("concat('AACTA', repeat(concat('CG', substring('TATTA', 1, cast(l_partkey % 4 as int) + 1)), l_linenumber), 'TTA')")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("chromosome"),
        F.col("l_partkey").cast("int").alias("start"),
        (F.col("l_partkey") + F.col("l_linenumber")).cast("int").alias("end"),
        F.col("l_orderkey").alias("read_name"),
        (F.round(F.col("l_discount") * 100) - 5).cast("double").alias("log_lik_ratio"),
        F.col("l_linenumber").cast("int").alias("num_cpgs"),
        site.alias("sequence"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"))


def model(spark, k: int = 6, letters_in_alphabet: int = 4) -> DataFrame:
    n = letters_in_alphabet ** k
    return spark.range(n).select(
        F.col("id").cast("int").alias("rank"),
        (F.lit(60) + (F.col("id") * 13) % 61).cast("int").alias("level_mean"),
        (F.lit(1) + (F.col("id") * 7) % 5).cast("int").alias("level_stdv"))


def alignments(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")

    def part(n, op):
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise(F.lit(""))

    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 16).otherwise(256)
    return table(spark, sf_dir, "orders").select(
        k.alias("aln_id"), F.col("o_custkey").alias("read_id"),
        (status + F.when(k % 17 == 0, 4).otherwise(0)).cast("int").alias("flag"),
        F.concat(F.lit("ctg"), (F.col("o_custkey") % 5).cast("string")).alias("contig"),
        ((k * 7) % 10007).cast("int").alias("pos"), (k % 61).cast("int").alias("mapq"),
        F.concat(part(k % 4, "S"), part(5 + k % 20, "M"), part(k % 3, "I"), part(4 + k % 7, "M"),
                 part(k % 5, "D"), part(5 + k % 11, "="),
                 F.when(k % 13 == 0, F.lit("40N6M")).otherwise(F.lit("")), part(k % 2, "H")).alias("cigar"))


def pairs(spark, sf_dir) -> DataFrame:
    """Monotone k-mer/event pairs with repeated events, repeated k-mers and jumps."""
    i = F.col("i")
    return signal(spark, sf_dir).select(
        "read_id", i.alias("pair_idx"), F.expr("(3 * i) div 4 + i div 10").cast("int").alias("kmer_idx"),
        F.expr("(2 * i + cast(read_id % 3 as int)) div 3").cast("int").alias("event_idx"), "v")


def kmer_ranks(spark, sf_dir) -> DataFrame:
    return signal(spark, sf_dir).select(
        "read_id", F.col("i").alias("kmer_idx"),
        F.expr("cast((read_id * 31 + (i div 2) * 977) % 4096 as int)").alias("kmer_rank"))


def event_rows(spark, sf_dir) -> DataFrame:
    """Event-to-reference rows: forward on even reads, backward on odd ones, with jumps and stays."""
    return signal(spark, sf_dir).select(
        "read_id", F.col("i").alias("idx"),
        F.expr("cast(1000 + (3 * i) div 4 + (i div 10) * 2 - case when i % 37 = 36 then 2 else 0 end as int)").alias("ref_pos"),
        F.expr("cast(case when read_id % 2 = 0 then i else 99 - i end as int)").alias("event_idx"),
        F.expr("case when v % 11 = 0 then 'B' when v % 7 = 0 then 'E' else 'M' end").alias("state"),
        F.expr("cast((read_id * 31 + i * 977) % 4096 as int)").alias("kmer_rank"),
        F.col("v"), F.expr("cast((case when read_id % 2 = 0 then i else 99 - i end) as int)").alias("start"),
        F.lit(1).alias("length"))


def base_map(spark, sf_dir) -> DataFrame:
    """Every base with its first event, NULL for the bases without one."""
    return signal(spark, sf_dir).select(
        "read_id", F.col("i").alias("k_idx"),
        F.expr("case when v % 3 = 0 then cast(2 * i as int) end").alias("start_event"))


def raw_arrays(spark, sf_dir) -> DataFrame:
    """One row per read with its samples in order; at most 100 values per group."""
    return signal(spark, sf_dir).groupBy("read_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("raw"))


# The same views for DuckDB; a query prepends the ones it uses.
SQL_VIEWS = {
    "letters": "SELECT doc_id AS read_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents",
    "reads": f"SELECT doc_id AS read_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents",
    "signal": "SELECT event_id // 100 AS read_id, CAST(event_id % 100 AS INTEGER) AS i, CAST(round(value * 100) AS BIGINT) AS v FROM events",
    "calls": """SELECT l_returnflag AS chromosome, CAST(l_partkey AS INTEGER) AS s, CAST(l_partkey + l_linenumber AS INTEGER) AS e,
        l_orderkey AS read_name, CAST(round(l_discount * 100) - 5 AS DOUBLE) AS llr, CAST(l_linenumber AS INTEGER) AS num_cpgs,
        concat('AACTA', repeat(concat('CG', substring('TATTA', 1, CAST(l_partkey % 4 AS INTEGER) + 1)), l_linenumber), 'TTA') AS sequence,
        l_orderkey * 8 + l_linenumber AS line_no FROM lineitem""",
    "model": "SELECT CAST(range AS INTEGER) AS rank, CAST(60 + (range * 13) % 61 AS INTEGER) AS level_mean, CAST(1 + (range * 7) % 5 AS INTEGER) AS level_stdv FROM range(4096)",
    "alignments": """SELECT o_orderkey AS aln_id, o_custkey AS read_id,
        CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 16 ELSE 256 END + CASE WHEN o_orderkey % 17 = 0 THEN 4 ELSE 0 END AS INTEGER) AS flag,
        concat('ctg', o_custkey % 5) AS contig, CAST((o_orderkey * 7) % 10007 AS INTEGER) AS pos, CAST(o_orderkey % 61 AS INTEGER) AS mapq,
        o_orderkey AS k FROM orders""",
    "ops": """SELECT aln_id, pos, j, len, op FROM (
        SELECT aln_id, pos, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS j,
          unnest([k % 4, 5 + k % 20, k % 3, 4 + k % 7, k % 5, 5 + k % 11, CASE WHEN k % 13 = 0 THEN 40 ELSE 0 END, CASE WHEN k % 13 = 0 THEN 6 ELSE 0 END, k % 2]) AS len,
          unnest(['S', 'M', 'I', 'M', 'D', '=', 'N', 'M', 'H']) AS op FROM alignments) WHERE len > 0""",
    "spans": "SELECT aln_id, CAST(sum(CASE WHEN op IN ('M', 'D', 'N', '=') THEN len ELSE 0 END) AS INTEGER) AS span FROM ops GROUP BY aln_id",
    "pairs": "SELECT read_id, i AS pair_idx, (3 * i) // 4 + i // 10 AS kmer_idx, CAST((2 * i + CAST(read_id % 3 AS INTEGER)) // 3 AS INTEGER) AS event_idx, v FROM signal",
    "kmer_ranks": "SELECT read_id, i AS kmer_idx, CAST((read_id * 31 + (i // 2) * 977) % 4096 AS INTEGER) AS kmer_rank FROM signal",
    "event_rows": """SELECT read_id, i AS idx, CAST(1000 + (3 * i) // 4 + (i // 10) * 2 - CASE WHEN i % 37 = 36 THEN 2 ELSE 0 END AS INTEGER) AS ref_pos,
        CAST(CASE WHEN read_id % 2 = 0 THEN i ELSE 99 - i END AS INTEGER) AS event_idx,
        CASE WHEN v % 11 = 0 THEN 'B' WHEN v % 7 = 0 THEN 'E' ELSE 'M' END AS state,
        CAST((read_id * 31 + i * 977) % 4096 AS INTEGER) AS kmer_rank, v FROM signal""",
    "base_map": "SELECT read_id, i AS k_idx, CASE WHEN v % 3 = 0 THEN 2 * i END AS start_event FROM signal",
}


def sql(needed: str, body: str) -> str:
    """``body`` with the named views (blank separated, in order) in front of it."""
    clauses = ", ".join(f"{name} AS ({SQL_VIEWS[name]})" for name in needed.split())
    return f"WITH {clauses}{body}" if body.lstrip().startswith(",") else f"WITH {clauses} {body}"
