"""Frequency, sequence and CpG queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions import sequence as S
from sigspark.functions import stats, values
from sigspark.harness import views as V
from sigspark.harness.registry import query
from sigspark.harness.views import sql
from sigspark.operators import frequency, kmers

_FREQ_COLUMNS = """chromosome, s AS "start", e AS "end", CAST(num_cpgs_in_group AS INTEGER) AS num_cpgs_in_group,
    called_sites, called_sites_methylated,
    CAST(printf('%.3f', called_sites_methylated / called_sites) AS DOUBLE) AS methylated_frequency, group_sequence"""

_AGG = """SELECT chromosome, s, e, arg_min(num_cpgs, line_no) AS num_cpgs_in_group,
    CAST(sum(num_cpgs) AS BIGINT) AS called_sites,
    CAST(sum(CASE WHEN llr > 0 THEN num_cpgs ELSE 0 END) AS BIGINT) AS called_sites_methylated,
    arg_min(sequence, line_no) AS group_sequence FROM {src} GROUP BY chromosome, s, e"""


def _freq_sql(threshold: float) -> str:
    return sql("calls", f", kept AS (SELECT * FROM calls WHERE abs(llr) >= {threshold}), "
               f"f AS ({_AGG.format(src='kept')}) SELECT {_FREQ_COLUMNS} FROM f")


_SPLIT_ROWS = """, kept AS (SELECT * FROM calls WHERE abs(llr) >= 2.5),
  hits AS (SELECT *, unnest(list_filter(range(1, length(sequence) + 1), lambda i: substring(sequence, i, 2) = 'CG')) AS hit FROM kept WHERE num_cpgs > 1),
  parts AS (SELECT chromosome, CAST(s + hit - strpos(sequence, 'CG') AS INTEGER) AS s, llr, line_no FROM hits),
  allrows AS (SELECT chromosome, s, s AS e, 1 AS num_cpgs, llr, line_no, 'split-group' AS sequence FROM parts
           UNION ALL SELECT chromosome, s, e, num_cpgs, llr, line_no, sequence FROM kept WHERE num_cpgs <= 1)"""


@query("meth_freq", _freq_sql(2.5))
def meth_freq(spark, sf):
    return frequency.sort_sites(frequency.site_frequency(V.calls(spark, sf)))


@query("meth_freq_threshold", _freq_sql(4.5))
def meth_freq_threshold(spark, sf):
    return frequency.site_frequency(V.calls(spark, sf), threshold=4.5)


@query("meth_freq_split", sql("calls", f"{_SPLIT_ROWS}, f AS ({_AGG.format(src='allrows')}) SELECT {_FREQ_COLUMNS} FROM f"))
def meth_freq_split(spark, sf):
    return frequency.site_frequency(V.calls(spark, sf), split_groups=True)


_PART_MERGE = f""", kept AS (SELECT * FROM calls WHERE abs(llr) >= 2.5),
  parts AS (SELECT chromosome, s, e, read_name % 3 AS part, arg_min(num_cpgs, line_no) AS n, arg_min(sequence, line_no) AS q,
      sum(num_cpgs) AS c, sum(CASE WHEN llr > 0 THEN num_cpgs ELSE 0 END) AS m FROM kept GROUP BY ALL),
  f AS (SELECT chromosome, s, e, arg_min(n, part) AS num_cpgs_in_group, CAST(sum(c) AS BIGINT) AS called_sites,
      CAST(sum(m) AS BIGINT) AS called_sites_methylated, arg_min(q, part) AS group_sequence FROM parts GROUP BY chromosome, s, e)
  SELECT {_FREQ_COLUMNS} FROM f"""


def _parts(spark, sf):
    calls = V.calls(spark, sf)
    return [frequency.site_frequency(calls.where(F.col("read_name") % 3 == i)) for i in range(3)]


@query("freq_merge", sql("calls", _PART_MERGE))
def freq_merge(spark, sf):
    return frequency.sort_sites(frequency.merge_frequencies(_parts(spark, sf)))


@query("freq_merge_equals_whole", sql("calls", """, kept AS (SELECT * FROM calls WHERE abs(llr) >= 2.5)
  SELECT chromosome, CAST(count(DISTINCT (s, e)) AS BIGINT) AS n_sites, CAST(0 AS BIGINT) AS n_different FROM kept GROUP BY chromosome"""))
def freq_merge_equals_whole(spark, sf):
    """Full outer comparison of the merged parts with the frequencies of all calls."""
    key = ["chromosome", "start", "end"]
    cols = [*key, F.struct("called_sites", "called_sites_methylated", "methylated_frequency").alias("x")]
    whole = frequency.site_frequency(V.calls(spark, sf)).select(*cols)
    merged = frequency.merge_frequencies(_parts(spark, sf)).select(*cols[:-1], cols[-1].alias("y"))
    return whole.join(merged, key, "full_outer").groupBy("chromosome").agg(
        F.count("*").alias("n_sites"),
        F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), 0).otherwise(1)).cast("long").alias("n_different"))


@query("window_clip", sql("calls", """SELECT chromosome, s AS "start", e AS "end", read_name, line_no FROM calls WHERE s >= 50 AND e < 900"""))
def window_clip(spark, sf):
    return frequency.clip_to_window(V.calls(spark, sf), 50, 900).select(
        "chromosome", "start", "end", "read_name", "line_no")


@query("confident_calls", sql("calls", """SELECT chromosome, num_cpgs, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN llr > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive
  FROM calls WHERE abs(llr) >= 2.5 GROUP BY ALL"""))
def confident_calls(spark, sf):
    return frequency.confident_calls(V.calls(spark, sf)).groupBy("chromosome", "num_cpgs").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("log_lik_ratio") > 0, 1).otherwise(0)).alias("n_positive"))


_RANK4 = "CAST(list_reduce(list_transform(string_split(kmer, ''), lambda c: strpos('ACGT', c) - 1), lambda a, b: a * 4 + b) AS INTEGER)"
_RANK5 = "CAST(list_reduce(list_transform(string_split(kmer, ''), lambda c: strpos('ACGMT', c) - 1), lambda a, b: a * 5 + b) AS INTEGER)"


@query("kmer_rank_counts", sql("reads", f""", p AS (SELECT seq, unnest(range(1, length(seq) - 4)) AS i FROM reads WHERE length(seq) >= 6),
  c AS (SELECT substring(seq, i, 6) AS kmer, count(*) AS n FROM p GROUP BY 1)
  SELECT kmer, {_RANK4} AS kmer_rank, n FROM c"""))
def kmer_rank_counts(spark, sf):
    return kmers.kmer_counts(V.reads(spark, sf), 6)


@query("methylated_kmer_ranks", sql("reads", f""", m AS (SELECT replace(seq, 'CG', 'MG') AS seq FROM reads WHERE length(seq) >= 6),
  p AS (SELECT seq, unnest(range(1, length(seq) - 4)) AS i FROM m),
  c AS (SELECT substring(seq, i, 6) AS kmer, count(*) AS n FROM p GROUP BY 1)
  SELECT {_RANK5} AS kmer_rank5, n FROM c"""))
def methylated_kmer_ranks(spark, sf):
    marked = V.reads(spark, sf).withColumn("seq", S.methylate(F.col("seq")))
    counts = kmers.explode_kmers(marked, 6).groupBy("kmer").agg(F.count("*").alias("n"))
    return counts.select(S.kmer_rank5(F.col("kmer")).alias("kmer_rank5"), "n")


@query("reverse_complement", sql("reads", "SELECT read_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc FROM reads"))
def reverse_complement(spark, sf):
    return V.reads(spark, sf).select("read_id", F.md5(S.reverse_complement(F.col("seq"))).alias("rc"))


@query("methylate", sql("reads", """SELECT read_id, md5(replace(seq, 'CG', 'MG')) AS marked,
  CAST((length(seq) - length(replace(seq, 'CG', ''))) // 2 AS INTEGER) AS n_marked FROM reads"""))
def methylate(spark, sf):
    m = S.methylate(F.col("seq"))
    return V.reads(spark, sf).select("read_id", F.md5(m).alias("marked"),
                                     F.regexp_count(m, F.lit("M")).alias("n_marked"))


@query("methylate_reverse_complement", sql("reads", """SELECT read_id,
  md5(replace(reverse(translate(seq, 'ACGT', 'TGCA')), 'CG', 'MG')) AS marked_rc FROM reads"""))
def methylate_reverse_complement(spark, sf):
    return V.reads(spark, sf).select("read_id", F.md5(
        S.reverse_complement_methylated(S.methylate(F.col("seq")))).alias("marked_rc"))


@query("disambiguate", sql("letters", f"""SELECT read_id,
  md5(list_aggregate(list_transform(string_split(translate(letters, '{V.LETTERS}', '{V.IUPAC}'), ''),
    lambda c: CASE WHEN c IN ('M','R','W','V','H','D','N') THEN 'A' WHEN c IN ('S','Y','B') THEN 'C' WHEN c = 'K' THEN 'G' ELSE c END),
    'string_agg', '')) AS plain FROM letters"""))
def disambiguate(spark, sf):
    codes = V.letters(spark, sf).select(
        "read_id", F.lower(F.translate("letters", V.LETTERS, V.IUPAC)).alias("codes"))
    return codes.select("read_id", F.md5(S.disambiguate(F.col("codes"))).alias("plain"))


@query("rna_to_dna", sql("letters", "SELECT read_id, md5(replace(letters, 'U', 'T')) AS dna FROM letters"))
def rna_to_dna(spark, sf):
    return V.letters(spark, sf).select("read_id", F.md5(S.u_to_t(F.col("letters"))).alias("dna"))


_GROUPS = """, g AS (SELECT read_id, string_split(seq, 'CG') AS p FROM reads),
  x AS (SELECT read_id, unnest(p) AS piece, unnest(range(len(p))) AS j, len(p) AS n FROM g),
  y AS (SELECT read_id, j, n, length(piece) AS gap, sum(length(piece)) OVER w + 2 * j AS pos FROM x WINDOW w AS (PARTITION BY read_id ORDER BY j)),
  z AS (SELECT read_id, pos, sum(CASE WHEN j = 0 OR gap + 2 > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY j) AS grp FROM y WHERE j < n - 1),
  grps AS (SELECT read_id, CAST(min(pos) AS INTEGER) AS first_cpg, CAST(max(pos) AS INTEGER) AS last_cpg, CAST(count(*) AS INTEGER) AS n_cpg FROM z GROUP BY read_id, grp)"""


@query("cpg_groups", sql("reads", _GROUPS + " SELECT * FROM grps"))
def cpg_groups(spark, sf):
    return kmers.cpg_groups(V.reads(spark, sf)).drop("grp")


@query("callable_cpg_groups", sql("reads", _GROUPS + " SELECT * FROM grps WHERE first_cpg - 10 > 10 AND last_cpg - first_cpg <= 200"))
def callable_cpg_groups(spark, sf):
    return kmers.callable_groups(kmers.cpg_groups(V.reads(spark, sf)).drop("grp"))


@query("read_length_groups", sql("reads", """SELECT CAST(length(seq) // 500 AS BIGINT) AS length_class, count(*) AS n_reads,
  CAST(sum(length(seq)) AS BIGINT) AS bases FROM reads GROUP BY 1"""))
def read_length_groups(spark, sf):
    return kmers.read_length_groups(V.reads(spark, sf), 500)


@query("strand_flip", sql("signal", "SELECT read_id, i, CAST(100 - i - 6 AS INTEGER) AS flipped FROM signal"))
def strand_flip(spark, sf):
    return V.signal(spark, sf).select("read_id", "i", S.flip_k_strand(
        F.lit(V.READ_SAMPLES), F.col("i"), 6).alias("flipped"))


@query("checked_parsers", """SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 30 THEN CAST(p_size AS BIGINT) END AS size_in_range,
  CASE WHEN regexp_full_match(p_brand, '[0-9]+') THEN 1 ELSE 0 END AS brand_is_number FROM part""")
def checked_parsers(spark, sf):
    t = V.table(spark, sf, "part")
    size = values.checked_integer(F.col("p_size").cast("string"), "uint8_t").cast("long")
    return t.select("p_partkey", F.when(size <= 30, size).alias("size_in_range"),
                    F.when(values.checked_integer(F.col("p_brand"), "int64_t").isNotNull(), 1)
                    .otherwise(0).alias("brand_is_number"))


@query("calls_tsv", sql("calls", """SELECT line_no, concat_ws(chr(9), chromosome, '+', s, e, read_name, printf('%.2f', llr), printf('%.2f', llr * 0.5 - 40),
  printf('%.2f', -llr * 0.5 - 40), 1, num_cpgs, sequence) AS line FROM calls"""))
def calls_tsv(spark, sf):
    from sigspark.sources.tsv import call_lines
    half = F.col("log_lik_ratio") * 0.5
    rows = V.calls(spark, sf).withColumn("strand", F.lit("+")).withColumn(
        "log_lik_methylated", half - 40).withColumn("log_lik_unmethylated", -half - 40).withColumn(
        "num_calling_strands", F.lit(1))
    return rows.select("line_no", call_lines(version=2).alias("line"))


@query("frequency_tsv", sql("calls", f""", kept AS (SELECT * FROM calls WHERE abs(llr) >= 2.5), f AS ({_AGG.format(src='kept')})
  SELECT concat_ws(chr(9), chromosome, s, e, num_cpgs_in_group, called_sites, called_sites_methylated,
    printf('%.3f', called_sites_methylated / called_sites), group_sequence) AS line FROM f"""))
def frequency_tsv(spark, sf):
    from sigspark.sources.tsv import frequency_lines
    return frequency.site_frequency(V.calls(spark, sf)).select(frequency_lines().alias("line"))
