"""Signal, calibration, alignment and output-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions import sequence as S
from sigspark.functions import stats
from sigspark.harness import views as V
from sigspark.harness.registry import query
from sigspark.harness.views import sql
from sigspark.operators import alignments as A
from sigspark.operators import eventrows, kmers, nearest, quality, readindex, resquiggle, scaling
from sigspark.operators import signal as sig


@query("prefix_sums", sql("signal", """SELECT read_id, i, v, CAST(coalesce(sum(v) OVER w, 0) AS BIGINT) AS sum_before,
  CAST(coalesce(sum(v * v) OVER w, 0) AS BIGINT) AS sumsq_before FROM signal
  WINDOW w AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def prefix_sums(spark, sf):
    return sig.prefix_sums(V.signal(spark, sf))


def _tstat_sql(w: int) -> str:
    return sql("signal", f""", m AS (SELECT read_id, i, count(*) OVER a AS n1, count(*) OVER b AS n2,
    sum(v) OVER a / {w}.0 AS m1, sum(v) OVER b / {w}.0 AS m2, sum(v * v) OVER a / {w}.0 AS q1, sum(v * v) OVER b / {w}.0 AS q2 FROM signal
    WINDOW a AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING),
           b AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING))
    SELECT read_id, i, CASE WHEN n1 = {w} AND n2 = {w} THEN round(abs(m2 - m1) / sqrt(greatest(q1 - m1 * m1 + q2 - m2 * m2, 1.1754943508222875e-38) / {w}.0), 4) ELSE 0.0 END AS tstat FROM m""")


@query("tstat_short", _tstat_sql(3))
def tstat_short(spark, sf):
    return sig.windowed_tstat(V.signal(spark, sf), 3).withColumn("tstat", F.round("tstat", 4))


@query("tstat_long", _tstat_sql(6))
def tstat_long(spark, sf):
    return sig.windowed_tstat(V.signal(spark, sf), 6).withColumn("tstat", F.round("tstat", 4))


@query("picoamps", sql("signal", "SELECT read_id, CAST(count(*) AS INTEGER) AS n, CAST(sum((v + 10) * 0.25) AS DOUBLE) AS total FROM signal GROUP BY read_id"))
def picoamps(spark, sf):
    raw = V.raw_arrays(spark, sf)
    pa = stats.to_picoamps(F.col("raw"), F.lit(10.0), F.lit(2048.0), F.lit(8192.0))
    return raw.select("read_id", pa.alias("pa")).select(
        "read_id", F.size("pa").alias("n"),
        F.aggregate("pa", F.lit(0.0), lambda acc, x: acc + x).alias("total"))


@query("event_segments", sql("signal", """, b AS (SELECT read_id, i, v, sum(CASE WHEN i > 0 AND v % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i) AS event_idx FROM signal)
  SELECT read_id, CAST(event_idx AS BIGINT) AS event_idx, min(i) AS "start", count(*) AS length, round(sum(v) / count(*), 4) AS mean,
    round(sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 0.0)), 3) AS stdv FROM b GROUP BY read_id, event_idx"""))
def event_segments(spark, sf):
    samples = V.signal(spark, sf)
    events = sig.segment_events(samples, samples.where("v % 7 = 0"))
    return events.withColumn("mean", F.round("mean", 4)).withColumn("stdv", F.round("stdv", 3))


@query("quantile_mad", sql("signal", """, a AS (SELECT read_id, list_sort(list(CAST(v AS DOUBLE))) AS x FROM signal GROUP BY read_id),
  m AS (SELECT read_id, x, x[len(x) // 2 + 1] AS med FROM a)
  SELECT read_id, med AS median, round(list_sort(list_transform(x, lambda y: abs(y - med)))[len(x) // 2 + 1] * 1.4826, 4) AS mad,
    round(quantile_cont_20, 3) AS q20 FROM (SELECT m.*, (SELECT quantile_cont(CAST(v AS DOUBLE), 0.2) FROM signal s WHERE s.read_id = m.read_id) AS quantile_cont_20 FROM m)"""))
def quantile_mad(spark, sf):
    rows = V.signal(spark, sf).groupBy("read_id").agg(
        F.array_sort(F.collect_list(F.col("v").cast("double"))).alias("x"))
    x = F.col("x")
    return rows.select("read_id", stats.sorted_median(x).alias("median"),
                       F.round(stats.mad(x), 4).alias("mad"),
                       F.round(stats.sorted_quantile(x, 0.2), 3).alias("q20"))


@query("mad_trim", sql("signal", """, c AS (SELECT read_id, i // 20 AS chunk, list_sort(list(CAST(v AS DOUBLE))) AS x FROM signal GROUP BY ALL HAVING count(*) = 20),
  m AS (SELECT read_id, chunk, list_sort(list_transform(x, lambda y: abs(y - x[11])))[11] * 1.4826 AS mad FROM c),
  l AS (SELECT *, min(mad) OVER (PARTITION BY read_id) AS low FROM m)
  SELECT read_id, CAST(min(CASE WHEN mad > low THEN chunk END) * 20 AS BIGINT) AS trim_start,
    CAST((max(CASE WHEN mad > low THEN chunk END) + 1) * 20 AS BIGINT) AS trim_end FROM l GROUP BY read_id"""))
def mad_trim(spark, sf):
    return sig.mad_trim(V.signal(spark, sf), chunk=20)


@query("mom_scaling", sql("signal model kmer_ranks", """, e AS (SELECT read_id, avg(v) AS e1, avg(v * v) AS e2 FROM signal GROUP BY read_id),
  m AS (SELECT read_id, avg(level_mean) AS m1, avg(level_mean * level_mean) AS m2 FROM kmer_ranks JOIN model ON rank = kmer_rank GROUP BY read_id)
  SELECT e.read_id, round(e1 - m1, 4) AS shift, round((e2 - 2 * (e1 - m1) * e1 + (e1 - m1) * (e1 - m1)) / m2, 4) AS scale FROM e JOIN m ON e.read_id = m.read_id"""))
def mom_scaling(spark, sf):
    events = V.signal(spark, sf).select("read_id", F.col("v").alias("mean"))
    levels = kmers.join_model(V.kmer_ranks(spark, sf), V.model(spark))
    return scaling.moments_scaling(events, levels).select(
        "read_id", F.round("shift", 4).alias("shift"), F.round("scale", 4).alias("scale"))


_RANGES = """, fresh AS (SELECT *, coalesce(lag(event_idx) OVER (PARTITION BY read_id ORDER BY pair_idx), -1) AS prev FROM pairs),
  ranges AS (SELECT read_id, kmer_idx, min(event_idx) AS start_event, max(event_idx) AS stop_event FROM fresh WHERE event_idx <> prev GROUP BY read_id, kmer_idx)"""
_ROWS = _RANGES + """, marked AS (SELECT r.*, kmer_rank, coalesce(lag(kmer_rank) OVER (PARTITION BY r.read_id ORDER BY r.kmer_idx) <> kmer_rank, true) AS fresh_rank
    FROM ranges r JOIN kmer_ranks k ON r.read_id = k.read_id AND r.kmer_idx = k.kmer_idx),
  erows AS (SELECT read_id, kmer_idx, kmer_rank, CASE WHEN fresh_rank AND event_idx = start_event THEN 'M' ELSE 'E' END AS state, event_idx
    FROM (SELECT *, unnest(range(start_event, stop_event + 1)) AS event_idx FROM marked))"""


@query("base_to_event_map", sql("signal pairs", _RANGES + " SELECT read_id, CAST(kmer_idx AS INTEGER) AS kmer_idx, start_event, stop_event FROM ranges"))
def base_to_event_map(spark, sf):
    return scaling.credited_ranges(V.pairs(spark, sf))


@query("match_states", sql("signal pairs kmer_ranks", _ROWS + " SELECT read_id, CAST(kmer_idx AS INTEGER) AS kmer_idx, kmer_rank, state, CAST(event_idx AS INTEGER) AS event_idx FROM erows"))
def match_states(spark, sf):
    return scaling.match_rows(scaling.credited_ranges(V.pairs(spark, sf)), V.kmer_ranks(spark, sf))


@query("wls_recalibration", sql("signal pairs kmer_ranks model", _ROWS + """, x AS (SELECT r.read_id, s.v AS y, level_mean AS mu, 1.0 / (level_stdv * level_stdv) AS w FROM erows r
    JOIN model ON rank = kmer_rank JOIN signal s ON s.read_id = r.read_id AND s.i = r.event_idx WHERE state = 'M'),
  n AS (SELECT read_id, count(*) AS n, sum(w) AS a, sum(mu * w) AS b, sum(mu * mu * w) AS c, sum(y * w) AS d, sum(mu * y * w) AS e FROM x GROUP BY read_id),
  p AS (SELECT read_id, n, (c * d - b * e) / (a * c - b * b) AS shift, (a * e - b * d) / (a * c - b * b) AS scale FROM n),
  v AS (SELECT x.read_id, sqrt(sum(w * (y - shift - scale * mu) * (y - shift - scale * mu)) / count(*)) AS var FROM x JOIN p ON x.read_id = p.read_id GROUP BY x.read_id)
  SELECT p.read_id, n AS n_match, CASE WHEN n >= 30 THEN round(shift, 3) END AS shift, CASE WHEN n >= 30 THEN round(scale, 3) END AS scale,
    CASE WHEN n >= 30 THEN round(var, 3) END AS var FROM p JOIN v ON p.read_id = v.read_id"""))
def wls_recalibration(spark, sf):
    rows = scaling.match_rows(scaling.credited_ranges(V.pairs(spark, sf)), V.kmer_ranks(spark, sf))
    levels = kmers.join_model(rows, V.model(spark))
    events = V.signal(spark, sf).select("read_id", F.col("i").alias("event_idx"), F.col("v").alias("mean"))
    out = scaling.weighted_recalibration(levels.join(events, ["read_id", "event_idx"]), min_events=30)
    return out.select("read_id", "n_match", *[F.round(c, 3).alias(c) for c in ("shift", "scale", "var")])


@query("events_per_base", sql("signal pairs", "SELECT read_id, round((max(event_idx) - min(event_idx)) / count(*), 6) AS events_per_base FROM pairs GROUP BY read_id"))
def events_per_base(spark, sf):
    p = V.pairs(spark, sf)
    n = p.groupBy("read_id").agg(F.count("*").alias("n_kmers"))
    return scaling.events_per_base(p, n).withColumn("events_per_base", F.round("events_per_base", 6))


@query("event_z_scores", sql("signal kmer_ranks model", """SELECT s.read_id, s.i, round((v - (2.0 * level_mean + 5.0)) / (level_stdv * 1.5), 4) AS z,
  round(-0.918938 - ln(level_stdv * 1.5) - 0.5 * pow((v - (2.0 * level_mean + 5.0)) / (level_stdv * 1.5), 2), 2) AS log_prob,
  round((v - 5.0) / 2.0, 4) AS scaled
  FROM signal s JOIN kmer_ranks k ON s.read_id = k.read_id AND s.i = k.kmer_idx JOIN model ON rank = kmer_rank"""))
def event_z_scores(spark, sf):
    s = V.signal(spark, sf)
    ranks = V.kmer_ranks(spark, sf).withColumnRenamed("kmer_idx", "i")
    rows = kmers.join_model(s.join(ranks, ["read_id", "i"]), V.model(spark))
    args = (F.col("v").cast("double"), F.col("level_mean"), F.col("level_stdv"), F.lit(5.0), F.lit(2.0), F.lit(1.5))
    return rows.select("read_id", "i", F.round(stats.z_score(*args), 4).alias("z"),
                       F.round(stats.match_log_prob(*args), 2).alias("log_prob"),
                       F.round(stats.scaled_level(args[0], args[3], args[4]), 4).alias("scaled"))


# ---- alignments

_ALN = "alignments ops spans"


@query("mapped_quality_filter", sql("alignments", "SELECT aln_id, flag, mapq FROM alignments WHERE (flag & 4) = 0 AND mapq >= 20 AND (flag & 256) = 0"))
def mapped_quality_filter(spark, sf):
    return A.usable_alignments(V.alignments(spark, sf)).select("aln_id", "flag", "mapq")


@query("cigar_pairs", sql("alignments ops", """, placed AS (SELECT aln_id, j, len, op,
    pos + coalesce(sum(CASE WHEN op IN ('M','D','N','=') THEN len ELSE 0 END) OVER w, 0) AS r,
    coalesce(sum(CASE WHEN op IN ('M','I','S','=') THEN len ELSE 0 END) OVER w, 0) AS q,
    coalesce(sum(CASE WHEN op = 'N' THEN 1 ELSE 0 END) OVER w, 0) AS seg FROM ops
    WINDOW w AS (PARTITION BY aln_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  b AS (SELECT *, unnest(range(CAST(len AS BIGINT))) AS o FROM placed WHERE op IN ('M', '='))
  SELECT aln_id, CAST(seg AS INTEGER) AS segment, CAST(r + o AS INTEGER) AS ref_pos, CAST(q + o AS INTEGER) AS read_pos FROM b"""))
def cigar_pairs(spark, sf):
    return A.cigar_pairs(V.alignments(spark, sf))


@query("region_scan", sql(_ALN, "SELECT a.aln_id, pos, CAST(pos + span AS INTEGER) AS aln_end FROM alignments a JOIN spans s ON a.aln_id = s.aln_id WHERE contig = 'ctg3' AND pos < 5000 AND pos + span > 999"))
def region_scan(spark, sf):
    return A.region_filter(A.with_end(V.alignments(spark, sf)), "ctg3:1000-5000").select("aln_id", "pos", "aln_end")


_BED = "SELECT s_suppkey AS region_id, concat('ctg', s_suppkey % 6) AS contig, CAST((s_suppkey * 37) % 9000 AS INTEGER) AS beg, CAST((s_suppkey * 37) % 9000 + (s_suppkey * 11) % 700 AS INTEGER) AS e FROM supplier"


def _bed(spark, sf):
    k = F.col("s_suppkey")
    return V.table(spark, sf, "supplier").select(
        k.alias("region_id"), F.concat(F.lit("ctg"), (k % 6).cast("string")).alias("contig"),
        ((k * 37) % 9000).cast("int").alias("beg"),
        ((k * 37) % 9000 + (k * 11) % 700).cast("int").alias("end"))


@query("bed_overlap", sql(_ALN, f""", bed AS ({_BED}) SELECT region_id, a.aln_id FROM bed b JOIN alignments a ON a.contig = b.contig
  JOIN spans s ON s.aln_id = a.aln_id WHERE a.pos < b.e AND a.pos + span > greatest(b.beg - 1, 0)"""))
def bed_overlap(spark, sf):
    placed = A.with_end(V.alignments(spark, sf)).select("aln_id", "contig", "pos", "aln_end")
    return A.bed_overlap(A.by_place(placed), _bed(spark, sf), bin_size=512).select("region_id", "aln_id")


@query("bed_overlap_shuffled", sql(_ALN, f""", bed AS ({_BED}) SELECT region_id, count(*) AS n FROM bed b JOIN alignments a ON a.contig = b.contig
  JOIN spans s ON s.aln_id = a.aln_id WHERE a.pos < b.e AND a.pos + span > greatest(b.beg - 1, 0) GROUP BY region_id"""))
def bed_overlap_shuffled(spark, sf):
    """The same join with the broadcast turned off by its size check."""
    hits = A.bed_overlap(A.with_end(V.alignments(spark, sf)), _bed(spark, sf), bin_size=512, max_broadcast_rows=0)
    return hits.groupBy("region_id").agg(F.count("*").alias("n"))


_PLACED = """, refs AS (SELECT read_id, seq FROM reads),
  a AS (SELECT o_orderkey AS aln_id, o_custkey % (SELECT max(doc_id) + 1 FROM documents) AS contig, CAST((o_orderkey * 7) % 401 AS INTEGER) AS pos, CAST((o_orderkey * 7) % 401 + 20 + o_orderkey % 300 AS INTEGER) AS e FROM orders)"""


_SLICES = sql("reads", _PLACED + " SELECT aln_id, coalesce(substring(seq, pos + 1, e - pos + 1), '') AS ref FROM a LEFT JOIN refs ON contig = read_id")


def _on_documents(spark, sf):
    """Alignments whose reference contigs are the documents."""
    k = F.col("o_orderkey")
    contigs = V.table(spark, sf, "documents").agg((F.max("doc_id") + 1).alias("n"))
    return V.table(spark, sf, "orders").select(
        k.alias("aln_id"), (F.col("o_custkey") % contigs.scalar()).alias("contig"),
        ((k * 7) % 401).cast("int").alias("pos"), ((k * 7) % 401 + 20 + k % 300).cast("int").alias("aln_end"))


@query("reference_slices", _SLICES)
def reference_slices(spark, sf):
    ref = V.reads(spark, sf).withColumnRenamed("read_id", "contig")
    return A.with_reference(_on_documents(spark, sf), ref).select("aln_id", "ref")


@query("reference_slices_tiled", _SLICES)
def reference_slices_tiled(spark, sf):
    """The same slices put together from tiles, as done for a reference too large to broadcast."""
    ref = V.reads(spark, sf).withColumnRenamed("read_id", "contig")
    return A.with_reference(_on_documents(spark, sf), ref, tile=128, max_broadcast_bytes=0).select("aln_id", "ref")


@query("read_sequence_join", sql("reads", """SELECT o_orderkey AS aln_id, CAST(length(coalesce(seq, '')) AS INTEGER) AS read_length FROM orders LEFT JOIN reads ON o_custkey = read_id"""))
def read_sequence_join(spark, sf):
    joined = A.join_reads(V.alignments(spark, sf), V.reads(spark, sf))
    return joined.select("aln_id", F.length("seq").alias("read_length"))


@query("signal_join", sql("signal alignments", """, n AS (SELECT read_id, CAST(count(*) AS INTEGER) AS n_samples FROM signal GROUP BY read_id)
  SELECT aln_id, n_samples FROM alignments a JOIN n ON a.read_id = n.read_id WHERE (flag & 4) = 0 AND mapq >= 20 AND (flag & 256) = 0"""))
def signal_join(spark, sf):
    rows = A.join_signals(A.usable_alignments(V.alignments(spark, sf)), V.raw_arrays(spark, sf))
    return rows.select("aln_id", F.size("raw").alias("n_samples"))


@query("signal_prefilter", sql("signal alignments", """, n AS (SELECT read_id, CAST(count(*) AS INTEGER) AS n_samples, CAST(sum(v) AS BIGINT) AS total FROM signal GROUP BY read_id)
  SELECT aln_id, n.read_id, n_samples, total FROM alignments a JOIN n ON a.read_id = n.read_id
  WHERE (flag & 4) = 0 AND mapq >= 20 AND (flag & 256) = 0 AND contig = 'ctg3' AND pos < 2000"""))
def signal_prefilter(spark, sf):
    chosen = A.usable_alignments(V.alignments(spark, sf)).where("contig = 'ctg3' and pos < 2000")
    wanted = A.wanted_signals(V.raw_arrays(spark, sf), chosen.select("read_id"))
    return A.join_signals(chosen, wanted).select("aln_id", "read_id", F.size("raw").alias("n_samples"),
                                                 F.aggregate("raw", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"))


@query("ultra_long_split", sql("reads", "SELECT read_id, length(seq) > 5000 AS set_aside FROM reads"))
def ultra_long_split(spark, sf):
    kept, aside = A.split_ultra_long(V.reads(spark, sf), 5000)
    return kept.select("read_id", F.lit(False).alias("set_aside")).unionByName(
        aside.select("read_id", F.lit(True).alias("set_aside")))


# ---- lookups

def _nearest_sql(reach: int) -> str:
    return sql("signal base_map", f""", n AS (SELECT *, max(k_idx) OVER (PARTITION BY read_id) AS last FROM base_map),
    b AS (SELECT n.*, (SELECT arg_max(start_event, k_idx) FROM base_map m WHERE m.read_id = n.read_id AND m.start_event IS NOT NULL
             AND m.k_idx <= n.k_idx AND m.k_idx > greatest(0, n.k_idx - {reach})) AS before,
          (SELECT arg_min(start_event, k_idx) FROM base_map m WHERE m.read_id = n.read_id AND m.start_event IS NOT NULL
             AND m.k_idx >= n.k_idx AND m.k_idx < least(n.k_idx + {reach}, n.last)) AS after FROM n)
    SELECT read_id, k_idx, CAST(coalesce(before, after) AS INTEGER) AS event_idx FROM b""")


@query("nearest_event", _nearest_sql(1000))
def nearest_event(spark, sf):
    return nearest.nearest_event(V.base_map(spark, sf))


@query("nearest_event_short_reach", _nearest_sql(3))
def nearest_event_short_reach(spark, sf):
    return nearest.nearest_event(V.base_map(spark, sf), reach=3)


_PAIRS_ON_REF = "SELECT read_id, 2 * i + CAST(v % 2 AS INTEGER) AS ref_pos, i * 3 AS event_idx FROM signal"
_INTERVALS = "SELECT read_id, CAST(2 * i - 9 AS INTEGER) AS lo, CAST(2 * i + 11 + v % 5 AS INTEGER) AS hi FROM signal WHERE v % 4 = 0"


@query("reference_bounds", sql("signal", f""", p AS ({_PAIRS_ON_REF}), q AS (SELECT DISTINCT * FROM ({_INTERVALS})),
  r AS (SELECT q.*, (SELECT arg_min(event_idx, ref_pos) FROM p WHERE p.read_id = q.read_id AND ref_pos >= lo) AS e1,
    (SELECT arg_min(event_idx, ref_pos) FROM p WHERE p.read_id = q.read_id AND ref_pos >= hi) AS e2,
    (SELECT min(ref_pos) FROM p WHERE p.read_id = q.read_id) AS lowest FROM q)
  SELECT read_id, lo, hi, CAST(e1 AS INTEGER) AS e1, CAST(e2 AS INTEGER) AS e2 FROM r WHERE e1 IS NOT NULL AND e2 IS NOT NULL AND lowest <= lo"""))
def reference_bounds(spark, sf):
    s = V.signal(spark, sf)
    p = s.select("read_id", (2 * F.col("i") + F.col("v") % 2).cast("int").alias("ref_pos"),
                 (F.col("i") * 3).alias("event_idx"))
    q = s.where("v % 4 = 0").select("read_id", (2 * F.col("i") - 9).cast("int").alias("lo"),
                                    (2 * F.col("i") + 11 + F.col("v") % 5).cast("int").alias("hi"))
    return nearest.reference_bounds(q, p)


@query("aligned_events", sql("signal base_map", """, n AS (SELECT *, max(k_idx) OVER (PARTITION BY read_id) AS last FROM base_map),
  b AS (SELECT read_id, k_idx, coalesce((SELECT arg_max(start_event, k_idx) FROM base_map m WHERE m.read_id = n.read_id AND m.start_event IS NOT NULL AND m.k_idx <= n.k_idx AND m.k_idx > greatest(0, n.k_idx - 1000)),
     (SELECT arg_min(start_event, k_idx) FROM base_map m WHERE m.read_id = n.read_id AND m.start_event IS NOT NULL AND m.k_idx >= n.k_idx AND m.k_idx < least(n.k_idx + 1000, n.last))) AS event_idx FROM n),
  l AS (SELECT read_id, CAST(count(*) + 5 AS INTEGER) AS read_length FROM signal GROUP BY read_id),
  p AS (SELECT s.read_id, 500 + i AS ref_pos, i AS read_pos, s.read_id % 2 = 1 AS rc, read_length FROM signal s JOIN l ON s.read_id = l.read_id),
  x AS (SELECT p.read_id, ref_pos, event_idx FROM p JOIN b ON p.read_id = b.read_id AND b.k_idx = CASE WHEN rc THEN read_length - read_pos - 6 ELSE read_pos END
    WHERE read_pos >= 6 AND read_pos + 6 < read_length),
  y AS (SELECT *, first_value(event_idx) OVER (PARTITION BY read_id ORDER BY ref_pos) AS f, first_value(event_idx) OVER (PARTITION BY read_id ORDER BY ref_pos DESC) AS l FROM x)
  SELECT read_id, CAST(ref_pos AS INTEGER) AS ref_pos, CAST(event_idx AS INTEGER) AS event_idx FROM y WHERE f <> l"""))
def aligned_events(spark, sf):
    s = V.signal(spark, sf)
    lengths = s.groupBy("read_id").agg((F.count("*") + 5).cast("int").alias("read_length"))
    p = s.select("read_id", (F.lit(500) + F.col("i")).alias("ref_pos"), F.col("i").alias("read_pos"),
                 (F.col("read_id") % 2 == 1).alias("rc"))
    return nearest.aligned_events(p, nearest.nearest_event(V.base_map(spark, sf)), lengths, 6)


# ---- event rows

@query("eventalign_summary", sql("signal event_rows", """, m AS (SELECT *, ref_pos - lag(ref_pos) OVER (PARTITION BY read_id ORDER BY idx) AS move FROM event_rows)
  SELECT read_id, count(*) AS num_events, CAST(count(*) FILTER (move = 1) AS BIGINT) AS num_steps, CAST(count(*) FILTER (move > 1 OR move < 0) AS BIGINT) AS num_skips,
    CAST(count(*) FILTER (move = 0) AS BIGINT) AS num_stays, CAST(count(*) AS BIGINT) AS total_samples, CAST(sum(CASE WHEN state = 'M' THEN v ELSE 0 END) AS BIGINT) AS sum_z FROM m GROUP BY read_id"""))
def eventalign_summary(spark, sf):
    return eventrows.alignment_summary(V.event_rows(spark, sf).withColumn("z", F.col("v")))


@query("collapse_events", sql("signal event_rows", """, c AS (SELECT *, CASE WHEN ref_pos = lag(ref_pos) OVER (PARTITION BY read_id ORDER BY idx) THEN 0 ELSE 1 END AS fresh FROM event_rows),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY idx) AS island FROM c),
  r AS (SELECT read_id, island, min(ref_pos) AS ref_pos, count(*) AS n, arg_min(event_idx, idx) AS event_idx, least(arg_min(event_idx, idx), arg_max(event_idx, idx)) AS a,
      greatest(arg_min(event_idx, idx), arg_max(event_idx, idx)) + 1 AS b, arg_min(v, idx) AS own FROM g GROUP BY read_id, island)
  SELECT r.read_id, ref_pos, n, event_idx, a AS start_idx, b AS end_idx, round(CASE WHEN n > 1 THEN avg(s.v) ELSE CAST(any_value(own) AS DOUBLE) END, 4) AS event_mean,
    round(CASE WHEN n > 1 THEN stddev_pop(s.v) ELSE 0.5 END, 3) AS event_stdv FROM r JOIN signal s ON s.read_id = r.read_id AND s.i >= a AND s.i < b
    GROUP BY r.read_id, island, ref_pos, n, event_idx, a, b"""))
def collapse_events(spark, sf):
    rows = V.event_rows(spark, sf).withColumn("mean", F.col("v").cast("double")).withColumn("stdv", F.lit(0.5))
    out = eventrows.collapse_events(rows, V.raw_arrays(spark, sf))
    return out.withColumn("event_mean", F.round("event_mean", 4)).withColumn("event_stdv", F.round("event_stdv", 3))


@query("event_cigar", sql("signal event_rows", """, st AS (SELECT read_id, idx, event_idx, abs(ref_pos - lag(ref_pos) OVER (PARTITION BY read_id ORDER BY idx)) AS r FROM event_rows),
  o AS (SELECT read_id, idx, unnest(CASE WHEN r IS NULL AND event_idx > 0 THEN [event_idx, 1] WHEN r IS NULL OR r = 1 THEN [1] WHEN r > 1 THEN [r - 1, 1] ELSE [1] END) AS len,
      unnest(CASE WHEN r IS NULL AND event_idx > 0 THEN ['S', 'M'] WHEN r IS NULL OR r = 1 THEN ['M'] WHEN r > 1 THEN ['D', 'M'] ELSE ['I'] END) AS op,
      unnest(CASE WHEN (r IS NULL AND event_idx > 0) OR r > 1 THEN [0, 1] ELSE [0] END) AS sub FROM st),
  c AS (SELECT *, CASE WHEN op = lag(op) OVER (PARTITION BY read_id ORDER BY idx, sub) THEN 0 ELSE 1 END AS fresh FROM o),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY idx, sub) AS run FROM c),
  t AS (SELECT read_id, run, concat(CAST(sum(len) AS BIGINT), any_value(op)) AS part FROM g GROUP BY read_id, run)
  SELECT read_id, string_agg(part, '' ORDER BY run) AS event_cigar FROM t GROUP BY read_id"""))
def event_cigar(spark, sf):
    return eventrows.event_cigars(V.event_rows(spark, sf))


@query("status_counts", sql("signal", """, r AS (SELECT read_id, CAST(sum(v) % 4 AS INTEGER) AS k, CAST(1000 + read_id % 50 AS BIGINT) AS len FROM signal GROUP BY read_id),
  s AS (SELECT CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 0 END AS status, len FROM r)
  SELECT status, count(*) AS n_reads, CAST(sum(len) AS BIGINT) AS bases FROM s GROUP BY status"""))
def status_counts(spark, sf):
    return quality.status_counts(_statuses(spark, sf))


def _statuses(spark, sf):
    reads = V.signal(spark, sf).groupBy("read_id").agg((F.sum("v") % 4).cast("int").alias("k"))
    k = F.col("k")
    status = quality.read_status(
        F.when(k == 0, 0).otherwise(150), F.lit(300), F.when(k == 1, 3.0).otherwise(1.2),
        F.when(k == 2, 6.0).otherwise(2.0))
    return reads.select("read_id", status.alias("status"), (1000 + F.col("read_id") % 50).alias("read_length"))


@query("run_counters", sql("signal", """, r AS (SELECT read_id, CAST(sum(v) % 4 AS INTEGER) AS k, CAST(1000 + read_id % 50 AS BIGINT) AS len FROM signal GROUP BY read_id)
  SELECT count(*) AS total_reads, count(*) FILTER (k = 1) AS failed_calibration, count(*) FILTER (k = 0) AS failed_alignment, count(*) FILTER (k = 2) AS failed_quality,
    CAST(sum(len) AS BIGINT) AS total_bases FROM r"""))
def run_counters(spark, sf):
    return quality.run_counters(_statuses(spark, sf))


@query("over_segmented", sql("reads", """, e AS (SELECT event_id // 100 AS read_id, count(*) * 10 AS n_events FROM events GROUP BY 1)
  SELECT r.read_id, coalesce(coalesce(n_events, 0) / nullif(length(seq), 0) < 15.0, false) AS alignable FROM reads r LEFT JOIN e ON r.read_id = e.read_id"""))
def over_segmented(spark, sf):
    n = V.signal(spark, sf).groupBy("read_id").agg((F.count("*") * 10).alias("n_events"))
    rows = V.reads(spark, sf).join(n, "read_id", "left")
    return rows.select("read_id", quality.alignable(F.coalesce("n_events", F.lit(0)), F.length("seq")).alias("alignable"))


# ---- read index

_SUMMARY = "SELECT o_orderkey AS read_id, concat('batch_', o_custkey % 40, '.fast5') AS filename FROM orders"
_LISTING = "SELECT concat('/runs/', s_suppkey % 4, '/batch_', s_suppkey % 50, '.fast5') AS path FROM supplier"


def _summary(spark, sf):
    return V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("read_id"),
        F.concat(F.lit("batch_"), (F.col("o_custkey") % 40).cast("string"), F.lit(".fast5")).alias("filename"))


def _listing(spark, sf):
    return V.table(spark, sf, "supplier").select(F.concat(
        F.lit("/runs/"), (F.col("s_suppkey") % 4).cast("string"), F.lit("/batch_"),
        (F.col("s_suppkey") % 50).cast("string"), F.lit(".fast5")).alias("path"))


@query("summary_join", f"""WITH s AS ({_SUMMARY}), l AS ({_LISTING}), known AS (SELECT DISTINCT l_orderkey AS read_id FROM lineitem WHERE l_linenumber = 3)
  SELECT s.read_id, l.path AS signal_path FROM s JOIN known ON known.read_id = s.read_id JOIN l ON regexp_extract(l.path, '[^/]*$') = s.filename""")
def summary_join(spark, sf):
    known = V.table(spark, sf, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("read_id"))
    return readindex.paths_from_summary(_summary(spark, sf), _listing(spark, sf), known)


@query("read_index", f"""WITH k AS (SELECT l_orderkey AS read_id, concat('f', min(l_suppkey)) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
  SELECT o_orderkey AS read_id, coalesce(p, '') AS signal_path FROM orders LEFT JOIN k ON o_orderkey = k.read_id""")
def read_index(spark, sf):
    return _index(spark, sf)


def _index(spark, sf):
    known = V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(
        F.col("l_orderkey").alias("read_id")).agg(F.concat(F.lit("f"), F.min("l_suppkey").cast("string")).alias("signal_path"))
    reads = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"))
    return readindex.signal_paths(reads, known)


@query("index_statistics", f"""SELECT count(*) AS n_reads, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN o_orderkey END) AS n_with_path
  FROM (SELECT DISTINCT o_orderkey, CASE WHEN l_returnflag = 'R' THEN 'R' END AS l_returnflag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def index_statistics(spark, sf):
    return readindex.index_statistics(_index(spark, sf))


@query("file_mode_filter", """WITH e AS (SELECT concat('f', l_suppkey) AS filename, count(*) AS n_reads FROM lineitem GROUP BY 1),
  d AS (SELECT n_reads, count(*) AS files FROM e GROUP BY 1), m AS (SELECT n_reads, files FROM d ORDER BY files DESC, n_reads LIMIT 1)
  SELECT filename, n_reads, n_reads > (SELECT CASE WHEN files > 2 THEN n_reads ELSE 4000 END FROM m) AS dropped FROM e""")
def file_mode_filter(spark, sf):
    entries = V.table(spark, sf, "lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("filename"))
    return readindex.files_over_mode(entries, trust_above=2)


@query("unique_reads", """SELECT o_custkey AS read_id, min(o_orderkey) AS ordinal, arg_min(o_totalprice, o_orderkey) AS payload FROM orders GROUP BY 1""")
def unique_reads(spark, sf):
    reads = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("read_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_totalprice").alias("payload"))
    return readindex.unique_reads(reads)


@query("fasta_comment_paths", """SELECT doc_id, CASE WHEN ends_with(c, '.fast5') THEN list_extract(string_split(c, ' '), -1) END AS path FROM
  (SELECT doc_id, concat(source, ' ch=', n_chars, ' ', lang, CASE WHEN doc_id % 3 = 0 THEN '.fast5' ELSE '.txt' END) AS c FROM documents)""")
def fasta_comment_paths(spark, sf):
    comment = F.concat(F.col("source"), F.lit(" ch="), F.col("n_chars").cast("string"), F.lit(" "), F.col("lang"),
                       F.when(F.col("doc_id") % 3 == 0, ".fast5").otherwise(".txt"))
    return V.table(spark, sf, "documents").select("doc_id", S.fast5_path_from_comment(comment).alias("path"))


# ---- resquiggle rows

def _intervals(spark, sf):
    """k-mer intervals of each read: every fourth value leaves its k-mer without signal."""
    keep = F.col("v") % 4 != 0
    at = F.struct(F.when(keep, 10 * F.col("i") + F.col("v") % 3).alias("start"),
                  F.when(keep, 10 * F.col("i") + 5 + F.col("v") % 6).alias("end"))
    rows = V.signal(spark, sf).groupBy("read_id").agg(
        F.array_sort(F.collect_list(F.struct("i", at.alias("s")))).alias("x"))
    return rows.select("read_id", F.lit(1000).alias("n_samples"), F.lit(1.5).alias("scale"), F.lit(0.5).alias("shift"),
                       F.transform("x", lambda r: r["s"]).alias("intervals"))


_KMER_INTERVALS = """, k AS (SELECT read_id, i AS j, CASE WHEN v % 4 <> 0 THEN 10 * i + v % 3 END AS a, CASE WHEN v % 4 <> 0 THEN 10 * i + 5 + v % 6 END AS b FROM signal)"""


@query("resquiggle_rows", sql("signal", _KMER_INTERVALS + " SELECT read_id, CAST(j AS INTEGER) AS kmer_idx, a AS start_raw_idx, b AS end_raw_idx FROM k"))
def resquiggle_rows(spark, sf):
    return resquiggle.kmer_rows(_intervals(spark, sf))


_PAF = """, m AS (SELECT read_id, j, a, b, lag(j) OVER w AS pj, lag(b) OVER w AS pb FROM k WHERE a IS NOT NULL WINDOW w AS (PARTITION BY read_id ORDER BY j)),
  t AS (SELECT *, coalesce(j - pj - 1, 0) AS d, a - coalesce(pb, CASE WHEN j = 0 THEN a ELSE 0 END) AS g FROM m),
  s AS (SELECT read_id, arg_min(a, j) AS signal_start, arg_max(b, j) AS signal_end, min(j) AS f, max(j) AS l, count(*) FILTER (a <> b) AS matches,
    string_agg(concat(CASE WHEN d > 0 THEN concat(d, 'D') ELSE '' END, CASE WHEN g <> 0 THEN concat(g, 'I') ELSE '' END, CASE WHEN a <> b THEN concat(b - a, ',') ELSE '' END), '' ORDER BY j) AS ss FROM t GROUP BY read_id),
  n AS (SELECT read_id, count(*) AS n FROM k GROUP BY read_id)"""


@query("resquiggle_paf", sql("signal", _KMER_INTERVALS + _PAF + """ SELECT s.read_id, 1000 AS n_samples, signal_start, signal_end, CAST(n AS INTEGER) AS n_kmers, CAST(f AS INTEGER) AS kmer_start,
  CAST(l + 1 AS INTEGER) AS kmer_end, CAST(matches AS INTEGER) AS matches, 1.5 AS scale, 0.5 AS shift, ss FROM s JOIN n ON s.read_id = n.read_id"""))
def resquiggle_paf(spark, sf):
    return resquiggle.paf_rows(_intervals(spark, sf))


@query("resquiggle_paf_rna", sql("signal", _KMER_INTERVALS + _PAF + """ SELECT s.read_id, CAST(n - f AS INTEGER) AS kmer_start, CAST(n - 1 - l AS INTEGER) AS kmer_end, ss
  FROM s JOIN n ON s.read_id = n.read_id"""))
def resquiggle_paf_rna(spark, sf):
    return resquiggle.paf_rows(_intervals(spark, sf), rna=True).select("read_id", "kmer_start", "kmer_end", "ss")


@query("eventalign_tsv", sql("signal event_rows model", """SELECT idx, e.read_id, concat_ws(chr(9), 'ctg', ref_pos, e.read_id, 't', event_idx, printf('%.2f', v / 1.0), printf('%.3f', 0.5), printf('%.5f', 7 / 4000.0),
    printf('%.2f', CASE WHEN state = 'B' THEN 0.0 ELSE 1.5 * level_mean + 4.0 END), printf('%.2f', CASE WHEN state = 'B' THEN 0.0 ELSE level_stdv * 4.0 END)) AS line
  FROM event_rows e JOIN model ON rank = kmer_rank"""))
def eventalign_tsv(spark, sf):
    rows = kmers.join_model(V.event_rows(spark, sf), V.model(spark))
    bad = F.col("state") == "B"
    mean = F.when(bad, 0.0).otherwise(1.5 * F.col("level_mean") + 4.0)
    stdv = F.when(bad, 0.0).otherwise(F.col("level_stdv") * 4.0)
    return rows.select("idx", "read_id", F.concat_ws(
        "\t", F.lit("ctg"), "ref_pos", "read_id", F.lit("t"), "event_idx", stats.fixed(F.col("v"), 2),
        stats.fixed(F.lit(0.5), 3), stats.fixed(F.lit(7) / F.lit(4000.0), 5),
        stats.fixed(mean, 2), stats.fixed(stdv, 2)).alias("line"))
