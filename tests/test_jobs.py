"""The jobs from raw signal to output on a small made-up genome with known methylation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.functions.values import parse_region
from sigspark.kernels.calibrate import PoreModel
from sigspark.kernels.reference import reverse_complement
from sigspark.operators import alignments as A, frequency, squiggle
from sigspark.options import Options
from sigspark.plans import jobs
from sigspark.sources import tsv
from sigspark.streaming import frequencies

RNG = np.random.default_rng(11)
LEVELS = RNG.permutation(np.linspace(60, 125, 4096)).astype(np.float32)
SHIFT = 6.0


def models():
    plain = PoreModel(6, "ACGT", LEVELS, np.full(4096, 1.5, np.float32))
    ranks = np.arange(5 ** 6)
    digits = np.stack([ranks // 5 ** (5 - i) % 5 for i in range(6)], 1)
    base = np.array([0, 1, 2, 1, 3])[digits]            # M reads as C
    level = LEVELS[(base * 4 ** np.arange(5, -1, -1)).sum(1)] + SHIFT * (digits == 3).any(1)
    return plain, PoreModel(6, "ACGMT", level.astype(np.float32), np.full(5 ** 6, 1.5, np.float32))


def genome():
    seq = "".join(RNG.choice(list("ACGT"), 1600))
    seq = seq.replace("CG", "CA")
    for at in range(150, 1450, 60):
        seq = seq[:at] + "CG" + seq[at + 2:]
    return seq


GENOME = genome()
PLAIN, MARKED = models()
# (read, start, end, reverse strand, methylated)
READS = [("r0", 20, 820, False, True), ("r1", 60, 900, False, False), ("r2", 300, 1200, True, True),
         ("r3", 500, 1500, True, False), ("r4", 100, 1300, False, True)]


def inputs(spark):
    reads, signals, alignments, truth = [], [], [], {}
    for i, (name, a, b, rc, methylated) in enumerate(READS):
        seq = reverse_complement(GENOME[a:b]) if rc else GENOME[a:b]
        level = (MARKED.level_mean[MARKED.ranks(seq.replace("CG", "MG"))] if methylated
                 else PLAIN.level_mean[PLAIN.ranks(seq)])
        counts = RNG.integers(7, 15, len(level))
        current = np.repeat(level, counts) * 1.01 + 2 + RNG.normal(0, 0.8, counts.sum())
        raw = np.clip(np.round(current / (1400 / 8192) - 5), -32768, 32767).astype(int)
        reads.append((name, seq))
        signals.append((name, raw.tolist(), 8192.0, 5.0, 1400.0, 4000.0))
        alignments.append((i, name, 16 if rc else 0, "chr", a, 60, f"{b - a}M", 3))
        truth[name] = np.cumsum(counts) - counts
    extra = [(5, "r0", 256, "chr", 20, 60, "800M", 0), (6, "r1", 4, "*", -1, 0, "*", 0), (7, "r9", 0, "chr", 0, 60, "50M", 0)]
    reads.append(("r9", "A" * 50))
    return (spark.createDataFrame(reads, "read_id string, seq string"),
            spark.createDataFrame(alignments + extra, "aln_id long, read_id string, flag int, contig string, pos int, mapq int, cigar string, nm int"),
            spark.createDataFrame(signals, "read_id string, raw array<smallint>, digitisation double, offset double, range double, sampling_rate double"),
            spark.createDataFrame([("chr", GENOME)], "contig string, seq string"), truth)


@pytest.fixture(scope="module")
def data(spark):
    return inputs(spark)


def plain_table(spark):
    return spark.createDataFrame(pd.DataFrame({"rank": np.arange(4096, dtype=np.int32), "level_mean": LEVELS,
                                               "level_stdv": np.full(4096, 1.5, np.float32)}))


def test_methylation_calls(spark, data, tmp_path):
    reads, alignments, signals, reference, _ = data
    calls = jobs.call_methylation(reads, alignments, signals, reference, PLAIN, MARKED).cache()
    frame = calls.toPandas()
    methylated = {n: m for n, *_, m in READS}
    right = [(row.log_lik_ratio > 0) == methylated[row.read_name] for row in frame.itertuples()]
    assert len(frame) > 50 and np.mean(right) > 0.97
    assert set(frame.read_name) == set(methylated)
    for row in frame.itertuples():
        assert row.sequence == GENOME[row.start - 5:row.end + 6]
        assert row.num_cpgs == GENOME[row.start:row.end + 2].count("CG")
        assert row.strand == ("-" if row.read_name in ("r2", "r3") else "+")
    # the same calls from a reference that is tiled instead of broadcast, and inside a window
    tiled = jobs.call_methylation(reads, alignments, signals, reference, PLAIN, MARKED,
                                  Options(max_broadcast_bytes=0, reference_tile=100)).toPandas()
    key = ["read_name", "start"]
    pd.testing.assert_frame_equal(frame.sort_values(key).reset_index(drop=True), tiled.sort_values(key).reset_index(drop=True))
    window = jobs.call_methylation(reads, alignments, signals, reference, PLAIN, MARKED, Options(region="chr:401-700")).toPandas()
    assert len(window) and window.start.min() >= 400 and window.end.max() < 700
    # calls as files: frequencies in one go, merged from parts, and as a stream
    lines = str(tmp_path / "calls")
    numbered = calls.repartition(3)
    tsv.write_lines(numbered, tsv.call_lines(2), tsv.CALL_COLUMNS_V2, lines)
    read = tsv.read_calls(spark, lines)
    assert read.count() == len(frame)
    columns = ["chromosome", "start", "end", "called_sites", "called_sites_methylated", "methylated_frequency"]
    whole = [tuple(r) for r in jobs.meth_freq(read).select(*columns).collect()]
    parts = [jobs.meth_freq(read.where(F.pmod(F.hash("read_name"), F.lit(2)) == i)) for i in range(2)]
    assert [tuple(r) for r in jobs.freq_merge(parts).select(*columns).collect()] == whole
    stream = frequencies.call_stream(spark, lines, files_per_trigger=1)
    partials = str(tmp_path / "partials")
    frequencies.append_partials(stream, partials, str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in frequencies.merged(spark, partials).select(*columns).collect()) == sorted(whole)
    running = frequencies.running_frequency(frequencies.call_stream(spark, lines, files_per_trigger=1))
    q = (running.select(*columns).writeStream.outputMode("complete").format("memory").queryName("running")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("running").collect()) == sorted(whole)


def test_status_and_counters(spark, data):
    reads, _, signals, _, _ = data
    short = reads.where("read_id = 'r0'").select(F.lit("r8").alias("read_id"), F.substring("seq", 1, 120).alias("seq"))
    piece = signals.where("read_id = 'r0'").withColumn("read_id", F.lit("r8")).withColumn("raw", F.slice("raw", 1, 1200))
    wrong = reads.where("read_id = 'r0'").select(F.lit("r7").alias("read_id"), F.repeat(F.lit("ACGGT"), 30).alias("seq"))
    noise = signals.where("read_id = 'r4'").withColumn("read_id", F.lit("r7"))
    rows = jobs.squiggles(reads.unionByName(short).unionByName(wrong), signals.unionByName(piece).unionByName(noise), PLAIN, Options()).cache()
    status = {r.read_id: r.status for r in rows.collect()}
    assert status["r8"] == 1 and status["r7"] == 2 and all(status[f"r{i}"] == 0 for i in range(5))
    totals = jobs.counters(rows).first()
    assert (totals.total_reads, totals.failed_calibration, totals.failed_alignment) == (7, 1, 1)


def test_strict_mode_fails_on_missing_signals(data):
    reads, alignments, signals, reference, _ = data
    with pytest.raises(Exception, match="no readable signal"):
        jobs.squiggles(reads, signals, PLAIN, Options(skip_unreadable=False)).collect()


def test_event_rows_and_outputs(spark, data):
    reads, alignments, signals, reference, truth = data
    aligned = jobs.event_alignment(reads, alignments, signals, reference, PLAIN)
    rows = jobs.event_rows(aligned, plain_table(spark), 6).cache()
    frame = rows.toPandas()
    assert set(frame.read_id) == {f"r{i}" for i in range(5)}
    for name, a, b, rc, _ in READS:
        mine = frame[(frame.read_id == name) & (frame.state == "M")]
        n = b - a - 5
        index = (n - 1 - (mine.ref_pos - a)) if rc else mine.ref_pos - a
        off = np.abs(truth[name][index.to_numpy()] - mine.start.to_numpy())
        assert np.median(off) < 12 and len(mine) > 0.6 * n
    assert (frame[frame.state == "M"].apply(lambda r: GENOME[r.ref_pos:r.ref_pos + 6] == r.reference_kmer, axis=1)).all()
    rc = frame[(frame.read_id == "r2") & (frame.state == "M")].iloc[0]
    assert rc.model_kmer == reverse_complement(rc.reference_kmer)
    # printed tables
    opts = Options(read_names=True, signal_index=True, samples=True)
    raw = jobs.picoamps(signals, alignments)
    table = jobs.event_table(rows, opts, raw)
    columns = tsv.eventalign_columns(True, True, True)
    line = table.orderBy("aln_id", "idx").select(tsv.eventalign_lines(columns).alias("l")).first().l.split("\t")
    assert len(line) == len(columns) == 16 and line[0] == "chr" and len(line[-1].split(",")) == int(line[14]) - int(line[13])
    collapsed = jobs.event_table(rows, Options(collapse=True), raw).toPandas().sort_values(["aln_id", "idx"])
    assert len(collapsed) < len(frame)
    assert (collapsed.groupby("aln_id").position.apply(lambda p: (p.diff() != 0).all())).all()
    scaled = jobs.event_table(rows, Options(scale_events=True)).toPandas()
    plain = jobs.event_table(rows).toPandas()
    both = scaled.merge(plain, on=["aln_id", "idx"])
    ok = both.model_kmer_x != "NNNNNN"
    assert (both[ok].model_mean_x - both[ok].model_mean_y).abs().max() > 0.5
    # summary and SAM
    summary = jobs.event_summary(rows, alignments, reads.select("read_id", F.lit("p").alias("signal_path"))).toPandas()
    counts = frame.groupby("aln_id").size()
    for r in summary.itertuples():
        assert r.num_events == counts[r.read_index] == r.num_steps + r.num_skips + r.num_stays + 1
    assert summary["var"].between(0.1, 2.5).all() and set(summary.strand) == {"template"}
    sam = {r.line.split("\t")[0]: r.line.split("\t") for r in jobs.event_sam(rows, alignments).collect()}
    assert sam["r2.template"][1] == "16" and sam["r2.template"][-1] == "ES:i:-1" and sam["r0.template"][-1] == "ES:i:1"


def test_resquiggle(spark, data):
    reads, _, signals, _, truth = data
    rows = jobs.resquiggle(reads, signals, PLAIN).toPandas()
    for name, a, b, _, _ in READS:
        mine = rows[rows.read_id == name].sort_values("kmer_idx")
        assert len(mine) == b - a - 5
        known = mine.dropna()
        assert (known.end_raw_idx > known.start_raw_idx).all()
        assert np.median(np.abs(truth[name][known.kmer_idx.to_numpy()] - known.start_raw_idx)) <= 4
    paf = jobs.resquiggle(reads, signals, PLAIN, paf=True)
    for r in paf.collect():
        import re
        used = sum(int(n) for n in re.findall(r"(\d+),", r.ss)) + sum(int(n) for n in re.findall(r"(\d+)I", r.ss))
        assert r.kmer_start > 0 or used == r.signal_end - r.signal_start
        skipped = sum(int(n) for n in re.findall(r"(\d+)D", r.ss))
        assert r.ss.count(",") + skipped == r.kmer_end - r.kmer_start
    line = paf.select(tsv.paf_lines().alias("l")).first().l.split("\t")
    assert line[4] == "+" and line[11] == "255" and line[12].startswith("sc:f:") and line[14].startswith("ss:Z:")


def test_index(spark):
    reads = spark.createDataFrame([("b", 1), ("a", 0), ("c", 2), ("a", 3)], "read_id string, ordinal long")
    summary = spark.createDataFrame([("a", "f1.fast5"), ("c", "f2.fast5"), ("x", "f1.fast5")], "read_id string, filename string")
    listing = spark.createDataFrame([("/d/e/f1.fast5",), ("/d/f3.fast5",)], "path string")
    out = [tuple(r) for r in jobs.index(reads, [summary], listing).collect()]
    assert out == [("a", "/d/e/f1.fast5"), ("b", ""), ("c", "")]
    assert [tuple(r) for r in jobs.index(reads, [], listing).collect()] == [("a", ""), ("b", ""), ("c", "")]


def test_batches_and_partitions_do_not_matter(spark, data):
    reads, _, signals, _, _ = data
    def run():
        return jobs.squiggles(reads, signals, PLAIN, Options()).select("read_id", "n_pairs", "shift", "scale", "var").orderBy("read_id").collect()
    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_signals_move_once(spark, data):
    reads, alignments, signals, reference, _ = data
    spark.catalog.clearCache()      # a cached plan would be shown with its own exchanges
    calls = jobs.call_methylation(reads, alignments, signals, reference, PLAIN, MARKED)
    text = calls._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(read_id") == text.count("Exchange hashpartitioning") == 3
    assert text.index("MapInArrow") < text.index("Exchange hashpartitioning")     # every stage sits above them
    bucketed = jobs.call_methylation(reads, alignments, signals, reference, PLAIN, MARKED, Options(colocated=True))
    assert "REPARTITION" not in bucketed._jdf.queryExecution().executedPlan().toString()


def test_unwanted_signals_do_not_move(spark, data):
    ids = spark.range(200_000).select(F.concat(F.lit("read-"), "id").alias("read_id"), F.lit(1).alias("raw"))
    wanted = ids.where("substring(read_id, -1) = '7'").select("read_id")
    repeated = wanted.union(wanted.limit(50)).union(spark.sql("select cast(null as string)"))
    kept = A.wanted_signals(ids, repeated)
    assert kept.columns == ids.columns and kept.join(wanted, "read_id", "left_semi").count() == 20_000
    assert kept.count() - 20_000 < 0.02 * 180_000
    assert A.wanted_signals(ids, wanted.limit(0)).count() == 0
    assert A.wanted_signals(ids, wanted, max_filter_bytes=0) is ids
    reads, alignments, signals, reference, _ = data
    spark.catalog.clearCache()
    few = jobs.call_methylation(reads, alignments, signals, reference, PLAIN, MARKED, Options(region="chr:20-280"))
    text = few._jdf.queryExecution().optimizedPlan().toString()
    moved = text[text.rindex("RepartitionByExpression"):]       # the last one is that of the signals
    assert "bitmap_construct_agg" in moved and "strategy=broadcast" in moved and "raw" in moved
    whole = jobs.call_methylation(reads, alignments, signals, reference, PLAIN, MARKED)
    inside = frequency.clip_to_window(whole, *parse_region("chr:20-280")[1:])
    found = sorted(few.collect())
    assert len({r["read_name"] for r in found}) == 3 and found == sorted(inside.collect())


def write_inputs(spark, data, folder):
    from sigspark.sources import slow5
    reads, alignments, signals, _, _ = data
    (folder / "reads.fa").write_text("".join(f">{r.read_id} x\n{r.seq}\n" for r in reads.collect()))
    (folder / "genome.fa").write_text(f">chr\n{GENOME[:700]}\n{GENOME[700:]}\n")
    sam = ["@SQ\tSN:chr\tLN:1600"] + [
        f"{r.read_id}\t{r.flag}\t{r.contig}\t{r.pos + 1}\t{r.mapq}\t{r.cigar}\t*\t0\t0\t*\t*\tNM:i:{r.nm}"
        for r in alignments.orderBy("aln_id").collect()]
    (folder / "aln.sam").write_text("\n".join(sam) + "\n")
    records = signals.select("read_id", F.lit(0).alias("read_group"), "digitisation", "offset", "range", "sampling_rate",
                             F.size("raw").cast("long").alias("len_raw_signal"), F.col("raw").alias("raw_signal"))
    slow5.write_blow5(records, str(folder / "blow5"))
    for name, model in (("dna", PLAIN), ("cpg", MARKED)):
        letters = np.array(list(model.letters))
        digits = np.arange(len(model.level_mean))[:, None] // len(letters) ** np.arange(5, -1, -1) % len(letters)
        lines = ["".join(letters[d]) + f"\t{m:.9g}\t{s:.9g}\t0\t0\t0" for d, m, s in zip(digits, model.level_mean, model.level_stdv)]
        (folder / f"{name}.model").write_text("#k\t6\n" + "\n".join(lines) + "\n")


def lines_of(path):
    out = []
    for part in sorted(p for p in path.iterdir() if p.name.startswith("part-")):
        out += part.read_text().splitlines()
    return out


def test_command_line(spark, data, tmp_path):
    from sigspark.__main__ import parser, run
    write_inputs(spark, data, tmp_path)
    at = lambda name: str(tmp_path / name)
    common = ["--reads", at("reads.fa"), "--alignments", at("aln.sam"), "--signals", at("blow5"), "--genome", at("genome.fa"),
              "--kmer-model", at("dna.model")]
    go = lambda *a: run(parser().parse_args(list(a)))
    go("call-methylation", *common, "--meth-model", at("cpg.model"), "-o", at("calls"))
    calls = [x.split("\t") for x in lines_of(tmp_path / "calls") if not x.startswith("chromosome")]
    reads, alignments, signals, reference, _ = data
    direct = jobs.call_methylation(reads, alignments, signals, reference, PLAIN, MARKED)
    known = {r[0] for r in direct.select(tsv.call_lines(2)).collect()}
    assert {"\t".join(c) for c in calls} == known
    go("meth-freq", "--input", at("calls"), "-o", at("freq"))
    freq = lines_of(tmp_path / "freq")
    assert freq[0].split("\t") == tsv.FREQUENCY_COLUMNS and len(freq) > 10
    go("freq-merge", at("freq"), at("freq"), "-o", at("twice"))
    once, twice = ([x.split("\t") for x in lines_of(tmp_path / n) if not x.startswith("chromosome")] for n in ("freq", "twice"))
    assert [2 * int(x[4]) for x in once] == [int(x[4]) for x in twice] and [x[6] for x in once] == [x[6] for x in twice]
    go("eventalign", *common, "--signal-index", "--summary", at("summary"), "-o", at("events"))
    events = [x.split("\t") for x in lines_of(tmp_path / "events")]
    assert events[0] == tsv.eventalign_columns(signal_index=True) and all(len(e) == 15 for e in events)
    summary = [x for x in lines_of(tmp_path / "summary") if not x.startswith("read_index")]
    assert len(summary) == 5 and all(len(x.split("\t")) == 14 for x in summary)
    go("eventalign", *common, "--sam", "-o", at("sam"))
    assert len(lines_of(tmp_path / "sam")) == 5
    go("resquiggle", "--reads", at("reads.fa"), "--signals", at("blow5"), "--kmer-model", at("dna.model"), "-c", "-o", at("paf"))
    assert len(lines_of(tmp_path / "paf")) == 5
    (tmp_path / "fast5" / "sub").mkdir(parents=True)
    (tmp_path / "fast5" / "sub" / "b.fast5").write_bytes(b"x")
    (tmp_path / "sum.tsv").write_text("filename\tread_id\nb.fast5\tr1\n")
    go("index", "--reads", at("reads.fa"), "--signals", at("fast5"), "--summary", at("sum.tsv"), "-o", at("readdb"))
    index = dict(x.split("\t") for x in lines_of(tmp_path / "readdb"))
    assert index["r1"].endswith("sub/b.fast5") and index["r0"] == "" and len(index) == 6
