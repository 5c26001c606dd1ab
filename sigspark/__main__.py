"""Command line: ``python -m sigspark VERB ...`` (or the same file under spark-submit)."""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import SparkSession, functions as F

from sigspark.functions.values import parse_count
from sigspark.operators import alignments as A
from sigspark.operators import readindex, squiggle
from sigspark.options import Options
from sigspark.plans import jobs
from sigspark.sources import bam, fastq, sequences, slow5, tsv


def session() -> SparkSession:
    """Signals make wide rows, so batches between Spark and Python hold few of them."""
    return (SparkSession.builder.appName("sigspark").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.maxRecordsPerBatch", "128").getOrCreate())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sigspark")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *files: str) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        for f in files:
            p.add_argument(f"--{f}", required=True)
        p.add_argument("--output", "-o", required=True)
        return p

    p = verb("index", "reads", "signals")
    p.add_argument("--summary", action="append", default=[])
    p.add_argument("--summary-list")
    p.add_argument("--slow5", action="store_true", help="index the records of binary signal files")
    p = verbs.add_parser("index-alignments")
    p.add_argument("--alignments", required=True)
    for name in ("call-methylation", "eventalign"):
        p = verb(name, "reads", "alignments", "signals", "genome", "kmer-model")
        p.add_argument("--meth-model")
        p.add_argument("--min-mapq", type=int, default=20)
        p.add_argument("--secondary", choices=("yes", "no"), default="no")
        p.add_argument("--skip-unreadable", choices=("yes", "no"), default="yes")
        p.add_argument("--window", "-w")
        p.add_argument("--rna", action="store_true")
        p.add_argument("--skip-ultra")
        p.add_argument("--ultra-thresh", type=parse_count, default=100_000)
        p.add_argument("--min-recalib-events", type=int, default=200)
        p.add_argument("--meth-out-version", type=int, choices=(1, 2), default=2)
        for flag in ("print-read-names", "scale-events", "samples", "signal-index", "collapse-events", "sam"):
            p.add_argument(f"--{flag}", action="store_true")
        p.add_argument("--summary")
    p = verb("resquiggle", "reads", "signals", "kmer-model")
    p.add_argument("--rna", action="store_true")
    p.add_argument("--paf", "-c", action="store_true")
    p = verb("meth-freq", "input")
    p.add_argument("--threshold", "-c", type=float, default=2.5)
    p.add_argument("--split", "-s", action="store_true")
    p = verb("freq-merge")
    p.add_argument("tables", nargs="+")
    return top


def _options(a) -> Options:
    return Options(
        min_mapq=a.min_mapq, secondary=a.secondary == "yes", skip_unreadable=a.skip_unreadable == "yes",
        ultra_threshold=a.ultra_thresh if a.skip_ultra else None,
        region=None if a.window and a.window.endswith(".bed") else a.window, rna=a.rna,
        min_events_to_rescale=a.min_recalib_events, prefilter=bool(a.window), call_version=a.meth_out_version, read_names=a.print_read_names,
        scale_events=a.scale_events, signal_index=a.signal_index, samples=a.samples, collapse=a.collapse_events)


def _reads(spark, path):
    pattern = any(c in path for c in "*?[{")
    if path.endswith(fastq.SUFFIXES) and not pattern:
        return fastq.read_fastq(spark, path).withColumn("ordinal", F.struct("file", "record"))
    if path.endswith((".gz", *fastq.SUFFIXES)):
        return sequences.read_fastx(spark, path).withColumn("ordinal", F.struct("file", "record"))
    return sequences.read_fasta(spark, path)


def _alignments(spark, path, window=None):
    """Alignments with ids in input order. A window, also a BED file of them, is found through the index of a BAM file."""
    bed = window and window.endswith(".bed")
    regions = tsv.read_bed(spark, window) if bed else None
    if path.endswith(".bam"):
        wanted = [(r["contig"], max(r["beg"] - 1, 0), r["end"]) for r in regions.toLocalIterator()] if bed else None
        rows = bam.read_bam(spark, path, wanted, bases="false").drop("seq")
        rows = A.region_filter(rows, window) if window and not bed else rows
        rows = sequences.with_alignment_ids(rows)
    else:
        rows = A.with_end(sequences.with_ordinals(sequences.read_sam(spark, path)))
    if bed:  # an alignment comes once for each region that it overlaps, the regions in order
        rows = A.bed_overlap(rows, regions).withColumn("aln_id", F.shiftleft("region_id", 40) + F.col("aln_id")).drop("region_id")
    return rows


def _signals(spark, path):
    read = slow5.read_slow5 if path.endswith(".slow5") else slow5.read_blow5
    return slow5.signals(read(spark, path))


def _model(spark, path, letters="ACGT"):
    table = sequences.read_model(spark, path, letters)
    k = len(table.first()["kmer"])
    return table, squiggle.collect_model(table, k, letters), k


def run(a) -> None:
    spark = session()
    if a.verb == "meth-freq":
        out = jobs.meth_freq(tsv.read_calls(spark, a.input), Options(call_threshold=a.threshold, split_groups=a.split))
        tsv.write_lines(out, tsv.frequency_lines(), tsv.FREQUENCY_COLUMNS, a.output)
    elif a.verb == "index-alignments":
        bam.index_bam(spark, a.alignments)
    elif a.verb == "freq-merge":
        out = jobs.freq_merge([tsv.read_frequencies(spark, t) for t in a.tables])
        tsv.write_lines(out, tsv.frequency_lines(), tsv.FREQUENCY_COLUMNS, a.output)
    elif a.verb == "index" and a.slow5:
        records = slow5.index_records(spark, a.signals)
        records.write.mode("overwrite").parquet(a.output)
        slow5.write_indexes(spark.read.parquet(a.output))
    elif a.verb == "index":
        summaries = a.summary + (tsv.read_path_list(spark, a.summary_list) if a.summary_list else [])
        out = jobs.index(_reads(spark, a.reads).select("read_id", "ordinal"),
                         [tsv.read_sequencing_summary(spark, s) for s in summaries],
                         tsv.list_signal_files(spark, a.signals))
        tsv.write_lines(out, F.concat_ws("\t", "read_id", "signal_path"), None, a.output)
        totals = readindex.index_statistics(tsv.read_readdb(spark, a.output)).first()
        if not totals["n_with_path"]:
            raise SystemExit("no read was found in a signal file")
        if totals["n_with_path"] < 0.99 * totals["n_reads"]:
            warnings.warn(f"{totals['n_reads'] - totals['n_with_path']} of {totals['n_reads']} reads have no signal file")
    elif a.verb == "resquiggle":
        _, model, _ = _model(spark, a.kmer_model)
        out = jobs.resquiggle(_reads(spark, a.reads), _signals(spark, a.signals), model, Options(rna=a.rna), a.paf)
        header = None if a.paf else ["read_id", "kmer_idx", "start_raw_idx", "end_raw_idx"]
        tsv.write_lines(out, tsv.paf_lines() if a.paf else tsv.resquiggle_lines(), header, a.output)
    else:
        _signal_verbs(spark, a, _options(a))


def _signal_verbs(spark, a, opts) -> None:
    reads, alignments, signals = _reads(spark, a.reads), _alignments(spark, a.alignments, a.window), _signals(spark, a.signals)
    genome = sequences.read_fasta(spark, a.genome).select(F.col("read_id").alias("contig"), "seq")
    table, model, k = _model(spark, a.kmer_model)
    if a.skip_ultra:
        aside = jobs.ultra_long_alignments(reads, alignments, opts)
        aside.write.mode("overwrite").parquet(a.skip_ultra)
    if a.verb == "call-methylation":
        if not a.meth_model:
            raise SystemExit("call-methylation needs --meth-model")
        _, cpg, _ = _model(spark, a.meth_model, "ACGMT")
        calls = jobs.call_methylation(reads, alignments, signals, genome, model, cpg, opts)
        header = tsv.CALL_COLUMNS if opts.call_version == 1 else tsv.CALL_COLUMNS_V2
        tsv.write_lines(calls, tsv.call_lines(opts.call_version), header, a.output)
        return
    # the rows feed up to three outputs; they are written once and read back
    rows = jobs.event_rows(jobs.event_alignment(reads, alignments, signals, genome, model, opts), table, k)
    rows.write.mode("overwrite").parquet(a.output + ".rows")
    rows = spark.read.parquet(a.output + ".rows")
    if a.summary:
        paths = reads.select("read_id", F.lit(a.signals).alias("signal_path"))
        tsv.write_lines(jobs.event_summary(rows, alignments, paths, opts.rna), tsv.summary_lines(), tsv.SUMMARY_COLUMNS, a.summary)
    if a.sam:
        tsv.write_lines(jobs.event_sam(rows, alignments), F.col("line"), None, a.output)
        return
    raw = None
    if opts.samples or opts.collapse:
        kept = jobs.selected(alignments, opts)
        raw = jobs.picoamps(jobs.wanted_signals(signals, kept, opts), kept)
    columns = tsv.eventalign_columns(opts.read_names, opts.signal_index, opts.samples)
    events = jobs.event_table(rows, opts, raw).orderBy("aln_id", "idx")
    tsv.write_lines(events, tsv.eventalign_lines(columns), columns, a.output)


if __name__ == "__main__":
    run(parser().parse_args())
