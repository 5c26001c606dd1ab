"""Published numbers for one read and one set of frequencies; the files are named by a manifest."""

import json
import os
import re

import numpy as np
import pytest

from sigspark.kernels import banded, calibrate, profile, reference

# A JSON object with the paths of: model, read, events, hmm_inputs, calls, frequencies, split_frequencies
MANIFEST = os.environ.get("SIGSPARK_GOLDENS", "")
pytestmark = pytest.mark.skipif(not os.path.isfile(MANIFEST), reason="SIGSPARK_GOLDENS names no manifest")
# Published results for the one read.
MOMENTS = ("1.95", "1.00")
PAIRS, MEAN_LOG_EMISSION = 7206, -2.872263
RECALIBRATED = ["3.18", "0.98", "1.40"]


def path(role):
    with open(MANIFEST) as f:
        return json.load(f)[role]


@pytest.fixture(scope="module")
def model():
    with open(path("model")) as f:
        rows = [line.split("\t") for line in f if re.match("[ACGT]{6}\t", line)]
    return calibrate.PoreModel(6, "ACGT", *[np.array([float(r[c]) for r in rows], np.float32) for c in (1, 2)])


@pytest.fixture(scope="module")
def read():
    with open(path("read")) as f:
        seq = "".join(line.strip() for line in f if not line.startswith(">"))
    with open(path("events")) as f:
        events = [g.split(",") for g in re.findall(r"\{([^}]*)\}", f.read())]
    return seq, np.array([float(e[2]) for e in events], np.float32)


@pytest.fixture(scope="module")
def fitted(model, read):
    seq, mean = read
    ranks = model.ranks(seq)
    shift, scale = calibrate.moments(mean, model.level_mean[ranks])
    aligned = banded.align([mean], [scale * model.level_mean[ranks] + shift], [model.level_stdv[ranks]])[0]
    return ranks, shift, scale, aligned


def test_moment_scaling(fitted):
    _, shift, scale, _ = fitted
    assert (f"{shift:.2f}", f"{scale:.2f}") == MOMENTS


def test_banded_alignment(fitted):
    aligned = fitted[3]
    assert len(aligned.kmer) == PAIRS
    assert aligned.mean_log_emission == pytest.approx(MEAN_LOG_EMISSION, abs=2e-6)


def test_recalibration(fitted, model, read):
    ranks, _, _, aligned = fitted
    start, _ = calibrate.credited(aligned.kmer, aligned.event, len(ranks))
    shift, scale, var, _ = calibrate.recalibrate(read[1], ranks, start, model, 200)
    assert [f"{x:.2f}" for x in (shift, scale, var)] == RECALIBRATED


def hmm_inputs():
    with open(path("hmm_inputs")) as f:
        lines = f.read().splitlines()
    for i in range(0, len(lines) - 2, 3):
        a, b = (line.split(" : ")[1].strip() for line in lines[i:i + 2])
        yield a, b, [int(x) for x in re.findall(r"-?\d+", lines[i + 2])]


def test_subsequences_and_marks():
    calls = list(hmm_inputs())
    assert len(calls) == 90
    for (plain, plain_rc, _), (marked, marked_rc, _) in zip(calls[::2], calls[1::2]):
        assert reference.reverse_complement(plain) == plain_rc
        assert plain.replace("CG", "MG") == marked
        assert plain_rc.replace("CG", "MG") == marked_rc


def test_forward_scores(fitted, model, read):
    """The published scores used a model with methylation; this one differs by little from it."""
    ranks, _, _, aligned = fitted
    start, _ = calibrate.credited(aligned.kmer, aligned.event, len(ranks))
    shift, scale, var, _ = calibrate.recalibrate(read[1], ranks, start, model, 200)
    epb = (aligned.event.max() - aligned.event.min()) / len(ranks)
    problems = []
    for seq, rc_seq, (a, b, stride, rc) in list(hmm_inputs())[::2]:
        events = read[1][a:b + 1] if stride == 1 else read[1][b:a + 1][::-1]
        r = model.ranks(rc_seq)[::-1] if rc else model.ranks(seq)
        problems.append(profile.scaled_problem(events, r, model, shift, scale, var, epb))
    with open(path("calls")) as f:
        known = np.array([float(line.split("\t")[6]) for line in f.readlines()[1:]])
    d = profile.forward(problems) - known
    assert abs(d.mean()) < 0.25 and d.std() < 1.6 and np.median(abs(d)) < 1.0


def test_frequency_goldens(spark):
    """The split table follows from the grouped one, in its order and with its rounding."""
    from sigspark.operators import frequency
    from sigspark.sources import tsv
    grouped = tsv.read_frequencies(spark, path("frequencies"))
    for rows, role in ((grouped, "frequencies"), (frequency.split_frequency(grouped), "split_frequencies")):
        lines = [r.line for r in frequency.sort_sites(rows).select(tsv.frequency_lines().alias("line")).collect()]
        with open(path(role)) as f:
            assert lines == f.read().splitlines()[1:]


def test_call_golden_through_frequency(spark):
    from sigspark.operators import frequency
    from sigspark.sources import tsv
    calls = tsv.read_calls(spark, path("calls"))
    assert calls.count() == 45
    with open(path("calls")) as f:
        rows = [line.rstrip("\n").split("\t") for line in f.readlines()[1:]]
    kept = [r for r in rows if abs(float(r[4])) >= 2.5]
    freq = frequency.site_frequency(calls).collect()
    assert sum(r.called_sites for r in freq) == sum(int(r[8]) for r in kept)
    lines = [r.line for r in calls.orderBy("line_no").select(tsv.call_lines(version=1).alias("line")).collect()]
    assert lines == ["\t".join(r) for r in rows]


def test_relational_calibration_agrees(spark, fitted, model, read):
    """Moments, credited ranges, match states and the weighted fit as joins and aggregates."""
    import pandas as pd
    from pyspark.sql import functions as F
    from sigspark.operators import scaling
    from sigspark.sources.sequences import read_model
    ranks, shift, scale, aligned = fitted
    table = read_model(spark, path("model"))
    frame = lambda **c: spark.createDataFrame(pd.DataFrame({"read_id": 1, **c}))
    events = frame(event_idx=np.arange(len(read[1])), mean=read[1].astype(float))
    kmer = frame(kmer_idx=np.arange(len(ranks)), kmer_rank=ranks)
    levels = table.select(F.col("rank").alias("kmer_rank"), "level_mean", "level_stdv")
    row = scaling.moments_scaling(events, kmer.join(levels, "kmer_rank")).first()
    assert (row["shift"], row["scale"]) == (pytest.approx(shift, abs=1e-5), pytest.approx(scale, abs=1e-6))
    pairs = frame(pair_idx=np.arange(len(aligned.kmer)), kmer_idx=aligned.kmer, event_idx=aligned.event)
    rows = scaling.match_rows(scaling.credited_ranges(pairs), kmer).join(levels, "kmer_rank").join(events, ["read_id", "event_idx"])
    fit = scaling.weighted_recalibration(rows).first()
    assert [f"{fit[c]:.2f}" for c in ("shift", "scale", "var")] == RECALIBRATED
