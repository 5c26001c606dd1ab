import pytest
from pyspark.sql import functions as F

from sigspark.functions import sequence as S, stats, values
from sigspark.kernels import reference
from sigspark.operators import alignments as A, eventrows, frequency, kmers, nearest


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "s string").select(fn(F.col("s"))).first()[0]


@pytest.mark.parametrize("text,expected", [
    ("MG", "MG"), ("M", "G"), ("TTMGA", "TMGAA"), ("G", "C"), ("", ""), ("AMGMGC", "GMGMGT"), ("ACM", "GGT")])
def test_reverse_complement_with_marks(spark, text, expected):
    assert one(spark, text, S.reverse_complement_methylated) == expected


def test_sequence_functions(spark):
    assert one(spark, "ACGTN", S.reverse_complement) == "NACGT"
    assert one(spark, "CGCGTACG", S.methylate) == "MGMGTAMG"
    assert one(spark, "acgtMRWSYKVHDBN", S.disambiguate) == "ACGTAAACCGAAACA" == reference.plain("acgtMRWSYKVHDBN")
    assert one(spark, "ACGT", S.kmer_rank) == 27 and one(spark, "ANNT", S.kmer_rank) == 3
    assert one(spark, "AMT", S.kmer_rank5) == 19
    assert one(spark, "ACGTA", lambda c: S.kmers(c, 3)) == ["ACG", "CGT", "GTA"]
    assert one(spark, "AC", lambda c: S.kmers(c, 3)) == []
    assert one(spark, "run 7 x.fast5", S.fast5_path_from_comment) == "x.fast5"


def test_printed_numbers(spark):
    import random
    random.seed(1)
    numbers = [0.0625, 0.1875, 2 / 3, -0.0005, 0.0005, 0.0015, 0.0025, 1234567.0, 0.9995, 1e-9, 0.0, -7.5]
    numbers += [m / c for c in (16, 80, 400, 2000) for m in range(0, c, max(c // 40, 1))]
    numbers += [random.uniform(-5000, 5000) for _ in range(300)] + [round(random.uniform(0, 99), 4) for _ in range(300)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    for digits in (0, 2, 3, 5, 6):
        got = [r[1] for r in rows.select("i", stats.fixed(F.col("x"), digits)).orderBy("i").collect()]
        assert got == [f"{x:.{digits}f}" for x in numbers]
    assert spark.range(1).select(stats.fixed(F.lit(float("inf")), 2)).first()[0] == "inf"
    assert spark.range(1).select(stats.fixed(F.lit(float("nan")), 2)).first()[0] == "nan"


def test_scalar_parsers(spark):
    assert [values.parse_count(t) for t in ("5", "1.5K", "2m", "3G")] == [5, 1500, 2_000_000, 3_000_000_000]
    assert values.parse_region("chr1:1,001-2000") == ("chr1", 1000, 2000)
    assert values.version_key("0.10.0") > values.version_key("0.9.1")
    rows = spark.createDataFrame([("255",), ("256",), ("-1",), ("1.0",), ("",)], "s string")
    got = [r[0] for r in rows.select(values.checked_integer(F.col("s"), "uint8_t").cast("int")).collect()]
    assert got == [255, None, None, None, None]
    rows = spark.createDataFrame([("1e-3",), (".",), ("x",), ("-2.5",)], "s string")
    assert [r[0] for r in rows.select(values.checked_float(F.col("s"))).collect()] == [0.001, None, None, -2.5]


def calls(spark, rows):
    return spark.createDataFrame(rows, "chromosome string, start int, end int, log_lik_ratio double, num_cpgs int, sequence string, line_no long")


def test_split_groups_and_first_seen(spark):
    rows = calls(spark, [("c", 10, 16, 5.0, 3, "AACGCGTTCGA", 0), ("c", 10, 10, -5.0, 1, "TTCGA", 1),
                         ("c", 12, 12, 5.0, 1, "GGCGA", 2), ("c", 30, 34, 1.0, 2, "ACGACGA", 3), ("c", 40, 44, 9.0, 2, "AAAA", 4)])
    out = {r.start: r for r in frequency.site_frequency(rows, split_groups=True).collect()}
    assert sorted(out) == [10, 12, 16]
    assert (out[10].called_sites, out[10].called_sites_methylated, out[10].group_sequence) == (2, 1, "split-group")
    assert (out[12].called_sites, out[12].group_sequence) == (2, "split-group") and out[16].called_sites == 1
    late = calls(spark, [("c", 10, 10, -5.0, 1, "TTCGA", 1), ("c", 10, 16, 5.0, 3, "AACGCGTTCGA", 2)])
    first = frequency.site_frequency(late, split_groups=True).where("start = 10").first()
    assert first.group_sequence == "TTCGA"


def test_merge_keeps_first_description(spark):
    schema = ("chromosome string, start int, end int, num_cpgs_in_group int, called_sites int, "
              "called_sites_methylated int, methylated_frequency double, group_sequence string")
    a = spark.createDataFrame([("c", 1, 1, 1, 4, 1, .25, "first"), ("c", 2, 2, 1, 2, 2, 1.0, "only")], schema)
    b = spark.createDataFrame([("c", 1, 1, 1, 4, 3, .75, "second"), ("c", 1, 9, 2, 2, 0, 0.0, "longer")], schema)
    got = [tuple(r) for r in frequency.sort_sites(frequency.merge_frequencies([a, b])).collect()]
    assert got == [("c", 1, 1, 1, 8, 4, 0.5, "first"), ("c", 1, 9, 2, 2, 0, 0.0, "longer"), ("c", 2, 2, 1, 2, 2, 1.0, "only")]


def test_cigar_of_events(spark):
    rows = [(1, 0, 100, 3), (1, 1, 101, 4), (1, 2, 101, 5), (1, 3, 101, 6), (1, 4, 105, 7), (1, 5, 106, 8),
            (2, 0, 50, 0), (2, 1, 50, 1)]
    frame = spark.createDataFrame(rows, "read_id int, idx int, ref_pos int, event_idx int")
    got = {r.read_id: r.event_cigar for r in eventrows.event_cigars(frame).collect()}
    assert got == {1: "3S2M2I3D2M", 2: "1M1I"}


def test_cigar_pairs_match_the_kernel(spark):
    cigar = "3S4M2I5M3D6=1X10N4M2H"
    frame = spark.createDataFrame([(1, 100, cigar)], "aln_id int, pos int, cigar string")
    got = sorted((r.segment, r.ref_pos, r.read_pos) for r in A.cigar_pairs(frame).collect())
    expected = [(s, int(r), int(q)) for s, (ref, read) in enumerate(reference.aligned_segments(100, cigar)) for r, q in zip(ref, read)]
    assert got == sorted(expected)
    assert A.with_end(frame).first().aln_end == 133


def test_cpg_groups_match_a_scan(spark):
    import re
    seqs = ["CGCGTTTTTTTTCGTTTTTTTTTCGA", "AAAA", "", "CG", "TCGCG" * 30]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id int, seq string")
    got = sorted((r.read_id, r.first_cpg, r.last_cpg, r.n_cpg) for r in kmers.cpg_groups(reads).collect())
    expected = []
    for i, seq in enumerate(seqs):
        group = []
        for at in [m.start() for m in re.finditer("CG", seq)] + [10 ** 9]:
            if group and at - group[-1] > 10:
                expected.append((i, group[0], group[-1], len(group)))
                group = []
            group.append(at)
    assert got == sorted(expected)


def test_nearest_event_matches_the_kernel(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    start = np.where(rng.random(400) < 0.01, np.arange(400), -1)
    rows = [(1, i, int(s) if s >= 0 else None) for i, s in enumerate(start)]
    frame = spark.createDataFrame(rows, "read_id int, k_idx int, start_event int")
    got = [r.event_idx if r.event_idx is not None else -1 for r in nearest.nearest_event(frame).orderBy("k_idx").collect()]
    assert got == reference.closest_events(start.astype(np.int32)).tolist()


def test_general_equals_printf(spark):
    from sigspark.functions import stats
    values = [0.0, 1.0, -1.5, 85.123456, 100.0, 123456.0, 999999.4, 999999.6, 1234567.0, 1e-5, 0.0001, 0.00012345678, 9.9999996, 3e20, -2.5e-7]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", stats.general(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["%g" % r["v"] for r in rows]


def test_cpg_groups_do_not_leave_their_task(spark):
    """No window or exchange holds a row for each site, and a batch is scanned in parts."""
    reads = spark.createDataFrame([(1, "ACG" * 5), (2, None), (3, "GCGTTTTTTTTTTTTTTTCG")], "read_id long, seq string")
    plan = kmers.cpg_groups(reads)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Generate" not in plan
    assert sorted(map(tuple, kmers.cpg_groups(reads).collect())) == [(1, 1, 1, 13, 5), (3, 1, 1, 1, 1), (3, 2, 18, 18, 1)]
    by_one = kmers._groups(__import__("pyarrow").array([7, 8]), ["AC", "GCG"], 10)
    assert by_one.to_pylist() == [{"read_id": 8, "grp": 1, "first_cpg": 1, "last_cpg": 1, "n_cpg": 1}]


def test_fixed_names_its_parts_seldom(spark):
    """Branches repeat what they name, and generated code beyond a size is not compiled."""
    from sigspark.functions import stats
    rows = spark.createDataFrame([(0.0, "0.00"), (-0.001, "-0.00"), (0.125, "0.12"), (12345678.375, "12345678.38"), (1e15, "1000000000000000.00")], "v double, t string")
    made = rows.select(stats.fixed(F.col("v"), 2).alias("x"), "t")
    assert [r.x for r in made.collect()] == [r.t for r in made.collect()]
    assert made._jdf.queryExecution().analyzed().toString().upper().count("FLOOR(") <= 4
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        assert [spark.range(1).select(stats.fixed(F.lit(0.0), d)).first()[0] for d in (0, 6, 9)] == ["0", "0.000000", "0.000000000"]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
