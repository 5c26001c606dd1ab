"""FASTQ by ranges of bytes: any cut gives the same records."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigspark.sources import fastq, sequences

_NAME = st.text("abc@+ 1", min_size=1, max_size=6).filter(lambda x: x.strip() == x)
_RECORD = _NAME.flatmap(lambda name: st.integers(0, 7).flatmap(lambda n: st.tuples(
    st.just(name), st.text("ACGT", min_size=n, max_size=n), st.sampled_from(["+", "+again"]), st.text("@+I#A", min_size=n, max_size=n))))


@settings(deadline=None, max_examples=150)
@given(st.lists(_RECORD, max_size=8), st.integers(1, 40), st.sampled_from(["\n", "\r\n"]), st.booleans())
def test_any_cut_gives_the_same_records(tmp_path_factory, records, size, end, closed):
    path = tmp_path_factory.mktemp("fastq") / "x.fastq"
    text = "".join(f"@{name}{end}{seq}{end}{plus}{end}{qual}{end}" for name, seq, plus, qual in records)
    path.write_bytes((text if closed else text.removesuffix(end)).encode())
    total = path.stat().st_size
    found = [r[:4] for begin in range(0, total, size) for r in fastq.range_records(str(path), begin, min(begin + size, total))]
    want = [(name.partition(" ")[0], name.partition(" ")[2], seq, qual or None) for name, seq, _, qual in records]
    assert found == want
    assert not total or fastq.four_lines(str(path))


def test_many_tasks_read_a_file(spark, tmp_path):
    rows = [(f"r{i}", "ACGT" * (i % 9 + 1)) for i in range(500)]
    (tmp_path / "a.fastq").write_text("".join(f"@{n} c{i}\n{s}\n+\n{'@' * len(s)}\n" for i, (n, s) in enumerate(rows)))
    (tmp_path / "long.fq").write_text("@w x\nAC\nGT\n+\n@I\nI@\n@v\nA\n+\nI\n")
    (tmp_path / "empty.fq").write_text("")
    table = fastq.read_fastq(spark, str(tmp_path), split_bytes=1000)
    assert table.rdd.getNumPartitions() > 20
    found = sorted(table.select("read_id", "comment", "seq", "qual").collect())
    assert found == sorted([(n, f"c{i}", s, "@" * len(s)) for i, (n, s) in enumerate(rows)] + [("w", "x", "ACGT", "@II@"), ("v", "", "A", "I")])
    kept = sequences.read_fastx(spark, str(tmp_path / "a.fastq"))
    assert sorted(kept.select("read_id", "seq", "qual").collect()) == sorted(
        table.where("file like '%a.fastq'").select("read_id", "seq", "qual").collect())
    order = [r.read_id for r in table.where("file like '%a.fastq'").orderBy("record").collect()]
    assert order == [n for n, _ in rows]


def test_a_later_record_of_more_lines_is_an_error(tmp_path):
    path = tmp_path / "x.fastq"
    path.write_text("@a\nA\n+\nI\n@b\nAC\nGT\n+\nIIII\n")
    with pytest.raises(ValueError, match="four lines"):
        list(fastq.range_records(str(path), 0, path.stat().st_size))


def test_small_ranges_of_a_large_input_grow(spark, tmp_path):
    assert fastq.range_bytes(10_000, 1000) == 1000
    assert fastq.range_bytes(fastq.RANGES * 5000, 1000) == 5000
    assert fastq.range_bytes(1 << 50, 1000) == fastq.SPLIT_BYTES and fastq.range_bytes(1 << 50, 1 << 40) == 1 << 40
    (tmp_path / "a.fastq").write_text("@r\nACGT\n+\nIIII\n" * 2000)
    table = fastq.read_fastq(spark, str(tmp_path), split_bytes=20)
    assert table.rdd.getNumPartitions() <= fastq.RANGES + 1 and table.count() == 2000
