"""Near duplicates, passages, decontamination, quality: against plain versions on small tables."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigspark.llm import decontam, neardup, passages, quality, words
from sigspark.llm.common import written

VOCABULARY = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("", "n", "st", "rm")]


def prose(seed, n):
    rng = random.Random(seed)
    return [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n)]


def changed(text, seed, every):
    rng = random.Random(seed)
    return [w if i % every != seed % every else rng.choice(VOCABULARY) + "x" for i, w in enumerate(text)]


def plain_words(text):
    lower = {i: i + 32 for i in range(65, 91)}
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in (text or "").translate(lower)).split(" ") if w]


def plain_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = plain_words(text)
        sets.setdefault(i, []).append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="aB \tç\n", max_size=12), max_size=6), st.integers(1, 9))
def test_word_hashes_are_those_of_the_words(texts, step):
    before, words.STEP = words.STEP, step
    try:
        hashes, first, begin, end = words.word_hashes(pa.array(texts, pa.string()), spans=True)
    finally:
        words.STEP = before
    data = "".join(texts).encode()
    expected = [w.encode() for t in texts for w in plain_words(t)]
    assert [data[a:b].lower() if True else 0 for a, b in zip(begin, end)] == [w.lower() for w in expected]
    assert list(np.diff(first)) == [len(plain_words(t)) for t in texts]
    alone = {w: words.word_hashes(pa.array([w.decode()]))[0][0] for w in set(expected)}
    assert [alone[w] for w in expected] == list(hashes) and len(set(alone.values())) == len(alone)


def test_near_duplicates_equal_all_pairs(spark, documents):
    base, other, long = prose(1, 120), prose(2, 90), prose(3, 4000)
    rows = [(i, " ".join(changed(base, i, 30 + i))) for i in range(10, 40)]            # a chain of near copies
    rows += [(100 + i, " ".join(other)) for i in range(25)]                             # exact copies
    rows += [(200 + i, " ".join(prose(50 + i, 60))) for i in range(8)]
    rows += [(300, " ".join(long)), (301, " ".join(long[:3900])), (302, "one two"), (303, "One  TWO"), (304, "one"), (305, ""),
             (306, None), (307, " \n"), (308, "one two three"), (400, " ".join(base[:50])), (400, " ".join(other))]
    docs = documents(rows + [(None, "one two"), (None, None)], ["node", "key", "signature"])
    for k in (4, 5):
        found = neardup.near_duplicates(docs, k=k).collect()
        assert len(found) == len(rows) + 2
        expected = plain_components(rows, k, 80)
        for row in found:
            if row.doc_id is None:
                assert row.component_id is None and row.kept
            else:
                assert row.component_id == expected[row.doc_id], row
                assert row.kept == (row.doc_id == expected[row.doc_id])
    assert neardup.near_duplicates(documents([])).collect() == []


@pytest.mark.parametrize("most", [neardup.NAMED, 0])
def test_near_duplicates_move_few_texts(spark, documents, monkeypatch, most):
    """Texts are looked up by ids that go to all tasks; keys of buckets move once. Beyond NAMED ids nothing changes but the joins."""
    base = prose(11, 90)
    rows = [(i, " ".join(changed(base, i, 60 + i))) for i in range(6)] + [(100 + i, " ".join(prose(70 + i, 60))) for i in range(12)]
    plans, held = {}, neardup.written

    def kept(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return held(df, name)

    monkeypatch.setattr(neardup, "written", kept)
    monkeypatch.setattr(neardup.small_side, "__defaults__", (most,))
    monkeypatch.setattr(neardup, "NAMED", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(rows), k=4).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == plain_components(rows, 4, 80)
    assert plans["members"].count("Exchange hashpartitioning") == 1
    if most:
        assert "SortMergeJoin" not in plans["texts"] and "hashpartitioning" not in plans["texts"].replace("BroadcastExchange", "")
        assert plans["links"].count("SortMergeJoin") == 1


@pytest.mark.parametrize("nodes", [1024, 3])
def test_chance_meetings_in_buckets_join_no_cluster(spark, monkeypatch, nodes):
    """Only nodes whose whole signatures are near each other come out, however the bucket is cut into blocks."""
    monkeypatch.setattr(neardup, "BLOCK_NODES", nodes)
    rng = np.random.default_rng(5)
    signs = rng.integers(0, 1 << 16, (20, neardup.BANDS * neardup.ROWS)).astype(">u2")
    signs[:, :neardup.ROWS] = 7                                                         # one band is common to all
    signs[11], signs[17], signs[5] = signs[3], signs[3], signs[4]
    sides = spark.createDataFrame([(i, 50 if i != 5 else 9, x.tobytes()) for i, x in enumerate(signs)], "node long, size long, signature binary")
    held = spark.createDataFrame([(1, i, 0 if i < 3 else i) for i in range(20)] + [(2, 0, 0), (2, 8, 8)], "key long, node long, own long")
    edges = neardup._alive_edges(held, sides, 80, neardup.MISS)
    assert {r.node: r.component for r in neardup.components(edges).collect()} == {3: 3, 11: 3, 17: 3}


def test_posterior_bound():
    for n in (16, 32, 96):
        bound = neardup.least_matches(n, 80, 1e-6)
        grid = np.linspace(0, 1, 20001)
        for m, low in ((bound, False), (bound - 1, True)):
            density = grid ** m * (1 - grid) ** (n - m)
            share = density[grid >= 0.8].sum() / density.sum()
            assert (share < 1.2e-6) if low else (share > 0.8e-6)


def test_passages_are_found_and_cut(spark, documents):
    shared, fuzzy = prose(7, 70), prose(8, 90)
    rows = [(i, " ".join(prose(20 + i, 80) + shared + prose(60 + i, 40))) for i in range(1, 6)]
    rows += [(10, " ".join(prose(90, 30) + fuzzy)), (11, " ".join(changed(fuzzy, 3, 25) + prose(91, 30)))]
    rows += [(20, " ".join(prose(92, 60) + shared[:40])), (21, None), (22, ""), (23, "word"), (24, "go " * 400),
             (30, " ".join(prose(93, 60) * 2)), (40, " ".join(prose(94, 200))), (40, " ".join(prose(94, 200)))]
    docs = documents(rows + [(None, " ".join(shared))], ["seed", "x", "chain"])
    found = passages.repeated_passages(docs)
    covered = {}
    for row in found.collect():
        covered.setdefault(row.doc_id, set()).update(range(row.first_word, row.first_word + row.n_words))
        assert row.other_id <= row.doc_id and row.n_equal >= 0.8 * row.n_words
    for i in range(2, 6):
        assert set(range(80, 150)) <= covered[i] and len(covered[i]) < 80
    assert len(covered[11] & set(range(90))) >= 85
    assert set(range(60, 120)) <= covered[30]
    assert not {1, 10, 20, 21, 22, 23, 40} & set(covered)
    cover = passages.repeated_passages(docs, cover=True)
    joined = {}
    for row in cover.collect():
        assert not joined.get(row.doc_id, set()) & set(range(row.first_word, row.first_word + row.n_words))
        joined.setdefault(row.doc_id, set()).update(range(row.first_word, row.first_word + row.n_words))
    assert joined == covered
    cut = {}
    for row in passages.without_passages(docs, cover).collect():
        cut.setdefault(row.doc_id, []).append(row)
    assert set(cut) >= {None, 1, 2, 10, 20, 21, 22, 23, 40} and len(cut[40]) == 2
    kept = cut[3][0]
    assert set(plain_words(rows[2][1])[:75]) <= set(kept.text.split()) and kept.n_chars == len(kept.text)
    assert not set(shared[5:65]) & set(kept.text.split()) - set(rows[2][1].split()[:80] + rows[2][1].split()[150:])
    assert cut[1][0].text == rows[0][1] and kept.seed == "x"
    assert passages.repeated_passages(documents([])).collect() == []


def test_passages_of_one_chain_are_split(spark, documents):
    one, two = prose(201, 100), prose(202, 100)
    rows = [(1, " ".join(one + prose(203, 60) + two)), (2, " ".join(prose(204, 30) + one + prose(205, 60) + two)),  # other text between
            (3, " ".join(prose(206, 200))), (4, " ".join(prose(206, 200)[:100] + prose(207, 100) + prose(206, 200)[100:]))]  # an insertion
    covered = {}
    for row in passages.repeated_passages(documents(rows)).collect():
        assert row.n_equal >= 0.8 * row.n_words
        covered.setdefault(row.doc_id, set()).update(range(row.first_word, row.first_word + row.n_words))
    assert set(covered) == {2, 4}
    for doc, shared in ((2, {*range(30, 130), *range(190, 290)}), (4, {*range(100), *range(200, 300)})):
        assert len(shared - covered[doc]) <= 4 and len(covered[doc] - shared) <= 12


def test_stretches_find_the_longest(spark):
    rng = random.Random(5)
    for _ in range(150):
        equal = np.array([rng.random() < rng.choice((0.1, 0.8, 0.95)) for _ in range(rng.randint(60, 160))])
        at = rng.randrange(len(equal) - passages.K)
        equal[at:at + passages.K] = True
        a = np.arange(len(equal), dtype=np.uint32) + 1
        b = np.where(equal, a, 0).astype(np.uint32)
        found = passages.stretches(a, b, np.array([at]), np.array([at]))
        total = np.append(0, np.cumsum(equal))
        best = max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1)
                    if equal[i] and equal[j - 1] and total[j] - total[i] >= 0.8 * (j - i)), default=0)
        longest = max((a1 - a0 for a0, a1, *_ in found), default=0)
        assert (longest >= passages.PASSAGE) == (best >= passages.PASSAGE)
        assert all(a1 - a0 >= passages.STRETCH and n >= 0.8 * max(a1 - a0, b1 - b0) for a0, a1, b0, b1, n in found)


def test_passages_with_a_fifth_of_the_words_replaced(spark, documents):
    rng, rows = random.Random(11), []
    for i in range(60):
        own = prose(300 + i, 50)
        places = set(rng.sample(range(1, 49), 10)) if i > 1 else set(range(4, 50, 5 + i)) - {49}
        other = [w if j not in places else f"x{i}y{j}" for j, w in enumerate(own)]
        rows += [(i, " ".join(prose(400 + i, 40) + own + prose(500 + i, 30))), (100 + i, " ".join(prose(600 + i, 20) + other + prose(700 + i, 30)))]
    far = prose(801, 300)
    rows += [(90, " ".join(far)), (190, " ".join(far[:120] + prose(802, 5) + far[125:]))]
    covered = {}
    for row in passages.repeated_passages(documents(rows)).collect():
        covered.setdefault(row.doc_id, set()).update(range(row.first_word, row.first_word + row.n_words))
    assert all(len(covered.get(100 + i, set()) & set(range(20, 70))) >= 45 for i in range(60))
    assert covered[190] >= set(range(300))


def test_matches_of_seeds_equal_all_places():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 60):
        seed, doc, place = rng.integers(0, 8, n).astype(np.uint64), rng.integers(0, 5, n), np.arange(n)
        row = doc * 2 + rng.integers(0, 2, n)
        found, want = sorted(zip(*(c.tolist() for c in passages.met(seed, doc, row, place)), strict=True)), []
        for i in range(n):
            same = [j for j in range(n) if seed[j] == seed[i]]
            own, owner = min(j for j in same if row[j] == row[i]), min(same, key=lambda j: (doc[j], row[j], j))
            if own != i or doc[owner] != doc[i]:
                other = owner if own == i else own
                want.append((doc[i], doc[other], place[i], place[other]))
            earlier = [j for j in same if own == i and (doc[j], row[j]) < (doc[i], row[i]) and j == min(k for k in same if row[k] == row[j])]
            if earlier and doc[owner] != doc[i]:  # the text before it too, where that is another one than the owner
                before = max(earlier, key=lambda j: (doc[j], row[j]))
                if before != owner and doc[before] != doc[i]:
                    want.append((doc[i], doc[before], place[i], place[before]))
        assert found == sorted(want)


def test_passage_whose_words_stand_scattered_in_an_earlier_text(spark, documents):
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10 ** 9, n)]
    passage = word(60)
    size = len(passages.MASK)
    scattered = sum((passage[i:i + size] + word(3) for i in range(len(passage) - size + 1)), [])
    rows = [(1, " ".join(scattered)), (2, " ".join(word(30) + passage + word(20))), (3, " ".join(word(10) + passage + word(40)))]
    found = {(r.doc_id, r.other_id, r.first_word, r.n_words) for r in passages.repeated_passages(documents(rows)).collect()}
    assert (3, 2, 10, 60) in found


def test_runs_that_may_hold_a_stretch():
    rng = np.random.default_rng(2)
    width = rng.integers(0, 60, 400)
    equal = rng.random(width.sum()) < np.repeat(rng.uniform(0.3, 1, 400), width)
    marks, ends = passages.may_hold(equal, width), np.cumsum(width)
    for i in range(400):
        own = equal[ends[i] - width[i]:ends[i]]
        assert not (decontam.overlap(own, passages.STRETCH, passages.EQUAL) and not marks[i])
    assert 20 < marks.sum() < 380


@settings(deadline=None, max_examples=80)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=30))
def test_chains_on_one_diagonal(places):
    x = np.array(sorted(places))
    found, want = passages.chained(x, x + 7), passages.chains(x, x + 7)
    assert [c.tolist() for c in found] == [c.tolist() for c in want]
    if passages.one_chain(x, x + 7, np.array([0]))[0]:
        assert len(want) == 1 and len(want[0]) == len(x)


def test_repeats_within_a_text_are_one_row(spark, documents, monkeypatch):
    """A line that stands a hundred times in a text is one row between the steps, not a hundred."""
    tables = {}
    monkeypatch.setattr(passages, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    line = "one two three four five six seven eight nine ten"
    rows = [(i, "\n".join(f"{line}\n{i} {j} {i * j}" for j in range(100))) for i in range(3)]
    passages.repeated_passages(documents(rows)).collect()
    assert 3 <= tables["chains"].count() <= 6


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=14, unique=True))
def test_best_chain_equals_quadratic(matches):
    matches.sort()
    x, y = (np.array(c) for c in zip(*matches))
    best = [float(passages.K)] * len(matches)
    for j in range(len(matches)):
        for i in range(j):
            if x[i] < x[j] and y[i] < y[j]:
                best[j] = max(best[j], passages.K + best[i] - passages.GAP * (x[j] - x[i] + y[j] - y[i]))
    first = passages.chains(x, y)[0]
    score = passages.K * len(first) - passages.GAP * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
    assert score == pytest.approx(max(best))
    assert sorted(i for c in passages.chains(x, y) for i in c) == list(range(len(matches)))


def test_benchmark_overlaps(spark, documents):
    item, other = prose(5, 40), prose(6, 20)
    rows = [(1, " ".join(prose(30, 50) + item + prose(31, 9))), (2, " ".join(item[5:20])), (3, " ".join(item[:12])),
            (4, " ".join(prose(32, 20) + changed(item, 4, 6))), (5, " ".join(prose(33, 400))), (6, None), (7, ""), (8, " ".join(item).upper()),
            (8, " ".join(other))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, "too short"), (None, " ".join(item)), (1, " ".join(item))],
                                  "item_id long, text string")
    docs = documents(rows, ["item_id", "hits"])
    found = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (4, 1), (8, 1), (8, 2)}
    assert (found[1, 1].first_word, found[1, 1].n_words, found[1, 1].item_first_word) == (50, 40, 0)
    assert found[2, 1].item_first_word == 5 and found[4, 1].n_words > found[4, 1].n_equal >= 0.8 * found[4, 1].n_words
    before, decontam.SLICE = decontam.SLICE, 1  # a slice for each item
    try:
        again = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    finally:
        decontam.SLICE = before
    assert again == set(found)
    kept = decontam.keep_clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7] and kept.columns == docs.columns
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []
    assert decontam.contaminated(documents([]), bench).collect() == []


@pytest.mark.parametrize(("least", "share", "sizes"), [(13, 0.8, (13, 14, 15, 16, 17, 20)), (8, 0.75, (8, 9, 12, 16)), (6, 1.0, (6, 7)), (5, 0.5, (5, 8))])
def test_a_mask_fits_every_overlap(least, share, sizes):
    kept = [[i for i, c in enumerate(mask) if c == "1"] for mask in decontam.masks(least, share)]
    for n in sizes:
        for replaced in itertools.combinations(range(1, n - 1), int((1 - share) * n + 1e-6)):
            assert any(not {at + i for i in places} & set(replaced) for places in kept for at in range(n - places[-1])), (n, replaced)


def test_benchmark_overlaps_equal_all_diagonals(spark, documents):
    item, rows = prose(41, 25), []
    for n, r in ((13, 2), (15, 3), (16, 3)):
        for replaced in itertools.combinations(range(1, n - 1), r):
            rows.append((len(rows), " ".join(["aa"] * 3 + ["zz" if j in replaced else item[4 + j] for j in range(n)] + ["bb"])))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(documents(rows), bench).collect()} == set(range(len(rows)))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.booleans(), max_size=40), st.integers(2, 10))
def test_longest_overlap_equals_all_stretches(equal, least):
    equal = np.array(equal, bool)
    sizes = [j - i for i in range(len(equal)) for j in range(i + least, len(equal) + 1)
             if equal[i] and equal[j - 1] and equal[i:j].sum() >= 0.8 * (j - i) - 1e-6]
    found = decontam.overlap(equal, least, 0.8)
    assert (found[1] - found[0] if found else 0) == max(sizes, default=0)


def test_quality_is_learnt_and_held_out(spark, documents):
    good = [(i, " ".join(prose(i, 60)).capitalize() + ".") for i in range(150)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(500 + i, 50))) for i in range(60)]
    junk += [(2000 + i, " ".join([prose(i, 1)[0]] * 80)) for i in range(60)]
    docs = documents(good + junk + [(5000, None), (5001, ""), (5002, "x" * 100_000)], ["score", "good", "features"])
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + junk] + [(None, 1), (7, None), (3, 1)], "doc_id long, quality int")
    train = quality.training_labels(labels)
    assert 0.6 < train.count() / labels.count() < 0.95
    model = quality.fit(docs, train)
    rows = {r.doc_id: r.mark for r in quality.scored(docs, model, score="mark").collect()}
    assert len(rows) == docs.count() and all(0 <= v <= 1 for v in rows.values())
    held = {r.doc_id for r in labels.subtract(train).collect()} - {None}
    wrong = [i for i in held if (rows[i] >= quality.GOOD) != (i < 1000)]
    assert len(held) > 30 and not wrong
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i, _ in good if i in held}
    with pytest.raises(ValueError):
        quality.scored(docs, model)
    one_sided = quality.fit(docs, labels.where("quality = 1"))
    assert all(r.mark > 0.9 for r in quality.scored(docs, one_sided, score="mark").collect())
    assert quality.fit(documents([]), labels).slope == 1.0


def test_stretches_move_packed_for_the_pipeline(spark, documents):
    """Many stretches of one pair of texts are no rows of their own."""
    parts = [prose(300 + i, 60) for i in range(12)]
    rows = [(1, " ".join(w for i, part in enumerate(parts) for w in part + prose(400 + i, 300))),
            (2, " ".join(w for i, part in enumerate(parts[::-1]) for w in part + prose(500 + i, 300)))]
    cover = passages.repeated_passages(documents(rows), cover=True)
    assert "align_packed" in cover._jdf.queryExecution().executedPlan().toString()
    assert sum(r.doc_id == 2 and r.n_words >= 60 for r in cover.collect()) == 12
