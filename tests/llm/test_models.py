"""Conversation repair, language-model scores and centroids against plain versions."""

import hashlib
import re
import zlib
from collections import Counter
from functools import cache
from math import log10

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sigspark.llm import centroids, lm, repair

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType())])
PARTS = re.compile(r"(s?(ua)+)?")
BEGINS = re.compile(r"s?(ua)*u?")


def cheapest(rows):
    """(cost, audit, repaired roles) of all edits, with up to two insertions before each row and at the end."""
    @cache
    def best(i, roles_state, inserted):
        found = []
        if i == len(rows) and roles_state in ("", "a"):
            found.append((0, "", ()))
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[roles_state]

        def then(cost, edit, initial, j, n):
            if initial is None or (initial in allowed and initial):
                rest = best(j, roles_state if initial is None else initial, n)
                if rest:
                    found.append((cost + rest[0], edit + rest[1], ((edit, initial), *rest[2])))

        if inserted < 2:
            for t in "ua":
                then(2, "I", t, i, inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            then(3, "D", None, i + 1, 0)
            if fault not in ("blank", "duplicate"):
                extra = 1 if fault == "truncated" else 0
                then(extra, "K", initial or "?", i + 1, 0)
                for t in "ua":
                    then(2 + extra, "R", t, i + 1, 0)
        return min(found, key=lambda f: f[:2]) if found else None

    return best(0, "", 0)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from(["", "", "", "blank", "duplicate", "truncated"])), max_size=9),
       st.sampled_from([2, 3, 256]))
def test_repair_equals_all_edits(rows, wait):
    log, out = repair._Log(), []
    for i, (initial, fault) in enumerate(rows):
        log.limit = min(log.limit, wait)
        out += log.feed((i,), initial, fault)
    out += log.close()
    assert [row[0] for row, _ in out if row] == list(range(len(rows)))
    cost, audit, steps = cheapest(rows)
    assert "".join(edit for _, moves in out for edit, _ in moves) == audit
    given_roles = [role[0] for _, moves in out for edit, role in moves if edit in "IR"]
    assert given_roles == [initial for edit, initial in steps if edit in "IR"]


def test_long_logs_leave_as_they_go():
    log, most = repair._Log(), 0
    for i in range(20_000):
        log.feed((i,), "ua"[i % 2] if i % 7 else "s", "truncated" if i % 5 == 0 else "")
        most = max(most, len(log.waiting))
    assert most <= repair.WAIT and repair.stepped.cache_info().currsize < 3000


def plain_report(table):
    """The contract of the query, row by row."""
    out = {}
    for conv in {row[0] for row in table}:
        rows = []
        for own, turn, role, text in table:
            if own != conv:
                continue
            space = lambda x: " " if x is None else str(x)
            what = zlib.crc32(f"{space(own)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            rows += [(turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, steps = cheapest(tuple((role[:1], fault) for (_, role, _), fault in zip(rows, faults, strict=True)))
        said, at = [], iter(rows)
        for edit, initial in steps:
            _, role, text = next(at) if edit != "I" else (None, None, "")
            if edit != "D":
                said.append(f"{role if edit == 'K' else repair.GIVEN[initial]}:{text}")
        turns = [r[0] for r in rows if r[0] is not None]
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in repair.FAULTS), illegal, cost,
                     audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_conversation_report(spark):
    odd = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes"), (1, 5, "assistant", "é \t"), (None, None, None, None),
           (None, 2, "user", "x?"), (3, None, "user", "a!"), (3, None, "", "b."), (3, -4, "tool", "c. "), (4, 1, "user", " "), (5, 0, "system", " \n")]
    many = [(100 + i, j, ["user", "assistant", "system"][(i * j + i) % 3], ["Yes.", "No", "Why?", " "][(i + j * j) % 4] + "!" * (j % 2))
            for i in range(60) for j in range(i % 9)]
    big = [(7, i, "ua"[i % 2] == "u" and "user" or "assistant", f"{i}. " * 3 + ".") for i in range(1500)]
    made = spark.createDataFrame(odd + many, TURNS)
    got = {row[0]: tuple(row)[1:] for row in repair.repaired_conversations(made.selectExpr("*", "1 as fault", "2 as step")).collect()}
    assert got == plain_report(odd + many)
    log = repair.repairs(spark.createDataFrame(big, TURNS)).collect()
    assert [r.edit for r in log] == ["Keep"] * 1500 and [r.turn for r in log] == list(range(1500))
    assert repair.repaired_conversations(made.where("false")).count() == 0
    frame = spark.createDataFrame(many, TURNS)
    connection = duckdb.connect()
    connection.register("conversations", frame.toPandas())
    columns = sorted(repair.repaired_conversations(frame).columns)
    assert sorted(map(tuple, repair.repaired_conversations(frame).select(columns).collect())) == sorted(
        connection.sql(f"SELECT {', '.join(columns)} FROM ({repair.SQL})").fetchall())


# ---- language model

def plain_scores(train, texts, order, mu=None):
    """Scores by a dictionary of exact counts, rounded to the bounds of their level."""
    mu = lm.MU if mu is None else mu
    split = lambda text: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w] + [None]
    single = Counter(w for text in train for w in split(text))
    held = Counter()
    for text in train:
        padded = ["<"] * (order - 1) + split(text)
        held.update(tuple(padded[i - k + 1:i + 1]) for i in range(order - 1, len(padded)) for k in range(2, order + 1))
    total, distinct, out = sum(single.values()), len(single), []
    floors = lm.FLOORS.tolist()

    def bounds(count):
        q = sum(f <= count for f in floors)
        return (0, 0) if not q else (floors[q - 1], floors[q] - 1)

    for text in texts:
        padded = ["<"] * (order - 1) + split(text)
        base = score = 0.0
        known = 0
        for i in range(order - 1, len(padded)):
            p = (single[padded[i]] + 1) / (total + distinct + 1)
            base += log10(p)
            known += single[padded[i]] > 0
            for k in range(2, order + 1):
                before = tuple(padded[i - k + 1:i])
                count = len(train) if set(before) == {"<"} else single[before[0]] if k == 2 else bounds(held[before])[1]
                p = (min(bounds(held[(*before, padded[i])])[0], count) + mu * p) / (count + mu)
            score += log10(p)
        out.append((len(padded) - order + 1, known, base, score))
    return out


@pytest.mark.parametrize(("order", "small"), [(2, True), (2, False), (3, True), (3, False)])
def test_scores_equal_counts(spark, documents, order, small):
    """With so many bits that no probe errs, both ways of asking give the scores of exact counts."""
    words = ["the", "The", "of", "xÉ", " ", "a", "b", "c"]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(60)] + [None, "", " \t", "new words the of", "the of " * 4000]
    train = texts[:40] + ["the of " * 4000, None]
    docs = documents(list(enumerate(texts)), extra=("block", "n", "data", "share"))
    model = lm.fit(documents(list(enumerate(train))), order=order, filter_bytes=lm.FILTER_BYTES if small else 0, bits=400)
    assert (model.filter is not None) == small
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.scored(docs, model).collect()}
    want = plain_scores(train, texts, order)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in range(len(texts)))


def test_filter_levels():
    rng = np.random.default_rng(5)
    keys, counts = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.integers(1, 3000, 20_000)
    data = np.frombuffer(lm.segment(keys, counts), np.uint8)
    held = lm.Filter(data, np.zeros(1, np.int64), np.array([len(data) * 8], np.uint64), 64)
    found, want = held.levels(keys), lm.level(counts)
    assert (found >= want).all() and (found == want).mean() > 0.99
    assert (held.levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) == 0).mean() > 0.99
    assert (lm.low(want) <= counts).all() and (counts <= lm.high(want)).all()


def test_scores_without_training(spark, documents):
    docs = documents([(1, "a b"), (None, "a"), (2, None), (2, None)])
    model = lm.fit(docs.where("false"))
    assert sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.scored(docs, model).collect()) == [(1, 0, 0, 0)] * 2 + [(2, 0, 0, 0), (3, 0, 0, 0)]
    assert lm.held_out_scores(docs.where("false")).count() == 0
    report = {(r.doc_id, r.n_tokens): r for r in lm.held_out_scores(docs).collect()}
    assert report[1, 3].train_tokens == sum(n for (i, n), r in report.items() if not r.held_out) + (1 if zlib.crc32(b"2") % 7 != 2 else 0)


# ---- centroids

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def plain_clusters(vectors, k, rounds):
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in vectors]
    named = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (named(r[0]), r[1]))[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((apart(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else centre for n, centre in enumerate(centres)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), centres


def test_answers_of_a_block_come_once(spark, documents, monkeypatch):
    """A share answers a block in one row, with values alone, over however many tasks the texts of the block lay."""
    tables, held = {}, lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: tables.setdefault(name, held(df, name)))
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1 << 12)
    texts = [" ".join(f"w{(i * j) % 97} x{j % 5}" for j in range(40 + i % 7)) for i in range(120)]
    docs = documents([*enumerate(texts), *enumerate(texts[:9]), (None, texts[3]), (None, texts[3]), (None, None)])
    model = lm.fit(docs, filter_bytes=0)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.scored(docs, model).collect())
    answers = tables["answers"]
    assert answers.select("block").distinct().count() > 3
    assert answers.count() == answers.select("block", "share", "kind").distinct().count()
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1 << 24)
    monkeypatch.setattr(lm, "written", held)
    assert len(got) == 132 and got == sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.scored(docs, lm.fit(docs)).collect())


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10_000), st.integers(1, 20), st.integers(1, 9), st.sampled_from([2, 300, 10 ** 7]))
def test_nearest_centre_equals_all(seed, k, d, size):
    rng = np.random.default_rng(seed)
    x, centres = rng.integers(-size, size, (40, d)), rng.integers(-size, size, (k, d))
    who, distance, measured = centroids.nearest(x, centres)
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (who == every.argmin(1)).all() and (distance == every.min(1)).all() and measured <= len(x) * k


def test_bounds_spare_distances():
    centres = np.arange(0, 64_000, 1000)[:, None] + np.zeros(16, np.int64)
    x = np.random.default_rng(0).integers(0, 64_000, (500, 1)) + np.zeros(16, np.int64)
    assert centroids.nearest(x, centres)[2] < 4 * len(x)


def test_clusters_equal_plain(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)] + [(7, [0.5, 0.5, 0.5, 0.5])] * 3 + [(None, [0.0] * 4)]
    big = float(np.float32(3e38))
    huge = [(100 + i, [big, -big, 1.5, 2.0 ** 70 * i]) for i in range(4)]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [1.0]), (205, [])]
    for vectors, k in ((good, 8), (good + huge, 5), (good[:3], 8)):
        frame = spark.createDataFrame(vectors + bad, VECTORS).selectExpr("*", "1 as cluster", "2 as v").repartition(3)
        rows, centres = centroids.clustered(frame, clusters=k, rounds=3, dimensions=4)
        want, final = plain_clusters(vectors, k, 3)
        got = sorted((str(r.vec_id), r.cluster, r.distance) for r in rows.collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and [[int(v) for v in c] for c in centres] == final
        assert all(g[2] == (w[2] if w[2] < 1 << 63 else None) for g, w in zip(got, want, strict=True))
    empty, centres = centroids.clustered(frame.where("false"))
    assert empty.count() == 0 and len(centres) == 0
    assert centroids.report(frame.where("false")).count() == 0


def test_cluster_report_equals_sql(spark):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(i, (rng.normal(size=64) + i % 8).astype(np.float32).tolist()) for i in range(150)], VECTORS)
    connection = duckdb.connect()
    connection.register("embeddings", frame.toPandas())
    columns = sorted(centroids.report(frame).columns)
    assert sorted(map(tuple, centroids.report(frame).select(columns).collect())) == sorted(
        connection.sql(f"SELECT {', '.join(columns)} FROM ({centroids.SQL})").fetchall())
