"""Token files, pieces, chat, licenses, pages, vectors: round trips and plain versions on small tables."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from sigspark.llm import ann, chat, extraction, licenses, pieces, tokenfile
from sigspark.llm.common import components, new_path
from sigspark.llm.queries import vocabulary

WORDS = vocabulary("word_bpe_49k.json")
MODEL = vocabulary("piece_bpe_32k.model")
ODD = ["", " ", "\n\n", "a", "Hello, World! it's 3.5%", "<|endoftext|> a <|STARTOFTEXT|> b<|startoftext|>", "ÀÉ éê ß ẞ İ K Å", "é ẍ", "日本語 ... ~ ~~", "x" * 3000,
       "don't WE'LL  I've\t'tis", "a b c\x1cd\x85e", "!!!??? ...,,, (a) [b] <c> a.b,c", "🙂🙃 ok", "½ ² 12,345.67", "_a_ -b- #c", "5€. 5€ 5€, 7. 7 it's. it's"]


def test_chunks_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    memo = tokenfile.word_memo(WORDS, 5)
    texts = ODD + [" ".join(random.Random(i).choices(ODD, k=4)) for i in range(60)]
    coded = memo.encode(tokenfile.chunks(t.encode()) for t in texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(memo.known) <= 5


def test_token_files(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = [(i * 7, t) for i, t in enumerate(ODD)] + [(3, None), (-5, "first"), (10**12, "last one")]
    folder = new_path(spark, "test-tokens")
    files = tokenfile.tokenized_files(documents(rows + [(None, "no place")], ["part", "path"]), folder, WORDS)
    found = tokenfile.read_files(files).orderBy("doc_id").collect()
    start = 0
    for (doc_id, text), row in zip(sorted(rows), found, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfile.read_files(tokenfile.tokenized_files(documents([]), folder, WORDS)).collect() == []
    again = documents([(1, "b"), (1, "a"), (1, "a")])
    assert [r.n_tokens for r in tokenfile.read_files(tokenfile.tokenized_files(again, folder, WORDS)).collect()] == [2, 2, 2]


def test_frames_are_fetched_alone_and_checked(tmp_path):
    path = tmp_path / "x.zst"
    ids = {i: np.arange(i * 50, dtype="<u4").tobytes() for i in range(40)}
    with pa.OSFile(str(path), "wb") as out:
        writer = tokenfile.FrameWriter(out, 1000)
        for i, x in ids.items():
            writer.add(i, x)
        writer.finish()
    reads = []
    with pa.OSFile(str(path), "rb") as source:
        reader = tokenfile.FrameReader(source)
        whole, reader.frame = reader.frame, lambda n: reads.append(n) or whole(n)
        assert {d: x for d, _, x in reader.documents([0, 17, 39])} == {d: ids[d] for d in (0, 17, 39)} and len(reads) == 3
        assert [(d, x) for d, _, x in reader.documents()] == [*ids.items()]
    plain = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()
    assert plain == b"".join(ids.values())  # any reader skips the directory and the seek table
    data = bytearray(path.read_bytes())
    frame = next(i for i in range(len(reader.seek)) if reader.seek[i][1])
    data[int(reader.starts[frame]) + 12] ^= 1
    path.write_bytes(data)
    with pa.OSFile(str(path), "rb") as source, pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokenfile.FrameReader(source).documents())


def small_pieces(names):
    ids = {p: i for i, p in enumerate(names)}
    scores = {p: -float((i * 7919) % 13) - 1 for i, p in enumerate(names)}
    joined = {p[:n] for p in names for n in range(1, len(p))}
    return pieces.Pieces(ids, scores, [p.encode() for p in names], [], len(names), -40.0, max(map(len, names)), False, joined)


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="abcz", max_size=60), st.integers(1, 7), st.integers(1, 9))
def test_stream_finds_a_best_path(text, chunk, every):
    made = small_pieces(["a", "b", "c", "ab", "bc", "abc", "cab", "aa", "aab", "bb"])
    best, score = [0.0], lambda p: made.scores.get(p, made.unknown_score if len(p) == 1 else None)
    for end in range(1, len(text) + 1):
        best.append(max(best[i] + score(text[i:end]) for i in range(max(0, end - 3), end) if score(text[i:end]) is not None))
    search, ids = pieces.Viterbi(made, every), []
    for at in range(0, len(text), chunk):
        ids += search.feed(text[at:at + chunk], at + chunk >= len(text))
    names = ["a", "b", "c", "ab", "bc", "abc", "cab", "aa", "aab", "bb", "z"]
    assert "".join(names[i] for i in ids) == text
    assert sum(score(names[i]) for i in ids) == pytest.approx(best[-1])


def test_window_stays_small():
    made = small_pieces(["a", "b", "ab", "ba"])
    search, most = pieces.Viterbi(made), 0
    for _ in range(300):
        search.feed("ab" * 10)
        most = max(most, len(search.text))
    assert most < 100


def test_pieces_round_trip(spark, documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, " two  spaces "), (102, "word " * 20_000), (102, "again")]
    found = pieces.round_trip(documents(rows, ["ids", "same"]), MODEL).collect()
    assert len(found) == len(rows) and all(r.same for r in found)
    made = pieces.Pieces.load(MODEL)
    by_id = {r.doc_id: r for r in found if r.doc_id < 102}
    for i, text in rows[:-2]:
        ids = list(pieces.encode(text or "", made))
        assert by_id[i].ids == ids and by_id[i].n_tokens == len(ids) and pieces.decode(ids, made) == (text or "")
        assert by_id[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert pieces.round_trip(documents([]), MODEL).collect() == []


def plain_maximal(rows):
    logs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            logs.setdefault(conv, set()).add((turn, role, text))
    top = {c: max((-1 << 70 if t is None else t) for t, _, _ in v) for c, v in logs.items()}
    number = lambda t: -1 << 70 if t is None else t
    out = {}
    for c, own in logs.items():
        if any(own < o and min(number(t) for t, _, _ in o - own) > top[c] for o in logs.values()):
            continue
        same = [d for d, o in logs.items() if o == own]
        out[min(same)] = len(same)
    return out


def test_snapshots_collapse(spark):
    rng, rows = random.Random(4), []
    for conv in range(60):
        talk = [(t, "user" if t % 2 == 0 else "assistant", f"{conv % 5} says {t}") for t in range(12)]
        rows += [(conv, *x) for x in talk[:rng.randint(1, 12)]]
    rows += [(70, 0, "user", "0 says 0"), (70, 1, "user", "other"), (71, 5, None, None), (72, None, "user", "x"), (72, 1, "user", "y"), (73, None, "user", "x"),
             (74, 2000, "user", "far"), (74, 0, "user", "<|im_end|> near"), (75, 0, "user", "<|im_end|> near"), (None, 0, "user", "nobody"), (76, 3, "a", "t"), (76, 3, "b", "t"),
             (77, 3, "a", "t"), (70, 1, "user", "other")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as n", "3 as last").repartition(3)
    assert {r.conv_id: r.n_copies for r in chat.maximal(frame).collect()} == plain_maximal(rows)
    found = {(r.conv_id, r.part): r for r in chat.formatted(frame).collect()}
    assert {c for c, _ in found} == set(plain_maximal(rows))
    assert found[74, 0].text == "<|im_start|>user\n< |im_end|> near<|im_end|>\n" and found[74, 1].n_turns == 1
    assert found[71, 0].text == "<|im_start|>\n<|im_end|>\n" and (72, -1) in found
    assert chat.formatted(frame.limit(0)).collect() == []


def test_wrapped_statements_are_met(spark, documents):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files, to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    gpl = " * Licensed under the GNU General\n * Public License,\n * version 3 or later"
    apache = "REM Licensed under the\r\nREM Apache License, Version 2.0"
    far = "licensed under the " + "other words " * 5 + "\nmit license"
    rows = [(1, "x " * 3000 + "\n" + mit), (2, bsd), (3, gpl), (4, apache), (5, mit.replace("\n", "\n \n")), (6, far), (7, "some words\n\n" + bsd)]
    found = {r.doc_id: r for r in licenses.scan(documents(rows)).collect()}
    assert {i: r.labels for i, r in found.items()} == {1: "mit", 2: "bsd", 3: "gpl,gpl-3", 4: "apache-2.0", 5: "", 6: "", 7: "bsd"}
    assert found[1].score == found[2].score == found[4].score == 1.0 and found[5].score == 0.0


def test_statements_equal_plain_containment(spark, documents):
    lines = [text for text, _ in licenses.STATEMENTS] + ["Licensed UNDER cc-by-nc 4.0", "All, rights\nreserved.", "cc By and CC  by", "general public license",
             "the mit license released under", "released under the mit", "mit mit mit mit mit", "K license", ""]
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.sample(lines, 3) + ["plain words here"] * rng.randint(0, 2))) for i in range(60)] + [(100, None), (101, ""), (102, "a " * 50_000), (103, "é")]
    found = {r.doc_id: r for r in licenses.scan(documents(rows, ["line", "label", "word"])).collect()}
    assert len(found) == len(rows)
    import re

    lower = {i: i + 32 for i in range(65, 91)}
    for i, text in rows:
        words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(lower))
        own, row = words(text or ""), found[i]
        places = [(j, label) for phrase, label in licenses.PHRASES for j in range(len(own)) if own[j:j + len(phrase.split())] == phrase.split()]
        met = [(label, len(set(s.split()) & set(words(line))) / len(set(s.split()))) for line in (text or "").split("\n") for s, label in licenses.STATEMENTS]
        met = [(label, c) for label, c in met if c >= licenses.SHARE - 1e-9]
        assert (row.n_words, row.n_base) == (len(own), len(places))
        assert (row.first_word, row.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert row.labels == ",".join(sorted({x for _, x in places} | {x for x, _ in met}))
        assert row.score == pytest.approx(1.0 if places else max([c for _, c in met], default=0.0))
    assert licenses.scan(documents([])).collect() == []


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class=cookie-notice>We use cookies. Accept.</div>
<div id=content><h1>Big story</h1><p>First  paragraph &eacute; words.<p>Second one<br>goes on &amp; on.</p><div class="advert">Buy now.</div><ul><li>Point one</ul></div>
<aside><p>Related text is quite long, indeed it is.</p></aside><form><p>Sign up here</p><input></form><section class=comments><h3>Comments</h3><p>Nice story.</p></section>
<script>var a="<p>no</p>"</script><footer>&copy; 2020 Me</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u1", PAGE), (2, "u2", None), (3, None, ""), (4, "u4", "<p>unclosed <b>tags</p></i></div>"), (1, "u1", PAGE),
            (5, "u5", "<article>" + "<p>Long text is here.</p>" * 3000 + "</article>"), (6, "u6", "<div>" * 2000 + "deep"), (7, "u7", "<!-- <p>x</p> --><![CDATA[ y"), (8, "u8", "&#0;&#xD800;&bogus; <")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    model = extraction.fit(pages)
    found = {r.page_id: r for r in extraction.extract(pages, model).collect()}
    assert found[1].text == "Big story\nFirst paragraph é words.\nSecond one goes on & on.\nPoint one"
    assert found[2].text == "" and found[3].text == "" and found[5].text.count("\n") == 2999
    assert all(r.n_chars == len(r.text) for r in found.values()) and extraction.extract(pages, model).count() == len(rows)
    assert extraction.extract(pages.limit(0), extraction.fit(pages.limit(0))).collect() == []


def test_field_finds_the_best_labels():
    rng = np.random.default_rng(2)
    model = extraction.Field(rng.normal(size=(extraction.SIZE, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for _ in range(30):
        page = [rng.integers(0, 50, 4).tolist() for _ in range(7)]
        scores = model.scores(page)
        def total(labels):
            return model.start[labels[0]] + sum(scores[i][x] for i, x in enumerate(labels)) + sum(model.turns[a, b] for a, b in zip(labels, labels[1:]))
        every = [[(n >> i) & 1 for i in range(7)] for n in range(128)]
        assert total(model.best(page)) == pytest.approx(max(map(total, every)))
    held = [(p, y) for p, y in extraction.training_pages()[::4]]
    model = extraction.trained([x for i, x in enumerate(extraction.training_pages()) if i % 4])
    right = sum(a == b for p, y in held for a, b in zip(model.best(p), y))
    assert right / sum(len(y) for _, y in held) > 0.97


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(v) for v in centres[i % 30] + 0.3 * rng.normal(size=16)]) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(200)] + [(2000, None), (2001, [0.0] * 16), (2050, [float("nan")] * 16), (2100, [1.0, None] + [1.0] * 14), (2150, [1.0] * 3), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "2 as key", "3 as query_id").repartition(4)
    found = ann.nearest(frame).collect()
    valid = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, unit = np.array([i for i, _ in valid]), np.array([v / np.linalg.norm(v) for _, v in valid])
    asked = [i for i in ids if i % 50 == 0]
    assert {r.query_id for r in found} == set(asked) and len(found) == 5 * len(asked)
    hits = 0
    for q in asked:
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        score = unit @ unit[ids == q][0]
        score[ids == q] = -2
        best = sorted(zip(-np.round(score, 12), ids))[:5]
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(score[ids == r.vec_id][0]) for r in own)
        hits += len({i for _, i in best} & {r.vec_id for r in own})
    assert hits >= 0.95 * 5 * len(asked)
    assert ann.nearest(frame.where("vec_id in (0, 1, 2)")).count() == 2 and ann.nearest(frame.limit(0)).collect() == []


@settings(deadline=None, max_examples=40)
@given(st.lists(st.floats(-3, 3), min_size=2, max_size=6), st.integers(1, 40))
def test_moves_rise_in_cost(place, probes):
    place = np.array(place)
    found = ann.moves(place, probes)
    inside = place - np.floor(place)
    cost = [sum((inside[i] ** 2 if s < 0 else (1 - inside[i]) ** 2) for i, s in enumerate(m) if s) for m in found]
    assert cost == sorted(cost) and len({tuple(m) for m in found}) == len(found) and len(found) == min(probes, 3 ** len(place))


def test_components_of_a_graph(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}


def test_every_dealt_query_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert json.dumps(sorted(entry.oracle_sql()))


def test_few_candidates_are_all_found(spark):
    rows = [(50, [-1.0, 0.0, 0.1]), *[(i, [1.0, 0.01 * i, 0.0]) for i in range(1, 6)]]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.query_id, r.rank) for r in found} == {(50, i) for i in range(1, 6)} and len({r.vec_id for r in found}) == 5
    rng = np.random.default_rng(3)
    many = [(i, [1.0, *(0.05 * rng.normal(size=15)).tolist()]) for i in range(1, 3000) if i % 50] + [(50 * i, [-1.0, *(0.05 * rng.normal(size=15)).tolist()]) for i in range(1, 4)]
    # with one cell for each query these three meet themselves and each other at most
    found = ann.nearest(spark.createDataFrame(many, "vec_id long, embedding array<double>"), tables=1, probes=1).collect()
    ids, x = np.array([i for i, _ in many]), np.array([v / np.linalg.norm(v) for _, v in many])
    for q in (50, 100, 150):
        score = x @ x[ids == q][0]
        score[ids == q] = -2
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == ids[np.argsort(-score)[:5]].tolist()


@pytest.mark.parametrize("html, text", [
    ("<article><svg class='i'/><p>Text of it.</p></article>", "Text of it."),
    ("<article><svg><path d='x'/><g><title>no</title></g></svg><p>Text.</p></article>", "Text."),
    ("<article><math/><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", "If x=2 holds."),
    ("<head><meta charset='x'><title>no</title><article><p>Text.</p></article>", "Text."),
    ("<html><head><link href='x'><noscript><img src='y'></noscript>Text <b>bold</b>", "Text bold"),
    ("<p>a<script src='x'/>b</p><iframe src='y'/><p>c</p>", "ab|c"),
    ("<p>Watch <object data='x'>the film</object> now</p>", "Watch the film now")])
def test_blocks_keep_what_is_text(html, text):
    assert "|".join(b.text for b in extraction.blocks(html)) == text


def test_deep_nesting_is_linear():
    n = 20_000
    found = extraction.blocks("<article>" + "<div>x" * n)
    assert len(found) == n and found[-1].at.depth == n and len(extraction.features(found)) == n and extraction.told(found) == [1] * n
