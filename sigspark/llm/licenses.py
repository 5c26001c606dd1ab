"""License scan: phrases, and an exact set-similarity join of text lines with license statements.

A line meets a statement if it contains at least `share` of its distinct words. Words are ordered by their
frequency in all texts, rare ones first; a line that meets a statement holds one of its first
size - needed + 1 words (prefix filter), has at least `needed` distinct words (length filter), and has enough words
left behind the first common one (positional filter). What is left is compared in full. All steps are DataFrame
operations. A statement that is wrapped is met in the same way by windows of its length over the words of a paragraph.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a word is, and the phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: License statements of one line, and their labels.
STATEMENTS = (
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under a creative commons attribution license", "cc"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("subject to the terms of the mozilla public license", "mpl"),
)
#: Share of the distinct words of a statement that a line must contain.
SHARE = 0.9
#: Foreign words in a statement that is wrapped, such as the marks of comment lines.
FOREIGN = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Word and gap in text that is not lower-cased yet.
_RAW_WORD, _GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _whole(patterns: Iterable[str]) -> str:
    """Any of the patterns between two gaps, in upper or lower case; a position within a word fails at once."""
    return f"(?i)(?:^|{_GAP[:-1]})(?:{'|'.join(patterns)})(?:{_GAP[:-1]}|$)"


def plain(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """The text in lower case. Other letters than A-Z may change too, but into none of a phrase or statement."""
    return F.lower(text)


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the words of the phrase stand one behind the other."""
    def here(i: Column) -> Column:
        found = F.lit(True)
        for offset, word in enumerate(phrase):
            found = found & F.coalesce(F.get(words, i + offset) == word, F.lit(False))
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def phrase_places(docs: DataFrame, phrases: tuple = PHRASES, text: str = "text") -> DataFrame:
    """All columns of docs; n_words, n_base, first_word, last_word and base_found (labels in phrase order)."""
    none = F.array().cast("array<array<int>>")
    found = docs.withColumn("n_words", F.regexp_count(plain(text), F.lit(_RAW_WORD)).cast("long"))
    # the search spares most texts the list of words
    some = plain(text).rlike(_whole(_GAP.join(phrase.split()) for phrase, _ in phrases))
    found = found.withColumn("_words", F.when(some, word_list(lowered(plain(text)))))
    found = found.withColumn("_places", F.when(F.col("_words").isNull(), none).otherwise(
        F.array(*(_places(F.col("_words"), phrase.split()) for phrase, _ in phrases))))
    every = F.flatten("_places")
    labels = F.array_compact(F.array(*(F.when(F.coalesce(F.size(F.get("_places", F.lit(i))), F.lit(0)) > 0, label)
                                       for i, (_, label) in enumerate(phrases))))
    return found.select(*docs.columns, "n_words", F.size(every).cast("long").alias("n_base"),
                        F.array_min(every).cast("long").alias("first_word"),
                        F.array_max(every).cast("long").alias("last_word"), labels.alias("base_found"))


def containing_lines(docs: DataFrame, statements: tuple = STATEMENTS, share: float = SHARE, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """(doc_id, line, label, containment) of every line and statement that meet; lines count from 0.

    So do statements that go over several lines without a blank one in between, if a window of up to their length and
    FOREIGN more words, which begins and ends as they do, contains enough of them; line is null then.

    The statements are a parameter of bounded size, so their words go to all tasks; texts do not move.
    """
    spark = docs.sparkSession
    sets = [(i, label, sorted(set(text.split())), len(set(text.split()))) for i, (text, label) in enumerate(statements)]
    reach = [len(text.split()) + FOREIGN for text, _ in statements]
    spare = [size - ceil(share * size - 1e-9) + 1 for *_, size in sets]
    ends = [(text.split()[:n], text.split()[-n:]) for (text, _), n in zip(statements, spare, strict=True)]
    vocabulary = sorted({word for _, _, words, _ in sets for word in words})
    counts = {row["word"]: row["n"] for row in docs.select(F.explode(word_list(lowered(plain(text)))).alias("word"))
              .where(F.col("word").isin(vocabulary)).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rank = {word: i for i, word in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    prefix, needs = [], {}
    for number, label, words, size in sets:
        needs[number] = ceil(share * size - 1e-9)
        ordered = sorted(words, key=rank.get)
        for at, word in enumerate(ordered[:size - needs[number] + 1]):
            prefix.append((word, number, label, at, size, needs[number], ordered, reach[number], *ends[number]))
    starts = F.broadcast(spark.createDataFrame(
        prefix, "word string, statement int, label string, at int, size int, needed int, words array<string>, reach int, heads array<string>, tails array<string>"))
    words = sorted({row[0] for row in prefix})
    rare, any_rare = F.array(*map(F.lit, words)), _whole(words)  # a search before any word is listed
    ranks = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    some = docs.where(plain(text).rlike(any_rare))
    lines = (some.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(lowered(plain(text)), "\n")).alias("line", "content"))
             .where(F.col("content").rlike(any_rare)).select("doc_id", "line", F.array_distinct(word_list(F.col("content"))).alias("own"))
             .where(F.arrays_overlap("own", rare)))
    # the line's words that any statement has, in the global order
    known = F.transform(F.array_sort(F.transform(
        F.filter("own", lambda w: F.map_contains_key(ranks, w)), lambda w: F.struct(F.element_at(ranks, w).alias("r"), w.alias("w")))),
        lambda x: x["w"])
    lines = lines.select("doc_id", "line", F.size("own").alias("n"), known.alias("known"))
    hits = (lines.select("doc_id", "line", "n", "known", F.posexplode("known").alias("place", "word")).join(starts, "word")
            .where((F.col("n") >= F.col("needed"))))
    # a pair is looked at for its first common word alone; from there on enough words must be left on both sides
    first = F.get(F.array_intersect("words", "known"), F.lit(0)) == F.col("word")
    left = F.least(F.col("size") - F.col("at"), F.size("known") - F.col("place"))
    both = F.size(F.array_intersect("known", "words"))
    found = (hits.where(first & (left >= F.col("needed"))).where(both >= F.col("needed"))
             .select("doc_id", "line", "label", (both / F.col("size")).alias("containment")))
    return found.union(_wrapped(some, starts, words, any_rare, max(reach, default=1), doc_id, text))


def _wrapped(docs: DataFrame, starts: DataFrame, rare: list[str], any_rare: str, most: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, null, label, containment) of the statements that a window over the words of a paragraph contains."""
    parts = (docs.where(F.instr(plain(text), "\n") > 0)
             .select(F.col(doc_id).alias("doc_id"), F.explode(F.split(lowered(plain(text)), r"\n[ \t\r]*\n")).alias("content"))
             .where((F.instr("content", "\n") > 0) & F.col("content").rlike(any_rare)).select("doc_id", word_list(F.col("content")).alias("own")))
    listed = F.array(*map(F.lit, rare))
    places = F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: F.array_contains(listed, F.get("own", i)))
    # the words around each rare word, so that no window is cut from a long text
    begin = lambda i: F.greatest(i - (most - 1), F.lit(0))
    near = F.transform(places, lambda i: F.struct(
        F.get("own", i).alias("word"), (i - begin(i)).alias("at"), F.slice("own", begin(i) + 1, F.lit(2 * most - 1)).alias("near")))
    hits = (parts.where(F.size("own") > 0).select("doc_id", F.explode(near).alias("x")).select("doc_id", "x.*").join(starts.drop("at"), "word")
            .where(F.size(F.array_intersect("near", "words")) >= F.col("needed")))
    # a window begins and ends as the statement does, but for as many words as may be missing
    begins = F.filter(F.sequence(F.greatest(F.col("at") - F.col("reach") + 1, F.lit(0)), F.col("at")), lambda i: F.array_contains("heads", F.get("near", i)))
    sizes = F.sequence(F.col("needed"), F.col("reach"))
    held = lambda i, n: F.when(F.array_contains("tails", F.get("near", i + n - 1)), F.size(F.array_intersect(F.slice("near", i + 1, n), "words")))
    both = F.array_max(F.flatten(F.transform(begins, lambda i: F.transform(sizes, lambda n: held(i, n)))))
    return hits.withColumn("both", both).where("both >= needed").select(
        "doc_id", F.lit(None).cast("int").alias("line"), "label", (F.col("both") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs.

    score is 1 where a phrase stands, else the largest containment of a statement, else 0. A null text is empty and
    has no words. Rows that repeat a doc_id, null among them, carry the statement labels of each other.
    """
    base = phrase_places(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    more = (containing_lines(docs, doc_id=doc_id, text=text).groupBy(F.col("doc_id").alias("of"))
            .agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment")))
    empty = F.array().cast("array<string>")
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return base.drop("text").join(more, F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", named(F.col("base_found")).alias("base_labels"),
        named(F.concat("base_found", F.coalesce("found", empty))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).cast("double").alias("score"))


def _sql() -> str:
    sets = ", ".join("({}, '{}', [{}])".format(i, label, ", ".join(f"'{w}'" for w in sorted(set(text.split()))))
                     for i, (text, label) in enumerate(STATEMENTS))
    phrases = ", ".join("('{}', [{}])".format(label, ", ".join(f"'{w}'" for w in text.split())) for text, label in PHRASES)
    word = f"'{WORD}'"
    return f"""
with low as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as text from documents),
d as (select doc_id, text, regexp_extract_all(text, {word}) as w from low),
phrase(label, p) as (values {phrases}),
place as (select doc_id, label, i - 1 as i from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), phrase
          where w[i:i + len(p) - 1] = p),
base as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word,
                string_agg(distinct label, ',' order by label) as base_labels from place group by doc_id),
statement(s, label, words) as (values {sets}),
line as (select doc_id, list_distinct(regexp_extract_all(content, {word})) as own
         from (select doc_id, unnest(string_split(text, chr(10))) as content from low)),
met as (select doc_id, label, len(list_intersect(own, words)) / len(words) as containment from line, statement
        where len(list_intersect(own, words)) >= ceil({SHARE} * len(words) - 1e-9)),
best as (select doc_id, max(containment) as containment from met group by doc_id),
named as (select doc_id, string_agg(distinct label, ',' order by label) as labels
          from (select doc_id, label from met union all select doc_id, label from place) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       (case when n_base > 0 then 1.0 else coalesce(containment, 0.0) end)::double as score
from d left join base using (doc_id) left join best using (doc_id) left join named using (doc_id)
"""


SQL = _sql()
