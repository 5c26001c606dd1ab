"""Chat formatting of logged conversations, after snapshots that longer logs contain were collapsed.

A log that was written after every turn holds a conversation many times, each time a turn longer. Running sums of
turn hashes name every prefix; a conversation whose whole sum is a proper prefix of another one is left out by an
anti-join. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that are summed, and rendered, in one group; longer conversations are cut into such parts.
PART = 1024
_SUMS = ("s0", "s1", "s2", "s3")
_ROLE, _END = "<|im_start|>", "<|im_end|>\n"


def _rows(turns: DataFrame) -> DataFrame:
    """Distinct rows with a conversation, and the part that their turn number lies in."""
    return (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
            .where("conv_id is not null").distinct()
            .withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-1)).cast("long")))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, n, s0..s3, last): number of rows up to each turn and sums of their hashes.

    A turn is the rows of one turn number. The sums are four 32-bit words of two hashes, so they cannot overflow.
    A conversation of any length is summed in parts; part totals are then added up.
    """
    columns = ["turn", "role", "text"]
    content = [*columns, *(F.col(c).isNull() for c in columns)]
    one, two = F.xxhash64(*content), F.xxhash64(F.lit("again"), *content)
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    words = dict(zip(_SUMS, (low(one), F.shiftrightunsigned(one, 32), low(two), F.shiftrightunsigned(two, 32)), strict=True))
    turns = rows.groupBy("conv_id", "part", "turn").agg(
        F.count("*").alias("n"), *(F.sum(word).alias(name) for name, word in words.items()))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = turns.select("conv_id", "part", "turn", *(F.sum(c).over(inside).alias(c) for c in ("n", *_SUMS)))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy("conv_id", "part").agg(*(F.sum(c).alias(c) for c in ("n", *_SUMS)), F.max("turn").alias("top"))
    parts = parts.select("conv_id", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias("b_" + c) for c in ("n", *_SUMS)),
                         F.max("part").over(Window.partitionBy("conv_id")).alias("last_part"), "top")
    last = (F.col("part") == F.col("last_part")) & F.col("turn").eqNullSafe(F.col("top"))
    return running.join(parts, ["conv_id", "part"]).select(
        "conv_id", "turn", *((F.col(c) + F.col("b_" + c)).alias(c) for c in ("n", *_SUMS)), last.alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of the conversations that no longer one begins with.

    Two conversations are equal if they hold the same (turn, role, text) rows; the smallest conv_id stands for
    all, n_copies counts them. One is a prefix of another if the other holds its rows and only later turn numbers
    besides. Repeated rows count once, rows without conv_id belong to no conversation.
    """
    named = prefixes(_rows(turns))
    whole = named.where("last").groupBy("n", *_SUMS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = named.where("not last").select("n", *_SUMS).distinct()
    return whole.join(proper, ["n", *_SUMS], "left_anti").select("conv_id", "n_copies")


def rendered(role: Column, text: Column) -> Column:
    """One turn in chat markup; markup within a text or role is broken up, null is empty."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(_ROLE), plain(role), F.lit("\n"), plain(text), F.lit(_END))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_copies, n_turns, text) of the maximal conversations.

    Turns are in order of (turn, role, text), those without a number first. A conversation gives one row for each
    PART turn numbers that it reaches into, so that no text is unbounded; most have the one part 0.
    """
    rows = _rows(turns).join(maximal(turns), "conv_id")
    return rows.groupBy("conv_id", "part").agg(
        F.max("n_copies").alias("n_copies"), F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            F.coalesce(F.col("turn"), F.lit(-(1 << 62))).alias("turn"), "role", "text"))),
            lambda x: rendered(x["role"], x["text"])), "").alias("text"))


SQL = """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
c as (select conv_id, list(struct_pack(turn := turn, role := role, text := text) order by turn, role, text) as l,
             max(turn) as top from t group by conv_id),
w as (select l, any_value(top) as top, min(conv_id) as conv_id, count(*) as n_copies from c group by l),
kept as (select w.conv_id, w.n_copies from w where not exists (
    select 1 from w o where len(o.l) > len(w.l) and o.l[1] = w.l[1] and o.l[1:len(w.l)] = w.l and o.l[len(w.l) + 1].turn > w.top))
select t.conv_id, t.turn // 1024 as part, max(n_copies) as n_copies, count(*) as n_turns,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10),
                  '' order by turn, role, text) as text
from t join kept using (conv_id) group by t.conv_id, t.turn // 1024
"""
