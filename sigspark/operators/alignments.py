"""Filters, expansions and joins around read-to-reference alignments.

An alignment row is (aln_id, read_id, flag, contig, pos, mapq, cigar, nm); ``pos`` is 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sigspark.functions.values import parse_region

UNMAPPED, REVERSE, SECONDARY = 4, 16, 256
DEFAULT_MAX_BROADCAST_BYTES = 64 << 20
DEFAULT_BIN = 1 << 14
#: Regions of a crowded bin that are met without a smaller one, and the smallest bin.
BIN_REGIONS, LEAST_BIN = 16, 64
#: Bases of the pieces that a broadcast contig is cut into, so that a slice is found without a walk through it.
BROADCAST_TILE = 1 << 12
#: Bits of a filter of reads for each read, bits that a read sets, bits of a block (those of a bitmap aggregate).
FILTER_BITS, FILTER_PROBES, FILTER_BLOCK = 12, 4, 1 << 15


def usable_alignments(alignments: DataFrame, min_mapq: int = 20, secondary: bool = False) -> DataFrame:
    """Mapped alignments of sufficient quality, without secondary ones unless asked for."""
    kept = alignments.where((F.col("flag").bitwiseAND(UNMAPPED) == 0) & (F.col("mapq") >= min_mapq))
    return kept if secondary else kept.where(F.col("flag").bitwiseAND(SECONDARY) == 0)


def split_ultra_long(alignments: DataFrame, threshold: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(processed, set aside): strictly longer reads go to the side output."""
    length = F.length("seq")
    return alignments.where(length <= threshold), alignments.where(length > threshold)


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len:int, op:string>> of a CIGAR text."""
    pattern = F.lit("([0-9]+)([MIDNSHP=X])")
    return F.zip_with(F.regexp_extract_all(cigar, pattern, 1), F.regexp_extract_all(cigar, pattern, 2),
                      lambda n, o: F.struct(n.cast("int").alias("len"), o.alias("op")))


def reference_span(cigar: Column) -> Column:
    """Reference bases covered by a CIGAR."""
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda acc, c: acc + F.when(
        c["op"].isin("M", "D", "N", "=", "X"), c["len"]).otherwise(F.lit(0)))


def with_end(alignments: DataFrame) -> DataFrame:
    return alignments.withColumn("aln_end", F.col("pos") + reference_span(F.col("cigar")))


def region_filter(alignments: DataFrame, region: str) -> DataFrame:
    """Alignments overlapping ``contig:beg-end``; needs ``aln_end``."""
    contig, beg, end = parse_region(region)
    return alignments.where((F.col("contig") == contig) & (F.col("pos") < end)
                            & (F.col("aln_end") > beg))


def bin_for(regions: DataFrame) -> int:
    """A power of two as bin size: DEFAULT_BIN, or smaller where its bins hold more than BIN_REGIONS regions, but not below their width.

    Every alignment in a bin meets every region in it, so crowded bins would cost the product of both.
    """
    ends = regions.select("_rc", "_re", F.explode(F.array(F.expr(f"_rb div {DEFAULT_BIN}"), F.expr(f"(_re - 1) div {DEFAULT_BIN}"))).alias("_at"), F.expr("_re - _rb").alias("_w"))
    bins = ends.groupBy("_rc", "_at").agg(F.count("*").alias("n"), F.sum("_w").alias("w"))
    n, full, width = bins.agg(F.sum("n") / 2, F.max("n") / 2, F.sum("w") / 2).first()
    if not n or full <= BIN_REGIONS:
        return DEFAULT_BIN
    size = max(DEFAULT_BIN * BIN_REGIONS / float(full), float(width) / float(n), LEAST_BIN)
    return min(1 << (int(size) - 1).bit_length(), DEFAULT_BIN)


def by_place(alignments: DataFrame) -> DataFrame:
    """The alignments of each task in the order of their places; needs ``aln_end``. Nothing is shuffled.

    Neighbours overlap the same regions, so the pairs that ``bed_overlap`` makes of them repeat each other and are
    written in a fraction of the bytes.
    """
    return alignments.sortWithinPartitions("contig", "pos", "aln_end")


def bed_overlap(alignments: DataFrame, bed: DataFrame, bin_size: int | None = None,
                max_broadcast_rows: int = 100_000) -> DataFrame:
    """Every (region, alignment) pair that overlaps, duplicates included, nothing clipped.

    BED starts are used as 1-based positions, so a region reaches one base further to the left
    than its file says. Both sides are cut into bins and met by an equality join on
    (contig, bin); a pair sharing several bins is kept in the first common one only. Regions are
    broadcast if they lie in few bins, counted from their ends alone; else they are shuffled, where
    AQE can split a bin that holds very many alignments. Without a bin size, that of ``bin_for`` is taken.
    """
    regions = bed.select("region_id", F.col("contig").alias("_rc"),
                         F.greatest(F.col("beg") - 1, F.lit(0)).alias("_rb"), F.col("end").alias("_re"))
    regions = regions.where("_re > _rb")
    bin_size = bin_size or bin_for(regions)
    bins = regions.agg(F.sum(F.expr(f"(_re - 1) div {bin_size} - _rb div {bin_size} + 1"))).first()[0]
    small = (bins or 0) <= max_broadcast_rows
    left = alignments.withColumn("_bin", F.explode(F.sequence(
        F.expr(f"pos div {bin_size}"), F.expr(f"greatest(pos, aln_end - 1) div {bin_size}"))))
    right = regions.withColumn("_rbin", F.explode(F.sequence(
        F.expr(f"_rb div {bin_size}"), F.expr(f"(_re - 1) div {bin_size}"))))
    first_common = F.greatest(F.expr(f"pos div {bin_size}"), F.expr(f"_rb div {bin_size}"))
    on = ((F.col("contig") == F.col("_rc")) & (F.col("_bin") == F.col("_rbin"))
          & (F.col("pos") < F.col("_re")) & (F.col("aln_end") > F.col("_rb"))
          & (F.col("_bin") == first_common))
    return left.join(F.broadcast(right) if small else right, on).drop(
        "_bin", "_rbin", "_rc", "_rb", "_re")


def cigar_pairs(alignments: DataFrame) -> DataFrame:
    """(aln_id, segment, ref_pos, read_pos) of every aligned base.

    Running sums over the operations of one alignment give the offsets; a skipped region (N)
    opens a new segment.
    """
    ops = alignments.select("aln_id", "pos", F.posexplode(cigar_ops(F.col("cigar"))).alias("j", "c")) \
        .select("aln_id", "pos", "j", F.col("c.len").alias("len"), F.col("c.op").alias("op"))
    before = Window.partitionBy("aln_id").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)

    def moved(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("len")).otherwise(0))
                          .over(before), F.lit(0))

    placed = ops.select(
        "aln_id", "len", "op",
        (F.col("pos") + moved("M", "D", "N", "=", "X")).alias("r"),
        moved("M", "I", "S", "=", "X").alias("q"),
        F.coalesce(F.sum(F.when(F.col("op") == "N", 1).otherwise(0)).over(before), F.lit(0)).alias("seg"))
    blocks = placed.where(F.col("op").isin("M", "=", "X") & (F.col("len") > 0))
    return blocks.select("aln_id", F.col("seg").cast("int").alias("segment"), "r", "q",
                         F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("o")).select(
        "aln_id", "segment", (F.col("r") + F.col("o")).cast("int").alias("ref_pos"),
        (F.col("q") + F.col("o")).cast("int").alias("read_pos"))


def join_reads(alignments: DataFrame, reads: DataFrame) -> DataFrame:
    """Left join on read_id; an alignment without a read gets an empty sequence."""
    return alignments.join(reads.select("read_id", "seq"), "read_id", "left").withColumn(
        "seq", F.coalesce("seq", F.lit("")))


def wanted_signals(signals: DataFrame, wanted: DataFrame,
                   max_filter_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Signals of the reads in ``wanted`` and about one in a hundred of the others, for a place ahead of their shuffle.

    A blocked Bloom filter: one hash of a read id names a block of bits, others the bits in it, so a
    signal meets one row of a broadcast table. The filter is sized by the counted rows of ``wanted``.
    Beyond ``max_filter_bytes`` there is none and all signals pass. Null ids are in no filter.
    """
    blocks = wanted.count() * FILTER_BITS // FILTER_BLOCK + 1
    if blocks * (FILTER_BLOCK // 8) > max_filter_bytes:
        return signals
    name = F.col("read_id").cast("string")
    block = F.pmod(F.xxhash64(name), F.lit(blocks))
    bits = [F.pmod(F.xxhash64(name, F.lit(i)), F.lit(FILTER_BLOCK)) for i in range(FILTER_PROBES)]
    held = (wanted.where("read_id is not null").select(block.alias("_block"), F.explode(F.array(*bits)).alias("_bit"))
            .groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits")))

    def is_set(bit: Column) -> Column:
        byte = F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        return F.call_function("getbit", F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1

    met = signals.withColumn("_block", block).join(F.broadcast(held), "_block")
    for bit in bits:
        met = met.where(is_set(bit))
    return met.select(*signals.columns)


def join_signals(rows: DataFrame, signals: DataFrame, skip_unreadable: bool = True) -> DataFrame:
    """Join the raw signals of the surviving reads.

    The signals are by far the largest input; ``wanted_signals`` keeps those of other reads out of
    their shuffle. With ``skip_unreadable`` off a read without signal
    fails the job.
    """
    if skip_unreadable:
        return rows.join(signals, "read_id").where(F.size("raw") > 0)
    joined = rows.join(signals, "read_id", "left")
    present = F.coalesce(F.size("raw"), F.lit(0)) > 0
    checked = F.when(present, F.col("raw")).otherwise(
        F.raise_error(F.concat(F.lit("no readable signal for "), F.col("read_id").cast("string"))))
    return joined.withColumn("raw", checked)


def reference_tiles(reference: DataFrame, tile: int) -> DataFrame:
    """Cut contigs into (contig, tile, bases) rows so that no row or key is a whole chromosome."""
    return reference.select("contig", F.posexplode(_cut(tile)).alias("tile", "bases"))


def _cut(tile: int) -> Column:
    """The text of ``seq`` in pieces of ``tile`` bases, made in one pass over the contig."""
    return F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{tile}}}"), F.lit(0))


def with_reference(alignments: DataFrame, reference: DataFrame, tile: int = 1 << 16,
                   max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Attach ``ref``: the reference from pos to aln_end inclusive, one base past the alignment.

    An alignment off the reference gets an empty text. A reference whose measured size fits is broadcast. A larger one is tiled: alignments meet the
    tiles they touch on (contig, tile) and the slices are put together per alignment, so a row
    never carries more than the tiles under one read.
    """
    size = reference.select(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    length = F.col("aln_end") - F.col("pos") + 1
    if size <= max_broadcast_bytes:
        piece = min(tile, BROADCAST_TILE)
        ref = F.broadcast(reference.select("contig", _cut(piece).alias("_pieces")))
        first = F.expr(f"cast(pos div {piece} as int)")
        touched = F.slice("_pieces", first + 1, F.expr(f"cast(aln_end div {piece} as int)") - first + 1)
        ref_text = F.substring(F.array_join(touched, ""), F.col("pos") - first * piece + 1, length)
        return (alignments.join(ref, "contig", "left")
                .withColumn("ref", F.coalesce(F.when(F.col("pos") >= 0, ref_text), F.lit(""))).drop("_pieces"))
    # the slice depends on the place alone, so alignments of equal number or place share it unharmed
    place = ["contig", "pos", "aln_end"]
    keys = alignments.select(*place).distinct().select(*place, F.explode(F.sequence(
        F.expr(f"pos div {tile}"), F.expr(f"aln_end div {tile}"))).alias("tile"))
    cut_from = F.greatest(F.col("pos") - F.col("tile") * tile, F.lit(0))
    cut_to = F.least(F.col("aln_end") - F.col("tile") * tile, F.lit(tile - 1))
    slices = keys.join(reference_tiles(reference, tile), ["contig", "tile"]).select(
        *place, "tile", F.substring(F.col("bases"), cut_from + 1, cut_to - cut_from + 1).alias("part"))
    whole = slices.groupBy(*place).agg(F.concat_ws("", F.transform(
        F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda t: t["part"])).alias("ref"))
    return alignments.join(whole, place, "left").withColumn("ref", F.coalesce("ref", F.lit("")))
