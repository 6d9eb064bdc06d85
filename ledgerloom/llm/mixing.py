"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, Scratch, durable, small

#: Fractional part of the golden ratio: slot i stands at the fraction of i times this, reckoned in units of 2**-64, so that late slots are as exact as early ones.
GOLDEN = (math.sqrt(5) - 1) / 2
GOLDEN_64 = Decimal(11400714819323198485)
#: Slots are ranked within ranges of so many.
CHUNK = 1 << 16
#: Rounds of the shuffle.
ROUNDS = 24


def source_targets(totals: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """totals (source, source_size) -> with `target`: shares of the whole by weight, none above cap times its source.

    Weights repeat over sources by code point, null last. Water filling in closed form: sources in
    order of cap*size/weight fill up first; the level that the rest share is found by running sums.
    The windows run over one row per source in one task: that bounds the number of different sources (some
    millions), not of documents. `sid` numbers the sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("sid", F.row_number().over(order)).withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("filled", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("all") - F.col("filled")) / F.col("open_w"))
    )
    # The level holds from the first source on that it doesn't fill; before it, sources are full.
    # Later ones, reckoned as if it were full too, are lower: so it is the largest that fits.
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(everything)
    return ranked.select("sid", "source", "source_size", F.least("most", F.coalesce(level * F.col("w"), F.col("most"))).alias("target"))


def schedule(targets: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """(slot, sid, rank): each slot is a block of words; golden-ratio points through the cumulative targets pick
    the source, and rank numbers a source's slots from 0.

    Points are met with source intervals by an equi-join on a grid of 4,096 cells, so neither side
    needs to be broadcast and no cell holds more than its share of slots. Ranks are a rank within a range of
    65,536 slots and the source's slots in the ranges before, so no task orders all slots of a source.
    """
    grid = 4096
    up = Window.orderBy("sid")
    spans = targets.withColumn("hi", F.sum("target").over(up)).withColumn("total", F.sum("target").over(Window.partitionBy()))
    spans = scratch.save(spans.select("sid", ((F.col("hi") - F.col("target")) / F.col("total")).alias("lo"), (F.col("hi") / F.col("total")).alias("hi"), "total"))
    count = math.ceil((spans.agg(F.max("total")).first()[0] or 0.0) / block)
    points = targets.sparkSession.range(count).select(F.col("id").alias("slot"), (((F.col("id") + 1).cast("decimal(18,0)") * F.lit(GOLDEN_64) % F.lit(Decimal(2**64))).cast("double") / 2.0**64).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * grid).cast("int"))
    cells = spans.filter("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * grid).cast("int"), F.least(F.floor(F.col("hi") * grid).cast("int"), F.lit(grid)))))
    # The last interval is closed above: rounding must not leave a point without a source.
    last = F.max("hi").over(Window.partitionBy())
    cells = cells.withColumn("hi", F.when(F.col("hi") >= last, F.lit(2.0)).otherwise(F.col("hi")))
    slots = scratch.save(points.join(cells, "cell").filter("u >= lo and u < hi").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk")))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = slots.groupBy("sid", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))
    return slots.withColumn("inside", inside).join(sums, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("inside") - 1).alias("rank"))


def shuffled(rank: Column, blocks: Column) -> Column:
    """The block that slot rank takes: a seeded permutation of 0 to blocks - 1, for any number of blocks.

    Swap-or-not rounds: each pairs x with (key - x) mod blocks, and a hash of the pair's larger member decides whether they change places.
    """
    def swap(x: Column, k: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("key"), k, blocks), blocks) - x, blocks)
        return F.when(F.pmod(F.xxhash64(F.lit("swap"), k, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), rank.cast("long"), swap)


def streams(docs: DataFrame, weights, cap: float, seed: str, id_col: str, text_col: str, source_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, targets): each row's place `start` in its source's stream of words, under a number `row` of its own; and one row per source."""
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    key = F.md5(F.concat_ws("/", F.lit(seed), F.col(id_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    rows = scratch.save(rows.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))
    sums = scratch.save(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    totals = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = scratch.save(source_targets(totals, list(weights), cap))
    at = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(at), F.lit(0)))
    named = targets.select("sid", F.col("source").alias("s"), "source_size", "target")
    part = F.struct(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "bucket")
    starts = scratch.save(starts.join(named, F.col("source").eqNullSafe(F.col("s"))).select(part.alias("part"), "sid", "bucket_start", "source_size", "target"))
    inside = Window.partitionBy("part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", part).withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, "part")
    placed = rows.select(F.monotonically_increasing_id().alias("row"), "id", "sid", "size", "source_size", "target", (F.col("bucket_start") + F.col("inner")).alias("start"))
    return scratch.save(placed), targets


def mix_blocks(rows: DataFrame, targets: DataFrame, cap: float, block: int, scratch: Scratch) -> DataFrame:
    """(slot, sid, block, row, id, first, words): what stands in each slot of the mix, as pieces of documents, `first` counting a document's words from 0.

    A source's stream repeats; as many of its words are given as its target says, to the nearest word. They are
    cut into blocks of `block` words, at most as many as the source has slots; the last block has what is
    left, which may be less or, where the schedule gave too few slots, some blocks' worth. A source too small for a
    slot of the schedule gets one behind the others. Slots, ranked, take the blocks in a shuffled order. Blocks and
    slots meet by an equi-join on (source, block).
    """
    slots = scratch.save(schedule(targets, block, scratch))
    whole = F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(float(cap)))).cast("long")
    given = targets.select("sid", "source_size", whole.alias("given")).filter("given > 0").join(slots.groupBy("sid").agg(F.count("*").alias("slots")), "sid", "left")
    given = scratch.save(given.withColumn("blocks", F.greatest(F.lit(1), F.least(F.coalesce("slots", F.lit(1)), F.ceil(F.col("given") / block)))))
    extra = given.filter("slots is null").select((F.row_number().over(Window.orderBy("sid")) - 1 + slots.count()).cast("long").alias("slot"), "sid", F.lit(0).cast("long").alias("rank"))
    placed = slots.select("slot", "sid", "rank").union(extra).join(small(given.select("sid", "blocks")), "sid").filter("rank < blocks")
    taken = placed.select("slot", "sid", shuffled(F.col("rank"), F.col("blocks")).alias("block"))
    rounds = rows.filter("size > 0").join(small(given.select("sid", "given", "blocks")), "sid")
    rounds = rounds.withColumn("lap", F.explode(F.sequence(F.lit(0), F.floor(F.col("given") / F.col("source_size")).cast("int"))))
    rounds = rounds.withColumn("from", F.col("lap") * F.col("source_size") + F.col("start")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("given"))).filter(F.col("from") < F.col("to"))
    last = F.col("blocks") - 1
    pieces = rounds.withColumn("block", F.explode(F.sequence(F.least(F.floor(F.col("from") / block), last), F.least(F.floor((F.col("to") - 1) / block), last))))
    low, high = F.greatest("from", F.col("block") * block), F.when(F.col("block") == last, F.col("to")).otherwise(F.least("to", (F.col("block") + 1) * block))
    pieces = pieces.select("sid", "block", "row", "id", (low - F.col("from")).alias("first"), (high - low).alias("words"))
    return taken.join(pieces, ["sid", "block"]).select("slot", "sid", "block", "row", "id", "first", "words")


def mix_sources(docs: DataFrame, weights=(5.0, 2.0, 1.0), cap: float = 3.0, block: int = 64, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, pieces, first_slot) for each row of docs: the words that the mix takes of it, in how many pieces, and the first slot that has one.

    A source's documents, in the order of a hash of the id, make one endless stream that repeats, cut into equal
    blocks; mix_blocks puts them in the slots of the schedule, and a row's words are summed over its pieces. So a
    source gives as many words as its target says: all its documents in full rounds, then a part. Positions in the stream
    come from sums over 4,096 hash buckets per source and a window inside a bucket, so a source with
    a third of all rows is spread over many tasks.

    Null text has size 0. Null source is a source of its own, last in order. Empty texts are taken 0
    times. Repeated rows are laid one after another. A source of size 0 has target 0. Empty input:
    empty result. Targets are met to the nearest word; no document exceeds cap times its size.
    """
    scratch = Scratch(docs.sparkSession)
    rows, targets = streams(docs, weights, cap, seed, id_col, text_col, source_col, scratch)
    pieces = mix_blocks(rows, targets, cap, block, scratch)
    sums = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("pieces"), F.min("slot").alias("first_slot"))
    out = durable(rows.join(sums, "row", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", F.lit(0)).alias("pieces"), "first_slot"
    ))
    scratch.clear()
    return out


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
