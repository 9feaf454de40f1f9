"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often, on average, the mix takes it.  Of all rates that
give each source its target words and none more than ``limit`` times a document, the one
closest to "each document once" in relative entropy has the form
``min(limit, exp(a * size))`` with one multiplier ``a`` per source, the solution of a
convex dual.  Newton steps find all multipliers at once: each step is one grouped sum
over the pairs (source, size) with their counts, whose number does not follow a hot
source's rows.  Rates are then rounded to copies along each source, in the order of
sizes, so that rounding errors cancel, and the remaining words are settled copy by copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.common import WORD, ranked, row_key, settled, table, unused

#: Rows of one source and size that are ranked together when single copies are given out.
BLOCK_ROWS = 50_000
STEPS = 40
FITS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float,
                   limit: float) -> DataFrame:
    """(key, words) with the target of each source: its weight's share, at most limit * words.

    The excess of stopped sources goes to the others by weight; that ends where the common
    level times the weight, stopped at the limit, uses up the whole budget.
    """
    weight = F.array(*[F.lit(float(w)) for w in weights])
    known = settled(
        ranked(sizes, [F.col("key").asc()], "sources", "rank")
        .withColumn("weight", F.element_at(weight, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("stop", F.col("words") * float(limit)).drop("rank"), "source-weights")
    total = known.agg(F.sum("words")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        at = F.col("stop") <= F.col("weight") * level
        n, held, free = known.agg(F.count_if(at), F.sum(F.when(at, F.col("words"))),
                                  F.sum(F.when(~at, F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (share * total - limit * (held or 0)) / free
    return known.select("key", "words", "square",
                        F.least("stop", F.col("weight") * level).alias("target"))


def balanced(cells: DataFrame, sources: DataFrame, limit: float, tolerance: float) -> DataFrame:
    """The multiplier of each source: bracketed Newton steps on the dual's slope."""
    infinite = F.lit(float("inf"))
    state = settled(sources.select(
        "key", "target", (F.col("square") / F.col("words")).alias("scale"),
        F.lit(0.0).alias("a"), (-infinite).alias("low"), infinite.alias("high"))
        .where(F.col("target") > 0), "multipliers")
    size = F.col("size") / F.col("scale")
    free = F.exp(F.least(F.col("a") * size, F.lit(700.0)))
    rate = F.least(free, F.lit(float(limit)))
    exact = "decimal(38,9)"  # so that the order of additions doesn't matter
    for _ in range(STEPS):
        slope = (cells.join(state, "key")
                 .groupBy("key", "target", "scale", "a", "low", "high")
                 .agg(F.sum((F.col("n") * size * rate).cast(exact)).cast("double").alias("got"),
                      F.sum(F.when(free < limit, F.col("n") * size * size * rate).otherwise(0.0)
                            .cast(exact)).cast("double").alias("curve"))
                 .withColumn("miss", F.col("got") - F.col("target") / F.col("scale"))
                 .withColumn("low", F.when(F.col("miss") < 0, F.col("a")).otherwise(F.col("low")))
                 .withColumn("high", F.when(F.col("miss") > 0, F.col("a")).otherwise(F.col("high"))))
        newton = F.col("a") - F.greatest(F.lit(-4.0), F.least(
            F.lit(4.0), F.col("miss") / F.greatest("curve", F.lit(1e-9))))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        bounded = (F.col("low") > -infinite) & (F.col("high") < infinite)
        step = (F.when(inside, newton).when(bounded, (F.col("low") + F.col("high")) / 2)
                .otherwise(newton))
        done = F.abs(F.col("miss")) * F.col("scale") <= F.col("target") * tolerance
        state = settled(slope.select(
            "key", "target", "scale", F.when(done, F.col("a")).otherwise(step).alias("a"),
            "low", "high", done.alias("done")), "multipliers")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("key", "scale", "a")


def _fitted(blocks: DataFrame, limit: int) -> DataFrame:
    """One round of giving or taking whole copies, of the largest size that still fits."""
    gap = blocks.groupBy("key").agg(
        (F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    room = F.when(F.col("gap") > 0, F.col("m") * limit - F.col("copies")).otherwise(F.col("copies"))
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (room > 0)
    chosen = (blocks.join(gap, "key").where(fits).groupBy("key", "gap")
              .agg(F.max(F.struct("size", "block", room.alias("room"))).alias("best"))
              .select("key", F.col("best.size").alias("size"), F.col("best.block").alias("block"),
                      (F.signum("gap") * F.least(
                          F.col("best.room"), F.floor(F.abs("gap") / F.col("best.size"))))
                      .cast("long").alias("change")))
    return (blocks.join(chosen, ["key", "size", "block"], "left")
            .withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                limit: int = 2, tolerance: float = 1e-5) -> DataFrame:
    """How many copies of each document the mix takes.

    Sources in code-point order, null last, get ``weights`` in turn and together
    ``share`` of all words; a target stops at ``limit`` times its source's words.  A null
    or empty text has size 0, rate 1 and takes no words.  Rows that are alike, id
    included, are told apart only by place and may get different copies, whose sum is
    right.  Of the columns only doc_id, text and source are read.  An empty table gives
    an empty result.  Returns doc_id, row_key, source, size, source_size, target, rate,
    copies, taken.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 11) / float(1 << 53)
    sized = settled(docs.select("doc_id", row_key().alias("row_key"), "source", key.alias("key"),
                                word_count(F.col("text")).alias("size"), unit.alias("unit")),
                    "sized")
    cells = settled(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "cells")
    words = F.sum(F.col("size") * F.col("n"))
    sources = settled(source_targets(
        cells.groupBy("key").agg(words.alias("words"), F.sum(
            F.col("size").cast("double") * F.col("size") * F.col("n")).alias("square")),
        weights, share, limit), "targets")
    tilted = balanced(cells, sources, limit, tolerance)
    full = F.col("target") >= F.col("words") * float(limit)
    rate = F.when(F.col("size") == 0, 1.0).when(full, float(limit)).otherwise(F.round(F.least(
        F.exp(F.least(F.col("a") * F.col("size") / F.col("scale"), F.lit(700.0))),
        F.lit(float(limit))), 9))
    rates = (cells.join(sources, "key").join(tilted, "key", "left")
             .select("key", "size", "n", "words", "target",
                     F.coalesce(rate, F.lit(0.0)).cast("decimal(12,9)").alias("rate")))
    in_block = F.floor(F.col("unit") * F.ceil(F.col("n") / BLOCK_ROWS)).alias("block")
    placed = sized.join(rates.select("key", "size", "n"), ["key", "size"]).select(
        "doc_id", "row_key", "source", "key", "size", "unit", in_block)
    along = Window.partitionBy("key").orderBy("size", "block").rowsBetween(
        Window.unboundedPreceding, 0)
    counted = (placed.groupBy("key", "size", "block").agg(F.count("*").alias("m"))
               .join(rates.drop("n"), ["key", "size"])
               .withColumn("upto", F.sum(F.col("rate") * F.col("m")).over(along)))
    blocks = settled(counted.withColumn("copies", (F.round("upto", 0) - F.round(
        F.col("upto") - F.col("rate") * F.col("m"), 0)).cast("long")).drop("upto"), "blocks")
    for _ in range(FITS):
        blocks = settled(_fitted(blocks, limit), "blocks")
    turn = F.row_number().over(Window.partitionBy("key", "size", "block")
                               .orderBy("unit", "doc_id", "row_key"))
    copies = F.floor(F.col("copies") / F.col("m")) + (
        F.col("turn") <= F.col("copies") % F.col("m")).cast("long")
    return (placed.withColumn("turn", turn).join(blocks, ["key", "size", "block"])
            .select("doc_id", "row_key", "source", "size", F.col("words").alias("source_size"),
                    F.col("target").cast("double").alias("target"),
                    F.col("rate").cast("double").alias("rate"), copies.alias("copies"),
                    (copies * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    copies, rows, one, other, key, turn, copy = unused(
        docs, "copies__", "alike__", "one__id", "one__key", "row__key", "turn__", "copy__")
    taken = (mix_sources(docs, **options).groupBy("doc_id", "row_key")
             .agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
             .withColumnsRenamed({"doc_id": one, "row_key": other}))
    # rows alike in id and text are told apart by their other columns
    keyed = docs.withColumn(key, row_key()).withColumn(turn, F.row_number().over(
        Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*docs.columns))))
    times = F.floor(F.col(copies) / F.col(rows)) + (
        F.col(turn) <= F.col(copies) % F.col(rows)).cast("long")
    return (keyed.join(taken, F.col("doc_id").eqNullSafe(F.col(one))
                       & (F.col(key) == F.col(other)))
            .where(times > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
            .select(*docs.columns))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")
