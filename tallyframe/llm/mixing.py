"""Mixing sources to target weights by weighted fair queueing.

A source's documents are shuffled by a keyed hash and queued, up to ``repeats``
times over.  A word's virtual time is the number of words of its source before
it, divided by the source's target, so all sources reach their target at
virtual time 1, where the words served add up to the budget: sorting all
documents by virtual finish time and truncating at the budget cuts every queue
there.  The running totals are taken in two levels (hash ranges of a source,
then documents within a range), so a source with a third of all rows is spread
over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): shares by weight in code-point order of the
    sources, null last, where none exceeds ``repeats`` times its size.

    sizes: a row per source (source, source_size).  What a full source cannot
    take is shared by weight among the others until none is above: the level t
    at which the sums of least(repeats * size, t * weight) meet the total.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    every = Window.partitionBy()
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("most", repeats * F.col("source_size")).withColumn("fills_at", F.col("most") / F.col("weight"))
    rank_at = F.dense_rank().over(Window.orderBy("fills_at"))
    s = s.withColumn("at", rank_at)
    below = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(every), F.sum("weight").over(every)
    used = F.coalesce(F.sum("most").over(below), F.lit(0)) + F.col("fills_at") * (heavy - F.coalesce(F.sum("weight").over(below), F.lit(0)))
    s = s.withColumn("full", used <= total)
    level = (total - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0))) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return s.withColumn("target", target.cast("double")).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """How much of each document the mix takes.

    docs: doc_id, text, source; other columns are ignored.  Returns a row for
    each row: doc_id, size (words; null text: 0), source_size, target (of the
    source), taken (words, repeats counted, at most ``repeats`` * size; the
    document at the cut is taken in part), start (words of the source queued
    before it), source.

    A null source is a source.  Documents without words take nothing.  Repeated
    rows are queued each; rows that tie in everything are interchangeable.
    Empty table: empty result.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.length("text")).alias("key"))
    rows = materialize(rows.select("*", F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNotNull().alias("named")), "sizes")
    ranges = 1 << max(1, (rows.count() // RANGE_ROWS).bit_length())
    rows = rows.withColumn("range", F.shiftrightunsigned("key", 64 - (ranges - 1).bit_length()))
    parts = rows.groupBy("src", "named", "range").agg(F.sum("size").alias("part"), F.first("source").alias("source"))
    before = Window.partitionBy("src", "named").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part").over(before), F.lit(0)))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sizes, weights, repeats).select(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNotNull().alias("named"), "source_size", "target")
    parts = parts.drop("source", "part").join(goals, ["src", "named"])
    within = Window.partitionBy("src", "named", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = rows.withColumn("start", F.sum("size").over(within) - F.col("size")).join(parts, ["src", "named", "range"]).withColumn("start", F.col("start") + F.col("before"))
    left = F.floor("target") - F.col("start")
    taken = sum((F.least(F.greatest(left - k * F.col("source_size"), F.lit(0)), F.col("size")) for k in range(1, repeats)), F.least(F.greatest(left, F.lit(0)), F.col("size")))
    return queue.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "start", "source")


def queue_order(mixed: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The mix as a stream: a row for each time a document is served, range-sorted
    by virtual finish time (round from 0, words taken, finish)."""
    served = mixed.where("taken > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.least(F.lit(repeats - 1), F.floor((F.col("target") - F.col("start") - 1e-9) / F.col("source_size"))).cast("int"))))
    at = F.col("round") * F.col("source_size") + F.col("start")
    words = F.least(F.greatest(F.floor("target") - at, F.lit(0)), F.col("size"))
    return served.withColumn("words", words).where("words > 0").withColumn("finish", (at + F.col("words")) / F.col("target")).orderBy("finish", "source", "start")
