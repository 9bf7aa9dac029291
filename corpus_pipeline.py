"""Corpus preparation: rules, near copies, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, table
from tallyframe.llm.mixing import REPEATS, mix_sources
from tallyframe.llm.packing import pack
from tallyframe.llm.pseudonyms import pseudonymise
from tallyframe.llm.queries import pseudonym_key
from tallyframe.llm.rules import quality_rules
from tallyframe.llm.shingles import jaccard_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), carry=True).where("kept").select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id.  Of rows
    that repeat an id and a text, one stays."""
    docs = docs.select(*COLUMNS)
    stay = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").count()
    stay = stay.select(F.col("doc_id").alias("stays"), F.col("count").alias("rows"))
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("stays")))
    again = kept.where("rows > 1").dropDuplicates(["doc_id", "text"])
    return kept.where("rows = 1").select(*COLUMNS).union(again.select(*COLUMNS))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms."""
    out = pseudonymise(docs.select(*COLUMNS), pseudonym_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes at least half of them."""
    docs = docs.select(*COLUMNS)
    mixed = mix_sources(docs)
    goal = F.floor("target") - F.col("start")
    times = sum(F.when(2 * F.least(goal - k * F.col("source_size"), F.col("size")) >= F.col("size"), 1).otherwise(0) for k in range(REPEATS))
    # rows that repeat an id share its times evenly
    times = mixed.where("size > 0").withColumn("times", times).groupBy("doc_id").agg(F.round(F.avg("times")).cast("int").alias("times")).where("times > 0")
    taken = docs.join(times.withColumnRenamed("doc_id", "taken_id"), F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return taken.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality_rules", rule_stage), ("near_copies", near_copy_stage), ("privacy", privacy_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Models, keyed hashes and a tokenizer decide; no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
