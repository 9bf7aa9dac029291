"""The ten operators over the synthetic tables, and SQL for those that have one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licenses import scan_licenses
from .mixing import mix_sources
from .ordinal import grade_documents
from .packing import pack
from .pages import extract_text
from .pseudonyms import pseudonymise
from .repeats import remove_repeats
from .rules import quality_rules
from .shingles import jaccard_components
from .vectors import near_vectors


def pseudonym_key(spark: SparkSession) -> str:
    """The owner's secret, from the session; a fixed one for test tables."""
    return spark.conf.get("spark.tallyframe.pseudonymKey", "test tables only")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("kept_text", "text")


def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))
    kinds = F.array_sort(F.transform(F.map_entries("n_found"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    total = F.aggregate(F.map_values("n_found"), F.lit(0), lambda a, b: a + b).cast("long")
    return found.select("doc_id", "text", total.alias("n_found"), F.array_join(kinds, ",").alias("kinds"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_repeats, op2_pages, op3_mixing, op4_jaccard, op5_vectors, op6_licenses, op7_pseudonyms, op8_packing, op9_rules, op10_grades)}

_COMPONENTS = """
, reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
"""

ORACLES = {
    "op4_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) END AS s
  FROM words
), nodes AS (SELECT doc_id AS id, len(s) AS n FROM sets), grams AS (SELECT doc_id, unnest(s) AS g FROM sets), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN nodes p ON p.id = x.doc_id JOIN nodes q ON q.id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
)"""
    + _COMPONENTS
    + "SELECT n.id AS doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM nodes n JOIN reach r ON r.id = n.id GROUP BY n.id, n.n",
    "op5_vectors": """
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), links AS (
  SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.95
)"""
    + _COMPONENTS
    + """SELECT n.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = n.id) AS n_links, min(r.other) AS component_id, n.id = min(r.other) AS kept
FROM nodes n JOIN reach r ON r.id = n.id GROUP BY n.id""",
}
