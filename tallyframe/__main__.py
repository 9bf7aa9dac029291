"""Command line: python -m tallyframe measure|sizes|count FOLDER --labels LABELS [--out DIR].

FOLDER holds the drawing tables as Parquet; LABELS is a Parquet file of the
labels table (kind: style, network or symbol).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .plans import takeoff as T
from .sources import sinks
from .sources.views import SCHEMAS, read_drawings


def _labels(spark: SparkSession, path: str | None, kind: str) -> DataFrame:
    rows = spark.read.schema(SCHEMAS["labels"]).parquet(path) if path else spark.createDataFrame([], SCHEMAS["labels"])
    return rows.where(F.col("kind") == kind).select(S.sheet_id(F.col("source"), F.col("page_index")).alias("sheet"), F.col("entity_id").alias("id"), *T.LABEL)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="tallyframe")
    p.add_argument("mode", choices=["measure", "sizes", "count"])
    p.add_argument("folder")
    p.add_argument("--labels")
    p.add_argument("--scale", help="a scale label that overrides those of the sheets")
    p.add_argument("--pages", type=lambda t: [int(x) for x in t.split(",")], help="page numbers from 0")
    p.add_argument("--out", help="folder for the files; without it the report is printed")
    p.add_argument("--project", default="takeoff")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyframe").getOrCreate()
    drawings = read_drawings(spark, a.folder, a.pages)
    if a.mode == "measure":
        made = T.takeoff_by_system(drawings, _labels(spark, a.labels, "style"), a.scale)
        lines, write = sinks.diagnostics_lines, lambda folder: None
    elif a.mode == "sizes":
        made = T.takeoff_system_size(drawings, _labels(spark, a.labels, "style"), _labels(spark, a.labels, "network"), a.scale)
        lines, write = sinks.system_size_lines, lambda folder: sinks.write_system_size(made, folder / "takeoff.xlsx")
    else:
        made = T.takeoff_counts(drawings, _labels(spark, a.labels, "symbol"), a.scale)
        lines, write = sinks.counts_lines, lambda folder: sinks.write_counts(made, folder / "counts.xlsx")
    if not a.out:
        text = "\n".join(lines(made))
        print(text)
        return text
    if a.mode == "measure":
        return str(sinks.write_documents(made, a.out, a.project))
    folder = sinks.document_folder(a.out, a.project)
    write(folder)
    return str(folder)


if __name__ == "__main__":
    main()
