"""Drawing tables: schemas, a Parquet reader, and views over the driver's tables.

The driver's tables hold no drawings, so sheets, segments, words and labels are
derived from ``lineitem``, ``part``, ``nation`` and ``documents`` by integer
arithmetic that Spark and DuckDB evaluate alike.  Each view is one SQL text.
Nine points are a foot, and all coordinates are multiples of nine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Schemas of the drawing tables (a sheet is a source and a page).
SCHEMAS = {
    "sheets": "source string, page_index int, page_w double, page_h double, page_text string, scale_label string, ppf double",
    "paths": "source string, page_index int, path_ord int, items array<struct<op:string,pts:array<struct<x:double,y:double>>>>, stroke array<double>, fill array<double>, width double, dashes string, closed boolean, kind string, x0 double, y0 double, x1 double, y1 double",
    "words": "source string, page_index int, word_ord int, text string, x0 double, y0 double, x1 double, y1 double",
    "labels": "kind string, source string, page_index int, entity_id string, system string, measurable boolean, confidence string, ambiguous boolean, reasoning string",
}


def read_drawings(spark: SparkSession, folder: str, pages: list[int] | None = None) -> dict[str, DataFrame]:
    """The drawing tables of a folder; ``pages`` is pushed to the Parquet scan."""
    out = {}
    for name, schema in SCHEMAS.items():
        df = spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
        out[name] = df.where(df.page_index.isin(pages)) if pages is not None else df
    return out


#: Each row of lineitem is a segment; a page is a supplier.  Ties in all keys are
#: harmless: such rows are the same segment, which is kept once.
SEGMENTS = """
SELECT DISTINCT sheet, style, x0, y0,
  CASE WHEN flat = 1 THEN x0 + len ELSE x0 END AS x1, CASE WHEN flat = 1 THEN y0 ELSE y0 + len END AS y1, pen_width, grey
FROM (
  SELECT CAST(l_suppkey AS BIGINT) AS sheet, concat(l_returnflag, l_linestatus) AS style,
    CAST(9 * ((7 * l_partkey + 3 * l_orderkey) % 168) AS DOUBLE) AS x0, CAST(9 * ((5 * l_orderkey + 11 * l_partkey) % 120) AS DOUBLE) AS y0,
    CAST(9 * l_quantity AS DOUBLE) AS len, CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 1 ELSE 0 END AS flat,
    CAST(CASE concat(l_returnflag, l_linestatus) WHEN 'NO' THEN 1.3 WHEN 'RF' THEN 0.7 WHEN 'AF' THEN 0.5 ELSE 0.24 END AS DOUBLE) AS pen_width,
    CAST(CASE WHEN l_returnflag = 'A' THEN 0.667 ELSE 0.0 END AS DOUBLE) AS grey
  FROM lineitem
) AS raw
"""

#: Pages are 3024 by 2160 points, with scale labels from five kinds.
SHEETS = """
SELECT CAST(s_suppkey AS BIGINT) AS sheet, concat('set', CAST(s_suppkey % 4 AS STRING)) AS source, 3024.0D AS page_w, 2160.0D AS page_h, 9.0D AS ppf
FROM supplier
"""

#: Size tags at the middle of some segments, and words of other kinds.
WORDS = """
SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS sheet, CAST(p_partkey AS BIGINT) AS word_ord,
  CAST(9 * ((7 * l_partkey + 3 * l_orderkey) % 168) + 4 AS DOUBLE) AS px, CAST(9 * ((5 * l_orderkey + 11 * l_partkey) % 120) + 5 AS DOUBLE) AS py,
  CAST(p_size AS STRING) AS size_text, concat(CAST(p_size AS STRING), '-0') AS length_text,
  concat(upper(substr(p_type, 1, 2)), '-', CAST(p_size AS STRING)) AS tag_text
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

#: Labels of pens by sheet and pen: what a labeler would say.
STYLE_LABELS = """
SELECT sheet, style,
  CASE (sheet + ascii(style)) % 4 WHEN 0 THEN 'Sprinkler pipe' WHEN 1 THEN 'Standpipe' WHEN 2 THEN 'Domestic water' ELSE 'Background' END AS system,
  (sheet + ascii(style)) % 4 < 3 AS measurable,
  CASE (sheet + 3 * ascii(substr(style, 2, 1))) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
  (sheet + 7 * ascii(style)) % 11 = 0 AS ambiguous
FROM (SELECT DISTINCT sheet, style FROM tk_segments) AS pens WHERE (sheet + 5 * ascii(style)) % 13 <> 0
"""

#: Segments for the symbol scan: two thirds of the short ones have pens of their own,
#: so that some pens draw lines and others symbols.
PARTS = """
SELECT sheet, CASE WHEN greatest(x1 - x0, y1 - y0) <= 36 AND (x0 + y0) / 9 % 3 < 2 THEN concat('s', style) ELSE style END AS style, x0, y0, x1, y1
FROM tk_segments
"""

#: Rows of lineitem as slanted segments, rising and falling.
SLANTS = """
SELECT DISTINCT sheet, style, x0, y0, x0 + len AS x1, CASE WHEN rising = 1 THEN y0 + len ELSE y0 - len END AS y1, rising
FROM (
  SELECT CAST(l_suppkey AS BIGINT) AS sheet, l_linestatus AS style,
    CAST(9 * ((7 * l_partkey + 3 * l_orderkey) % 168) AS DOUBLE) AS x0, CAST(9 * ((5 * l_orderkey + 11 * l_partkey) % 120) AS DOUBLE) AS y0,
    CAST(9 * l_quantity AS DOUBLE) AS len, CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 1 ELSE 0 END AS rising
  FROM lineitem
) AS raw
"""

#: Text pages for the trade classifier: whole documents with a phrase put before them.
TRADE_PAGES = """
SELECT doc_id % 97 AS sheet_set, doc_id,
  upper(concat(CASE doc_id % 97 % 7 WHEN 0 THEN 'FIRE PROTECTION PLAN SPRINKLER RISER ' WHEN 1 THEN 'MECHANICAL PLAN DUCT DIFFUSER AHU ' WHEN 2 THEN 'PLUMBING PLAN WATER CLOSET LAVATORY '
    WHEN 3 THEN 'ELECTRICAL PLAN PANELBOARD LUMINAIRE ' WHEN 4 THEN 'DUCT CFM DIFFUSER (M.101) m-102, ' WHEN 5 THEN 'MECHANICAL ROOM ELECTRICAL ROOM FP2.20 ' ELSE 'S-201 A101 M.1011 ' END, coalesce(text, ''))) AS page_text
FROM documents
"""

VIEWS = {"tk_segments": SEGMENTS, "tk_sheets": SHEETS, "tk_words": WORDS, "tk_style_labels": STYLE_LABELS, "tk_parts": PARTS, "tk_slants": SLANTS, "tk_pages": TRADE_PAGES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in ``sf_dir``; no temporary views are left behind."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier", "part", "documents") if t in VIEWS[name]}
    if "tk_segments" in VIEWS[name]:
        tables["tk_segments"] = view(spark, sf_dir, "tk_segments")
    text = VIEWS[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **tables)


def duck(name: str) -> str:
    """The view's text for DuckDB, as a common table expression."""
    text = VIEWS[name].replace("AS STRING)", "AS VARCHAR)").replace("0.0D", "0.0").replace("4.0D", "4.0").replace("9.0D", "9.0")
    return f"{name} AS ({text.strip()})"
