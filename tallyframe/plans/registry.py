"""Queries over the driver's tables and the SQL that checks them.

Each query applies operators of this package to the views of ``sources.views``;
its SQL says the same in DuckDB's dialect over the same views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geometry as G
from ..operators import rollups as R
from ..operators import symbols as Y
from ..sources.views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOLERANCE_PT, RADIUS_PT = 4.5, 18.0


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under its function's name, with the SQL that checks it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            own = [duck(v) for v in views]
            text = sql.strip()
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if 'reach' in sql else ''}" + ", ".join(own + ([text.removeprefix("WITH ").removeprefix("RECURSIVE ")] if text.startswith("WITH ") else [])) + ("" if text.startswith("WITH ") else " " + text) if own else text
        return f

    return put


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "tk_segments")
    seg = F.xxhash64("sheet", "style", "x0", "y0", "x1", "y1")
    return s.withColumn("seg", seg)


_LEN = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"


@query(f"SELECT s.sheet, style, count(*) AS n, round(sum({_LEN}) / 9, 4) AS lf, row_number() OVER (PARTITION BY s.sheet ORDER BY sum({_LEN}) DESC, style) AS pen_rank, max(pen_width) AS pen_width, min(grey) < 0.3 AS is_dark FROM tk_segments s JOIN tk_sheets t ON s.sheet = t.sheet GROUP BY s.sheet, style", ("tk_segments", "tk_sheets"))
def lf_by_pen(spark, sf_dir):
    """Raw linear feet by sheet and pen, ranked (style histogram, style ids)."""
    s = segments(spark, sf_dir).join(view(spark, sf_dir, "tk_sheets").select("sheet", "ppf"), "sheet")
    length = S.segment_length(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    out = s.groupBy("sheet", "style").agg(F.count("*").alias("n"), F.round(F.sum(length) / F.first("ppf"), 4).alias("lf"), F.max("pen_width").alias("pen_width"), (F.min("grey") < 0.3).alias("is_dark"))
    return R.ranked(out, "lf", "style").withColumn("pen_rank", (F.substring("id", 2, 9).cast("long") + 1)).drop("id")


@query(f"WITH pens AS (SELECT sheet, style, max(pen_width) AS w, sum({_LEN}) AS len FROM tk_segments WHERE grey < 0.3 GROUP BY ALL) SELECT sheet, max_by(style, row(w, len, style)) AS style, max(w) AS pen_width FROM pens GROUP BY sheet", ("tk_segments",))
def heaviest_dark_pen(spark, sf_dir):
    s = segments(spark, sf_dir)
    pens = s.where("grey < 0.3").groupBy("sheet", "style").agg(F.max("pen_width").alias("w"), F.sum(S.segment_length(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).alias("len"))
    return pens.groupBy("sheet").agg(F.max_by("style", F.struct("w", "len", "style")).alias("style"), F.max("w").alias("pen_width"))


_RUNS_SQL = """
nodes AS (SELECT DISTINCT sheet, style, x0, y0, x1, y1, CASE WHEN y0 = y1 THEN 1 ELSE 0 END AS flat FROM tk_segments WHERE x0 <> x1 OR y0 <> y1),
spots AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY style, flat, x0, y0, x1, y1) AS id FROM nodes),
ends AS (SELECT sheet, style, flat, id, x0 AS x, y0 AS y FROM spots UNION ALL SELECT sheet, style, flat, id, x1, y1 FROM spots),
links AS (SELECT DISTINCT a.sheet, a.id AS a, b.id AS b FROM ends a JOIN ends b USING (sheet, style, flat, x, y) WHERE a.id <> b.id),
reach(sheet, id, other) AS (SELECT sheet, id, id FROM spots UNION SELECT r.sheet, r.id, l.b FROM reach r JOIN links l ON l.sheet = r.sheet AND l.a = r.other),
root AS (SELECT sheet, id, min(other) AS run FROM reach GROUP BY ALL),
runs AS (SELECT s.sheet, s.style, r.run, sum(x1 - x0 + y1 - y0) AS length_pt, count(*) AS segment_count, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM spots s JOIN root r USING (sheet, id) GROUP BY ALL)
"""


def runs_of(spark, sf_dir) -> DataFrame:
    """Stitched runs, borders out, with their feet (lf) by the sheet's scale."""
    sheets = view(spark, sf_dir, "tk_sheets")
    runs = G.stitch_runs(segments(spark, sf_dir).select("sheet", "style", "seg", "x0", "y0", "x1", "y1"), lattice=9.0)
    runs = G.without_borders(runs, sheets).join(sheets.select("sheet", "ppf", "page_w", "page_h"), "sheet")
    return runs.withColumn("lf", F.col("length_pt") / F.col("ppf"))


@query("WITH " + _RUNS_SQL.strip() + " SELECT sheet, style, count(*) AS n_runs, round(sum(length_pt) / 9, 4) AS lf, max(length_pt) AS longest_pt, CAST(max(segment_count) AS BIGINT) AS most_segments FROM runs GROUP BY sheet, style", ("tk_segments",))
def runs_by_pen(spark, sf_dir):
    """Stitched runs, borders out: count, feet and longest by sheet and pen."""
    return runs_of(spark, sf_dir).groupBy("sheet", "style").agg(F.count("*").alias("n_runs"), F.round(F.sum("lf"), 4).alias("lf"), F.max("length_pt").alias("longest_pt"), F.max("segment_count").alias("most_segments"))


_NETS_SQL = (
    _RUNS_SQL.strip()
    + """,
pieces AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY style, x0, y0, x1, y1) AS pid FROM runs),
tips AS (SELECT sheet, pid, x0 AS x, y0 AS y FROM pieces UNION ALL SELECT sheet, pid, x1, y1 FROM pieces),
meets AS (SELECT DISTINCT t.sheet, t.pid AS a, p.pid AS b FROM tips t JOIN pieces p ON p.sheet = t.sheet AND p.pid <> t.pid
  AND t.x BETWEEN p.x0 - 4.5 AND p.x1 + 4.5 AND t.y BETWEEN p.y0 - 4.5 AND p.y1 + 4.5
  AND sqrt(power(greatest(p.x0 - t.x, 0, t.x - p.x1), 2) + power(greatest(p.y0 - t.y, 0, t.y - p.y1), 2)) <= 4.5),
both_ways AS (SELECT sheet, a, b FROM meets UNION SELECT sheet, b, a FROM meets),
joined(sheet, id, other) AS (SELECT sheet, pid, pid FROM pieces UNION SELECT r.sheet, r.id, l.b FROM joined r JOIN both_ways l ON l.sheet = r.sheet AND l.a = r.other),
net AS (SELECT sheet, id, min(other) AS net FROM joined GROUP BY ALL),
networks AS (SELECT p.sheet, n.net, count(*) AS n_runs, sum(length_pt) AS length_pt, count(DISTINCT style) AS n_styles, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM pieces p JOIN net n ON n.sheet = p.sheet AND n.id = p.pid GROUP BY ALL)
"""
)


def networks_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    runs = G.settle(runs_of(spark, sf_dir), "runs")
    return runs, G.settle(G.networks(runs, TOLERANCE_PT), "networks")


@query("WITH " + _NETS_SQL.strip() + " SELECT sheet, CAST(count(*) AS BIGINT) AS n_networks, round(max(length_pt) / 9, 4) AS largest_lf, CAST(max(n_runs) AS BIGINT) AS most_runs, CAST(max(n_styles) AS BIGINT) AS most_styles, round(max(100 * greatest((x1 - x0) / 3024, (y1 - y0) / 2160)), 4) AS widest_span FROM networks GROUP BY sheet", ("tk_segments",))
def networks_by_sheet(spark, sf_dir):
    """Networks: tee joins within half a foot; count, largest, span."""
    runs, nets = networks_of(spark, sf_dir)
    n = runs.join(nets, ["sheet", "run"]).groupBy("sheet", "network").agg(F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"), F.count("*").alias("n_runs"), F.sum("lf").alias("lf"), F.countDistinct("style").alias("n_styles"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    span = S.page_span_percent(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("page_w"), F.col("page_h"))
    return n.groupBy("sheet").agg(F.count("*").alias("n_networks"), F.round(F.max("lf"), 4).alias("largest_lf"), F.max("n_runs").alias("most_runs"), F.max("n_styles").alias("most_styles"), F.round(F.max(span), 4).alias("widest_span"))


@query("WITH " + _NETS_SQL.strip() + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY length_pt DESC, net) AS k FROM networks) SELECT sheet, round(sum(CASE WHEN k <= 3 THEN length_pt ELSE 0 END) / sum(length_pt), 4) AS top3_share FROM ranked GROUP BY sheet", ("tk_segments",))
def top3_share(spark, sf_dir):
    runs, nets = networks_of(spark, sf_dir)
    total = runs.join(nets, ["sheet", "run"])
    return total.groupBy("sheet").agg(F.round(F.sum(F.when(F.col("network") < 3, F.col("length_pt")).otherwise(0)) / F.sum("length_pt"), 4).alias("top3_share"))


def size_tags(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "tk_words").withColumn("size", S.nominal_size(F.col("size_text"))).where("size is not null").select("sheet", "word_ord", "px", "py", "size")


_TAG_SQL = """,
tags AS (SELECT sheet, word_ord, px, py, CAST(size_text AS DOUBLE) AS size FROM tk_words WHERE size_text IN ('1', '2', '3', '4', '6', '8')),
near AS (SELECT r.sheet, r.run, t.size, t.word_ord, sqrt(power(greatest(r.x0 - t.px, 0, t.px - r.x1), 2) + power(greatest(r.y0 - t.py, 0, t.py - r.y1), 2)) AS d FROM runs r JOIN tags t ON t.sheet = r.sheet
  AND t.px BETWEEN r.x0 - 18 AND r.x1 + 18 AND t.py BETWEEN r.y0 - 18 AND r.y1 + 18),
best AS (SELECT sheet, run, max_by(size, row(-round(d, 6), word_ord)) AS size FROM near WHERE d <= 18 GROUP BY ALL),
sized AS (SELECT r.*, b.size FROM runs r LEFT JOIN best b ON b.sheet = r.sheet AND b.run = r.run)
"""


@query("WITH " + _RUNS_SQL.strip() + _TAG_SQL.strip() + " SELECT sheet, coalesce(CAST(CAST(size AS INT) AS VARCHAR) || '\"', 'unsized') AS size_text, count(*) AS n_runs, round(sum(length_pt) / 9, 4) AS lf FROM sized GROUP BY ALL", ("tk_segments", "tk_words"))
def lf_by_size(spark, sf_dir):
    """Linear feet by the nearest size tag within two feet."""
    runs = G.settle(runs_of(spark, sf_dir), "runs")
    sized = runs.join(G.nearest_tag(runs, size_tags(spark, sf_dir), RADIUS_PT), ["sheet", "run"])
    return sized.groupBy("sheet", F.coalesce(S.size_label(F.col("size")), F.lit("unsized")).alias("size_text")).agg(F.count("*").alias("n_runs"), F.round(F.sum("lf"), 4).alias("lf"))


_ITEM_SQL = """,
items AS (SELECT r.*, coalesce(system, '(unlabeled)') AS system, coalesce(confidence, 'low') AS confidence,
  CASE WHEN system IS NULL THEN 'not labelled' WHEN NOT measurable AND NOT ambiguous THEN 'excluded' WHEN measurable AND NOT ambiguous AND confidence <> 'low' THEN 'counted' ELSE 'flagged' END AS state
  FROM {src} r LEFT JOIN tk_style_labels l ON l.sheet = r.sheet AND l.style = r.style)
"""


def labelled_runs(spark, sf_dir, runs: DataFrame) -> DataFrame:
    return R.item_gate(R.with_labels(runs, view(spark, sf_dir, "tk_style_labels"), ["sheet", "style"]))


#: Networks of the runs whose pens have a trusted label, and what a labeler would say of each.
_NET_LABEL_SQL = (
    _RUNS_SQL.strip().replace("runs AS (", "all_runs AS (", 1)
    + """,
runs AS (SELECT r.* FROM all_runs r JOIN tk_style_labels l ON l.sheet = r.sheet AND l.style = r.style WHERE measurable AND NOT ambiguous AND confidence <> 'low'),
"""
    + _NETS_SQL[len(_RUNS_SQL.strip()) :].strip().lstrip(",")
    + """,
spots_of AS (SELECT *, CAST(sheet + x0 / 9 + 3 * y0 / 9 AS BIGINT) AS k FROM networks),
labelled AS (SELECT *, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 4 = 0 THEN 'Sprinkler pipe' WHEN k % 4 = 1 THEN 'Standpipe' WHEN k % 4 = 2 THEN 'Domestic water' ELSE 'Match line' END AS system, k % 4 < 3 AS measurable,
  CASE k % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, k % 11 = 0 AS ambiguous FROM spots_of),
gated AS (SELECT *, CASE WHEN system IS NULL OR NOT measurable THEN 'excluded' WHEN NOT ambiguous AND confidence <> 'low' THEN 'counted' ELSE 'flagged' END AS state FROM labelled)
"""
)


def labelled_networks(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs of trusted pens, their networks, the networks with label and state)."""
    runs = G.settle(R.trusted_runs(runs_of(spark, sf_dir), view(spark, sf_dir, "tk_style_labels")), "runs")
    nets = G.settle(G.networks(runs, TOLERANCE_PT), "networks")
    box = [f(c).alias(c) for f, cs in ((F.min, ("x0", "y0")), (F.max, ("x1", "y1"))) for c in cs]
    facts = runs.join(nets, ["sheet", "run"]).groupBy("sheet", "network", "page_w", "page_h").agg(F.sum("lf").alias("lf"), *box)
    facts = facts.withColumn("id", F.concat(F.lit("N"), F.col("network").cast("string"))).withColumn("spans", S.spans_page(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("page_w"), F.col("page_h")))
    k = (F.col("sheet") + F.col("x0") / 9 + 3 * F.col("y0") / 9).cast("long")
    names = F.element_at(F.array(*map(F.lit, ("Sprinkler pipe", "Standpipe", "Domestic water", "Match line"))), (k % 4 + 1).cast("int"))
    said = facts.where(k % 13 != 0).select("sheet", "network", names.alias("system"), (k % 4 < 3).alias("measurable"), F.when(k % 5 == 0, "low").when(k % 5 == 1, "medium").otherwise("high").alias("confidence"), (k % 11 == 0).alias("ambiguous"), F.lit("").alias("reasoning"))
    return runs, nets, R.entity_gate(R.with_labels(facts, said, ["sheet", "network"]))


@query("WITH " + _NET_LABEL_SQL.strip() + _TAG_SQL.strip() + """, parts AS (SELECT g.system, p.length_pt, coalesce(CAST(CAST(z.size AS INT) AS VARCHAR) || '"', 'unsized') AS size_text
  FROM pieces p JOIN net n ON n.sheet = p.sheet AND n.id = p.pid JOIN gated g ON g.sheet = n.sheet AND g.net = n.net JOIN sized z ON z.sheet = p.sheet AND z.run = p.run WHERE g.state = 'counted')
SELECT system, coalesce(size_text, 'total') AS size_text, round(sum(length_pt / 9), 4) AS lf FROM parts GROUP BY GROUPING SETS ((system, size_text), (system))""", ("tk_segments", "tk_words", "tk_style_labels"))  # fmt: skip
def takeoff_system_size(spark, sf_dir):
    """Linear feet by system and pipe size over trusted networks, with a total for each system."""
    runs, nets, gated = labelled_networks(spark, sf_dir)
    items = runs.select("sheet", "run", "lf").join(nets, ["sheet", "run"]).join(gated.select("sheet", "network", "system", "state"), ["sheet", "network"])
    return R.system_size(items, G.nearest_tag(runs, size_tags(spark, sf_dir), RADIUS_PT))


@query("WITH " + _NET_LABEL_SQL.strip() + """ SELECT sheet, CASE WHEN state = 'counted' THEN 'confirm' ELSE state END AS kind, count(*) AS n, sum(CASE WHEN system IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_unlabelled
FROM gated WHERE state <> 'counted' OR greatest((x1 - x0) / 3024, (y1 - y0) / 2160) >= 0.8 GROUP BY ALL""", ("tk_segments", "tk_style_labels"))  # fmt: skip
def network_notes(spark, sf_dir):
    """Review notes of networks that are not counted, or to confirm, by sheet and kind."""
    notes = R.network_notes(labelled_networks(spark, sf_dir)[2])
    return notes.groupBy("sheet", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("note").contains("no label returned")).alias("n_unlabelled"))


@query("WITH RECURSIVE " + """spots AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY style, rising, x0, y0, x1) AS id FROM tk_slants),
ends AS (SELECT sheet, style, rising, id, x0 AS x, y0 AS y FROM spots UNION ALL SELECT sheet, style, rising, id, x1, y1 FROM spots),
links AS (SELECT DISTINCT a.sheet, a.id AS a, b.id AS b FROM ends a JOIN ends b USING (sheet, style, rising, x, y) WHERE a.id <> b.id),
reach(sheet, id, other) AS (SELECT sheet, id, id FROM spots UNION SELECT r.sheet, r.id, l.b FROM reach r JOIN links l ON l.sheet = r.sheet AND l.a = r.other),
root AS (SELECT sheet, id, min(other) AS run FROM reach GROUP BY ALL),
pieces AS (SELECT s.*, r.run FROM spots s JOIN root r USING (sheet, id)),
tips AS (SELECT sheet, run, min_by(y0, x0) AS ya, min(x0) AS xa, max_by(y1, x1) AS yb, max(x1) AS xb FROM pieces GROUP BY ALL),
points AS (SELECT sheet, run, xa AS x, ya AS y FROM tips UNION ALL SELECT sheet, run, xb, yb FROM tips),
near AS (SELECT p.sheet, p.run AS a, q.run AS b, p.x - q.x0 AS dx, p.y - q.y0 AS dy, q.x1 - q.x0 AS ux, q.y1 - q.y0 AS uy FROM points p JOIN pieces q ON q.sheet = p.sheet AND q.run <> p.run AND p.x BETWEEN q.x0 - 4.5 AND q.x1 + 4.5 AND p.y BETWEEN least(q.y0, q.y1) - 4.5 AND greatest(q.y0, q.y1) + 4.5),
clamped AS (SELECT *, greatest(0, least(1, (dx * ux + dy * uy) / (ux * ux + uy * uy))) AS t FROM near),
meets AS (SELECT DISTINCT sheet, a, b FROM clamped WHERE sqrt(power(dx - t * ux, 2) + power(dy - t * uy, 2)) <= 4.5 + 1e-9),
both_ways AS (SELECT sheet, a, b FROM meets UNION SELECT sheet, b, a FROM meets),
joined(sheet, id, other) AS (SELECT sheet, run, run FROM tips UNION SELECT r.sheet, r.id, l.b FROM joined r JOIN both_ways l ON l.sheet = r.sheet AND l.a = r.other),
net AS (SELECT sheet, id, min(other) AS net FROM joined GROUP BY ALL),
sums AS (SELECT p.sheet, n.net, count(DISTINCT p.run) AS n_runs, sum(sqrt(2) * (x1 - x0)) / 9 AS lf FROM pieces p JOIN net n ON n.sheet = p.sheet AND n.id = p.run GROUP BY ALL)
SELECT sheet, count(*) AS n_networks, CAST(sum(n_runs) AS BIGINT) AS n_runs, CAST(max(n_runs) AS BIGINT) AS most_runs, round(max(lf), 3) AS largest_lf FROM sums GROUP BY sheet""", ("tk_slants",))  # fmt: skip
def slant_networks(spark, sf_dir):
    """Runs and networks of rising and falling lines, where a run's box says little."""
    s = view(spark, sf_dir, "tk_slants").repartition("sheet").withColumn("seg", F.xxhash64("sheet", "style", "x0", "y0", "x1", "y1"))
    runs = G.settle(G.stitch_runs(s.select("sheet", "style", "seg", "x0", "y0", "x1", "y1"), lattice=9.0), "runs")
    feet = G.networks(runs, TOLERANCE_PT, lengths=True).groupBy("sheet", "network").agg(F.count("*").alias("n_runs"), (F.sum("length_pt") / 9).alias("lf"))
    return feet.groupBy("sheet").agg(F.count("*").alias("n_networks"), F.sum("n_runs").alias("n_runs"), F.max("n_runs").alias("most_runs"), F.round(F.max("lf"), 3).alias("largest_lf"))


@query("WITH " + _RUNS_SQL.strip() + ", pens AS (SELECT sheet, style, sum(length_pt) / 9 AS lf, count(*) AS n_runs FROM runs GROUP BY ALL)" + _ITEM_SQL.strip().format(src="pens") + " SELECT system, round(sum(round(lf, 1)), 1) AS lf, count(DISTINCT sheet) AS n_sheets, count(DISTINCT style) AS n_styles, CASE max(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS worst FROM items WHERE state = 'counted' GROUP BY system", ("tk_segments", "tk_style_labels"))
def takeoff_by_system(spark, sf_dir):
    pens = runs_of(spark, sf_dir).groupBy("sheet", "style").agg(F.sum("lf").alias("lf"), F.count("*").alias("n_runs"))
    return R.by_system(labelled_runs(spark, sf_dir, pens))


@query("WITH " + _RUNS_SQL.strip() + ", pens AS (SELECT sheet, style, sum(length_pt) / 9 AS lf FROM runs GROUP BY ALL)" + _ITEM_SQL.strip().format(src="pens") + " SELECT state, count(*) AS n, round(sum(lf), 1) AS lf FROM items WHERE state <> 'counted' GROUP BY state", ("tk_segments", "tk_style_labels"))
def takeoff_review(spark, sf_dir):
    """Everything that was not counted, by reason."""
    pens = runs_of(spark, sf_dir).groupBy("sheet", "style").agg(F.sum("lf").alias("lf"))
    return R.review(labelled_runs(spark, sf_dir, pens))


@query("SELECT sheet, tag_text AS tag, count(*) AS n FROM tk_words WHERE regexp_full_match(tag_text, '[A-Z]{1,5}-?[0-9]{1,3}') GROUP BY ALL", ("tk_words",))
def fixture_tags(spark, sf_dir):
    words = view(spark, sf_dir, "tk_words").select("sheet", F.col("tag_text").alias("text"))
    return Y.fixture_tags(words).withColumnRenamed("count", "n")


@query("SELECT sheet, count(*) AS n, sum(CAST(split_part(length_text, '-', 1) AS DOUBLE)) AS feet FROM tk_words WHERE CAST(split_part(length_text, '-', 1) AS INT) BETWEEN 1 AND 60 GROUP BY sheet", ("tk_words",))
def length_tags(spark, sf_dir):
    feet = S.length_tag_feet(F.col("length_text"))
    return view(spark, sf_dir, "tk_words").withColumn("feet", feet).where("feet is not null").groupBy("sheet").agg(F.count("*").alias("n"), F.sum("feet").alias("feet"))


@query("WITH t AS (SELECT sheet, word_ord, px, py, CAST(split_part(length_text, '-', 1) AS DOUBLE) AS feet FROM tk_words), m AS (SELECT t.sheet, t.word_ord, t.px, t.py, t.feet, (x1 - x0 + y1 - y0) AS pt, round(sqrt(power(t.px - (x0 + x1) / 2, 2) + power(t.py - (y0 + y1) / 2, 2)), 6) AS d FROM t JOIN tk_segments s ON s.sheet = t.sheet AND (x1 - x0 + y1 - y0) BETWEEN 0.5 * feet * 9 AND 1.6 * feet * 9 AND abs(t.px - (x0 + x1) / 2) <= 70 AND abs(t.py - (y0 + y1) / 2) <= 70), b AS (SELECT sheet, word_ord, px, py, feet, min(d) AS d FROM m WHERE d <= 70 GROUP BY ALL) SELECT sheet, count(*) AS n_matched, round(sum(d), 3) AS distance FROM b GROUP BY sheet", ("tk_words", "tk_segments"))
def dimension_reach(spark, sf_dir):
    """Length tags with a segment of plausible length within 70 points, and how near it is."""
    tags = view(spark, sf_dir, "tk_words").withColumn("feet", S.length_tag_feet(F.col("length_text"))).select("sheet", F.struct("word_ord", "px", "py").alias("word_ord"), "px", "py", "feet")
    s = segments(spark, sf_dir).select("sheet", "seg", "x0", "y0", "x1", "y1")
    best = G.dimension_matches(s, tags, view(spark, sf_dir, "tk_sheets"))
    mid = s.select("sheet", "seg", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    d = F.round(F.hypot(F.col("word_ord.px") - F.col("mx"), F.col("word_ord.py") - F.col("my")), 6)
    return best.join(mid, ["sheet", "seg"]).groupBy("sheet").agg(F.count("*").alias("n_matched"), F.round(F.sum(d), 3).alias("distance"))


CAP_PT = 36.0


def _symbol_paths(spark, sf_dir) -> DataFrame:
    s = view(spark, sf_dir, "tk_parts").withColumn("path_ord", F.xxhash64("sheet", "style", "x0", "y0", "x1", "y1"))
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    items = F.array(F.struct(F.lit("l").alias("op"), F.array(at("x0", "y0"), at("x1", "y1")).alias("pts")))
    return s.select("sheet", "style", "path_ord", items.alias("items"), F.lit("stroke").alias("kind"), F.lit(False).alias("closed"), F.lit(None).cast("string").alias("fill"), "x0", "y0", "x1", "y1")


def symbol_parts(spark, sf_dir) -> DataFrame:
    """Repeated parts: suspects without line-work pens, duplicates and one-offs."""
    small = Y.symbol_suspects(_symbol_paths(spark, sf_dir), F.lit(CAP_PT))
    small = small.withColumn("token", Y.style_token(F.col("style"), F.col("fill"), F.col("kind"), F.col("closed")))
    return G.settle(Y.repeated_parts(small.withColumn("sig", Y.path_signature(F.col("items"), F.col("token")))), "parts")


def symbol_instances(spark, sf_dir) -> DataFrame:
    """Repeated parts, grouped, with the signature of all parts of an instance together."""
    parts = symbol_parts(spark, sf_dir)
    return Y.composites(parts, Y.instances(parts), F.lit(CAP_PT), view(spark, sf_dir, "tk_sheets"))


_LINEWORK_SQL = "SELECT sheet, style, sum(CASE WHEN greatest(x1 - x0, y1 - y0) > 36 THEN 1 ELSE 0 END)::BIGINT AS n_long, count(*) AS n FROM tk_parts GROUP BY sheet, style HAVING sum(CASE WHEN greatest(x1 - x0, y1 - y0) > 36 THEN 1 ELSE 0 END) >= greatest(5, 0.25 * count(*))"
#: An instance is what its parts' boxes say in the least of the eight frames, from its own corner.
_SYMBOL_SQL = (
    """
WITH linework AS ("""
    + _LINEWORK_SQL
    + """),
small AS (SELECT *, style || CAST(x1 - x0 + y1 - y0 AS VARCHAR) AS sig, row_number() OVER (PARTITION BY sheet ORDER BY style, x0, y0, x1, y1) AS id FROM (SELECT DISTINCT * FROM tk_parts) p WHERE greatest(x1 - x0, y1 - y0) BETWEEN 2 AND 36 AND NOT EXISTS (SELECT 1 FROM linework l WHERE l.sheet = p.sheet AND l.style = p.style)),
parts AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sheet, sig) AS n FROM small) WHERE n >= 2),
links AS (SELECT a.sheet, a.id AS a, b.id AS b FROM parts a JOIN parts b ON a.sheet = b.sheet AND a.id <> b.id AND a.x0 - 0.75 <= b.x1 + 0.75 AND b.x0 - 0.75 <= a.x1 + 0.75 AND a.y0 - 0.75 <= b.y1 + 0.75 AND b.y0 - 0.75 <= a.y1 + 0.75),
reach(sheet, id, other) AS (SELECT sheet, id, id FROM parts UNION SELECT r.sheet, r.id, l.b FROM reach r JOIN links l ON l.sheet = r.sheet AND l.a = r.other),
root AS (SELECT sheet, id, min(other) AS instance FROM reach GROUP BY ALL),
frames(f, a, b, c, d) AS (VALUES (0, 1, 0, 0, 1), (1, 0, -1, 1, 0), (2, -1, 0, 0, -1), (3, 0, 1, -1, 0), (4, -1, 0, 0, 1), (5, 1, 0, 0, -1), (6, 0, 1, 1, 0), (7, 0, -1, -1, 0)),
turned AS (SELECT p.sheet, r.instance, f, style, least(a * x0 + b * y0, a * x1 + b * y1) AS u0, least(c * x0 + d * y0, c * x1 + d * y1) AS v0, greatest(a * x0 + b * y0, a * x1 + b * y1) AS u1, greatest(c * x0 + d * y0, c * x1 + d * y1) AS v1 FROM parts p JOIN root r ON r.sheet = p.sheet AND r.id = p.id, frames),
shifted AS (SELECT *, min(u0) OVER w AS ou, min(v0) OVER w AS ov FROM turned WINDOW w AS (PARTITION BY sheet, instance, f)),
written AS (SELECT sheet, instance, f, string_agg(part, '+' ORDER BY part) AS whole FROM (SELECT *, concat_ws(',', style, u0 - ou, v0 - ov, u1 - ou, v1 - ov) AS part FROM shifted) GROUP BY ALL),
shape AS (SELECT sheet, instance, min(whole) AS composite FROM written GROUP BY ALL),
inst AS (SELECT p.sheet, r.instance, count(*) AS n_parts, any_value(s.composite) AS composite, greatest(max(x1) - min(x0), max(y1) - min(y0)) AS extent FROM parts p JOIN root r ON r.sheet = p.sheet AND r.id = p.id JOIN shape s ON s.sheet = p.sheet AND s.instance = r.instance GROUP BY ALL)
"""
)
_CLUSTER_SQL = _SYMBOL_SQL + ", c AS (SELECT sheet, composite, count(*) AS n, any_value(n_parts) AS n_parts FROM inst WHERE extent <= 36 GROUP BY ALL HAVING count(*) >= 2)"


@query(_CLUSTER_SQL + " SELECT sheet, count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_instances, CAST(max(n) AS BIGINT) AS largest, CAST(sum(n * n_parts) AS BIGINT) AS n_parts FROM c GROUP BY sheet", ("tk_segments", "tk_parts"))
def symbol_clusters(spark, sf_dir):
    """Clusters of congruent instances by sheet."""
    inst = G.settle(symbol_instances(spark, sf_dir).where("not oversized"), "instances")
    c = Y.cluster_symbols(inst)
    return c.groupBy("sheet").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_instances"), F.max("n").alias("largest"), F.sum(F.col("n") * F.col("exemplar.n_parts")).alias("n_parts"))


@query(
    _CLUSTER_SQL + """, k AS (SELECT *, (sheet + 3 * n + n_parts) AS k FROM c),
l AS (SELECT *, CASE WHEN k % 13 = 0 THEN NULL ELSE CASE k % 4 WHEN 0 THEN 'Sprinkler head' WHEN 1 THEN 'Valve' WHEN 2 THEN 'Cleanout' ELSE 'Annotation' END END AS system FROM k)
SELECT system, CAST(sum(n) AS BIGINT) AS ea FROM l WHERE system IS NOT NULL AND k % 4 < 3 AND k % 11 <> 0 AND k % 5 <> 0 GROUP BY system""", ("tk_segments", "tk_parts"))  # fmt: skip
def takeoff_counts(spark, sf_dir):
    """Each component's count over trusted clusters."""
    return R.component_counts(labelled_clusters(spark, sf_dir))


def labelled_clusters(spark, sf_dir) -> DataFrame:
    """Clusters with what a labeler would say of each, and their state."""
    clusters = Y.cluster_symbols(G.settle(symbol_instances(spark, sf_dir).where("not oversized"), "instances"))
    k = F.col("sheet") + 3 * F.col("n") + F.col("exemplar.n_parts")
    names = F.element_at(F.array(*map(F.lit, ("Sprinkler head", "Valve", "Cleanout", "Annotation"))), (k % 4 + 1).cast("int"))
    said = clusters.where(k % 13 != 0).select("sheet", F.col("cluster").alias("id"), names.alias("system"), (k % 4 < 3).alias("measurable"), F.when(k % 5 == 0, "low").when(k % 5 == 1, "medium").otherwise("high").alias("confidence"), (k % 11 == 0).alias("ambiguous"), F.lit("").alias("reasoning"))
    return Y.component_takeoff(clusters, said)


@query(
    _CLUSTER_SQL + """, k AS (SELECT *, (sheet + 3 * n + n_parts) AS k FROM c)
SELECT CASE WHEN k % 13 = 0 OR k % 4 = 3 THEN 'excluded' ELSE 'flagged' END AS kind, count(*) AS n FROM k WHERE k % 13 = 0 OR k % 4 = 3 OR k % 11 = 0 OR k % 5 = 0 GROUP BY 1""", ("tk_segments", "tk_parts"))  # fmt: skip
def cluster_notes(spark, sf_dir):
    """Review notes of clusters by kind."""
    return R.cluster_notes(labelled_clusters(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query(_SYMBOL_SQL + " SELECT sheet, count(*) AS n_instances, CAST(sum(CASE WHEN extent > 36 THEN 1 ELSE 0 END) AS BIGINT) AS n_oversized, CAST(sum(n_parts) AS BIGINT) AS n_parts FROM inst GROUP BY sheet", ("tk_segments", "tk_parts"))
def symbol_scan(spark, sf_dir):
    return symbol_instances(spark, sf_dir).groupBy("sheet").agg(F.count("*").alias("n_instances"), F.count_if("oversized").alias("n_oversized"), F.sum("n_parts").alias("n_parts"))


@query(_LINEWORK_SQL, ("tk_segments", "tk_parts"))
def linework_pens(spark, sf_dir):
    paths = _symbol_paths(spark, sf_dir)
    pens = Y.linework_pens(paths, F.lit(CAP_PT))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return paths.join(pens, ["sheet", "style"], "left_semi").groupBy("sheet", "style").agg(F.count_if(extent > CAP_PT).alias("n_long"), F.count("*").alias("n"))


def symbol_cores(spark, sf_dir):
    """Instances by shared cores (an ordered search in each sheet; no SQL says the same)."""
    small = symbol_parts(spark, sf_dir)
    parts = small.join(Y.instances(small), ["sheet", "path_ord"])
    size = parts.groupBy("sheet", "instance").agg(F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("extent"))
    parts = parts.join(size.where(F.col("extent") <= CAP_PT), ["sheet", "instance"])
    return Y.core_clusters(parts).groupBy("sheet", "key").agg(F.sum("times").alias("n"))


QUERIES["symbol_cores"] = symbol_cores


@query(f"SELECT s.sheet, count(*) AS n_paths, 0.0 AS near_zero, round(100 * greatest((max(x1) - min(x0)) / any_value(page_w), (max(y1) - min(y0)) / any_value(page_h)), 4) AS span_percent FROM tk_segments s JOIN tk_sheets t ON t.sheet = s.sheet GROUP BY s.sheet", ("tk_segments", "tk_sheets"))
def cleanliness(spark, sf_dir):
    """How clean each sheet's line work is."""
    s = segments(spark, sf_dir).withColumn("length_pt", S.segment_length(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))
    return R.cleanliness(s, view(spark, sf_dir, "tk_sheets"))


@query("SELECT sheet, CAST(size_text AS DOUBLE) AS size, count(*) AS n FROM tk_words WHERE size_text IN ('1', '2', '3', '4', '6', '8') GROUP BY ALL", ("tk_words",))
def size_tag_histogram(spark, sf_dir):
    return size_tags(spark, sf_dir).groupBy("sheet", "size").agg(F.count("*").alias("n"))


def _trade_sql() -> str:
    """Scores by the rule: every page's flags, then sums and distinct words by set."""
    has = lambda w: "regexp_matches(page_text, '\\b" + w.replace("-", "\\-").replace(" ", "\\s+") + "\\b')"
    number = "list_distinct(list_transform(list_filter(list_transform(string_split_regex(page_text, '\\s+'), lambda w: trim(w, '.,;:()[]{}''\"')), lambda w: regexp_full_match(w, '(FP|[MPSAE])[-.]?[0-9]{1,3}(\\.[0-9]{1,2})?')), lambda w: regexp_extract(w, '^(FP|[MPSAE])', 1)))"
    letter = {t: k for k, t in S.TRADE_LETTERS}
    out = []
    for place, (trade, names, words) in enumerate(R.TRADES):
        out.append(f"SELECT sheet_set, '{trade}' AS trade, {place} AS place, CAST(4 * count(*) FILTER (WHERE {' OR '.join(map(has, names))}) + 2 * count(*) FILTER (WHERE list_contains(numbers, '{letter[trade]}')) + least({' + '.join(f'max(CAST({has(w)} AS INT))' for w in words)}, 6) AS BIGINT) AS score FROM numbered GROUP BY sheet_set")
    return f"WITH numbered AS (SELECT *, {number} AS numbers FROM tk_pages), scores AS (" + " UNION ALL ".join(out) + ")"


@query(_trade_sql() + " SELECT sheet_set, trade, score FROM scores", ("tk_pages",))
def trade_scores(spark, sf_dir):
    """Trade scores by set of pages, over whole texts."""
    return R.trade_scores(view(spark, sf_dir, "tk_pages")).select("sheet_set", "trade", "score")


@query(_trade_sql() + ", r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM scores WINDOW w AS (PARTITION BY sheet_set ORDER BY score DESC, place)) SELECT sheet_set, CASE WHEN score >= 4 AND score >= 1.5 * second THEN trade END AS trade, score FROM r WHERE k = 1", ("tk_pages",))
def trades(spark, sf_dir):
    return R.decide_trade(R.trade_scores(view(spark, sf_dir, "tk_pages")))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_size AS VARCHAR) || '\"' AS label FROM part WHERE p_size IN (1, 2, 3, 4, 6, 8)")
def pipe_sizes(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = S.nominal_size(F.concat(F.col("p_size").cast("string"), F.lit('"')))
    return part.select("p_partkey", size.alias("size")).where("size is not null").withColumn("label", S.size_label(F.col("size")))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 9.0 WHEN 1 THEN 18.0 WHEN 2 THEN 108.0 WHEN 3 THEN 3.6 END AS ppf FROM nation")
def scale_labels(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    texts = F.element_at(F.array(F.lit('PLAN SCALE: 1/8" = 1\'-0" NTS'), F.lit('1/4"=1\'-0"'), F.lit('SCALE 1-1/2" = 1\'-0"'), F.lit('1" = 20\''), F.lit("AS NOTED")), F.col("n_regionkey") + 1)
    return nation.select("n_nationkey", F.round(S.points_per_foot(S.detect_scale_label(texts)), 4).alias("ppf"))
