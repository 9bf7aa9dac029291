"""Distance joins, components, runs, networks and sizes on sheets.

Everything is keyed by ``sheet`` (source and page), so a shuffle on the sheet
serves all steps.  Spatial joins never compare all pairs: both sides are dealt
to grid cells and joined on (sheet, cell), then tested exactly.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


#: Ends and segments tested at a time.
PAIRS = 1 << 20


def settle(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder of spark.checkpoint.dir; where
    none is set (a single machine), in a folder of the session's own, set there."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # releases the shuffles of what is written
    return spark.read.schema(df.schema).parquet(path)


def cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def in_cells(df: DataFrame, x0: str, y0: str, x1: str, y1: str, size: float, grow: float = 0.0) -> DataFrame:
    """A row for each grid cell that the box touches, grown by ``grow``."""
    out = df.withColumn("cx", F.explode(cells(F.col(x0) - grow, F.col(x1) + grow, size)))
    return out.withColumn("cy", F.explode(cells(F.col(y0) - grow, F.col(y1) + grow, size)))


def walk_cells(df: DataFrame, size: float) -> DataFrame:
    """A row for each grid cell that a segment x0..y1 crosses: along its longer side
    cell by cell, and across it only what it covers there."""
    slack = 1e-6
    flat = F.abs(F.col("x1") - F.col("x0")) >= F.abs(F.col("y1") - F.col("y0"))
    u0, u1, v0, v1 = (F.when(flat, F.col(a)).otherwise(F.col(b)) for a, b in (("x0", "y0"), ("x1", "y1"), ("y0", "x0"), ("y1", "x1")))
    out = df.withColumn("cu", F.explode(cells(F.least(u0, u1) - slack, F.greatest(u0, u1) + slack, size)))

    def at(u: Column) -> Column:
        share = F.coalesce(F.try_divide(u - u0, u1 - u0), F.lit(0.0))
        return v0 + (v1 - v0) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))

    a, b = at(F.col("cu") * size - slack), at((F.col("cu") + 1) * size + slack)
    out = out.withColumn("cv", F.explode(cells(F.least(a, b) - slack, F.greatest(a, b) + slack, size)))
    return out.withColumn("cx", F.when(flat, F.col("cu")).otherwise(F.col("cv"))).withColumn("cy", F.when(flat, F.col("cv")).otherwise(F.col("cu"))).drop("cu", "cv")


def around(df: DataFrame, px: str, py: str, radius: float, size: float) -> DataFrame:
    """A row for each grid cell within ``radius`` of a point."""
    out = df.withColumn("cx", F.explode(cells(F.col(px) - radius, F.col(px) + radius, size)))
    return out.withColumn("cy", F.explode(cells(F.col(py) - radius, F.col(py) + radius, size)))


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least of 0..n-1 that the edges (u, v) lead to, for each."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    return label


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sheet, node, root): root is the smallest node reachable on the sheet.

    A sheet is one drawing page, tens of thousands of pieces at most, and no
    edge leaves it, so each sheet's union-find runs in one task; no rounds over
    the whole table are needed.  nodes: sheet, node; edges: sheet, a, b.
    """

    def run(pdf):
        import pandas as pd

        ids, code = np.unique(np.concatenate([pdf.a.to_numpy(), pdf.b.to_numpy()]), return_inverse=True)
        return pd.DataFrame({"sheet": pdf.sheet.iloc[0], "node": ids, "root": ids[_roots(code[: len(pdf)], code[len(pdf) :], len(ids))]})

    kinds = dict(nodes.dtypes)
    schema = f"sheet {kinds['sheet']}, node {kinds['node']}, root {kinds['node']}"
    rows = nodes.select("sheet", F.col("node").alias("a"), F.col("node").alias("b")).union(edges.select("sheet", "a", "b"))
    return rows.groupBy("sheet").applyInPandas(run, schema)


def straight_segments(paths: DataFrame, chords: int = 16) -> DataFrame:
    """Segments of paths: lines as they are, Bezier curves as chords; rectangles and quads give none."""
    items = paths.select("sheet", "path_ord", "style", F.posexplode("items").alias("item_ord", "item"))
    p = F.col("item.pts")
    ends = F.when(F.col("item.op") == "l", F.slice(p, 1, 2)).when(F.col("item.op") == "c", S.bezier_chords(p, chords))
    items = items.withColumn("ends", ends).where("ends is not null")
    pairs = F.arrays_zip(F.slice("ends", 1, F.size("ends") - 1).alias("a"), F.slice("ends", 2, F.size("ends") - 1).alias("b"))
    out = items.select("sheet", "style", "path_ord", "item_ord", F.posexplode(pairs).alias("chord", "s"))
    return out.select("sheet", "style", "path_ord", "item_ord", "chord", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def snap(segments: DataFrame, lattice: float) -> DataFrame:
    """Ends on a lattice, ends ordered, points and re-drawn segments dropped (first stays).

    Declarative counterpart of greedy snapping: equal on drawings whose ends lie
    within a quarter of the tolerance of each other."""
    at = lambda c: F.round(F.col(c) / lattice).cast("long")
    s = segments.repartition("sheet").select("*", *[at(c).alias("k" + c) for c in ("x0", "y0", "x1", "y1")])
    a, b = F.struct(F.col("kx0").alias("x"), F.col("ky0").alias("y")), F.struct(F.col("kx1").alias("x"), F.col("ky1").alias("y"))
    return _once(s.withColumn("n0", F.least(a, b)).withColumn("n1", F.greatest(a, b))).drop("kx0", "ky0", "kx1", "ky1")


def _once(s: DataFrame) -> DataFrame:
    first = Window.partitionBy("sheet", "style", "n0", "n1").orderBy("seg")
    return s.where("n0 <> n1").withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def snap_greedy(segments: DataFrame, tolerance: float) -> DataFrame:
    """As snap, with ends joined in the order of ``seg``: an end takes the first end
    seen within ``tolerance`` of it, across cell borders too, or is new."""

    def run(pdf):
        import math

        seen: dict = {}
        points: list[tuple[float, float]] = []

        def node(x: float, y: float) -> int:
            cx, cy = math.floor(x / tolerance), math.floor(y / tolerance)
            near = [k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in seen.get((cx + i, cy + j), ()) if math.hypot(points[k][0] - x, points[k][1] - y) <= tolerance]
            if near:
                return min(near)
            points.append((x, y))
            seen.setdefault((cx, cy), []).append(len(points) - 1)
            return len(points) - 1

        pdf = pdf.sort_values("seg", kind="stable")
        ends = [(node(a, b), node(c, d)) for a, b, c, d in zip(pdf.x0, pdf.y0, pdf.x1, pdf.y1, strict=True)]
        return pdf.assign(n0=[min(e) for e in ends], n1=[max(e) for e in ends])

    s = segments.select("sheet", "style", "seg", "x0", "y0", "x1", "y1").where("x0 <> x1 or y0 <> y1")
    kinds = ", ".join(f"{c} {t}" for c, t in s.dtypes)
    return _once(s.groupBy("sheet", "style").applyInPandas(run, f"{kinds}, n0 long, n1 long"))


def _gather(degrees: float):
    """Of a sheet's segments (n0, n1: ends as nodes), a row for each run.

    At a node, segments sorted by angle are joined with the next one, and the last
    with the first: that links the same segments as all pairs do."""

    def run(t):
        t = t.combine_chunks().sort_by("seg")
        n, style = len(t), t["style"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        node = np.r_[style, style].astype(np.int64)
        ends = [c.combine_chunks() for c in (t["n0"], t["n1"])]
        for part in zip(*(c.flatten() if pa.types.is_struct(c.type) else [c] for c in ends), strict=True):
            at = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in part]), return_inverse=True)[1]
            node = np.unique(node * (2 * n + 1) + at, return_inverse=True)[1]
        who, angle = np.r_[np.arange(n), np.arange(n)], t["angle"].to_numpy()
        who, node = (x[np.r_[style, style] >= 0] for x in (who, node))  # no pen: joined with nothing
        order = np.lexsort((angle[who], node))
        who, node = who[order], node[order]
        bend = np.flatnonzero(node[1:] != node[:-1]) + 1
        first, last = np.r_[0, bend][: len(node)], np.r_[bend, len(node)][: len(node)] - 1
        near = np.flatnonzero((node[1:] == node[:-1]) & (np.abs(angle[who[1:]] - angle[who[:-1]]) <= degrees))
        turn = 180.0 - np.abs(angle[who[last]] - angle[who[first]]) <= degrees
        root = _roots(np.r_[who[near], who[first[turn]]], np.r_[who[near + 1], who[last[turn]]], n)
        order = np.argsort(root, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(root[order]) != 0])
        names = ["x0", "y0", "x1", "y1"]
        held = pa.StructArray.from_arrays([t[c].combine_chunks().take(pa.array(order)) for c in names], names)
        lead = t.select(["sheet", "style", "seg"]).take(pa.array(order[start]))
        return lead.rename_columns(["sheet", "style", "run"]).append_column("segments", pa.ListArray.from_arrays(pa.array(np.r_[start, n], pa.int32()), held))

    return run


def stitch_runs(segments: DataFrame, tolerance: float = 0.5, degrees: float = 2.0, lattice: float | None = None) -> DataFrame:
    """Runs: segments of one pen that share an end and a direction, joined transitively.

    segments: sheet, style, seg (unique in the sheet), x0..y1.  Returns sheet,
    style, run (least seg), length_pt, segment_count, x0..y1 (bounding box),
    segments (array of x0..y1), ends (the two outermost points along the longer
    side of the box).  Ends are snapped greedily within ``tolerance``, or to a
    ``lattice``, which needs no grouped function.
    """
    segments = segments.where("sheet is not null")
    s = snap(segments, lattice) if lattice else snap_greedy(segments, tolerance)
    s = s.select("sheet", "style", "seg", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "n0", "n1", S.angle_180(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("angle"))
    kinds = dict(s.dtypes)
    schema = f"sheet {kinds['sheet']}, style {kinds['style']}, run {kinds['seg']}, segments array<struct<x0:double,y0:double,x1:double,y1:double>>"
    runs = s.groupBy("sheet").applyInArrow(_gather(degrees), schema)
    each = lambda f: F.transform("segments", f)
    lengths = F.filter(each(lambda e: S.segment_length(e["x0"], e["y0"], e["x1"], e["y1"])), lambda x: x.isNotNull())
    runs = runs.select(
        "sheet", "style", "run", F.when(F.size(lengths) > 0, F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)).alias("length_pt"), F.size("segments").cast("long").alias("segment_count"),
        F.array_min(each(lambda e: F.least(e["x0"], e["x1"]))).alias("x0"), F.array_min(each(lambda e: F.least(e["y0"], e["y1"]))).alias("y0"),
        F.array_max(each(lambda e: F.greatest(e["x0"], e["x1"]))).alias("x1"), F.array_max(each(lambda e: F.greatest(e["y0"], e["y1"]))).alias("y1"), "segments",
    )
    flat = F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")
    points = F.flatten(F.transform("segments", lambda e: F.array(F.struct(F.when(flat, e["x0"]).otherwise(e["y0"]).alias("u"), e["x0"].alias("x"), e["y0"].alias("y")), F.struct(F.when(flat, e["x1"]).otherwise(e["y1"]).alias("u"), e["x1"].alias("x"), e["y1"].alias("y")))))
    tip = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return runs.withColumn("ends", F.array(tip(F.array_min(points)), tip(F.array_max(points))))


def run_segments(runs: DataFrame) -> DataFrame:
    """A row for each segment of each run: sheet, run, x0..y1."""
    return runs.select("sheet", "run", F.explode("segments").alias("s")).select("sheet", "run", "s.x0", "s.y0", "s.x1", "s.y1")


def without_borders(runs: DataFrame, sheets: DataFrame) -> DataFrame:
    joined = runs.join(sheets.select("sheet", "page_w", "page_h"), "sheet")
    return joined.where(~S.border_run(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "page_w", "page_h")))).drop("page_w", "page_h")


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) for each whole number from lo[index] to hi[index]."""
    many = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), many)
    return which, lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)


def _cells(lo: np.ndarray, hi: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    return _spread(np.floor(lo / size).astype(np.int64), np.floor(hi / size).astype(np.int64))


def _walk(x0, y0, x1, y1, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(segment, cell) as walk_cells deals them, for one sheet."""
    slack = 1e-6
    flat = np.abs(x1 - x0) >= np.abs(y1 - y0)
    u0, u1, v0, v1 = (np.where(flat, a, b) for a, b in ((x0, y0), (x1, y1), (y0, x0), (y1, x1)))
    i, cu = _cells(np.minimum(u0, u1) - slack, np.maximum(u0, u1) + slack, size)
    du, dv = (u1 - u0)[i], (v1 - v0)[i]
    share = lambda u: np.clip(np.divide(u - u0[i], du, out=np.zeros(len(i)), where=du != 0), 0.0, 1.0)
    a, b = v0[i] + dv * share(cu * size - slack), v0[i] + dv * share((cu + 1) * size + slack)
    k, cv = _cells(np.minimum(a, b) - slack, np.maximum(a, b) + slack, size)
    i, cu = i[k], cu[k]
    return i, np.where(flat[i], cu, cv) * (1 << 32) + np.where(flat[i], cv, cu)


def _touching(px, py, who, x0, y0, x1, y1, owner, tolerance: float, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) on one sheet where a point of run a lies within ``tolerance`` of a segment of run b.

    Only ends are given as points, so crossings stay apart."""
    i, cell = _walk(x0, y0, x1, y1, size)
    order = np.argsort(cell, kind="stable")
    i, cell = i[order], cell[order]
    p, cx = _cells(px - tolerance, px + tolerance, size)
    k, cy = _cells(py[p] - tolerance, py[p] + tolerance, size)
    p, key = p[k], cx[k] * (1 << 32) + cy
    lo, hi = np.searchsorted(cell, key, "left"), np.searchsorted(cell, key, "right")
    done, found = np.cumsum(hi - lo), []
    cut = np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, PAIRS), "right")
    for s, e in zip(cut, np.r_[cut[1:], len(done)], strict=True):
        at, near = _spread(lo[s:e], hi[s:e] - 1)
        q, g = p[s + at], i[near]
        other = who[q] != owner[g]
        q, g = q[other], g[other]
        dx, dy = x1[g] - x0[g], y1[g] - y0[g]
        square = dx * dx + dy * dy
        t = np.clip(np.divide((px[q] - x0[g]) * dx + (py[q] - y0[g]) * dy, square, out=np.zeros(len(q)), where=square != 0), 0.0, 1.0)
        meet = np.hypot(px[q] - (x0[g] + t * dx), py[q] - (y0[g] + t * dy)) <= tolerance + 1e-9
        found.append(np.unique(np.stack([who[q[meet]], owner[g[meet]]]), axis=1))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 2


def _joined(tolerance: float, cell: float):
    """Of a sheet's runs, each with the least run that touching ones lead to."""

    def run(t):
        t = t.combine_chunks().sort_by("run")

        def parts(name: str, fields: list[str]):
            lists = t[name].combine_chunks()
            flat = lists.flatten()
            cols = [flat.field(flat.type.get_field_index(f)).to_numpy(zero_copy_only=False) for f in fields]
            whole = np.logical_and.reduce([np.isfinite(c) for c in cols])
            return [c[whole] for c in cols] + [np.repeat(np.arange(len(t)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[whole]]

        a, b = _touching(*parts("ends", ["x", "y"]), *parts("segments", ["x0", "y0", "x1", "y1"]), tolerance, cell)
        root = _roots(a, b, len(t))
        return t.select(["sheet", "run", "length_pt"]).append_column("root", t["run"].combine_chunks().take(pa.array(root)))

    return run


def networks(runs: DataFrame, tolerance: float, cell: float = 36.0, lengths: bool = False) -> DataFrame:
    """(sheet, run, network): connected runs; networks are numbered by length, longest 0.

    Two runs touch where an end of one lies within ``tolerance`` of the other.  A
    sheet is joined in one task, so the cells of its segments are never
    shuffled.  ``lengths``: with length_pt of the run."""
    kinds = dict(runs.dtypes)
    schema = f"sheet {kinds['sheet']}, run {kinds['run']}, length_pt double, root {kinds['run']}"
    joined = runs.where("sheet is not null").select("sheet", "run", "length_pt", "ends", "segments").groupBy("sheet").applyInArrow(_joined(tolerance, cell), schema)
    total = joined.repartition("sheet").withColumn("t", F.sum("length_pt").over(Window.partitionBy("sheet", "root")))
    rank = F.dense_rank().over(Window.partitionBy("sheet").orderBy(F.desc("t"), "root")) - 1
    return total.withColumn("network", rank).select("sheet", "run", "network", *["length_pt"] * lengths)


def nearest_tag(runs: DataFrame, tags: DataFrame, radius: float, cell: float = 36.0) -> DataFrame:
    """(sheet, run, size): size of the nearest tag within ``radius``, last word on ties; null without one.

    tags: sheet, word_ord, px, py, size.  Tags, which are few, go to the cells
    around them; segments to those that they cross."""
    pieces = walk_cells(run_segments(runs), cell)
    tags = around(tags, "px", "py", radius, cell)
    d = S.point_segment_distance(*(F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")))
    near = pieces.join(tags, ["sheet", "cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius + 1e-9)
    best = near.groupBy("sheet", "run").agg(F.max_by("size", F.struct(-F.round("d", 6), "word_ord")).alias("size"))
    return runs.select("sheet", "run").join(best, ["sheet", "run"], "left")


def nearest_run(points: DataFrame, runs: DataFrame, most: float, cell: float = 144.0) -> DataFrame:
    """(sheet, point, run): run whose box centre is nearest to the point within ``most``, first on ties."""
    mid = runs.select("sheet", "run", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    mid = mid.withColumn("cx", F.floor(F.col("mx") / cell)).withColumn("cy", F.floor(F.col("my") / cell))
    wide = points.withColumn("cx", F.explode(cells(F.col("px") - most, F.col("px") + most, cell))).withColumn("cy", F.explode(cells(F.col("py") - most, F.col("py") + most, cell)))
    near = wide.join(mid, ["sheet", "cx", "cy"]).withColumn("d", F.hypot(F.col("px") - F.col("mx"), F.col("py") - F.col("my"))).where(F.col("d") <= most)
    return near.groupBy("sheet", "point").agg(F.min_by("run", F.struct(F.round("d", 6), "run")).alias("run"))


def dimension_matches(segments: DataFrame, tags: DataFrame, sheets: DataFrame, reach: float = 70.0) -> DataFrame:
    """Length tags matched to the nearest segment of plausible length (0.5 to 1.6 times), and its error.

    tags: sheet, word_ord, px, py, feet."""
    s = segments.join(sheets.select("sheet", "ppf"), "sheet").withColumn("mx", (F.col("x0") + F.col("x1")) / 2).withColumn("my", (F.col("y0") + F.col("y1")) / 2)
    s = s.withColumn("pt", S.segment_length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).withColumn("cx", F.floor(F.col("mx") / reach)).withColumn("cy", F.floor(F.col("my") / reach))
    t = tags.withColumn("cx", F.explode(cells(F.col("px") - reach, F.col("px") + reach, reach))).withColumn("cy", F.explode(cells(F.col("py") - reach, F.col("py") + reach, reach)))
    near = t.join(s, ["sheet", "cx", "cy"]).withColumn("d", F.hypot(F.col("px") - F.col("mx"), F.col("py") - F.col("my")))
    near = near.where((F.col("d") <= reach) & F.col("pt").between(0.5 * F.col("feet") * F.col("ppf"), 1.6 * F.col("feet") * F.col("ppf")))
    pen = ["style"] if "style" in segments.columns else []
    best = near.groupBy("sheet", "word_ord", "feet").agg(F.min_by(F.struct("seg", "pt", "ppf", *pen), F.struct(F.round("d", 6), "seg")).alias("m"))
    return best.select("sheet", "word_ord", "feet", *[F.col("m.style").alias("style")] * len(pen), F.col("m.seg").alias("seg"), F.col("m.pt").alias("pt"), S.scale_error_percent(F.col("m.pt"), F.col("feet"), F.col("m.ppf")).alias("error_percent"))
