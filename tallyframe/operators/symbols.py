"""Symbol counts: suspects, congruence signatures, instances, cores, clusters.

Signatures and instance grouping are column expressions and grid joins.  Core
discovery and matching inside one sheet (an ordered, consuming search) run as a
grouped function per sheet on the instances that are left, about a thousand a
sheet.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .geometry import components, in_cells

#: Sizes in points and feet, counts and shares of the symbol scan.
MIN_PT, CAP_FT, CAP_PT, GAP_PT, GRID = 2.0, 4.0, 72.0, 1.5, 36.0
LONG_PATHS, LONG_SHARE = 5, 0.25
MATCH_PT, SHAPE_PT, INK_SHARE = 0.35, 0.25, 0.70
TILE_GROW, LIGHTER = 0.5, 0.999
#: The eight frames of a square: x' = a x + b y, y' = c x + d y.
FRAMES = ((1, 0, 0, 1), (0, -1, 1, 0), (-1, 0, 0, -1), (0, 1, -1, 0), (-1, 0, 0, 1), (1, 0, 0, -1), (0, 1, 1, 0), (0, -1, -1, 0))


def size_cap(cap_pt: float | None, ppf: Column) -> Column:
    return F.lit(cap_pt) if cap_pt is not None else F.when(ppf > 0, CAP_FT * ppf).otherwise(CAP_PT)


def suspects(paths: DataFrame, cap: Column) -> DataFrame:
    """Paths of symbol size: largest extent from MIN_PT to the cap."""
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return paths.where((extent >= MIN_PT) & (extent <= cap))


def linework_pens(paths: DataFrame, cap: Column) -> DataFrame:
    """Pens that draw long lines: at least LONG_PATHS over the cap, and LONG_SHARE of the pen's paths."""
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    count = paths.where(extent >= MIN_PT).groupBy("sheet", "style").agg(F.count_if(extent > cap).alias("n_long"), F.count("*").alias("n"))
    return count.where((F.col("n_long") >= LONG_PATHS) & (F.col("n_long") >= LONG_SHARE * F.col("n"))).select("sheet", "style")


def symbol_suspects(paths: DataFrame, cap: Column) -> DataFrame:
    """Suspects without those of line-work pens and without exact duplicates."""
    small = suspects(paths, cap).join(linework_pens(paths, cap), ["sheet", "style"], "left_anti")
    return distinct_paths(small)


def style_token(style: Column, fill: Column, kind: Column, closed: Column) -> Column:
    """What besides geometry makes two parts differ: pen, fill, kind, closed."""
    return F.concat_ws("|", style.cast("string"), F.coalesce(fill.cast("string"), F.lit("none")), kind, closed.cast("string"))


def instance_signature(parts: Column) -> Column:
    """Text equal for sets of parts that are congruent under shifts, quarter turns and mirrors.

    parts: array of struct (token, items).  Points are whole tenths relative to
    the least corner of all parts together, so their places among each other are
    part of the signature; a rectangle's corners and a line's ends are put in
    order; the least of the eight frames counts."""
    tenth = lambda v: F.round(v * 10).cast("long")
    # points are put on the grid of tenths once; frames and shifts are whole-number steps after that
    grid = F.transform(parts, lambda part: F.struct(part["token"].alias("token"), F.transform(part["items"], lambda i: F.struct(i["op"].alias("op"), F.transform(i["pts"], lambda p: F.struct(tenth(p["x"]).alias("x"), tenth(p["y"]).alias("y"))).alias("pts"))).alias("items")))

    def framed(parts: Column, m: Column) -> Column:
        a, b, c, d = (m[k] for k in "abcd")

        def turn(i: Column) -> Column:
            pts = F.transform(i["pts"], lambda p: F.struct((a * p["x"] + b * p["y"]).alias("x"), (c * p["x"] + d * p["y"]).alias("y")))
            xs, ys = F.transform(i["pts"], lambda p: a * p["x"] + b * p["y"]), F.transform(i["pts"], lambda p: c * p["x"] + d * p["y"])
            box = F.array(F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y")), F.struct(F.array_max(xs).alias("x"), F.array_max(ys).alias("y")))
            return F.struct(i["op"].alias("op"), F.when(i["op"] == "re", box).otherwise(F.when((i["op"] == "l"), F.array_sort(pts)).otherwise(pts)).alias("pts"))

        def corner(turned: Column) -> Column:
            flat = F.flatten(F.flatten(F.transform(turned, lambda part: F.transform(part["items"], lambda i: i["pts"]))))
            return F.struct(turned.alias("parts"), F.array_min(F.transform(flat, lambda p: p["x"])).alias("ox"), F.array_min(F.transform(flat, lambda p: p["y"])).alias("oy"))

        def shifted(t: Column) -> Column:
            shift = lambda i: F.struct(i["op"].alias("op"), F.transform(i["pts"], lambda p: F.struct((p["x"] - t["ox"]).alias("x"), (p["y"] - t["oy"]).alias("y"))).alias("pts"))
            return F.array_sort(F.transform(t["parts"], lambda part: F.struct(part["token"].alias("token"), F.array_sort(F.transform(part["items"], shift)).alias("items"))))

        turned = F.transform(parts, lambda part: F.struct(part["token"].alias("token"), F.transform(part["items"], turn).alias("items")))
        return _let(_let(turned, corner), shifted)

    frames = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abcd", m, strict=True)]) for m in FRAMES])
    best = _let(grid, lambda g: F.array_min(F.transform(frames, lambda m: framed(g, m))))
    return F.substring(F.sha1(F.to_json(best)), 1, 12)


def _let(value: Column, then) -> Column:
    """then(value) with value evaluated once: nothing else keeps a step inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def path_signature(items: Column, token: Column) -> Column:
    """Signature of one path."""
    return instance_signature(F.array(F.struct(token.alias("token"), items.alias("items"))))


def simple_signature(items: Column) -> Column:
    """Shift-only signature; rectangles reduced to width and height."""
    flat = F.flatten(F.transform(items, lambda i: i["pts"]))
    ox, oy = F.array_min(F.transform(flat, lambda p: p["x"])), F.array_min(F.transform(flat, lambda p: p["y"]))
    tenth = lambda v: F.round(v * 10).cast("long")
    return F.to_json(F.transform(items, lambda i: F.struct(i["op"].alias("op"), F.transform(i["pts"], lambda p: F.struct(tenth(p["x"] - ox).alias("x"), tenth(p["y"] - oy).alias("y"))).alias("pts"))))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Without exact duplicates: of equal pen, kind and items the first stays."""
    w = Window.partitionBy("sheet", "style", "kind", "closed", F.to_json("items")).orderBy("path_ord")
    return paths.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def repeated_parts(paths: DataFrame, min_count: int = 2) -> DataFrame:
    """Paths whose signature (column sig) occurs min_count times on the sheet."""
    return paths.withColumn("times", F.count("*").over(Window.partitionBy("sheet", "sig"))).where(F.col("times") >= min_count).drop("times")


def instances(paths: DataFrame, gap: float = GAP_PT) -> DataFrame:
    """(sheet, path_ord, instance): paths whose boxes, grown by half the gap, meet, transitively."""
    boxes = in_cells(paths.select("sheet", "path_ord", "x0", "y0", "x1", "y1"), "x0", "y0", "x1", "y1", GRID, gap / 2)
    a = boxes.select("sheet", "cx", "cy", F.col("path_ord").alias("a"), *[F.col(c).alias("a" + c) for c in ("x0", "y0", "x1", "y1")])
    b = boxes.select("sheet", "cx", "cy", F.col("path_ord").alias("b"), "x0", "y0", "x1", "y1")
    meet = S.boxes_overlap(*(F.col("a" + c) for c in ("x0", "y0", "x1", "y1")), *(F.col(c) for c in ("x0", "y0", "x1", "y1")), grow=gap / 2)
    edges = a.join(b, ["sheet", "cx", "cy"]).where("a < b").where(meet).select("sheet", "a", "b").distinct()
    roots = components(paths.select("sheet", F.col("path_ord").alias("node")), edges)
    return roots.select("sheet", F.col("node").alias("path_ord"), F.col("root").alias("instance"))


def composites(paths: DataFrame, grouped: DataFrame, cap: Column, sheets: DataFrame) -> DataFrame:
    """A row per instance: box, parts, signature of all parts together; oversized ones flagged.

    paths: with token (style_token)."""
    joined = paths.join(grouped, ["sheet", "path_ord"]).join(sheets.select("sheet", "ppf"), "sheet")
    inst = joined.groupBy("sheet", "instance", "ppf").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_parts"), instance_signature(F.collect_list(F.struct("token", "items"))).alias("composite"))
    return inst.withColumn("oversized", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > cap).drop("ppf")


def cluster_symbols(inst: DataFrame, key: str = "composite", min_count: int = 2) -> DataFrame:
    """Clusters by count, then drawn area; ids S0, S1, ...  Exemplar: top-left of the most common arrangement."""
    arrangement = inst.groupBy("sheet", key, "composite").agg(F.count("*").alias("n"), F.min("instance").alias("first"))
    modal = arrangement.groupBy("sheet", key).agg(F.max_by("composite", F.struct("n", -F.col("first"))).alias("modal"), F.count("*").alias("variants"))
    c = inst.join(modal, ["sheet", key]).groupBy("sheet", key, "variants").agg(
        F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.min_by(F.struct("instance", "x0", "y0", "x1", "y1", "n_parts"), F.struct((F.col("composite") != F.col("modal")).cast("int"), "y0", "x0")).alias("exemplar"),
    )
    area = (F.col("exemplar.x1") - F.col("exemplar.x0")) * (F.col("exemplar.y1") - F.col("exemplar.y0"))
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy(F.desc("n"), F.desc(area), key)) - 1
    return c.where(F.col("n") >= min_count).withColumn("cluster", F.concat(F.lit("S"), rank.cast("string")))


def fixture_tags(words: DataFrame) -> DataFrame:
    return words.where(S.is_fixture_tag(F.col("text"))).groupBy("sheet", F.trim("text").alias("tag")).count()


def component_takeoff(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Clusters with their labels and state; see rollups.component_counts and cluster_notes.

    clusters: of cluster_symbols (id in ``cluster``); labels: sheet, id and the label's fields."""
    from .rollups import entity_gate, with_labels

    return entity_gate(with_labels(clusters.withColumnRenamed("cluster", "id"), labels, ["sheet", "id"]))


# --- cores: what many instances share, found and matched within one sheet -------------


def _overlap(parts: list[dict]) -> Counter:
    return Counter((p["sig"]) for p in parts)


def ink(part: dict) -> float:
    return (max(part["x1"] - part["x0"], part["y1"] - part["y0"]) + 0.1) ** 2


def _anchor(parts: list[dict]) -> dict:
    area = lambda p: round((p["x1"] - p["x0"]) * (p["y1"] - p["y0"]), 1)
    return max(parts, key=lambda p: (area(p), round(max(p["x1"] - p["x0"], p["y1"] - p["y0"]), 1), p["sig"]))


def _centre(p: dict) -> tuple[float, float]:
    return (p["x0"] + p["x1"]) / 2, (p["y0"] + p["y1"]) / 2


def _placed(parts: list[dict], at: tuple[float, float], frame: tuple[int, int, int, int]) -> list[tuple]:
    """Parts as (signature, dx, dy) from a point, in a frame."""
    a, b, c, d = frame
    out = []
    for p in parts:
        x, y = _centre(p)
        x, y = x - at[0], y - at[1]
        out.append((p["sig"], a * x + b * y, c * x + d * y))
    return out


def _matched(core: list[tuple], parts: list[dict], anchor: dict) -> list[int] | None:
    """Indices of the parts that realise a core around an anchor, in some frame."""
    for frame in FRAMES:
        used: list[int] = []
        here = _placed(parts, _centre(anchor), frame)
        for sig, x, y in core:
            hit = next((k for k, (s, u, v) in enumerate(here) if k not in used and s == sig and abs(u - x) <= MATCH_PT and abs(v - y) <= MATCH_PT), None)
            if hit is None:
                break
            used.append(hit)
        else:
            return used
    return None


def take_cores(cores: list[list[tuple]], parts: list[dict]) -> tuple[list[tuple[int, list[dict]]], list[dict]]:
    """(core, its parts) for every placement, cores tried in order, each consuming
    its parts as often as it fits; and the parts left over."""
    pieces, left = [], list(parts)
    for k, core in enumerate(cores):
        anchor_sig = min(core, key=lambda c: abs(c[1]) + abs(c[2]))[0]
        while used := next((u for p in left if p["sig"] == anchor_sig and (u := _matched(core, left, p))), None):
            pieces.append((k, [left[i] for i in used]))
            left = [p for i, p in enumerate(left) if i not in used]
    return pieces, left


def fully_tiled(parts: list[dict], smaller: list[list[tuple]]) -> bool:
    """Smaller cores consume every part, and stand apart in two groups or more: the
    parts are symbols drawn side by side, not one symbol."""
    pieces, left = take_cores(smaller, parts)
    if left or len(pieces) < 2:
        return False
    boxes = [_hull(piece) for _, piece in pieces]
    together = [(i, j) for j, q in enumerate(boxes) for i, p in enumerate(boxes[:j]) if _boxes_meet(p, q)]
    label = list(range(len(boxes)))
    for i, j in together:
        low, high = sorted((label[i], label[j]))
        label = [low if v == high else v for v in label]
    return len(set(label)) > 1


def _hull(parts: list[dict]) -> dict:
    return {side: f(p[side] for p in parts) for side, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}


def _boxes_meet(p: dict, q: dict) -> bool:
    """The boxes, each grown by TILE_GROW, meet."""
    return all(p[lo] - TILE_GROW <= q[hi] + TILE_GROW and q[lo] - TILE_GROW <= p[hi] + TILE_GROW for lo, hi in (("x0", "x1"), ("y0", "y1")))


def find_cores(inst: list[list[dict]]) -> list[list[tuple]]:
    """Cores of one sheet, heaviest first: for each anchor, arrangements found twice or
    more, joined where they share INK_SHARE of the larger's ink, cut to what they share.
    Those that smaller cores tile fully are left out."""
    by_anchor: dict[str, dict[tuple, list[list[dict]]]] = {}
    for parts in inst:
        key = tuple(sorted(p["sig"] for p in parts))
        by_anchor.setdefault(_anchor(parts)["sig"], {}).setdefault(key, []).append(parts)
    cores = []
    for groups in by_anchor.values():
        often = sorted((g for g in groups.values() if len(g) > 1), key=lambda g: (-len(g), -sum(map(ink, g[0]))))
        singles = [g for g in groups.values() if len(g) == 1]
        left = often + (singles if not often else [])
        while left:
            seed, rest, family = left[0], [], [left[0][0]]
            for other in left[1:]:
                common = _overlap(seed[0]) & _overlap(other[0])
                weight = {p["sig"]: ink(p) for p in seed[0] + other[0]}
                both = sum(weight[s] * n for s, n in common.items())
                if both >= INK_SHARE * max(sum(map(ink, seed[0])), sum(map(ink, other[0]))):
                    family.append(other[0])
                else:
                    rest.append(other)
            left = rest
            shared = list(seed[0])
            for parts in family[1:]:
                anchor = _anchor(parts)
                best: list[dict] = []
                for frame in FRAMES:
                    here = _placed(parts, _centre(anchor), frame)
                    mine = _placed(shared, _centre(_anchor(shared)), FRAMES[0])
                    used: set[int] = set()
                    kept = []
                    for p, (sig, x, y) in zip(shared, mine, strict=True):
                        hit = next((k for k, (s, u, v) in enumerate(here) if k not in used and s == sig and abs(u - x) <= MATCH_PT and abs(v - y) <= MATCH_PT), None)
                        if hit is not None:
                            used.add(hit)
                            kept.append(p)
                    if len(kept) > len(best):
                        best = kept
                shared = best or shared
            if len(seed) > 1 or len(family) > 1:
                cores.append((sum(map(ink, shared)), shared))
    cores.sort(key=lambda c: -c[0])
    placed = [_placed(parts, _centre(_anchor(parts)), FRAMES[0]) for _, parts in cores]
    weight = [w for w, _ in cores]
    return [mine for mine, (w, parts) in zip(placed, cores, strict=True) if not fully_tiled(parts, [c for c, v in zip(placed, weight, strict=True) if v < LIGHTER * w])]


def match_sheet(rows: list[dict]) -> list[tuple[int, str, int]]:
    """(instance, cluster key, times) of one sheet's instances.  rows: parts with
    instance, sig, x0..y1 in path order.  The heaviest core is tried first and
    consumes its parts, as often as it fits; what has no core stays a composite."""
    inst: dict[int, list[dict]] = {}
    for r in rows:
        inst.setdefault(r["instance"], []).append(r)
    cores = find_cores(list(inst.values()))
    out = []
    for name, parts in inst.items():
        found = Counter(k for k, _ in take_cores(cores, parts)[0])
        if found:
            out += [(name, f"core{k}", n) for k, n in sorted(found.items())]
        else:
            out.append((name, "+".join(sorted(p["sig"] for p in parts)), 1))
    return out


def core_clusters(parts: DataFrame) -> DataFrame:
    """(sheet, instance, key, times) by cores; parts: sheet, instance, path_ord, sig, x0..y1."""

    def run(pdf):
        import pandas as pd

        rows = pdf.sort_values("path_ord").to_dict("records")
        made = match_sheet(rows)
        return pd.DataFrame({"sheet": [pdf.sheet.iloc[0]] * len(made), "instance": [m[0] for m in made], "key": [m[1] for m in made], "times": [m[2] for m in made]})

    kind = dict(parts.dtypes)["sheet"]
    return parts.select("sheet", "instance", "path_ord", "sig", "x0", "y0", "x1", "y1").groupBy("sheet").applyInPandas(run, f"sheet {kind}, instance long, key string, times long")
