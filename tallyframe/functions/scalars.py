"""Scalar functions as column expressions: drawing text, scales, sizes, geometry.

All are built-in expressions, so they stay in generated code and push down.
Where a text cannot be read the result is null, never an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS_PER_INCH = 72.0
#: Nominal pipe sizes in inches and their labels.
NOMINAL = ((0.5, '1/2"'), (0.75, '3/4"'), (1.0, '1"'), (1.25, '1-1/4"'), (1.5, '1-1/2"'), (2.0, '2"'), (2.5, '2-1/2"'), (3.0, '3"'), (4.0, '4"'), (6.0, '6"'), (8.0, '8"'))
#: Vulgar fractions and prime marks as ASCII.
FRACTIONS = (("¼", "1/4"), ("½", "1/2"), ("¾", "3/4"), ("⅛", "1/8"), ("⅜", "3/8"), ("⅝", "5/8"), ("⅞", "7/8"), ("⅓", "1/3"), ("⅔", "2/3"))
_SINGLE, _DOUBLE = "′’´`", "″”“"


def normalise_marks(text: Column) -> Column:
    """Curly and prime marks to ' and ", vulgar fractions to a/b (by plain replacement)."""
    out = F.translate(text, _SINGLE + _DOUBLE, "'" * len(_SINGLE) + '"' * len(_DOUBLE))
    for mark, plain in FRACTIONS:
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


def _double(text: Column) -> Column:
    return F.expr("double(null)") if text is None else text.try_cast("double")


def _fraction(top: Column, bottom: Column) -> Column:
    return F.try_divide(_double(top), _double(bottom))


def feet_inches(token: Column, bare_hyphen: bool = False) -> Column:
    """Feet of 12', 12'-0", 12'-6, 12'-6.5"; with ``bare_hyphen`` also 14-10.  Inches of 12 or more,
    and inches that no hyphen parts from the feet: null."""
    t = F.trim(normalise_marks(token))
    marked = r"^(\d+)\s*'\s*(?:-\s*(\d+(?:\.\d+)?)\s*\"?)?$"
    bare = r"^(\d+)-(\d+)$"
    feet = F.when(t.rlike(marked), _double(F.regexp_extract(t, marked, 1)))
    inch = F.when(t.rlike(marked), F.coalesce(_double(F.nullif(F.regexp_extract(t, marked, 2), F.lit(""))), F.lit(0.0)))
    if bare_hyphen:
        feet = F.coalesce(feet, F.when(t.rlike(bare), _double(F.regexp_extract(t, bare, 1))))
        inch = F.coalesce(inch, F.when(t.rlike(bare), _double(F.regexp_extract(t, bare, 2))))
    return F.when(inch < 12, feet + inch / 12)


def paper_inches(text: Column) -> Column:
    """Inches on paper: 1-1/2, 1 1/2, 1/8, 3, 0.5."""
    t = F.trim(text)
    mixed, part, whole = r"^(\d+)[-\s](\d+)/(\d+)$", r"^(\d+)/(\d+)$", r"^\d+(?:\.\d+)?$"
    return (
        F.when(t.rlike(mixed), _double(F.regexp_extract(t, mixed, 1)) + _fraction(F.regexp_extract(t, mixed, 2), F.regexp_extract(t, mixed, 3)))
        .when(t.rlike(part), _fraction(F.regexp_extract(t, part, 1), F.regexp_extract(t, part, 2)))
        .when(t.rlike(whole), _double(t))
    )


SCALE = r"(\d+(?:[-\s]\d+/\d+|/\d+|\.\d+)?)\s*\"\s*=\s*(\d+)\s*'(?:\s*-\s*(\d+(?:\.\d+)?)\s*\"?)?"


def points_per_foot(label: Column) -> Column:
    """Points on the page for a foot of ground, of a label such as 1/8" = 1'-0"."""
    t = normalise_marks(label)
    paper = paper_inches(F.regexp_extract(t, SCALE, 1))
    ground = _double(F.regexp_extract(t, SCALE, 2)) + F.coalesce(_double(F.nullif(F.regexp_extract(t, SCALE, 3), F.lit(""))), F.lit(0.0)) / 12
    return F.when(t.rlike(SCALE), F.try_divide(POINTS_PER_INCH * paper, F.nullif(ground, F.lit(0.0))))


def detect_scale_label(page_text: Column) -> Column:
    """First scale label in a page's text that can be read, normalised."""
    found = F.regexp_extract_all(normalise_marks(page_text), F.lit(SCALE), F.lit(0))
    return F.get(F.filter(found, lambda m: points_per_foot(m).isNotNull() & (points_per_foot(m) > 0)), F.lit(0))


def scale_error_percent(drawn_pt: Column, known_ft: Column, ppf: Column) -> Column:
    """Signed error of a drawn length against a known one; null where any is zero."""
    return (F.nullif(drawn_pt, F.lit(0.0)) / F.nullif(ppf, F.lit(0.0)) / F.nullif(known_ft, F.lit(0.0)) - 1) * 100


def nominal_size(token: Column) -> Column:
    """Nominal pipe size in inches of 1¼, 3/4", 2, 1-1/2; others null."""
    t = F.regexp_replace(F.trim(token), "[\"”Ø]+$", "")
    for mark, plain in FRACTIONS:
        t = F.replace(F.regexp_replace(t, rf"^(\d+)[-\s]?{mark}$", f"$1-{plain}"), F.lit(mark), F.lit(plain))
    inches = F.when(t.rlike(r"^\d+(?:[-\s]\d+/\d+|/\d+|\.\d+)?$"), paper_inches(t))
    near = F.filter(F.array(*[F.lit(s) for s, _ in NOMINAL]), lambda s: F.abs(inches - s) <= 0.02)
    return F.get(near, F.lit(0))


def size_label(inches: Column) -> Column:
    """1.25 to 1-1/4"; sizes off the list as plain numbers."""
    out = F.concat(F.regexp_replace(inches.cast("string"), r"\.0$", ""), F.lit('"'))
    for value, text in NOMINAL:
        out = F.when(inches == value, text).otherwise(out)
    return F.when(inches.isNotNull(), out)


def segment_length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def angle_180(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y1 - y0, x1 - x0)), F.lit(180.0))


def collinear(a: Column, b: Column, tolerance: float = 2.0) -> Column:
    gap = F.abs(a - b)
    return F.least(gap, 180.0 - gap) <= tolerance


def point_segment_distance(px, py, x0, y0, x1, y1) -> Column:
    """Distance to the nearest point of a segment; a point where it has no length."""
    dx, dy = x1 - x0, y1 - y0
    t = F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))


def polyline_length(points: Column) -> Column:
    """Sum over consecutive points (array of struct x, y); 0 for fewer than two."""
    n = F.size(points)
    step = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.when(n >= 2, F.aggregate(step, F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)


def bezier_point(p: Column, t: Column) -> Column:
    """Point of a cubic Bezier with control points p (array of four structs x, y)."""
    u = 1.0 - t
    at = lambda c: u * u * u * F.get(p, F.lit(0))[c] + 3.0 * u * u * t * F.get(p, F.lit(1))[c] + 3.0 * u * t * t * F.get(p, F.lit(2))[c] + t * t * t * F.get(p, F.lit(3))[c]
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def bezier_chords(p: Column, chords: int = 16) -> Column:
    """The chords' end points, first control point included."""
    return F.transform(F.sequence(F.lit(0), F.lit(chords)), lambda k: bezier_point(p, k / float(chords)))


def path_length(items: Column) -> Column:
    """Length of the items of a path: lines, Bezier curves and rectangles' perimeters; quads count 0."""

    def one(i: Column) -> Column:
        p = i["pts"]
        a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return (
            F.when(i["op"] == "l", F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
            .when(i["op"] == "c", polyline_length(bezier_chords(p)))
            .when(i["op"] == "re", 2 * (F.abs(b["x"] - a["x"]) + F.abs(b["y"] - a["y"])))
            .otherwise(0.0)
        )

    return F.aggregate(F.transform(items, one), F.lit(0.0), lambda s, v: s + v)


def style_key(stroke: Column, width: Column, dashes: Column) -> Column:
    """Pen of a path: colour to 3 places, width to 2, dashes; fill is not part of it."""
    colour = F.when(stroke.isNotNull(), F.transform(stroke, lambda c: F.round(c, 3)))
    return F.struct(colour.alias("stroke"), F.round(F.coalesce(width, F.lit(0.0)), 2).alias("width"), F.coalesce(dashes, F.lit("[] 0")).alias("dashes"))


def style_text(style: Column) -> Column:
    colour = F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(style["stroke"], lambda c: F.format_string("%.3f", c)), ","), F.lit("]")), F.lit("none"))
    return F.format_string("%s w=%.2f %s", colour, style["width"], style["dashes"])


def dark(style: Column) -> Column:
    """A dark pen that draws: every channel under 0.30, some width."""
    return F.coalesce((F.array_max(style["stroke"]) < 0.30) & (style["width"] > 0), F.lit(False))


def border_run(x0, y0, x1, y1, page_w, page_h) -> Column:
    """A run that spans the sheet along an edge: title block and frame lines."""
    w, h = x1 - x0, y1 - y0
    flat = (w >= 0.85 * page_w) & (h <= 0.06 * page_h) & ((y0 <= 0.06 * page_h) | (y1 >= 0.94 * page_h))
    tall = (h >= 0.85 * page_h) & (w <= 0.06 * page_w) & ((x0 <= 0.06 * page_w) | (x1 >= 0.94 * page_w))
    return flat | tall


def boxes_overlap(a0, b0, a1, b1, c0, d0, c1, d1, grow: float = 0.0) -> Column:
    """Inclusive overlap of two boxes, each grown by ``grow`` on every side."""
    return (a0 - grow <= c1 + grow) & (c0 - grow <= a1 + grow) & (b0 - grow <= d1 + grow) & (d0 - grow <= b1 + grow)


def page_span_percent(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    return 100.0 * F.greatest(w / page_w, h / page_h)


def drawn_size_text(w: Column, h: Column, ppf: Column) -> Column:
    return F.when(ppf > 0, F.format_string("%.1fx%.1f ft", w / ppf, h / ppf)).otherwise(F.format_string("%.1fx%.1f pt", w, h))


def slug(text: Column) -> Column:
    out = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("takeoff"))


def length_tag_feet(word: Column) -> Column:
    """Feet of a whole-word tag such as 12-0, from 1 to 60."""
    feet = F.when(F.trim(word).rlike(r"^\d+-\d+$"), feet_inches(F.trim(word), bare_hyphen=True))
    return F.when(feet.between(1, 60), feet)


def is_fixture_tag(word: Column) -> Column:
    return F.trim(word).rlike(r"^[A-Z]{1,5}-?[0-9]{1,3}$")


#: Letters of sheet numbers and their trades, and marks around them; FP stands before P.
TRADE_LETTERS = (("FP", "Fire Protection"), ("M", "Mechanical"), ("P", "Plumbing"), ("S", "Structural"), ("A", "Architectural"), ("E", "Electrical"))
_AROUND = ".,;:()[]{}'\""
#: Sheet numbers in upper-case text, as whole words; group 1 is the letters.
SHEET_NUMBERS = r"""(?<!\S)[.,;:()\[\]{}'"]*+(FP|[MPSAE])[-.]?[0-9]{1,3}(?:\.[0-9]{1,2})?[.,;:()\[\]{}'"]*+(?!\S)"""


def sheet_number_trade(word: Column) -> Column:
    """Trade of a sheet number such as M1.1, m-101, M.101, FP2.20; others null."""
    number = r"^(FP|[MPSAE])[-.]?[0-9]{1,3}(?:\.[0-9]{1,2})?$"
    letters = F.regexp_extract(F.upper(F.btrim(word, F.lit(_AROUND))), number, 1)
    out = F.lit(None).cast("string")
    for prefix, trade in TRADE_LETTERS:
        out = F.when(letters == prefix, trade).otherwise(out)
    return out


def has_term(text: Column, term: str) -> Column:
    """Whole-word match, any white space between the words of the term."""
    return F.upper(text).rlike(r"\b" + r"\s+".join(re.escape(w) for w in term.upper().split()) + r"\b")


def filename_words(name: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), "[_.-]+", " "))


def trusted_label(measurable: Column, ambiguous: Column, confidence: Column) -> Column:
    return F.coalesce(measurable & ~ambiguous & F.lower(confidence).isin("high", "medium"), F.lit(False))


def trusted_item(ambiguous: Column, confidence: Column) -> Column:
    """As a label's trust, without ``measurable``."""
    return F.coalesce(~ambiguous & F.lower(confidence).isin("high", "medium"), F.lit(False))


def image_tokens(w: Column, h: Column, long_edge: int = 1568, cap: int = 1600) -> Column:
    """Token estimate of an image after it is scaled to a long edge."""
    k = F.least(F.lit(1.0), F.lit(float(long_edge)) / F.greatest(w, h))
    return F.least(F.lit(cap), F.ceil(w * k * h * k / 750.0).cast("int"))


def safe_tokens(count: Column, factor: float = 1.1) -> Column:
    return F.ceil(count * max(factor, 1.0)).cast("long")


def centroid(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Middle of a box, as a struct (x, y)."""
    return F.struct(((x0 + x1) / 2).alias("x"), ((y0 + y1) / 2).alias("y"))


def sheet_id(source: Column, page_index: Column) -> Column:
    return F.concat(source, F.lit("#p"), page_index.cast("string"))


def effective_ppf(override_label: Column, detected: Column) -> Column:
    """Points per foot of an override label, else the one detected; zero counts as none."""
    return F.coalesce(points_per_foot(override_label), F.nullif(detected, F.lit(0.0)))


def consecutive(points: Column) -> Column:
    """Segments (a, b) of a polyline: array of consecutive points."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.arrays_zip(F.slice(points, 1, n).alias("a"), F.slice(points, 2, n).alias("b"))


def same_shape(a: Column, b: Column, tolerance: float = 0.25) -> Column:
    """Point lists of equal length whose coordinates differ by ``tolerance`` at most."""
    near = F.forall(F.zip_with(a, b, lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)), lambda x: x)
    return (F.size(a) == F.size(b)) & near


def measurable_path(items: Column) -> Column:
    return path_length(items) >= 1.0


def spans_page(w: Column, h: Column, page_w: Column, page_h: Column, share: float = 0.80) -> Column:
    """A long main or a match line: spans most of the sheet in one direction."""
    return F.coalesce((page_w > 0) & (page_h > 0) & (F.greatest(w / page_w, h / page_h) >= share), F.lit(False))


def text_sample(text: Column, most: int = 1500) -> Column:
    """What a labeler is shown of a page (a feature of the request, not of the takeoff)."""
    return F.substring(F.coalesce(text, F.lit("")), 1, most)
