"""Scalars, runs, networks, sizes and signatures against hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators import geometry as G
from tallyframe.operators import symbols as Y


def values(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_scale_labels(spark):
    labels = ["1/8\" = 1'-0\"", "1/4\"=1'-0\"", "1/2\" = 1'-0\"", "3/32\" = 1'-0\"", "1\" = 1'-0\"", "3\" = 1'-0\"", "1-1/2\" = 1'-0\"", "1\" = 20'-0\"", "1\" = 20'", "⅛\" = 1′-0″", "NTS", ""]
    assert values(spark, labels, S.points_per_foot) == pytest.approx([9, 18, 36, 6.75, 72, 216, 108, 3.6, 3.6, 9, None, None])


def test_feet_inches(spark):
    got = values(spark, ["12'-0\"", "10'-10\"", "12'", "1′-6″", "12'-6", "12'6\"", "3´-6`", "N-145", "FP4.01", "14-10", "hello"], S.feet_inches)
    assert got == pytest.approx([12, 10 + 10 / 12, 12, 1.5, 12.5, None, None, None, None, None, None])
    assert values(spark, ["14-10", "4-6"], lambda c: S.feet_inches(c, bare_hyphen=True)) == pytest.approx([14 + 10 / 12, 4.5])


def test_pipe_sizes(spark):
    texts = ["1¼", "1½", "¾", "2", '4"', "1-1/2", '3/4"', "47", "5", "12-0", '1/8"', "", "A1", "0", "1/0", "0/0"]
    assert values(spark, texts, S.nominal_size) == [1.25, 1.5, 0.75, 2, 4, 1.5, 0.75] + [None] * 9


def test_sheet_numbers(spark):
    assert values(spark, ["M1.1", "m-101", "FP2.20", "P201,", "E1.1", "12'-0", "ROOM", "M"], S.sheet_number_trade) == ["Mechanical", "Mechanical", "Fire Protection", "Plumbing", "Electrical", None, None, None]


def runs(spark, rows):
    df = spark.createDataFrame([("a", "k", i, *map(float, r)) for i, r in enumerate(rows)], "sheet string, style string, seg long, x0 double, y0 double, x1 double, y1 double")
    return G.stitch_runs(df)


@pytest.mark.parametrize(
    ("rows", "lengths"),
    [
        ([(0, 0, 36, 0), (36, 0, 72, 0), (72, 0, 108, 0)], [108]),
        ([(0, 0, 108, 0), (108, 0, 108, 50)], [50, 108]),
        ([(0, 0, 100, 0), (100, 0, 200, 0), (100, 0, 100, 50)], [50, 200]),
        ([(0, 0, 108, 0), (0, 0, 108, 0)], [108]),
    ],
)
def test_stitching(spark, rows, lengths):
    assert sorted(r.length_pt for r in runs(spark, rows).collect()) == pytest.approx(lengths)


def test_networks_and_sizes(spark):
    r = runs(spark, [(0, 0, 200, 0), (100, 0, 100, 60), (0, 900, 90, 900), (300, 50, 300, 200), (250, 100, 400, 100)]).cache()
    nets = {(x.run, x.network) for x in G.networks(r, 4.5).collect()}
    assert len({n for _, n in nets}) == 4  # the branch joins its main, the crossing lines stay apart
    assert {tuple(p) for x in r.collect() for p in x.ends} >= {(0.0, 0.0), (200.0, 0.0), (100.0, 60.0)}
    tags = spark.createDataFrame([("a", 1, 53.0, 5.0, 2.0)], "sheet string, word_ord long, px double, py double, size double")
    assert sorted((x.size is None) for x in G.nearest_tag(r, tags, 18.0).collect()) == [False, True, True, True, True]


def test_signature_is_the_same_under_turns_and_mirrors(spark):
    def path(points):
        pts = ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in points)
        return f"array(named_struct('op', 'l', 'pts', array({pts})))"

    ell = [path([(0, 0), (10, 0)])[6:-1] + ", " + path([(0, 0), (0, 6)])[6:-1], path([(50, 50), (50, 60)])[6:-1] + ", " + path([(50, 50), (44, 50)])[6:-1], path([(0, 0), (12, 0)])[6:-1] + ", " + path([(0, 0), (0, 6)])[6:-1]]
    a, b, c = (spark.sql(f"SELECT array({e}) AS items").select(Y.path_signature(F.col("items"), F.lit("t"))).first()[0] for e in ell)
    assert a == b != c


def test_fixture_tags(spark):
    df = spark.createDataFrame([("a", t) for t in ("WC-1", "WC-1", "LAV2", "P-3", "12-0", "2", "TYP")], "sheet string, text string")
    assert {(r.tag, r["count"]) for r in Y.fixture_tags(df).collect()} == {("WC-1", 2), ("LAV2", 1), ("P-3", 1)}


@pytest.mark.parametrize("flip", [1, -1])
def test_slanted_lines_keep_their_ends(spark, flip):
    r = runs(spark, [(0, 100 * (flip < 0), 100, 100 * (flip > 0)), (100, 100 * (flip > 0), 100, 300), (0, 100 * (flip > 0), -80, 100 * (flip > 0) + 300)]).cache()
    assert len({x.network for x in G.networks(r, 4.5).collect()}) == 2  # the riser joins at its end, the line off the other corner does not
    tags = spark.createDataFrame([("a", 1, 30.0, 30.0 if flip > 0 else 70.0, 2.0)], "sheet string, word_ord long, px double, py double, size double")
    assert sorted(str(x.size) for x in G.nearest_tag(r, tags, 5.0).collect()) == ["2.0", "None", "None"]


def test_networks_by_all_pairs_without_shuffled_cells(spark):
    rng = random.Random(4)
    rows = [(s, "p", float(x), float(y), float(x + rng.randint(-90, 90)), float(y + rng.randint(-90, 90))) for s in range(3) for x, y in ((rng.randint(-60, 300), rng.randint(-60, 300)) for _ in range(60))]
    s = spark.createDataFrame([(a, p, k, *r) for k, (a, p, *r) in enumerate(rows)], "sheet long, style string, seg long, x0 double, y0 double, x1 double, y1 double")
    r = G.stitch_runs(s).cache()
    of = {}
    for x in r.collect():
        of.setdefault(x.sheet, []).append(x)

    def gap(p, e):
        dx, dy = e.x1 - e.x0, e.y1 - e.y0
        t = max(0.0, min(1.0, ((p.x - e.x0) * dx + (p.y - e.y0) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p.x - e.x0 - t * dx, p.y - e.y0 - t * dy)

    expected = set()
    for sheet, found in of.items():
        root = {x.run: x.run for x in found}
        links = [(a.run, b.run) for a in found for b in found if a.run != b.run and any(gap(p, e) <= 4.5 for p in a.ends for e in b.segments)]
        for _ in found:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        expected |= {(sheet, frozenset(k for k in root if root[k] == v)) for v in set(root.values())}
    nets = G.networks(r, 4.5)
    got = {}
    for x in nets.collect():
        got.setdefault((x.sheet, x.network), set()).add(x.run)
    assert {(sheet, frozenset(v)) for (sheet, _), v in got.items()} == expected and any(len(v) > 1 for v in got.values())
    plan = nets._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # a sheet's cells stay in its task


def test_runs_by_all_pairs_at_a_node(spark):
    angles = [0.0, 1.5, 3.0, 90.0, 178.9, 40.0]
    rows = [("a", p, 10 * i + k, 0.0, 0.0, 100 * math.cos(math.radians(d)), 100 * math.sin(math.radians(d))) for i, p in enumerate(("p", "q", None)) for k, d in enumerate(angles)]
    s = spark.createDataFrame(rows, "sheet string, style string, seg long, x0 double, y0 double, x1 double, y1 double")
    got = {(x.run, x.segment_count) for x in G.stitch_runs(s).collect()}
    assert got == {(0, 4), (3, 1), (5, 1), (10, 4), (13, 1), (15, 1), *((20 + k, 1) for k in range(6))}


def test_greedy_snapping_crosses_cells(spark):
    rows = [(0, 0, 40.24, 0), (40.26, 0, 60, 0), (40.0, 0.0, 0.0, 0.1)]
    assert [round(x.length_pt, 2) for x in runs(spark, rows).collect()] == [59.98]


def test_walked_cells_hold_the_line(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1000.0, 990.0), (5.0, 5.0, 5.0, 5.0), (10.0, 300.0, 12.0, -20.0)], "x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in G.walk_cells(df, 36.0).collect():
        got.setdefault(r.x0, set()).add((r.cx, r.cy))
    for x0, y0, x1, y1 in [tuple(r) for r in df.collect()]:
        on = {(int((x0 + (x1 - x0) * k / 5000) // 36), int((y0 + (y1 - y0) * k / 5000) // 36)) for k in range(5001)}
        assert on <= got[x0] and len(got[x0]) <= 3 * len(on) + 3


def test_parts_in_other_places_are_other_symbols(spark):
    def inst(parts):
        made = ", ".join(f"named_struct('token', 't', 'items', array(named_struct('op', 'l', 'pts', array(named_struct('x', {a}D, 'y', {b}D), named_struct('x', {c}D, 'y', {d}D)))))" for a, b, c, d in parts)
        return spark.sql(f"SELECT array({made}) AS p").select(Y.instance_signature(F.col("p"))).first()[0]

    ell, tee = [(0, 0, 10, 0), (0, 0, 0, 6)], [(0, 0, 10, 0), (5, 0, 5, 6)]
    turned, moved = [(50, 50, 50, 60), (44, 50, 50, 50)], [(7.04, 3, 7.04, 9), (7.04, 3, 17.04, 3)]
    assert inst(ell) == inst(turned) == inst(moved) != inst(tee)


def test_trades(spark):
    from pyspark.sql import functions as F

    from tallyframe.operators import rollups as R

    pages = [(1, "DUCT CFM DIFFUSER AHU"), (2, "CONDUCTOR PRODUCT ELECTROMECHANICAL AQUEDUCT"), (3, "MECHANICAL ROOM"), (3, "ELECTRICAL ROOM"), (4, "M1.1 (M-102), refer to electrical"), (4, "M.101 mechanical plan"), (5, None), (6, "fire   protection FP2.20"), (6, "Fire sprinkler FP2.21")]
    df = spark.createDataFrame(pages, "sheet_set long, page_text string")
    got = {r.sheet_set: r.trade for r in R.decide_trade(R.trade_scores(df)).collect()}
    assert got == {1: "Mechanical", 2: None, 3: None, 4: "Mechanical", 5: None, 6: "Fire Protection"}
    scores = {(r.sheet_set, r.trade): r.score for r in R.trade_scores(df).collect()}
    assert scores[(6, "Fire Protection")] == 12 and scores[(4, "Mechanical")] == 8 and scores[(4, "Electrical")] == 4
    named = R.trade_scores(df.where("sheet_set = 5").withColumn("file", F.lit("Weld_County_Mechanical_Permit_Set.pdf")), filename="file")
    assert R.decide_trade(named).first().trade == "Mechanical"


def drawings(spark, ppf=9.0):
    from tallyframe.sources.views import SCHEMAS

    line = lambda a, b, c, d: [("l", [(float(a), float(b)), (float(c), float(d))])]
    lines = [(0, (0, 0, 108, 0), [0.0] * 3), (1, (108, 0, 108, 90), [0.0] * 3), (2, (10, 120, 110, 120), [0.7] * 3)]
    paths = [("FP.pdf", 0, k, line(*xy), c, None, 1.3, "[] 0", False, "s", float(min(xy[0], xy[2])), float(min(xy[1], xy[3])), float(max(xy[0], xy[2])), float(max(xy[1], xy[3]))) for k, xy, c in lines]
    for k in range(4):  # four L symbols of another pen, one of them turned
        x, y = 20.0 + 25 * k, 60.0
        arms = [(x, y, x + 10, y), (x, y, x, y + 6)] if k < 3 else [(x, y, x, y + 10), (x, y, x + 6, y)]
        for j, xy in enumerate(arms):
            paths.append(("FP.pdf", 0, 10 + 2 * k + j, line(*xy), [0.0, 0.0, 1.0], None, 0.7, "[] 0", False, "s", xy[0], xy[1], xy[2], xy[3]))
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    words = [("FP.pdf", 0, 0, '2"', 50.0, 2.0, 56.0, 8.0), ("FP.pdf", 0, 1, "WC-1", 5.0, 5.0, 9.0, 9.0)]
    return {"sheets": make("sheets", [("FP.pdf", 0, 216.0, 144.0, "", None, ppf)]), "paths": make("paths", paths), "words": make("words", words)}


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "sheet string, id string, system string, measurable boolean, confidence string, ambiguous boolean, reasoning string")


def test_takeoff_by_system_to_files(spark, tmp_path):
    from datetime import datetime

    from tallyframe.plans import takeoff as T
    from tallyframe.sources import sinks

    d = drawings(spark)
    said = labels_of(spark, [("FP.pdf#p0", "s0", "Pipe", True, "high", False, "black"), ("FP.pdf#p0", "s9", "Ghost", True, "high", False, "")])
    t = T.takeoff_by_system(d, said)
    assert [(r.system, r.lf) for r in t["totals"].collect()] == [("Pipe", 22.0)]
    assert sorted((r.id, r.state, r.n_runs) for r in t["items"].collect())[0] == ("s0", "counted", 2)
    folder = sinks.write_documents(t, tmp_path, " A b/c ", datetime(2024, 1, 2, 3, 4, 5))
    assert folder.name == "A_b_c_20240102_030405"
    assert (folder / "takeoff_by_system.csv").read_text().splitlines()[1] == "Pipe,22.0,LF,1,1,high"
    assert "Pipe: 22.0 LF" in (folder / "diagnostics.txt").read_text()
    half = T.takeoff_by_system(d, said, override="1/4\" = 1'-0\"")
    assert half["totals"].first().lf == 11.0
    none = T.takeoff_by_system(drawings(spark, None), said)
    assert none["items"].count() == 0 and none["errors"].count() == 1
    refined = T.takeoff_by_system(d, labels_of(spark, [("FP.pdf#p0", "s0", "Pipe?", True, "low", False, "")]), again=lambda facts: facts.select("sheet", "id", F.lit("Main").alias("system"), F.lit(True).alias("measurable"), F.lit("high").alias("confidence"), F.lit(False).alias("ambiguous"), F.lit("second look").alias("reasoning")))
    assert refined["totals"].first().system == "Main"


def test_takeoff_system_size_and_counts(spark, tmp_path):
    import zipfile

    from tallyframe.plans import takeoff as T
    from tallyframe.sources import sinks

    d, sheet = drawings(spark), "FP.pdf#p0"
    pens = labels_of(spark, [(sheet, "s0", "Pipe", True, "high", False, "")])
    nets = labels_of(spark, [(sheet, "N0", "Main", True, "medium", False, "")])
    t = T.takeoff_system_size(d, pens, nets)
    assert {(r.system, r.size_text): r.lf for r in t["by_system_size"].collect()} == {("Main", '2"'): 12.0, ("Main", "unsized"): 10.0, ("Main", "total"): 22.0}
    assert [(r.id, r.sizes, r.counted) for r in t["detail"].collect()] == [("N0", '2"=12, unsized=10', True)]
    sinks.write_system_size(t, tmp_path / "t.xlsx")
    assert "Main — total" in zipfile.ZipFile(tmp_path / "t.xlsx").read("xl/worksheets/sheet1.xml").decode()
    lost = T.takeoff_system_size(d, pens, nets.limit(0))
    assert lost["by_system_size"].count() == 0 and [r.note for r in lost["review"].collect()] == ["N0: excluded — no label returned — 22 LF"]
    c = T.takeoff_counts(d, labels_of(spark, [(sheet, "S0", "Head", True, "high", False, "")]))
    assert [tuple(r) for r in c["by_component"].collect()] == [("Head", 4)]
    assert [(r.id, r["count"], r["size"]) for r in c["detail"].collect()] == [("S0", 4, "1.1x0.7 ft")]
    assert "  WC-1: 1" in list(sinks.counts_lines(c))
    assert sinks.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]


def test_cost(spark):
    from tallyframe.plans import takeoff as T

    prices = spark.createDataFrame([("m-4", 1.0, 5.0), ("m-4-8", 5.0, 25.0)], "name string, input_per_million double, output_per_million double")
    asked = spark.createDataFrame([(m, 1_000_000, 100_000, b) for m, b in (("m-4", False), ("m-4-8-fast", True), ("m-4-80", False), ("x", False))], "model string, input_tokens long, output_tokens long, batch boolean")
    assert {r.model: r.cost for r in T.cost(asked, prices).collect()} == {"m-4": 1.5, "m-4-8-fast": 3.75, "m-4-80": 1.5, "x": None}


def part(instance, sig, x, y, size):
    return {"instance": instance, "sig": sig, "x0": x, "y0": y, "x1": x + size, "y1": y + size}


def head(instance, x, y):
    return [part(instance, "ring", x, y, 10.0), part(instance, "dot", x + 3, y + 3, 2.0)]


def letter(instance, x, y):
    return [part(instance, "bar", x, y, 6.0), part(instance, "stem", x + 1, y + 1, 4.0)]


def test_cores_of_symbols_drawn_with_their_label():
    """Heads alone, labels alone, and both fused: the fused pair is no core of its own."""
    rows = [p for k in range(3) for p in head(k, 100.0 * k, 0.0)]
    rows += [p for k in range(3) for p in letter(10 + k, 100.0 * k, 50.0)]
    fused = [p for k in range(4) for p in head(20 + k, 100.0 * k, 90.0) + letter(20 + k, 100.0 * k + 12, 92.0)]
    got = Y.match_sheet(rows + fused)
    keys = {i: sorted((key, n) for j, key, n in got if j == i) for i, *_ in got}
    heads, letters = keys[0], keys[10]
    assert len(heads) == len(letters) == 1 and heads != letters
    assert all(keys[k] == heads for k in (1, 2)) and all(keys[10 + k] == letters for k in (1, 2))
    assert all(keys[20 + k] == sorted(heads + letters) for k in range(4))
    # without heads and labels of their own the pair is one symbol
    assert {key for _, key, _ in Y.match_sheet(fused)} == {"core0"}


def test_core_whose_pieces_touch_stays():
    parts = head(0, 0.0, 0.0) + letter(0, 4.0, 4.0)
    small = [Y._placed(p, Y._centre(Y._anchor(p)), Y.FRAMES[0]) for p in (head(1, 0.0, 0.0), letter(1, 0.0, 0.0))]
    assert not Y.fully_tiled(parts, small)
    assert not Y.fully_tiled(head(0, 0.0, 0.0) + letter(0, 10.9, 0.0), small)
    assert Y.fully_tiled(head(0, 0.0, 0.0) + letter(0, 11.5, 0.0), small)
    assert not Y.fully_tiled(head(0, 0.0, 0.0) + letter(0, 11.5, 0.0), small[:1])
