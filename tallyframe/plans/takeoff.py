"""Takeoffs from drawing tables, end to end: by system, by system and size, by component.

Drawings are the tables of ``sources.views.SCHEMAS``.  A labeler names pens,
networks and clusters by id; it is a table of labels, or a function from a table
of facts to one (``ask``), so any service can stand behind it.  A function that
fails gives no labels: its entities are flagged, never lost, and the rest goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geometry as G
from ..operators import rollups as R
from ..operators import symbols as Y

#: Pens and clusters that a labeler is shown, and distances in feet.
TOP_PENS, TOP_CLUSTERS, NETWORK_FT, RADIUS_FT = 12, 12, 0.5, 2.0
Labeler = DataFrame | Callable[[DataFrame], DataFrame]
LABEL = ("system", "measurable", "confidence", "ambiguous", "reasoning")


def sheets_of(drawings: dict[str, DataFrame], override: str | None = None) -> DataFrame:
    """Sheets with id, size and scale: an override label beats the scale detected, which
    beats one read from the page's text."""
    read = F.coalesce(F.nullif(F.col("ppf"), F.lit(0.0)), S.points_per_foot(F.col("scale_label")), S.points_per_foot(S.detect_scale_label(F.col("page_text"))))
    return drawings["sheets"].select(S.sheet_id(F.col("source"), F.col("page_index")).alias("sheet"), "source", "page_index", "page_w", "page_h", "page_text", S.effective_ppf(F.lit(override), read).alias("ppf"))


def paths_of(drawings: dict[str, DataFrame]) -> DataFrame:
    key = S.style_key(F.col("stroke"), F.col("width"), F.col("dashes"))
    p = drawings["paths"].withColumns({"sheet": S.sheet_id(F.col("source"), F.col("page_index")), "pen": key})
    return p.withColumn("style", S.style_text(F.col("pen"))).withColumn("dark", S.dark(F.col("pen"))).drop("pen")


def words_of(drawings: dict[str, DataFrame]) -> DataFrame:
    at = S.centroid(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    w = drawings["words"].withColumn("sheet", S.sheet_id(F.col("source"), F.col("page_index"))).withColumn("at", at)
    return w.select("sheet", "word_ord", "text", F.col("at.x").alias("px"), F.col("at.y").alias("py"))


def runs_of(drawings: dict[str, DataFrame], sheets: DataFrame) -> DataFrame:
    """Runs without borders, with feet where the sheet has a scale."""
    s = G.straight_segments(paths_of(drawings))
    seg = F.shiftleft(F.col("path_ord").cast("long"), 28) + F.shiftleft(F.col("item_ord").cast("long"), 8) + F.col("chord")
    runs = G.without_borders(G.stitch_runs(s.withColumn("seg", seg)), sheets)
    return G.settle(runs.join(sheets.select("sheet", "ppf", "page_w", "page_h"), "sheet").withColumn("lf", F.try_divide("length_pt", "ppf")), "runs")


def ask(labeler: Labeler, facts: DataFrame) -> DataFrame:
    """Labels (sheet, id, LABEL) of the facts' ids; unknown ids fall away later."""
    answered = labeler(facts) if callable(labeler) else labeler
    return answered.select("sheet", "id", *LABEL)


def twice(labeler: Labeler, again: Labeler | None, facts: DataFrame) -> DataFrame:
    """First answers, with those that need a second look asked again; that can only refine."""
    first = R.coerce_labels(ask(labeler, facts))
    if again is None:
        return first
    doubtful = first.where(R.needs_second_look(F.col("measurable"), F.col("ambiguous"), F.col("confidence"))).select("sheet", "id")
    return R.second_look(first, ask(again, facts.join(doubtful, ["sheet", "id"], "left_semi")), ["sheet", "id"])


def pens(runs: DataFrame) -> DataFrame:
    """Facts of each sheet's pens, the longest first, ids s0, s1, ...: what a labeler is told."""
    facts = runs.groupBy("sheet", "style").agg(F.sum("lf").alias("lf"), F.count("*").alias("n_runs"), F.max("lf").alias("longest"), F.first("ppf").alias("ppf"))
    return R.ranked(facts.where("lf > 0"), "lf", "style", TOP_PENS)


def takeoff_by_system(drawings: dict[str, DataFrame], labeler: Labeler, override: str | None = None, again: Labeler | None = None) -> dict[str, DataFrame]:
    """items (a row per pen that is counted or flagged), totals, excluded, errors.

    Sheets without a scale are errors; confident background is excluded.  A
    drawing without line work gives empty tables."""
    sheets = sheets_of(drawings, override)
    facts = G.settle(pens(runs_of(drawings, sheets.where("ppf > 0"))), "pens")
    gated = R.item_gate(R.with_labels(facts, twice(labeler, again, facts), ["sheet", "id"]))
    gated = gated.withColumn("state", F.when(F.col("state") == "not labelled", "flagged").otherwise(F.col("state")))
    items = gated.where("state <> 'excluded'")
    return {"items": items, "totals": R.system_totals(items), "excluded": gated.where("state = 'excluded'"), "errors": R.unscaled_sheets(sheets)}


def takeoff_system_size(drawings: dict[str, DataFrame], pen_labeler: Labeler, network_labeler: Labeler, override: str | None = None, again: Labeler | None = None) -> dict[str, DataFrame]:
    """by_system_size (with a total for each system), detail, review and errors, over trusted networks of trusted pens."""
    sheets = sheets_of(drawings, override)
    runs = runs_of(drawings, sheets.where("ppf > 0"))
    facts = pens(runs)
    named = ask(pen_labeler, facts).join(facts.select("sheet", "id", "style"), ["sheet", "id"])
    runs = G.settle(R.trusted_runs(runs, named), "pipe")
    # half a foot on each sheet: lengths in feet make one tolerance of all scales
    scaled = runs.select("sheet", "style", "run", "length_pt", "lf", *_in_feet())
    nets = G.settle(G.networks(scaled, NETWORK_FT), "networks")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    net = runs.join(nets, ["sheet", "run"]).groupBy("sheet", "network").agg(F.sum("lf").alias("lf"), F.count("*").alias("n_runs"), F.collect_set("style").alias("styles"), F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"), *box)
    size = (F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("page_w"), F.col("page_h"))
    net = net.withColumns({"id": F.concat(F.lit("N"), F.col("network").cast("string")), "spans": S.spans_page(*size), "pct_page": F.round(S.page_span_percent(*size)).cast("int")})
    net = G.settle(net, "network-facts")
    tags = words_of(drawings).withColumn("size", S.nominal_size(F.col("text"))).where("size is not null").join(sheets.select("sheet", "ppf"), "sheet").where("ppf > 0")
    tags = tags.select("sheet", "word_ord", (F.col("px") / F.col("ppf")).alias("px"), (F.col("py") / F.col("ppf")).alias("py"), "size")
    sized = G.settle(G.nearest_tag(scaled, tags, RADIUS_FT, cell=4.0), "sizes")
    gated = R.entity_gate(R.with_labels(net, twice(network_labeler, again, net), ["sheet", "id"]))
    members = runs.select("sheet", "run", "lf").join(nets, ["sheet", "run"])
    items = members.join(gated.select("sheet", "network", "system", "state"), ["sheet", "network"])
    texts = R.size_text(members.join(sized, ["sheet", "run"]), ["sheet", "network"])
    detail = R.detail(gated.join(texts, ["sheet", "network"], "left"), F.round("lf", 1).alias("linear_feet"), "pct_page", "sizes")
    return {"by_system_size": R.system_size(items, sized), "detail": detail, "review": R.network_notes(gated), "errors": R.unscaled_sheets(sheets)}


def _in_feet() -> list:
    """Geometry of runs in feet."""
    foot = F.col("ppf")
    seg = F.transform("segments", lambda e: F.struct(*[(e[c] / foot).alias(c) for c in ("x0", "y0", "x1", "y1")]))
    tips = F.transform("ends", lambda e: F.struct((e["x"] / foot).alias("x"), (e["y"] / foot).alias("y")))
    return [seg.alias("segments"), tips.alias("ends")]


def takeoff_counts(drawings: dict[str, DataFrame], labeler: Labeler, override: str | None = None, again: Labeler | None = None, min_count: int = 2) -> dict[str, DataFrame]:
    """by_component, detail, review and tags of symbols; sheets without a scale are counted in points."""
    sheets = sheets_of(drawings, override)
    paths = paths_of(drawings).join(sheets.select("sheet", "ppf"), "sheet").withColumn("cap", Y.size_cap(None, F.col("ppf")))
    small = Y.symbol_suspects(paths, F.col("cap")).withColumn("token", Y.style_token(F.col("style"), F.col("fill"), F.col("kind"), F.col("closed")))
    parts = G.settle(Y.repeated_parts(small.withColumn("sig", Y.path_signature(F.col("items"), F.col("token"))), min_count).drop("ppf"), "parts")
    caps = sheets.select("sheet", "ppf").withColumn("cap", Y.size_cap(None, F.col("ppf")))
    inst = Y.composites(parts.drop("cap"), Y.instances(parts), F.lit(float("inf")), sheets).join(caps, "sheet")
    inst = inst.where(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) <= F.col("cap")).drop("cap", "ppf", "oversized")
    clusters = Y.cluster_symbols(G.settle(inst, "instances"), min_count=min_count)
    clusters = G.settle(clusters.withColumnRenamed("cluster", "id").join(sheets.select("sheet", "ppf"), "sheet"), "clusters")
    shown = clusters.where(F.substring("id", 2, 9).cast("int") < TOP_CLUSTERS)
    gated = R.entity_gate(R.with_labels(clusters, twice(labeler, again, shown), ["sheet", "id"]))
    e = F.col("exemplar")
    size = S.drawn_size_text(e["x1"] - e["x0"], e["y1"] - e["y0"], F.col("ppf"))
    return {"by_component": R.component_counts(gated), "detail": R.detail(gated, F.col("n").alias("count"), size.alias("size"), "variants"), "review": R.cluster_notes(gated), "tags": Y.fixture_tags(words_of(drawings))}


def first_instances(inst: DataFrame, key: str = "composite", most: int = 3) -> DataFrame:
    """The first instances of each cluster from the top left: what a second look is shown."""
    w = Window.partitionBy("sheet", key).orderBy("y0", "x0", "instance")
    return inst.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def cost(requests: DataFrame, prices: DataFrame, batch_factor: float = 0.5) -> DataFrame:
    """Cost of requests by the price of their model: the exact name, else the longest
    known name that a hyphen follows; null for unknown ones.

    requests: model, input_tokens, output_tokens, batch; prices: name, input_per_million,
    output_per_million (a price list: broadcast, a row per model)."""
    known = F.broadcast(prices.select("name", "input_per_million", "output_per_million"))
    r = requests.withColumn("request", F.monotonically_increasing_id())
    fits = (F.col("model") == F.col("name")) | F.col("model").startswith(F.concat(F.col("name"), F.lit("-")))
    best = r.select("model").distinct().join(known, fits).groupBy("model").agg(F.max_by(F.struct("input_per_million", "output_per_million"), F.length("name")).alias("price"))
    worth = (F.col("input_tokens") * F.col("price.input_per_million") + F.col("output_tokens") * F.col("price.output_per_million")) / 1e6
    return r.join(best, "model", "left").withColumn("cost", worth * F.when(F.col("batch"), batch_factor).otherwise(1.0)).drop("request", "price")
