"""Label joins, trust gates and roll-ups.

Nothing measured is dropped without a row that says so: an item is counted,
flagged, excluded with a note, or not labelled with a note.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def coerce_labels(labels: DataFrame) -> DataFrame:
    """Blank systems named, confidence in lower case (low where missing), flags false by default."""
    return labels.withColumns(
        {
            "system": F.coalesce(F.nullif(F.trim("system"), F.lit("")), F.lit("(unnamed)")),
            "confidence": F.coalesce(F.lower("confidence"), F.lit("low")),
            "measurable": F.coalesce("measurable", F.lit(False)),
            "ambiguous": F.coalesce("ambiguous", F.lit(False)),
        }
    )


def parse_reply(reply: Column) -> Column:
    """Labels of a JSON reply {"labels": [...]}; an empty array where it is malformed."""
    kind = "struct<labels:array<struct<id:string,system:string,measurable:boolean,confidence:string,ambiguous:boolean,reasoning:string>>>"
    return F.coalesce(F.from_json(reply, kind)["labels"], F.array())


def with_labels(entities: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Every entity with its label, or a flagged default; labels of unknown entities fall away."""
    named = coerce_labels(labels).withColumn("labelled", F.lit(True))
    out = entities.join(named, keys, "left")
    return out.withColumns(
        {
            "labelled": F.coalesce("labelled", F.lit(False)),
            "system": F.coalesce("system", F.lit("(unlabeled)")),
            "measurable": F.coalesce("measurable", F.lit(False)),
            "confidence": F.coalesce("confidence", F.lit("low")),
            "ambiguous": F.coalesce("ambiguous", F.lit(True)),
        }
    )


def second_look(labels: DataFrame, refined: DataFrame, keys: list[str]) -> DataFrame:
    """Refined labels replace flagged ones only; a flagged id that is left out stays flagged."""
    again = coerce_labels(refined).select(*keys, *[F.col(c).alias("new_" + c) for c in ("system", "measurable", "confidence", "ambiguous")], F.lit(True).alias("seen"))
    flagged = needs_second_look(F.col("measurable"), F.col("ambiguous"), F.col("confidence"))
    use = flagged & F.coalesce("seen", F.lit(False))
    out = labels.join(again, keys, "left")
    return out.withColumns({c: F.when(use, F.col("new_" + c)).otherwise(F.col(c)) for c in ("system", "measurable", "confidence", "ambiguous")}).drop("seen", *["new_" + c for c in ("system", "measurable", "confidence", "ambiguous")])


def needs_second_look(measurable: Column, ambiguous: Column, confidence: Column) -> Column:
    return ambiguous | (measurable & ~S.trusted_label(measurable, ambiguous, confidence))


def item_gate(items: DataFrame) -> DataFrame:
    """State of each item: counted, flagged, or excluded (confident background)."""
    trusted = S.trusted_label(F.col("measurable"), F.col("ambiguous"), F.col("confidence"))
    state = F.when(~F.col("labelled"), "not labelled").when(~F.col("measurable") & ~F.col("ambiguous"), "excluded").when(trusted, "counted").otherwise("flagged")
    return items.withColumn("state", state)


def system_totals(items: DataFrame) -> DataFrame:
    """Linear feet by system over trusted items, each rounded to a tenth first."""
    return items.where("state = 'counted'").groupBy("system").agg(F.round(F.sum(F.round("lf", 1)), 1).alias("lf"))


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 0).when(confidence == "medium", 1).otherwise(2)


def by_system(items: DataFrame) -> DataFrame:
    """Sink rows: quantity, sheets, pens and worst confidence by system."""
    trusted = items.where("state = 'counted'")
    return trusted.groupBy("system").agg(F.round(F.sum(F.round("lf", 1)), 1).alias("lf"), F.countDistinct("sheet").alias("n_sheets"), F.countDistinct("style").alias("n_styles"), F.max_by("confidence", confidence_rank(F.col("confidence"))).alias("worst"))


def system_size(networks: DataFrame, sized: DataFrame) -> DataFrame:
    """Linear feet by system and size label with a total row for each system.

    networks: sheet, run, lf, system, state; sized: sheet, run, size."""
    rows = networks.where("state = 'counted'").join(sized, ["sheet", "run"], "left").withColumn("size_text", F.coalesce(S.size_label(F.col("size")), F.lit("unsized")))
    out = rows.groupingSets([[F.col("system"), F.col("size_text")], [F.col("system")]], "system", "size_text").agg(F.sum("lf").alias("lf"), F.grouping("size_text").alias("is_total"))
    return out.select("system", F.when(F.col("is_total") == 1, "total").otherwise(F.col("size_text")).alias("size_text"), F.round("lf", 4).alias("lf"))


def entity_gate(entities: DataFrame) -> DataFrame:
    """State of a network or cluster: an unlabelled or non-measurable one is excluded
    (also an ambiguous one), an untrusted one flagged, the rest counted."""
    trusted = S.trusted_label(F.col("measurable"), F.col("ambiguous"), F.col("confidence"))
    state = F.when(~F.col("labelled") | ~F.col("measurable"), "excluded").when(trusted, "counted").otherwise("flagged")
    return entities.withColumn("state", state)


def trusted_runs(runs: DataFrame, pen_labels: DataFrame) -> DataFrame:
    """Runs of pens with a trusted label: what networks are made of."""
    good = coerce_labels(pen_labels).where(S.trusted_label(F.col("measurable"), F.col("ambiguous"), F.col("confidence")))
    return runs.join(good.select("sheet", "style").distinct(), ["sheet", "style"], "left_semi")


def _feet(column: str) -> Column:
    return F.format_number(F.col(column), 0)


def _flagged_as(unit: Column) -> Column:
    return F.concat(F.col("id"), F.lit(": "), F.col("system"), F.lit(" flagged ("), F.col("confidence"), F.when(F.col("ambiguous"), ", ambiguous").otherwise(""), F.lit(") — "), unit)


def _excluded_as(kind: str, unit: Column) -> Column:
    why = F.when(~F.col("labelled"), "no label returned").otherwise(F.concat(F.lit(f"{kind} ("), F.col("system"), F.lit(")")))
    reason = F.when(F.coalesce(F.length("reasoning"), F.lit(0)) > 0, F.concat(F.lit(" ["), F.col("reasoning"), F.lit("]"))).otherwise("")
    return F.concat(F.col("id"), F.lit(": excluded — "), why, F.lit(" — "), unit, reason)


def network_notes(gated: DataFrame) -> DataFrame:
    """(sheet, id, kind, note) for each network that is not counted, and for counted ones
    that span the sheet.  gated: with id, lf and spans (S.spans_page)."""
    unit = F.concat(_feet("lf"), F.lit(" LF"))
    note = F.when(F.col("state") == "excluded", _excluded_as("non-pipe", unit)).when(F.col("state") == "flagged", _flagged_as(unit))
    confirm = F.concat(F.lit("CONFIRM (counted, but spans the sheet — main or match line): "), F.col("id"), F.lit(" ("), F.col("system"), F.lit(")"))
    out = gated.withColumn("note", F.coalesce(note, F.when(F.col("spans"), confirm))).where("note is not null")
    return out.select("sheet", "id", F.when(F.col("state") == "counted", "confirm").otherwise(F.col("state")).alias("kind"), "note")


def cluster_notes(gated: DataFrame) -> DataFrame:
    """As network_notes for clusters; a counted one with several drawn variants is to confirm."""
    n = F.col("n").cast("string")
    note = F.when(F.col("state") == "excluded", _excluded_as("not countable", F.concat(n, F.lit(" instances")))).when(F.col("state") == "flagged", _flagged_as(F.concat(n, F.lit(" EA"))))
    confirm = F.concat(F.lit("CONFIRM (counted): "), F.col("id"), F.lit(" ("), F.col("system"), F.lit(") absorbed "), F.col("variants").cast("string"), F.lit(" drawn variants — confirm they are one component."))
    out = gated.withColumn("note", F.coalesce(note, F.when(F.col("variants") > 1, confirm))).where("note is not null")
    return out.select("sheet", "id", F.when(F.col("state") == "counted", "confirm").otherwise(F.col("state")).alias("kind"), "note")


def size_text(sized: DataFrame, keys: list[str]) -> DataFrame:
    """By entity, its feet by size as one text: 1"=100, unsized=30, sizes ascending.

    sized: keys, size (null: unsized), lf."""
    by = sized.groupBy(*keys, "size").agg(F.sum("lf").alias("lf")).where("size is not null or lf > 0")
    part = F.concat(F.coalesce(S.size_label(F.col("size")), F.lit("unsized")), F.lit("="), F.format_string("%.0f", "lf"))
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("size", F.lit(float("inf"))).alias("k"), part.alias("text"))))
    return by.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), ", ").alias("sizes"))


def detail(gated: DataFrame, *more: str) -> DataFrame:
    """A row for each labelled entity, for the detail sheets of the sinks."""
    flags = [F.col("measurable").alias("is_measurable"), (F.col("state") == "counted").alias("counted")]
    return gated.select("sheet", "id", "system", *flags, "confidence", "ambiguous", *more, F.coalesce("reasoning", F.lit("")).alias("reasoning"))


def component_counts(clusters: DataFrame) -> DataFrame:
    """Count of each component over trusted clusters, same names merged."""
    return clusters.where("state = 'counted'").groupBy("system").agg(F.sum("n").cast("long").alias("ea"))


def prefixed_notes(notes: DataFrame) -> DataFrame:
    """Notes of all sheets in one list, each with its sheet."""
    return notes.select(F.concat(F.lit("["), F.col("sheet").cast("string"), F.lit("] "), F.col("note")).alias("note"), "kind")


def unscaled_sheets(sheets: DataFrame) -> DataFrame:
    """(sheet, error) for sheets whose lengths cannot be told; counts go on in points."""
    return sheets.where("ppf is null or ppf <= 0").select("sheet", F.lit("no scale on sheet; cannot compute footage").alias("error"))


def review(items: DataFrame) -> DataFrame:
    """Everything that was not counted, by reason."""
    return items.where("state <> 'counted'").groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("lf"), 1).alias("lf"))


def ranked(df: DataFrame, by: str, first: str, most: int | None = None, prefix: str = "s") -> DataFrame:
    """Ids by falling ``by`` within a sheet (ties by ``first``), the top ``most`` kept."""
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy(F.desc(by), first))
    out = df.withColumn("rank", rank)
    return (out if most is None else out.where(F.col("rank") <= most)).withColumn("id", F.concat(F.lit(prefix), (F.col("rank") - 1).cast("string"))).drop("rank")


def scale_gate(matches: DataFrame) -> DataFrame:
    """Known dimensions within 1 % and 2 %, the best match, and the pen that most of
    those within 3 % are drawn with (the first of its name on ties), by sheet."""
    e = F.abs("error_percent")
    out = matches.groupBy("sheet").agg(F.count("*").alias("n"), F.count_if(e <= 1).alias("within_1"), F.count_if(e <= 2).alias("within_2"), F.min(F.round(e, 4)).alias("best"))
    if "style" not in matches.columns:
        return out
    pens = matches.where(e <= 3).groupBy("sheet", "style").count()
    first = F.row_number().over(Window.partitionBy("sheet").orderBy(F.desc("count"), "style"))
    modal = pens.withColumn("k", first).where("k = 1").select("sheet", F.col("style").alias("modal_style"))
    return out.join(modal, "sheet", "left")


def cleanliness(paths: DataFrame, sheets: DataFrame) -> DataFrame:
    """By sheet: number of paths, share of lengths under a point, drawn extent against the page.

    paths: sheet, length_pt, x0..y1."""
    out = paths.groupBy("sheet").agg(F.count("*").alias("n_paths"), F.round(F.avg((F.col("length_pt") < 1).cast("double")), 6).alias("near_zero"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    span = S.page_span_percent(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("page_w"), F.col("page_h"))
    return out.join(sheets.select("sheet", "page_w", "page_h"), "sheet").select("sheet", "n_paths", "near_zero", F.round(span, 4).alias("span_percent"))


#: The trades, what names each, and words of its vocabulary.
TRADES = (
    ("Mechanical", ("MECHANICAL", "HVAC"), ("DUCT", "DUCTWORK", "CFM", "AHU", "RTU", "VAV", "DIFFUSER", "GRILLE", "LOUVER", "DAMPER", "CONDENSATE", "REFRIGERANT", "FURNACE", "THERMOSTAT", "SUPPLY AIR", "RETURN AIR", "EXHAUST FAN")),
    ("Plumbing", ("PLUMBING",), ("SANITARY", "CLEANOUT", "VTR", "WATER HEATER", "HOSE BIBB", "BACKFLOW", "DWV", "LAVATORY", "URINAL", "WATER CLOSET", "FLOOR DRAIN", "FIXTURE UNITS")),
    ("Structural", ("STRUCTURAL",), ("FOOTING", "REBAR", "REINFORCING", "ANCHOR BOLT", "SHEAR WALL", "JOIST", "GIRDER", "TRUSS", "FOUNDATION", "FRAMING", "CMU", "GRADE BEAM")),
    ("Architectural", ("ARCHITECTURAL", "ARCHITECTURE"), ("REFLECTED CEILING", "ROOM FINISH", "DOOR SCHEDULE", "WINDOW SCHEDULE", "WALL TYPE", "PARTITION", "CASEWORK", "MILLWORK", "FINISH SCHEDULE", "GYPSUM", "STOREFRONT")),
    ("Electrical", ("ELECTRICAL",), ("PANELBOARD", "RECEPTACLE", "LUMINAIRE", "CIRCUIT BREAKER", "SWITCHBOARD", "SWITCHGEAR", "TRANSFORMER", "CONDUIT", "VOLTAGE", "AMPACITY", "GROUNDING", "LIGHTING FIXTURE")),
    ("Fire Protection", ("FIRE PROTECTION", "FIRE SPRINKLER", "SPRINKLER"), ("NFPA", "STANDPIPE", "FDC", "FIRE RISER", "PENDENT", "ESCUTCHEON", "WET PIPE", "DRY PIPE", "HAZARD CLASSIFICATION", "K-FACTOR")),
)
#: Points for a file name, a page that names a trade, a page with its sheet number, the most for words.
FILE_POINTS, NAME_POINTS, NUMBER_POINTS, WORD_POINTS = 12, 4, 2, 6
LEAST_SCORE, MARGIN, LEAST_TEXT = 4, 1.5, 200


def trade_scores(pages: DataFrame, set_key: str = "sheet_set", filename: str | None = None) -> DataFrame:
    """Score of each trade for each set: 12 if the file name says it, 4 a page that names
    it, 2 a page with its sheet numbers, and up to 6 for distinct words of its vocabulary.

    Each whole page is read once: flags of all trades are made together, and summed by set."""
    letters = {trade: letter for letter, trade in S.TRADE_LETTERS}
    numbers = F.regexp_extract_all("t", F.lit(S.SHEET_NUMBERS), F.lit(1))
    # a look-ahead consumes nothing, so that terms within and behind others are found too
    terms = "|".join(r"\s+".join(re.escape(w) for w in term.split()) for _, names, words in TRADES for term in (*names, *words))
    found = F.transform(F.regexp_extract_all("t", F.lit(rf"\b(?=({terms})\b)"), F.lit(1)), lambda w: F.regexp_replace(w, r"\s+", " "))
    seen = pages.withColumn("t", F.upper("page_text")).select("*", F.coalesce(F.array_distinct(numbers), F.array()).alias("numbers"), F.coalesce(F.array_distinct(found), F.array()).alias("found"))
    flags = []
    for k, (trade, names, words) in enumerate(TRADES):
        file = functools.reduce(lambda a, b: a | b, [S.has_term(S.filename_words(F.col(filename)), n) for n in names]) if filename else F.lit(False)
        flags += [F.arrays_overlap("found", F.array(*map(F.lit, names))).cast("int").alias(f"named_{k}"), F.array_contains("numbers", letters[trade]).cast("int").alias(f"number_{k}"), F.coalesce(file, F.lit(False)).cast("int").alias(f"file_{k}")]
        flags += [F.array_contains("found", w).cast("int").alias(f"word_{k}_{j}") for j, w in enumerate(words)]
    seen = seen.select(set_key, *flags)
    sums = [F.sum(f"{what}_{k}").alias(f"{what}_{k}") for k in range(len(TRADES)) for what in ("named", "number")] + [F.max(f"file_{k}").alias(f"file_{k}") for k in range(len(TRADES))]
    sums += [F.max(f"word_{k}_{j}").alias(f"word_{k}_{j}") for k, (_, _, words) in enumerate(TRADES) for j in range(len(words))]
    total = seen.groupBy(set_key).agg(*sums)

    def score(k: int) -> Column:
        words = functools.reduce(lambda a, b: a + b, [F.col(f"word_{k}_{j}") for j in range(len(TRADES[k][2]))])
        return (FILE_POINTS * F.col(f"file_{k}") + NAME_POINTS * F.col(f"named_{k}") + NUMBER_POINTS * F.col(f"number_{k}") + F.least(words, F.lit(WORD_POINTS))).cast("long")

    each = F.array(*[F.struct(F.lit(trade).alias("trade"), F.lit(k).alias("place"), score(k).alias("score")) for k, (trade, *_) in enumerate(TRADES)])
    return total.select(set_key, F.explode(each).alias("e")).select(set_key, "e.score", "e.trade", "e.place")


def enough_text(pages: DataFrame, set_key: str = "sheet_set", least: int = LEAST_TEXT) -> DataFrame:
    """Sets with so many characters of text that they are worth classifying."""
    return pages.groupBy(set_key).agg(F.sum(F.length("page_text")).alias("chars")).where(F.col("chars") >= least).select(set_key)


def decide_trade(scores: DataFrame, set_key: str = "sheet_set") -> DataFrame:
    """The top trade where it has 4 points and 1.5 times the runner-up, else null (ties in the trades' order)."""
    w = Window.partitionBy(set_key).orderBy(F.desc("score"), "place")
    top = scores.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("rank = 1")
    return top.select(set_key, F.when((F.col("score") >= LEAST_SCORE) & (F.col("score") >= MARGIN * F.coalesce("second", F.lit(0))), F.col("trade")).alias("trade"), "score")


def resolve_trade(explicit: Column, decided: Column, asked: Column | None = None) -> Column:
    """Explicit choice, keyword decision, labeler's answer, else construction."""
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), decided, asked if asked is not None else F.lit(None).cast("string"), F.lit("construction"))
