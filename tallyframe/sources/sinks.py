"""Sinks: CSV files, text reports and workbooks of a takeoff.

What is written here is a roll-up (a row per system, pen, network or cluster),
so it is brought to the driver row by row; measured tables themselves are
written by ``DataFrame.write``.
"""

from __future__ import annotations

import csv
import re
import zipfile
from collections.abc import Iterable
from datetime import datetime
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import rollups as R


def by_system_rows(items: DataFrame) -> DataFrame:
    """System, quantity, sheets, pens and worst confidence, the largest first."""
    out = R.by_system(items).orderBy(F.desc("lf"), "system")
    return out.select(F.col("system").alias("System"), F.format_string("%.1f", "lf").alias("Quantity"), F.lit("LF").alias("Unit"), F.col("n_sheets").alias("Sheets"), F.col("n_styles").alias("Styles"), F.col("worst").alias("Min_Confidence"))


def detail_rows(items: DataFrame) -> DataFrame:
    """A row for each item by sheet, the largest first; YES where it is not counted."""
    note = F.regexp_replace(F.coalesce("reasoning", F.lit("")), "[\r\n]", " ")
    flagged = F.when(F.col("state") == "counted", "").otherwise("YES")
    out = items.orderBy("sheet", F.desc("lf"), "style")
    return out.select(F.col("system").alias("System"), F.col("sheet").alias("Sheet"), F.col("style").alias("Lineweight"), F.format_string("%.1f", "lf").alias("Quantity"), F.lit("LF").alias("Unit"), F.col("confidence").alias("Confidence"), flagged.alias("Flagged"), F.col("n_runs").alias("Runs"), F.regexp_replace(F.col("ppf").cast("string"), r"\.0$", "").alias("Scale_pt_per_ft"), note.alias("Notes"))


def write_csv(rows: DataFrame, path: str | Path) -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        out.writerows(rows.toLocalIterator())


def diagnostics_lines(takeoff: dict[str, DataFrame]) -> Iterable[str]:
    """Totals, flagged items and errors of a takeoff by system."""
    items, n = takeoff["items"], {r[0]: r[1] for r in takeoff["items"].groupBy("state").count().collect()}
    yield f"takeoff items: {sum(n.values())} (trusted: {n.get('counted', 0)}, flagged: {n.get('flagged', 0)})"
    yield "TOTALS by system (trusted):"
    total = [f"  {r.system}: {r.lf:,.1f} LF" for r in takeoff["totals"].orderBy(F.desc("lf"), "system").toLocalIterator()]
    yield from total or ["  (none)"]
    if n.get("flagged"):
        yield "FLAGGED for review (not counted):"
        for r in items.where("state = 'flagged'").orderBy("sheet", F.desc("lf")).toLocalIterator():
            yield f"  {r.sheet}  {r.style}  {r.lf:,.1f} LF -> {r.system} [conf={r.confidence}, ambiguous={r.ambiguous}]" + (f" — {r.reasoning}" if r.reasoning else "")
    errors = [f"  {r.sheet}: {r.error}" for r in takeoff["errors"].orderBy("sheet").toLocalIterator()]
    if errors:
        yield from ["ERRORS:", *errors]


def system_size_lines(takeoff: dict[str, DataFrame]) -> Iterable[str]:
    """The table by system and size, then what is to be reviewed."""
    yield "TAKEOFF — linear feet by system and size (trusted networks):"
    rows = [f"  {r.system:<24} {r.size_text:>8}  {r.lf:>10,.1f} LF" for r in summary_rows(takeoff["by_system_size"]).toLocalIterator()]
    yield from rows or ["  (no trusted networks)"]
    notes = [f"  [{r.sheet}] {r.note}" for r in takeoff["review"].orderBy("sheet", "id").toLocalIterator()]
    if notes:
        yield from ["REVIEW:", *notes]


def counts_lines(takeoff: dict[str, DataFrame], most: int = 12) -> Iterable[str]:
    """Counts by component, the most frequent tags, then what is to be reviewed."""
    yield "COUNTS (trusted clusters):"
    rows = [f"  {r.system:<24} {r.ea:>6} EA" for r in takeoff["by_component"].orderBy(F.desc("ea"), "system").toLocalIterator()]
    yield from rows or ["  (no symbols)"]
    tags = [f"  {r.tag}: {r['count']}" for r in takeoff["tags"].groupBy("tag").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "tag").limit(most).collect()]
    if tags:
        yield from ["TAGS:", *tags]
    notes = [f"  [{r.sheet}] {r.note}" for r in takeoff["review"].orderBy("sheet", "id").toLocalIterator()]
    if notes:
        yield from ["REVIEW:", *notes]


def summary_rows(by_system_size: DataFrame) -> DataFrame:
    """Sizes ascending, unsized and then the total last, the largest system first."""
    inches = F.when(F.col("size_text") == "unsized", 1e9).when(F.col("size_text") == "total", 2e9)
    for value, text in S.NOMINAL:
        inches = inches.when(F.col("size_text") == text, value)
    total = by_system_size.where("size_text = 'total'").select("system", F.col("lf").alias("all"))
    return by_system_size.join(total, "system").orderBy(F.desc("all"), "system", inches.asc_nulls_first()).select("system", "size_text", F.round("lf", 1).alias("lf"))


def document_folder(out_dir: str | Path, project: str, now: datetime | None = None) -> Path:
    """A new folder named by the project and the time."""
    name = re.sub(r"[^A-Za-z0-9._-]+", "_", project).strip("_") or "takeoff"
    folder = Path(out_dir) / f"{name}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def write_documents(takeoff: dict[str, DataFrame], out_dir: str | Path, project: str = "takeoff", now: datetime | None = None) -> Path:
    """The by-system table, the detail table and the diagnostics of a takeoff by system."""
    folder = document_folder(out_dir, project, now)
    write_csv(by_system_rows(takeoff["items"]), folder / "takeoff_by_system.csv")
    write_csv(detail_rows(takeoff["items"]), folder / "takeoff_detail.csv")
    (folder / "diagnostics.txt").write_text("\n".join(diagnostics_lines(takeoff)) + "\n", encoding="utf-8")
    return folder


def unique_names(names: Iterable[str]) -> list[str]:
    """File names in order, those that repeat with _2, _3, ..."""
    seen: dict[str, int] = {}
    taken: set[str] = set()
    out = []
    for name in names:
        made = name
        while made in taken:
            seen[name] = seen.get(name, 1) + 1
            made = f"{name}_{seen[name]}"
        taken.add(made)
        out.append(made)
    return out


def _cell(column: int, row: int, value) -> str:
    letters, column = "", column + 1
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    if isinstance(value, bool) or value is None or isinstance(value, str):
        text = "" if value is None else "YES" if value is True else "" if value is False else value
        text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
        return f'<c r="{letters}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    return f'<c r="{letters}{row}"><v>{value}</v></c>'


def write_workbook(sheets: dict[str, tuple[list[str], Iterable]], path: str | Path) -> None:
    """An .xlsx workbook of (header, rows) by sheet name."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    n = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}worksheet+xml"/>' for k in n)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/>{parts}</Types>')
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(n, sheets, strict=True)) + "</sheets></workbook>")
        for k, (columns, rows) in zip(n, sheets.values(), strict=True):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                for i, row in enumerate([columns, *rows], 1):
                    f.write((f'<row r="{i}">' + "".join(_cell(j, i, v) for j, v in enumerate(row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")


def _sheet(df: DataFrame, empty: str) -> tuple[list[str], list]:
    rows = [tuple(r) for r in df.toLocalIterator()]
    return df.columns, rows or [(empty,)]


def write_system_size(takeoff: dict[str, DataFrame], path: str | Path) -> None:
    """Workbook of a takeoff by system and size: Summary, Detail, Review."""
    size = F.when(F.col("size_text") == "total", "").otherwise(F.col("size_text"))
    name = F.when(F.col("size_text") == "total", F.concat(F.col("system"), F.lit(" — total"))).otherwise(F.col("system"))
    summary = summary_rows(takeoff["by_system_size"]).select(name.alias("System"), size.alias("Size"), F.col("lf").alias("Linear feet"))
    review = takeoff["review"].orderBy("sheet", "id")
    write_workbook({"Summary": _sheet(summary, "(no trusted networks)"), "Detail": _sheet(takeoff["detail"].orderBy("sheet", F.desc("linear_feet"), "id"), "(none)"), "Review": _sheet(R.prefixed_notes(review).select("note"), "(nothing to review)")}, path)


def write_counts(takeoff: dict[str, DataFrame], path: str | Path) -> None:
    """Workbook of counts: Summary by count without a grand total, Detail, Review."""
    summary = takeoff["by_component"].orderBy(F.desc("ea"), "system").select(F.col("system").alias("Component"), F.col("ea").alias("EA"))
    review = takeoff["review"].orderBy("sheet", "id")
    write_workbook({"Summary": _sheet(summary, "(no symbols)"), "Detail": _sheet(takeoff["detail"].orderBy("sheet", F.desc("count"), "id"), "(none)"), "Review": _sheet(R.prefixed_notes(review).select("note"), "(nothing to review)")}, path)
