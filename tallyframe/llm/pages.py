"""HTML extraction by structure and nearest-URL page differencing.

A page is read into text lines, one for each block element.  Lines inside
menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts
and styles (by element, role, class or id) go.  The other lines of every page
are aligned with those of the page nearest by URL path on the same host, by
longest common subsequence: shared lines are the site's, others the page's own.

Structure is the second signal.  A line inside a marked article (article, main,
or a role or class that says so) stays although shared, as articles repeat
passages.  Beside a marked article, a page's own lines stay and shared ones go;
without a neighbour only the article is known.  A page without a marked article
keeps its own lines; where more than COPIES of its text is shared the two are
copies of one article, and all lines stay.

Neighbours come from one global range sort of (host, path, page_id, line
hashes), so a host with a third of all pages is spread over tasks; the rows at
the borders of partitions meet in a second step, two for each partition.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from bisect import bisect_left
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
_SPACE = re.compile(r"[\s ]+")
#: HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("nav footer aside form script style noscript template svg math iframe object embed head title select button textarea input dialog menu option datalist canvas audio video map xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_CHROME_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|newsletter|subscri\w*|signup|sidebar\w*|rail|menu\w*|nav|navbar\w*|navigation|topbar|breadcrumbs?|footer|foot|masthead|comment\w*|disqus\w*|repl(?:y|ies)|respond|related|recommend\w*|shar(?:e|ing)|social|popup|modal|overlay|widget\w*|toolbar|pagination|pager|skip|login|search\w*|legal|disclaimer|metadata|byline)(?:$|[\s_-])",
    re.I,
)
_CORE_CLASS = re.compile(r"(?:^|\s)(?:article|post|entry|story)(?:[_-]?(?:body|content|text))?(?:$|\s)", re.I)
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
_WALL = frozenset("table td th ul ol dl article main section div body html aside nav footer header form blockquote button".split())
_BARE = frozenset("html body article main".split())
#: A page without a marked article of which more than this share of the text is its neighbour's is a copy of it.
COPIES = 0.5


def text_lines(page: str) -> list[tuple[str, bool]]:
    """(line, inside the article) of the blocks of a page that are not chrome."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, chrome, core: of this element or one around it
    piece: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        if piece:
            line = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
            if line:
                out.append((line, bool(stack) and stack[-1][2]))
            piece.clear()

    def close(names: tuple[str, ...], wall: frozenset = frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                if any(x[0] not in INLINE for x in stack[k:]):
                    flush()
                del stack[k:]
                return
            if stack[k][0] in wall:
                return

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            if not (stack and stack[-1][1]):
                piece.append(page[at:])
            break
        if m.start() > at and not (stack and stack[-1][1]):
            piece.append(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["close"] or m["close2"]:
            if name == "br":
                piece.append(" ")
            elif name not in VOID:
                close((name,))
            continue
        if name in VOID:
            if name in INLINE:
                if name == "br":
                    piece.append(" ")
            else:
                flush()
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in _P_ENDS:
            close(("p",), _WALL)
        elif name in _SAME_ENDS:
            close(_SAME_ENDS[name], frozenset(("table", "ul", "ol", "dl", "select")) if name != "td" else frozenset(("table", "tr")))
        if name not in INLINE:
            flush()
        _, chrome, core = stack[-1] if stack else ("", False, False)
        given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs)} if "=" in attrs or "hidden" in attrs else {}
        role = given.get("role", "").lower()
        called = f"{given.get('class', '')} {given.get('id', '')}".strip()
        if name in CHROME or role in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
            chrome = True
        elif name == "header" or re.search(r"(?:^|[\s_-])header(?:$|[\s_-])", called, re.I):
            chrome = chrome or not core  # an article's own header holds its title
        elif called and name not in _BARE and _CHROME_CLASS.search(called):
            chrome = True
        if not chrome and (name in ("article", "main") or role in ("main", "article") or "articlebody" in given.get("itemprop", "").lower() or called and name in ("div", "section") and _CORE_CLASS.search(called)):
            core = True
        stack.append((name, chrome, core))
    flush()
    return out


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL, without scheme, query and fragment."""
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path.rstrip("/") or "/"
    except ValueError:
        return "", url or ""


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices in ``a`` of a longest common subsequence with ``b`` (Hunt-Szymanski)."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def main_lines(lines: list[str], core: list[bool], shared: list[int] | None, copies: float = COPIES) -> list[str]:
    """The lines that are main text; shared: indices of lines that the neighbour has too, None without one."""
    if shared is None:
        return [x for x, inside in zip(lines, core, strict=True) if inside] or lines
    site = set(shared)
    if not any(core) and sum(len(lines[i]) for i in site) > copies * sum(map(len, lines)):
        return lines
    return [x for i, (x, inside) in enumerate(zip(lines, core, strict=True)) if inside or i not in site]


def _hash(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def _read(batches):
    """Pages with the hashes of their lines; body: whether each line is inside the article, and the lines, packed."""
    for batch in batches:
        urls, pages = batch.column("url"), batch.column("html")
        for a in range(0, len(batch), 512):
            rows = []
            for i in range(a, min(a + 512, len(batch))):
                url = urls[i].as_py()
                lines = text_lines(pages[i].as_py() or "")
                mine = [_hash(x.encode()) for x, _ in lines]
                body = "\n".join(["".join("01"[inside] for _, inside in lines), *(x for x, _ in lines)])
                rows.append((url, *place(url), mine, _hash(repr(mine).encode()), zlib.compress(body.encode())))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(a, len(rows)), *(pa.array(c, k) for c, k in zip(cols, [pa.string()] * 3 + [pa.list_(pa.int64()), pa.int64(), pa.binary()], strict=True))], ["page_id", "url", "host", "path", "mine", "key", "body"])


def _neighbours(batches):
    """Each row with the rows before and after it in its partition; the first and last also as borders."""
    part, before, row, first = TaskContext.get().partitionId(), None, None, True
    names = ("page_id", "url", "host", "path", "mine")

    def made(row, before, after):
        nonlocal first
        edge = None if before and after else 2 * part if not before else 2 * part + 1
        return (*row, before and (before[2], before[3], before[4]), after and (after[2], after[3], after[4]), edge, before is None, after is None)

    for batch in batches:
        out = []
        for now in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row is not None:
                out.append(made(row, before, now))
                before = row
            row = now
        if out:
            yield _rows(out)
    if row is not None:
        yield _rows([made(row, before, None)])


_SIDE = pa.struct([("host", pa.string()), ("path", pa.string()), ("mine", pa.list_(pa.int64()))])


def _rows(out):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), _SIDE, _SIDE, pa.int64(), pa.bool_(), pa.bool_()]
    side = lambda x: None if x is None else dict(zip(("host", "path", "mine"), x, strict=True))
    cols = list(zip(*((*r[:5], side(r[5]), side(r[6]), *r[7:]) for r in out), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "host", "path", "mine", "before", "after", "edge", "opens", "ends"])


def _near(path: str, side) -> int:
    if side is None:
        return -1
    n = 0
    for x, y in zip(path, side["path"], strict=False):
        if x != y:
            break
        n += 1
    return n


def _differ(batches):
    """Indices of each page's lines that the nearer of its neighbours on the host shares."""
    for batch in batches:
        rows = []
        for host, path, mine, before, after in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "mine", "before", "after")), strict=True):
            sides = [s for s in (before, after) if s is not None and s["host"] == host]
            best = max(sides, key=lambda s: _near(path, s), default=None)  # noqa: B023
            rows.append(best and common_lines(mine, best["mine"]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([_hash(repr(x).encode()) for x in batch.column("mine").to_pylist()], pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["p2", "u2", "key2", "shared"])


def _texts(batches):
    for batch in batches:
        rows = []
        for body, shared in zip(batch.column("body").to_pylist(), batch.column("shared").to_pylist(), strict=True):
            core, *lines = zlib.decompress(body).decode().split("\n")
            rows.append("\n".join(main_lines(lines, [x == "1" for x in core], shared)) if core else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(rows, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of each page.

    pages: page_id long, url string, html string; other columns are ignored.
    Returns a row for each row: page_id, url, text (blocks joined by \\n, empty
    if none), n_chars (code points).

    A null page has an empty text.  A null or broken URL counts as a host of its
    own kind (empty).  Rows that tie in URL and id are neighbours of each other.
    Repeated rows are extracted each.  Empty table: empty result.
    """
    read = pages.select("page_id", "url", "html").mapInArrow(_read, "page_id long, url string, host string, path string, mine array<long>, key long, body binary")
    read = materialize(read, "pages")
    schema = "page_id long, url string, host string, path string, mine array<long>, before struct<host:string,path:string,mine:array<long>>, after struct<host:string,path:string,mine:array<long>>, edge long, opens boolean, ends boolean"
    ranged = read.where(F.size("mine") > 0).select("page_id", "url", "host", "path", "mine").repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id", "url", F.hash("mine"))
    ranged = materialize(ranged.mapInArrow(_neighbours, schema), "neighbours")
    order = Window.orderBy("edge")  # two rows for each partition
    me = F.struct("host", "path", "mine")
    borders = ranged.where("edge is not null").withColumn("lag", F.lag(me).over(order)).withColumn("lead", F.lead(me).over(order))
    borders = borders.withColumn("before", F.coalesce("before", "lag")).withColumn("after", F.coalesce("after", "lead")).drop("lag", "lead")
    sides = ranged.where("edge is null").union(borders)
    shared = sides.select("page_id", "url", "host", "path", "mine", "before", "after").mapInArrow(_differ, "p2 long, u2 string, key2 long, shared array<int>")
    shared = shared.groupBy("p2", "u2", "key2").agg(F.max("shared").alias("shared"))  # rows of one page and text
    joined = read.join(shared, F.col("page_id").eqNullSafe(F.col("p2")) & F.col("url").eqNullSafe(F.col("u2")) & (F.col("key") == F.col("key2")), "left")
    out = joined.select("page_id", "url", "body", "shared").mapInArrow(_texts, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
