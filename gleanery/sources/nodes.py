"""Page scan and the page -> node table step.

Each page becomes pre-order rows:

* ``anc`` lists the ``pre`` numbers of all ancestors, which turns containment
  into an equi join; ``path`` is the tag path, a handful of values per site.
* ``text``/``vtext`` hold the text content and visible text of text nodes and
  of every element whose text is short (a cell, link, heading, price). Longer
  elements are put together from their text nodes when asked for, so text is
  never stored once per ancestor.
* ``o0,i0,i1,o1`` are byte offsets of outer and inner HTML in the page source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import spread, table

NODE_SCHEMA = (
    "page_id LONG, pre INT, last INT, parent INT, depth INT, kind STRING, tag STRING, id STRING, "
    "classes ARRAY<STRING>, attrs MAP<STRING,STRING>, sib_pos INT, sib_cnt INT, type_pos INT, type_cnt INT, "
    "anc ARRAY<INT>, path STRING, hidden BOOLEAN, faded BOOLEAN, text STRING, vtext STRING, "
    "o0 INT, i0 INT, i1 INT, o1 INT"
)
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        *[(n, pa.int32()) for n in ("pre", "last", "parent", "depth")],
        *[(n, pa.string()) for n in ("kind", "tag", "id")],
        ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())),
        *[(n, pa.int32()) for n in ("sib_pos", "sib_cnt", "type_pos", "type_cnt")],
        ("anc", pa.list_(pa.int32())),
        ("path", pa.string()),
        ("hidden", pa.bool_()),
        ("faded", pa.bool_()),
        ("text", pa.string()),
        ("vtext", pa.string()),
        *[(n, pa.int32()) for n in ("o0", "i0", "i1", "o1")],
    ]
)
_FLUSH_ROWS = 20_000
MAX_DEPTH = 512  # fixed value: nesting browsers build
SHORT_TEXT = 512  # characters kept on the element row itself

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
SECTIONS = frozenset("thead tbody tfoot".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
# A start tag ends these open elements, looking no further up than the boundary.
_CELL = (frozenset("td th".split()), frozenset("tr table".split()))
_ROW = (frozenset(["tr"]), frozenset("table thead tbody tfoot".split()))
AUTO_CLOSE = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": _CELL,
    "th": _CELL,
    "tr": _ROW,
    **{s: (SECTIONS, frozenset(["table"])) for s in SECTIONS},
}
_P_SCOPE = frozenset("button caption html table td th".split())
_CLOSE_P = (frozenset(["p"]), _P_SCOPE)
_PLAIN_INSIDE = frozenset("textarea title".split())  # text with entities, but no tags
_SILENT = frozenset("script style".split())
_HALF_TAG = re.compile(r"</?[a-zA-Z]")
# tags as nearly all are written, read in one match; all others go the parser's way
_PLAIN_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)>')
_PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
_PLAIN_ATTR = re.compile(r' ([a-z-]+)="([^"]*)"')
_OWN_CONTENT = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_FADED = re.compile(r"opacity\s*:\s*0*\.?0+\s*(?:;|!|$)", re.I)


class _Node:
    __slots__ = (
        "pre last parent depth kind tag attrs sib_pos sib_cnt type_pos type_cnt anc path hidden faded "
        "text vtext p0 l0 v0 w0 o0 i0 i1 o1 kids"
    ).split()

    def __init__(self, pre, parent, kind, tag=None):
        self.pre, self.kind, self.tag, self.parent = pre, kind, tag, parent
        self.last, self.text, self.vtext, self.kids = pre, None, None, {}
        self.attrs, self.sib_pos, self.sib_cnt, self.type_pos, self.type_cnt = [], None, None, None, None
        up = parent
        self.depth = up.depth + 1 if up else 0
        self.anc = up.anc + [up.pre] if up else []
        self.path = (up.path + "/" + tag if up else "") if kind != "text" and kind != "comment" else None
        self.hidden, self.faded = (up.hidden, up.faded) if up else (False, False)


class _Tree(HTMLParser):
    """Token events -> node list, with the end tags a browser would supply."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.nodes, self.stack = html, [], []
        self.parts, self.vparts, self.tlen, self.vlen = [], [], 0, 0
        self.at = 0
        self._open("document", None, 0, 0)
        self.feed(html)
        self._end()
        self._pop_to(0, len(html))

    def _end(self) -> None:
        """What is left open at the end: script text, a comment, or half a tag (dropped)."""
        rest = self.rawdata
        if self.cdata_elem and rest:
            self.rawdata = ""
            self.handle_data(rest)
        elif rest.startswith("<!--"):
            self.rawdata = ""
            self.handle_comment(rest[4:])
        elif _HALF_TAG.match(rest):
            self.rawdata = ""
        self.close()

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def updatepos(self, i, j):
        """The place in the page as one number, without counting lines."""
        if i < j:
            self.at += j - i
        return j

    def parse_starttag(self, i):
        m = _PLAIN_START.match(self.rawdata, i)
        if m is None or m[1] in _OWN_CONTENT:
            return super().parse_starttag(i)
        self._start(m[1], _PLAIN_ATTR.findall(m[2]) if m[2] else [], m.end() - i)
        return m.end()

    def parse_endtag(self, i):
        m = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def _open(self, kind, tag, outer, inner) -> _Node:
        if len(self.stack) > MAX_DEPTH:  # like browsers: deeper elements become siblings
            self._pop_to(MAX_DEPTH, outer)
        up = self.stack[-1] if self.stack else None
        n = _Node(len(self.nodes), up, kind, tag)
        n.p0, n.l0, n.v0, n.w0 = len(self.parts), self.tlen, len(self.vparts), self.vlen
        n.o0, n.i0, n.i1, n.o1 = outer, inner, inner, inner
        self.nodes.append(n)
        if kind == "element":
            up.kids.setdefault("*", []).append(n)
            up.kids.setdefault(tag, []).append(n)
        if kind in ("element", "document"):
            self.stack.append(n)
        return n

    def _pop_to(self, size: int, inner_end: int, outer_end: int | None = None) -> None:
        """Close open elements until ``size`` are left; the last closed one owns the end tag."""
        while len(self.stack) > size:
            n = self.stack.pop()
            n.last = len(self.nodes) - 1
            if n.kind == "element":
                if self.tlen - n.l0 <= SHORT_TEXT:
                    n.text = "".join(self.parts[n.p0 :])
                if self.vlen - n.w0 <= SHORT_TEXT:
                    n.vtext = " ".join(self.vparts[n.v0 :])
            n.i1 = max(n.i0, n.i1, inner_end)
            n.o1 = max(n.i1, outer_end) if outer_end is not None and len(self.stack) == size else n.i1
            if n.kids:
                for name, kids in n.kids.items():
                    many = len(kids)
                    if name == "*":
                        for k, kid in enumerate(kids, 1):
                            kid.sib_pos, kid.sib_cnt = k, many
                    else:
                        for k, kid in enumerate(kids, 1):
                            kid.type_pos, kid.type_cnt = k, many
                n.kids = {}

    def _find(self, tags, boundary=frozenset()) -> int:
        """Stack index of the innermost open element in ``tags``, or -1."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in boundary:
                return -1
        return -1

    def _imply(self, tag: str | None, at: int) -> None:
        """Supply html, head, body, tbody and tr where the source leaves them out."""
        if len(self.stack) == 1:
            if tag == "html":
                return
            self._open("element", "html", at, at)
        top = self.stack[-1].tag
        if top == "head" and tag not in HEAD_ONLY:
            self._pop_to(len(self.stack) - 1, at)
            top = "html"
        if top == "html" and tag not in ("head", "body", "frameset"):
            wanted = "head" if tag in HEAD_ONLY and not self.stack[-1].kids.get("body") else "body"
            self._open("element", wanted, at, at)
        elif top == "table" and tag in ("tr", "td", "th"):
            self._open("element", "tbody", at, at)
            top = "tbody"
        if top in SECTIONS and tag in ("td", "th"):
            self._open("element", "tr", at, at)

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, len(self.get_starttag_text() or ""))

    def _start(self, tag, attrs, size):
        at = self.at
        if tag in ("html", "body", "head") and self._find({tag}) > 0:
            return
        if tag in AUTO_CLOSE:
            i = self._find(*AUTO_CLOSE[tag])
        else:
            i = self._find(*_CLOSE_P) if tag in BLOCKS else -1
        if i > 0:
            self._pop_to(i, at)
        self._imply(tag, at)
        n = self._open("element", tag, at, at + size)
        if attrs:
            seen = {}
            for name, value in attrs:
                seen.setdefault(name, value or "")
            n.attrs = list(seen.items())
            style = seen.get("style", "")
            n.hidden = n.hidden or "hidden" in seen or bool(_INVISIBLE.search(style))
            n.faded = n.faded or bool(_FADED.search(style))
        if tag in VOID:
            self._pop_to(len(self.stack) - 1, n.i0)
        elif tag in _PLAIN_INSIDE:
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        i = self._find({tag})
        if i < 1:
            return
        at = self.at
        end = self.html.find(">", at) + 1 or len(self.html)
        if tag in ("body", "html"):
            self._pop_to(max(i + 1, self._find({"body"}) + 1), at)
            self.stack[i].i1, self.stack[i].o1 = at, end
            return
        self._pop_to(i, at, end)

    def handle_data(self, data):
        at, top = self.at, self.stack[-1]
        if self.cdata_elem in _PLAIN_INSIDE:
            data = unescape(data)
        if len(self.stack) < 3 and not data.strip():
            return
        if top.tag in (None, "html", "head") and data.strip():
            self._imply(None, at)
            top = self.stack[-1]
        prev = self.nodes[-1]
        if prev.kind == "text" and prev.parent is top:
            n = prev
            n.text += data
        else:
            n = self._open("text", None, at, at)
            n.text = data
        self.parts.append(data)
        self.tlen += len(data)
        if not (n.hidden or n.faded or top.tag in _SILENT) and (shown := data.strip()):
            self.vparts.append(shown)
            self.vlen += len(shown) + 1
            n.vtext = f"{n.vtext} {shown}" if n.vtext else shown

    def handle_comment(self, data):
        self._open("comment", None, self.at, self.at).text = data


def _byte_at(html: str):
    """Character offset -> byte offset in the UTF-8 source; None if they are the same."""
    if html.isascii():
        return None
    cp = np.frombuffer(html.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))
    return lambda i: int(ends[i - 1]) if i else 0


_COPIED = "pre last depth kind tag sib_pos sib_cnt type_pos type_cnt anc path hidden faded text vtext".split()


def _rows(page_id: int, html: str, out: dict[str, list]) -> None:
    """Append the page's nodes to the output columns, column by column."""
    at, nodes = _byte_at(html), _Tree(html).nodes
    out["page_id"].extend([page_id] * len(nodes))
    out["parent"].extend([n.parent.pre if n.parent else None for n in nodes])
    found = [dict(n.attrs) if n.attrs else None for n in nodes]
    out["attrs"].extend([n.attrs for n in nodes])
    out["id"].extend([a and a.get("id") or None for a in found])
    out["classes"].extend([a["class"].split() if a and "class" in a else [] for a in found])
    for f in _COPIED:
        out[f].extend(map(attrgetter(f), nodes))
    for f in ("o0", "i0", "i1", "o1"):
        places = map(attrgetter(f), nodes)
        out[f].extend(map(at, places) if at else places)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fresh():
        return {name: [] for name in _ARROW.names}

    def flush(out):
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _ARROW], schema=_ARROW)

    out = fresh()
    for batch in batches:
        for page_id, html in zip(batch.column(0), batch.column(1)):
            _rows(page_id.as_py(), html.as_py(), out)
            if len(out["pre"]) >= _FLUSH_ROWS:
                yield flush(out)
                out = fresh()
    if out["pre"]:
        yield flush(out)


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> node rows. Only the two needed columns cross into Python."""
    return (
        pages.filter(F.col("html").isNotNull())
        .select(F.col("page_id").cast("long"), "html")
        .mapInArrow(_parse_batches, NODE_SCHEMA)
    )


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def accepted(pages: DataFrame) -> DataFrame:
    """Pages that hold HTML text (A1)."""
    return pages.filter(F.col("html").isNotNull() & F.col("url").isNotNull())


def rejected(pages: DataFrame) -> DataFrame:
    """Issue rows for the pages that ``accepted`` leaves out."""
    return pages.filter(F.col("html").isNull() | F.col("url").isNull()).select(
        "page_id",
        F.lit("page_unusable").alias("code"),
        F.lit("Failed to fetch page content").alias("issue"),
        F.col("url").alias("value"),
    )


def save_nodes(nodes: DataFrame, name: str, path: str, buckets: int) -> None:
    """Write nodes as a table partitioned by kind and bucketed on the page.

    One shuffle here removes the page shuffle from every later structural join.
    """
    (
        nodes.repartition(buckets, "page_id")
        .write.partitionBy("kind")
        .bucketBy(buckets, "page_id")
        .sortBy("page_id", "pre")
        .option("path", path)
        .saveAsTable(name)
    )


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "element")


def text_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "text")
