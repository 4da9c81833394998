"""Main text of HTML pages by two passes over its blocks.

A page is cut into blocks at block-level tags. The first pass classifies each one:

* inside a menu, header, footer, sidebar, notice, advert, form or comment element
  (by tag, role, class or id) a block is bad;
* elsewhere text decides: a share of link characters above MAX_LINKS is bad; few
  stop words are bad; many are good in long blocks and nearly good in others
  (good, if no block of the page is: those in articles with a prior, else those
  outside of articles, else all); headings and blocks under SHORT characters
  stay open;
* an article or main element is a prior for its own blocks: without many links
  they are nearly good at least, whatever their length and stop words, and so
  are headings. An element without a good block of its own and with less text
  than the good blocks (nearly good, if there are none) outside of it is a
  teaser and no prior.

In the second pass open and nearly good blocks take the label of their nearest
decided neighbours: of both if they agree, else good for nearly good blocks and
for headings before a good block, bad for the rest. The ends of a page count as
bad. With a prior the neighbours are those of the same element, its ends count as
good, bad elements inside it are passed over, and headings go with the block that
follows.

References are decoded, white space (line breaks too) becomes one space, and kept
blocks are joined by line ends in page order. Nothing else is dropped or cut.

Defined results: null, empty and text-free html gives an empty text with length 0;
unclosed tags and comments run to the end of the page; repeated rows get equal
texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.base import query, small_batches, table

MAX_LINKS = 0.33
SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.12, 0.30

# Frequent function words of the page languages.
STOP_WORDS = frozenset(
    (
        "the of and to a in is that it was for on with as are be this by at from or an have not he they his her you we which were been has had but their its will "
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie "
        "le la les de des et en un une du que qui dans est pour pas au sur par avec ce il elle se plus ou son sa ne aux mais on nous vous "
        "el los las y del que en un una con por para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre"
    ).split()
)
# Elements whose text is never part of an article.
DROPPED = frozenset("nav footer aside form button select option dialog menu iframe object svg canvas map audio video label textarea datalist".split())
SILENT = "script|style|noscript|template|title"
BLOCK = frozenset(
    (
        "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
        "header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul"
    ).split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words in class names and ids.
MARKS = frozenset(
    (
        "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices alert "
        "sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist reply replies respond disqus discussion "
        "share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay login signin signup register search widget "
        "pagination pager paging toolbar teaser"
    ).split()
)

TOP_MARKS = frozenset("header masthead topbar banner".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SILENT})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARK = re.compile(r"[A-Za-z][a-z]+|[A-Z]{2,}|[a-z]+")
_HEADING = re.compile(r"h[1-6]$")


def _bad_element(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        if name.lower() == "role":
            if value.strip().lower() in ROLES:
                return True
        else:
            marks = {m.lower() for m in _MARK.findall(value)} & MARKS
            if marks - TOP_MARKS if in_article else marks:  # an article has a header of its own, with its title
                return True
    return False


def _is_article(tag: str, attrs: str) -> bool:
    if tag in ("article", "main"):
        return True
    return any(n.lower() == "role" and (a or b or c).strip().lower() in ("article", "main") for n, a, b, c in _ATTR.findall(attrs)) if attrs else False


def blocks_of(page: str) -> list[tuple[str, str, bool, int, int]]:
    """``(text, tag, bad, article, link characters)`` of each block with text; ``article`` numbers the innermost one, 0 for none."""
    out: list[tuple[str, str, bool, int, int]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, bad, article
    open_tags: Counter[str] = Counter()  # so that an end tag without a start costs nothing, however deep the page
    articles = 0
    parts: list[str] = []
    state = {"tag": "", "links": 0}
    link = 0

    def close() -> None:
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                _, bad, art = stack[-1] if stack else ("", False, 0)
                out.append((text, state["tag"], bad, art, state["links"]))
            parts.clear()
        state["links"] = 0

    def put(text: str) -> None:
        parts.append(text)
        if link:
            state["links"] += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        end, tag, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 0 if end else 1
        elif tag in BLOCK or tag in DROPPED:
            close()
            link = 0
            if end:
                if open_tags[tag]:
                    last = ""
                    while last != tag:
                        last = stack.pop()[0]
                        open_tags[last] -= 1
                state["tag"] = ""
            else:
                state["tag"] = tag
                if tag not in VOID and tag not in ("p", "html", "body") and not _HEADING.match(tag) and not attrs.endswith("/"):
                    _, bad, art = stack[-1] if stack else ("", False, 0)
                    if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
                        stack.pop()
                        open_tags[tag] -= 1
                        _, bad, art = stack[-1] if stack else ("", False, 0)
                    bad = bad or _bad_element(tag, attrs, art > 0)
                    if _is_article(tag, attrs):
                        articles += 1
                        art = articles
                    stack.append((tag, bad, art))
                    open_tags[tag] += 1
                elif tag == "p" and _bad_element(tag, attrs, True):
                    state["tag"] = "-"  # a paragraph that calls itself a notice or the like
    if at < len(page):
        put(page[at:])
    close()
    return [(t, tag, bad or tag == "-", art, links) for t, tag, bad, art, links in out]


def _by_text(text: str, tag: str, links: int) -> str:
    """First-pass label of a block by its text alone."""
    if links > MAX_LINKS * len(text):
        return "bad"
    if _HEADING.match(tag):
        return "heading"
    if len(text) < SHORT:
        return "bad" if links else "short"
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    return ("good" if len(text) > LONG else "near") if stops >= MANY_STOPS else "near" if stops >= FEW_STOPS else "bad"


def _priors(blocks: list[tuple[str, str, bool, int, int]], first: list[str]) -> set[int]:
    """Articles that hold main text, as far as their text tells."""
    best = "good" if "good" in first else "near"
    size: Counter[int] = Counter()
    strong: Counter[int] = Counter()
    for (text, _, bad, art, links), x in zip(blocks, first):
        if not bad:
            size[art] += max(0, len(text) - links)
            strong[art] += len(text) if x == best else 0
    total = sum(strong.values())
    return {art for art in size if art and (best == "good" and strong[art] or size[art] >= total - strong[art])}


def _second_pass(first: list[str], end: str) -> list[bool]:
    """Open labels by their nearest decided ones on both sides; ``end`` is what counts beyond the ends."""
    n = len(first)
    before, after = [end] * n, [end] * n
    last = end
    for i, x in enumerate(first):
        before[i] = last
        last = x if x in ("good", "bad") else last
    last = end
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = first[i] if first[i] in ("good", "bad") else last
    out = []
    for x, b, a in zip(first, before, after):
        if x in ("good", "bad"):
            out.append(x == "good")
        elif x == "heading":
            out.append(a == "good")
        elif b == a:
            out.append(b == "good")
        else:
            out.append(x == "near")
    return out


def labels_of(blocks: list[tuple[str, str, bool, int, int]]) -> list[bool]:
    """Whether each block belongs to the main text."""
    first = ["bad" if bad else _by_text(text, tag, links) for text, tag, bad, _, links in blocks]
    priors = _priors(blocks, first)
    inside: dict[int, list[int]] = {art: [] for art in priors}
    for i, (text, tag, bad, art, links) in enumerate(blocks):
        if art in priors and not bad:
            inside[art].append(i)
            if first[i] != "good" and links <= MAX_LINKS * len(text):
                first[i] = "heading" if _HEADING.match(tag) else "near"
    if "good" not in first:  # a page of middling paragraphs only
        near = [i for i, x in enumerate(first) if x == "near"]
        held = [i for i in near if blocks[i][3] in priors] or [i for i in near if not blocks[i][3]]
        for i in held or near:
            first[i] = "good"
    # blocks of articles are decided among themselves, the rest of the page beside what they came to
    for own in inside.values():
        rest = [i for i in own if first[i] != "heading"]
        for i, keep in zip(rest, _second_pass([first[i] for i in rest], "good")):
            first[i] = "good" if keep else "bad"
        follows = "good"
        for i in reversed(own):
            if first[i] == "heading":
                first[i] = follows
            follows = first[i]
    return _second_pass(first, "bad")


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b[0] for b, keep in zip(blocks, labels_of(blocks)) if keep)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` with ``text`` and ``n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, rows, held = 0, [], 0
            for i, h in enumerate(b.column(len(keep))):
                rows.append(main_text(h.as_py()))
                held += len(rows[-1])
                if held > 1 << 22 or i + 1 == len(b):
                    cols = [c.slice(done, len(rows)) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(rows, pa.string()), pa.array([len(r) for r in rows], pa.int64())], [*keep, "text", "n_chars"])
                    done, rows, held = i + 1, [], 0

    small_batches(pages.sparkSession)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(html_col)).mapInArrow(run, f"{kinds}, text string, n_chars long")


# The given pages mark their article with one element and hold few kinds of references.
_SQL_TEXT = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)(?:</article>|$)', 1, 's'), '</?(p|h1)>', chr(30), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g')"
_SQL_PLAIN = """regexp_replace(replace(replace(replace(b, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"""


@query(
    "op4_main_text",
    rf"""
WITH cut AS (SELECT page_id, url, string_split({_SQL_TEXT}, chr(30)) AS bs FROM pages),
done AS (
  SELECT page_id, url,
         coalesce(array_to_string(list_filter(list_transform(bs, lambda b: trim(regexp_replace({_SQL_PLAIN}, '[\s\x0B]+', ' ', 'g'))), lambda b: b <> ''), chr(10)), '') AS text
  FROM cut
)
SELECT page_id, url, text, length(text) AS n_chars FROM done
""",
)
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
