"""Reading selected elements: text, attributes, HTML, paths, cleaned content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.scalars import js_trim, nullif, ordered_text, squash, truncated
from gleanery.operators.selectors import KEY, select_many
from gleanery.operators.texts import PLAIN, SEEN, texts_at_hand, with_text
from gleanery.sources.nodes import elements

HTML_SPAN = ("o0", "i0", "i1", "o1")
# Attributes kept in the compact page text, and elements left out of it.
CONTEXT_ATTRS = ("id", "class", "href", "src", "alt", "title")
CONTEXT_SKIPPED = ("script", "style", "noscript", "template")
NOISE_TAGS = ("script", "style", "noscript", "template", "nav", "footer", "header", "aside", "form", "iframe")
NOISE_CLASSES = ("ad", "ads", "advert", "advertisement", "sponsored", "cookie", "popup")


def with_visible_text(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``visible`` = text without hidden elements and scripts (B11). ``found`` must carry ``vtext``."""
    return texts_at_hand(found, nodes, SEEN, F.col("vtext").isNotNull(), squash(F.coalesce("vtext", F.lit(""))), "visible")


def with_best_text(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``value`` = visible text, else all text, else NULL (B12). ``found`` must carry both texts."""
    enough = F.col("vtext").isNotNull() & ((F.col("vtext") != "") | F.col("text").isNotNull())
    best = F.coalesce(nullif(squash(F.col("vtext"))), nullif(js_trim(F.col("text"))))
    return texts_at_hand(found, nodes, {**PLAIN, **SEEN}, enough, best, "value")


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name.lower()))


def attr_rows(found: DataFrame) -> DataFrame:
    """One row per attribute."""
    return found.select(*KEY, F.explode("attrs").alias("name", "value"))


def _cut(source: str, a: Column, b: Column) -> Column:
    return F.decode(F.substring(F.col(source), a + 1, b - a), "UTF-8")


def with_html(found: DataFrame, pages: DataFrame, inner: bool = True, both: bool = False) -> DataFrame:
    """Add ``value`` = source text of the element (B15); with ``both``, ``inner_html`` and ``outer_html``.

    ``found`` must carry the o/i offsets.

    Elements are gathered per page, so the page source is moved once per page
    and cut by byte offsets, whatever the number of elements.
    """
    cuts = {"inner_html": ("i0", "i1"), "outer_html": ("o0", "o1")} if both else {"value": ("i0", "i1") if inner else ("o0", "o1")}
    rest = [c for c in found.columns if c != "page_id" and c not in HTML_SPAN]
    held = sorted({c for ab in cuts.values() for c in ab})
    spans = found.groupBy("page_id").agg(F.collect_list(F.struct(*rest, *held)).alias("_s"))
    src = pages.select("page_id", F.col("html").cast("binary").alias("_src"))
    cut = F.transform("_s", lambda e: F.struct(*[e[c].alias(c) for c in rest], *[_cut("_src", e[a], e[b]).alias(k) for k, (a, b) in cuts.items()]))
    return spans.join(src, "page_id").select("page_id", F.explode(cut).alias("_e")).select("page_id", "_e.*")


def extract_many(nodes: DataFrame, pages: DataFrame, wanted: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Every match of labelled selectors as (label, page_id, pos, value).

    wanted: label -> (selector, kind text|html|attribute, attribute name).
    Labels of one kind are read together, so plans grow with kinds, not labels.
    """
    by_kind: dict[str, dict[str, str]] = {}
    for label, (selector, kind, _) in wanted.items():
        by_kind.setdefault(kind, {})[label] = selector
    parts = []
    if group := by_kind.get("text"):
        parts.append(with_best_text(select_many(nodes, group, "text", "vtext"), nodes))
    if group := by_kind.get("html"):
        parts.append(with_html(select_many(nodes, group, *HTML_SPAN), pages))
    if group := by_kind.get("attribute"):
        value = F.coalesce(*[F.when(F.col("label") == k, attr(wanted[k][2])) for k in group])
        parts.append(select_many(nodes, group, "attrs").withColumn("value", value))
    out = None
    for p in parts:
        p = p.select("label", *KEY, "value")
        out = p if out is None else out.unionByName(p)
    pos = F.row_number().over(Window.partitionBy("page_id", "label").orderBy("pre")) - 1
    return out.select("label", "page_id", pos.alias("pos"), "value")


def extract_list(nodes: DataFrame, pages: DataFrame, selector: str, kind: str = "text", name: str = "href") -> DataFrame:
    """Every match of one selector as (page_id, pos, value), by text, html or attribute."""
    return extract_many(nodes, pages, {"": (selector, kind, name)}).drop("label")


def _chain(found: DataFrame, nodes: DataFrame, cols: list[str]) -> DataFrame:
    """Each element with itself and all its ancestors: (page_id, pre, up_pre, ...)."""
    up = elements(nodes).select("page_id", F.col("pre").alias("up_pre"), *cols)
    lines = found.select("page_id", "pre", F.explode(F.concat("anc", F.array("pre"))).alias("up_pre"))
    return lines.join(up, ["page_id", "up_pre"])


def element_xpath(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Absolute XPath of each element (B17). ``found`` must carry ``anc`` and ``id``."""
    part = F.concat("tag", F.when(F.col("type_cnt") > 1, F.format_string("[%d]", "type_pos")).otherwise(F.lit("")))
    parts = _chain(found, nodes, ["tag", "type_pos", "type_cnt"]).groupBy(*KEY).agg(
        F.collect_list(F.struct(F.col("up_pre").alias("at"), part.alias("text"))).alias("_p")
    )
    path = F.concat(F.lit("/"), ordered_text(F.col("_p"), "/"))
    own = F.when(F.col("id").isNotNull(), F.concat(F.lit('//*[@id="'), "id", F.lit('"]')))
    return found.select(*KEY, "id").join(parts, list(KEY)).select(*KEY, F.coalesce(own, path).alias("xpath"))


def sibling_position(nodes: DataFrame) -> DataFrame:
    """Position and count among same-tag siblings (W1, W2), by window."""
    w = Window.partitionBy("page_id", "parent", "tag")
    return elements(nodes).select(
        "page_id",
        "pre",
        "tag",
        F.row_number().over(w.orderBy("pre")).alias("type_pos"),
        F.count("*").over(w).alias("type_cnt"),
    )


def dom_context(
    nodes: DataFrame, root_tag: str = "body", max_depth: int | None = None, max_elements: int | None = None, text: bool = True, attrs: bool = True
) -> DataFrame:
    """Compact markup of each page (C1), down to ``max_depth`` and up to ``max_elements`` if given.

    Hidden elements are left out and not counted; script-like ones are left
    out but counted. After the element that reaches the cap, later text goes too.
    """
    roots = elements(nodes).filter((F.col("tag") == root_tag) & (F.col("type_pos") == 1)).groupBy("page_id").agg(
        F.min_by(F.struct("pre", "last", "depth"), "pre").alias("_root")
    )
    near = (
        nodes.filter(F.col("kind").isin("element", "text"))
        .select("page_id", "pre", "last", "depth", "kind", "tag", "attrs", "hidden", "anc", "text")
        .join(roots, "page_id")
        .filter(
            (F.col("pre") >= F.col("_root.pre"))
            & (F.col("pre") <= F.col("_root.last"))
            & (F.lit(True) if max_depth is None else F.col("depth") - F.col("_root.depth") <= max_depth)
            & ~F.col("hidden")
        )
    )
    order = Window.partitionBy("page_id").orderBy("pre")
    skipped = F.coalesce(F.col("tag").isin(*CONTEXT_SKIPPED), F.lit(False))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside_skipped = F.coalesce(F.max(F.when(skipped, F.col("last"))).over(before) >= F.col("pre"), F.lit(False))
    counted = (F.col("kind") == "element").cast("int")
    near = near.withColumn("_skip", skipped).withColumn("_under", inside_skipped).filter(~F.col("_under"))
    near = near.withColumn("_seen", F.coalesce(F.sum(counted).over(before), F.lit(0)))
    kept = near.filter(~F.col("_skip") if max_elements is None else (F.col("_seen") < max_elements) & ~F.col("_skip"))
    shown = F.filter(F.map_entries("attrs"), lambda e: e["key"].isin(*CONTEXT_ATTRS))
    attr_text = F.array_join(F.transform(shown, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), e["value"], F.lit('"'))), "")
    opening = F.concat(F.lit("<"), "tag", attr_text if attrs else F.lit(""), F.lit(">"))
    closing = F.concat(F.lit("</"), "tag", F.lit(">"))
    body = js_trim(F.col("text")) if text else F.lit("")
    # an element opens at (pre, 0) and closes after its last node: inner elements close first
    events = F.when(
        F.col("kind") == "element",
        F.array(
            F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("rank"), opening.alias("text")),
            F.struct(F.col("last").alias("at"), F.lit(1).alias("side"), (-F.col("depth")).alias("rank"), closing.alias("text")),
        ),
    ).otherwise(F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("rank"), body.alias("text"))))
    return (
        kept.select("page_id", F.explode(events).alias("e"))
        .groupBy("page_id")
        .agg(ordered_text(F.collect_list("e"), "").alias("context"))
    )


def main_content_text(nodes: DataFrame) -> DataFrame:
    """Text of the richest content area without noise subtrees.

    Areas are ``main``/``article`` elements, else the body; the one with the
    most clean text wins, the earliest on a tie.
    """
    noise = F.coalesce(F.col("tag").isin(*NOISE_TAGS), F.lit(False)) | F.coalesce(
        F.arrays_overlap("classes", F.array(*[F.lit(c) for c in NOISE_CLASSES])), F.lit(False)
    )
    before = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = nodes.filter(F.col("kind").isin("element", "text")).select(
        "page_id", "pre", "last", "kind", "tag", "anc", "text", noise.alias("_noise"), "hidden", "faded"
    )
    marked = marked.withColumn("_dirty", F.coalesce(F.max(F.when(F.col("_noise"), F.col("last"))).over(before) >= F.col("pre"), F.lit(False)))
    clean = marked.filter(~F.col("_dirty") & ~F.col("hidden") & ~F.col("faded"))
    areas = clean.filter(F.col("tag").isin("main", "article", "body")).select(
        "page_id", F.col("pre").alias("area"), (F.col("tag") != "body").alias("special")
    )
    texts = clean.filter((F.col("kind") == "text") & (js_trim(F.col("text")) != "")).select(
        "page_id", "pre", "text", F.explode("anc").alias("area")
    )
    per_area = (
        texts.join(areas, ["page_id", "area"])
        .groupBy("page_id", "area", "special")
        .agg(
            F.sum(F.length(squash(F.col("text")))).alias("n_chars"),
            ordered_text(F.collect_list(F.struct(F.col("pre").alias("at"), js_trim(F.col("text")).alias("text"))), " ").alias("content"),
        )
    )
    best = per_area.groupBy("page_id").agg(
        F.max_by(F.struct("content", "n_chars"), F.struct("special", "n_chars", -F.col("area"))).alias("_b")
    )
    return best.select("page_id", squash(F.col("_b.content")).alias("content"), F.col("_b.n_chars").alias("n_chars"))


def relevant_html(
    pages: DataFrame, nodes: DataFrame, found: DataFrame, container: DataFrame | None = None, cap: int | None = None, limit: int | None = None
) -> DataFrame:
    """HTML around the matches for a prompt.

    Parents' outer HTML of the matches (the first ``cap``, and cut to ``limit``
    characters, if given), repeated when shared;
    pages without a match use the container element, else the body.
    ``found`` must carry ``parent``.
    """
    spans = elements(nodes).select("page_id", "pre", *HTML_SPAN, "tag")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))
    first = found.select("page_id", "pre", "parent").withColumn("rank", rank)
    first = first if cap is None else first.filter(F.col("rank") <= cap)
    parents = first.select("page_id", "rank", F.col("parent").alias("pre")).join(spans, list(KEY)).select("page_id", "rank", "o0", "o1")
    bodies = spans.filter(F.col("tag") == "body").select("page_id", "pre", "o0", "o1")
    boxes = bodies
    if container is not None:
        held = container.groupBy("page_id").agg(F.min("pre").alias("pre")).join(spans, list(KEY)).select("page_id", "pre", "o0", "o1")
        boxes = held.unionByName(bodies.join(held, "page_id", "left_anti"))
    boxes = boxes.join(parents.select("page_id"), "page_id", "left_anti").select("page_id", F.lit(1).alias("rank"), "o0", "o1")
    pieces = parents.unionByName(boxes).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "o0", "o1"))).alias("_s"))
    text = F.array_join(F.transform("_s", lambda s: _cut("_src", s["o0"], s["o1"])), "\n")
    return pieces.join(pages.select("page_id", F.col("html").cast("binary").alias("_src")), "page_id").select(
        "page_id", (text if limit is None else truncated(text, limit, "<!-- HTML truncated for size limits -->")).alias("html")
    )
