"""Text of elements: stored on the row where it is short, put together from text nodes where it is long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scalars import js_trim, ordered_text, squash
from gleanery.sources.nodes import elements, text_nodes

KEY = ["page_id", "pre"]


def _long_texts(keys: DataFrame, nodes: DataFrame, sources: dict[str, str]) -> DataFrame:
    """(page_id, pre, _text and/or _vtext) of elements too long to be kept on their own row.

    Text nodes find their selected ancestors by key alone; the text itself is
    moved only for pairs that are part of the answer.
    """
    texts = text_nodes(nodes)
    owned = texts.select("page_id", F.col("pre").alias("at"), F.explode("anc").alias("pre")).join(keys, KEY, "left_semi")
    body = texts.select("page_id", F.col("pre").alias("at"), *sources)
    folded = [
        ordered_text(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("text")))), sep).alias(f"_{c}")
        for c, sep in sources.items()
    ]
    return owned.join(body, ["page_id", "at"]).groupBy(*KEY).agg(*folded)


# text source -> what goes between the parts
PLAIN, SEEN = {"text": ""}, {"vtext": " "}


def texts_at_hand(found: DataFrame, nodes: DataFrame, sources: dict[str, str], enough: Column, value: Column, name: str) -> DataFrame:
    """Add ``name`` = ``value`` over the text columns; rows without ``enough`` text at hand get it from text nodes."""
    rest = found.filter(~enough)
    whole = rest.drop(*sources).join(_long_texts(rest.select(*KEY).distinct(), nodes, sources), KEY, "left")
    whole = whole.withColumnsRenamed({f"_{c}": c for c in sources})
    return found.filter(enough).unionByName(whole).withColumn(name, value).drop(*sources)


def with_text(found: DataFrame, nodes: DataFrame, trim: bool = True) -> DataFrame:
    """Add ``value`` = text content (B10). ``found`` must carry ``text``."""
    text = F.coalesce("text", F.lit(""))
    return texts_at_hand(found, nodes, PLAIN, F.col("text").isNotNull(), js_trim(text) if trim else text, "value")


def _compare(text: Column, op: str, value: str, squeezed: bool) -> Column:
    t = squash(text) if squeezed else text
    return t.contains(value) if op == "*=" else t.startswith(value) if op == "^=" else t == value


def elements_with(nodes: DataFrame, whole: bool, op: str, value: str, squeezed: bool, tag: str = "*") -> DataFrame:
    """(page_id, pre) of elements whose text passes a test.

    ``whole``: all text inside the element; else its own text nodes, of which
    the first counts for parts of a text and any for an equal one.
    """
    if whole:
        els = elements(nodes) if tag == "*" else elements(nodes).filter(F.col("tag") == tag)
        return with_text(els.select(*KEY, "text"), nodes, trim=False).filter(_compare(F.col("value"), op, value, squeezed)).select(*KEY)
    own = text_nodes(nodes).select("page_id", F.col("parent").alias("pre"), F.col("pre").alias("at"), "text")
    if op == "=" and not squeezed:
        return own.filter(F.col("text") == value).select(*KEY).distinct()
    first = own.groupBy(*KEY).agg(F.min_by("text", "at").alias("text"))
    return first.filter(_compare(F.col("text"), op, value, squeezed)).select(*KEY)
