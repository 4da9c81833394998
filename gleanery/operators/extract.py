"""Records from container elements, and the DOM-then-response order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.transforms import apply_transform
from gleanery.operators.dom import attr, with_text
from gleanery.operators.selectors import css_then_xpath, select_many, within
from gleanery.session import written

NO_MATCH = "No elements found using the provided selectors"
REC = ["page_id", "rec_pre"]


@dataclass(frozen=True)
class Field:
    """One output column: where to look inside the container and how to clean it."""

    name: str
    selector: str | None = None
    attribute: str | None = None
    transform: str | Callable[[Column], Column] | None = None


def containers(nodes: DataFrame, css: str | None, xpath: str | None = None, cap: int | None = None) -> DataFrame:
    """Record containers of each page, the first ``cap`` if given."""
    found = css_then_xpath(nodes, css, xpath, "text", "attrs")
    page = Window.partitionBy("page_id")
    ranked = found.withColumn("rec_no", F.row_number().over(page.orderBy("pre")))
    if cap is not None:
        ranked = ranked.filter(F.col("rec_no") <= cap)
    return ranked.withColumnRenamed("pre", "rec_pre")


def extract_records(nodes: DataFrame, recs: DataFrame, fields: list[Field], page_urls: DataFrame | None = None) -> DataFrame:
    """One row per container, one column per field (D1); a miss is NULL.

    All fields go through one long table: one containment join, one
    first-match aggregate and one fold over known names, however many fields
    there are. Containment joins on the ancestor list, so it is linear.
    """
    read = ("attrs", "text")
    recs = written(recs, "containers")  # read three times below
    hits = select_many(nodes, {f.name: f.selector for f in fields if f.selector}, "anc", *read)
    pairs = within(hits, recs.select("page_id", F.col("rec_pre").alias("pre"))).withColumnRenamed("ctx_pre", "rec_pre")
    first = F.min_by(F.struct("pre", *read), "pre")
    longs = pairs.groupBy(*REC, "label").agg(first.alias("_e")).select(*REC, "label", "_e.*")
    own = [f.name for f in fields if not f.selector]
    if own:
        here = recs.select(*REC, F.explode(F.array(*[F.lit(n) for n in own])).alias("label"), F.col("rec_pre").alias("pre"), *read)
        longs = longs.unionByName(here)
    longs = with_text(written(longs, "fields"), nodes)
    wide = longs.groupBy(*REC).agg(
        *[
            F.max(F.when(F.col("label") == f.name, attr(f.attribute) if f.attribute else F.col("value"))).alias(f.name)
            for f in fields
        ]
    )
    out = recs.select(*REC, "rec_no").join(wide, REC, "left")
    if page_urls is not None:
        out = out.join(page_urls.select("page_id", F.col("url").alias("_url")), "page_id")
    else:
        out = out.withColumn("_url", F.lit(None).cast("string"))
    cols = [apply_transform(F.col(f.name), f.transform, F.col("_url")).alias(f.name) for f in fields]
    return out.select(*REC, "rec_no", *cols)


def dom_extract(
    nodes: DataFrame,
    css: str | None,
    xpath: str | None,
    fields: list[Field],
    page_urls: DataFrame | None = None,
    cap: int | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Record extraction, of the first ``cap`` containers if given (D9), for all pages or the pages in ``only``.

    ``only`` restricts the containers, which are few and narrow, rather than
    the node table: the fields are joined to containers anyway.
    """
    recs = containers(nodes, css, xpath, cap)
    if only is not None:
        recs = recs.join(only.select("page_id"), "page_id", "left_semi")
    return extract_records(nodes, recs, fields, page_urls)


def extract_metadata(pages: DataFrame, nodes: DataFrame, css: str | None, xpath: str | None, cap: int | None = None) -> DataFrame:
    """Per page: found, extracted, what a cap cut, selectors, the one that matched, time, success, error."""
    found = css_then_xpath(nodes, css, xpath).groupBy("page_id").agg(
        F.count("*").alias("found"), F.first("selector_type").alias("selector_type")
    )
    n = F.coalesce("found", F.lit(0))
    return pages.select("page_id").join(found, "page_id", "left").select(
        "page_id",
        n.alias("found"),
        (n if cap is None else F.least(n, F.lit(cap))).alias("extracted"),
        (F.lit(0) if cap is None else F.greatest(n - cap, F.lit(0))).alias("cut"),
        F.lit(css).cast("string").alias("css_selector"),
        F.lit(xpath).cast("string").alias("xpath_selector"),
        F.current_timestamp().alias("run_ts"),
        "selector_type",
        (n > 0).alias("success"),
        F.when(n == 0, F.lit(NO_MATCH)).alias("error"),
    )


def dom_then_responses(dom: DataFrame, answered: DataFrame) -> DataFrame:
    """DOM records; on pages without any, records parsed from responses."""
    cheap = dom.withColumn("method", F.lit("dom"))
    costly = answered.join(dom.select("page_id").distinct(), "page_id", "left_anti").withColumn("method", F.lit("llm"))
    return cheap.unionByName(costly)


def scalar_or_list(raw: DataFrame, lists: list[str], fields: list[str] | None = None) -> DataFrame:
    """List fields keep all values, scalar fields the first.

    The plan is a short list of names, so it is a test on the row; fields
    outside ``fields`` drop out.
    """
    rows = raw if fields is None else raw.filter(F.col("dp_id").isin(fields))
    is_list = F.col("dp_id").isin(lists) if lists else F.lit(False)
    first = rows.filter(~is_list).groupBy("page_id", "dp_id").agg(F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    return rows.filter(is_list).select("page_id", "dp_id", "pos", "value").unionByName(first.select("page_id", "dp_id", "pos", "value"))
