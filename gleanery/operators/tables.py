"""HTML tables -> long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.scalars import js_trim
from gleanery.operators.dom import with_text
from gleanery.sources.nodes import elements

_TABLE = ["page_id", "table_pre"]
_HEAD = -1  # the row of a table's headers, which no element has


def _around(tag: str) -> Column:
    """``pre`` numbers of the ancestors with a tag: the tag path runs beside the ancestor list."""
    n = F.greatest(F.size("anc") - 1, F.lit(0))
    up, tags = F.slice("anc", 2, n), F.slice(F.split("path", "/"), 2, n)
    return F.array_compact(F.zip_with(up, tags, lambda pre, t: F.when(t == tag, pre)))


def _with_values(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``value``, the text of cells. The text nodes are read only if a cell is too long to hold its text itself."""
    cell = F.col("tag") != "tr"
    if items.filter(cell & F.col("text").isNull()).groupBy().count().first()[0] == 0:
        return items.withColumn("value", F.when(cell, js_trim(F.col("text")))).drop("text")
    rows = items.filter(~cell).withColumn("value", F.lit(None).cast("string")).drop("text")
    return with_text(items.filter(cell), nodes).unionByName(rows)


def _items(nodes: DataFrame) -> DataFrame:
    """Rows and cells with the table and rows around them; nested tables count for the outer one too.

    Intervals nest, so a cell is inside a first row if a first row before it ends after it.
    Pages without an id have no first rows.
    """
    items = elements(nodes).filter(F.col("tag").isin("tr", "th", "td")).select(
        "page_id", "pre", "last", "tag", "text", "sib_pos", _around("table").alias("tables"), _around("tr").alias("rows"),
        F.col("path").contains("/thead/").alias("in_thead"),
    )
    before = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when((F.col("tag") == "tr") & (F.col("sib_pos") == 1) & F.col("page_id").isNotNull(), F.col("last"))).over(before)
    facts = _with_values(items, nodes).withColumn("in_first", F.coalesce(reach >= F.col("pre"), F.lit(False)))
    return facts.drop("last", "sib_pos").withColumn("table_pre", F.explode("tables")).drop("tables")


def table_rows(nodes: DataFrame) -> DataFrame:
    """(page_id, table_pre, row_no, col_name, value, idx), one row per cell kept.

    Headers are all ``thead th`` and ``tr:first-child th``; without any, the
    ``td`` of first rows. The first ``tr`` is skipped when headers exist,
    cells beyond the headers drop out, a repeated header keeps its last cell.

    All is decided inside a page, so rows are dealt once, by page. A header is one
    more row of its table, numbered like the cells of a row, and names them by number.
    """
    table = Window.partitionBy(*_TABLE)
    th_head = (F.col("tag") == "th") & (F.col("in_thead") | F.col("in_first"))
    td_head = (F.col("tag") == "td") & F.col("in_first")
    marked = _items(nodes).withColumns(
        {
            "has_th": F.max(th_head).over(table),
            "has_td": F.max(td_head).over(table),
            "first_row": F.min(F.when(F.col("tag") == "tr", F.col("pre"))).over(table),
        }
    )
    marked = marked.withColumn("has_head", F.col("has_th") | F.col("has_td"))
    is_head = F.when(F.col("has_th"), th_head).otherwise(td_head)
    kept_row = lambda r: (r > F.col("table_pre")) & ~(F.col("has_head") & (r == F.col("first_row")))
    none = F.array().cast("array<int>")
    places = F.concat(F.when(is_head, F.array(F.lit(_HEAD))).otherwise(none), F.when(F.col("tag") == "td", F.filter("rows", kept_row)).otherwise(none))
    cells = marked.select(*_TABLE, "pre", "value", "has_head", F.explode(places).alias("row_pre"))
    in_row = Window.partitionBy(*_TABLE, "row_pre").orderBy("pre")
    cells = cells.withColumn("idx", F.row_number().over(in_row) - 1)
    known = (F.col("row_pre") == _HEAD) & F.col("page_id").isNotNull()
    head = F.max(F.when(known, F.col("value"))).over(Window.partitionBy(*_TABLE, "idx"))
    name = F.when(F.col("has_head"), head).otherwise(F.format_string("col%d", "idx"))
    cells = cells.withColumn("col_name", name).filter((F.col("row_pre") != _HEAD) & F.col("col_name").isNotNull())
    rows = cells.groupBy(*_TABLE, "row_pre", "col_name").agg(F.max_by("value", "idx").alias("value"), F.max("idx").alias("idx"))
    row_no = F.dense_rank().over(table.orderBy("row_pre"))
    return rows.select(*_TABLE, row_no.alias("row_no"), "col_name", "value", "idx")
