"""Pages rendered from relational rows, for jobs that have no crawl at hand.

A page holds a fixed range of a unique key, so its size is bounded by
construction however skewed the other columns are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scalars import ordered_text


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _page(rows: DataFrame, key: str, per_page: int, piece: Column, head: Column | str, tail: str, url: str) -> DataFrame:
    page = F.floor(F.col(key) / per_page).cast("long")
    head = F.lit(head) if isinstance(head, str) else head
    return (
        rows.select(page.alias("page_id"), F.struct(F.col(key).alias("at"), piece.alias("text")).alias("_p"))
        .groupBy("page_id")
        .agg(ordered_text(F.collect_list("_p"), "").alias("_body"))
        .select("page_id", F.format_string(url, "page_id").alias("url"), F.concat(head, "_body", F.lit(tail)).alias("html"))
    )


def card_pages(part: DataFrame, per_page: int = 20) -> DataFrame:
    """Product-grid pages: one ``li.card`` per part."""
    price = F.concat(F.lit("$"), F.format_number("p_retailprice", 2))
    piece = F.concat(
        F.lit('<li class="card item" data-key="'), F.col("p_partkey").cast("string"), F.lit('"><h2 class="name"> '),
        escape_html(F.col("p_name")), F.lit(' </h2><span class="price">'), price, F.lit('</span><a href="/part/'),
        F.col("p_partkey").cast("string"), F.lit('">more<br></a><p class="brand">'), escape_html(F.col("p_brand")),
        F.lit('<img src="/img/'), F.col("p_partkey").cast("string"), F.lit('.png">'),
    )
    head = F.concat(F.lit("<title>Parts</title><h1>Grid</h1><ul class=grid>"))
    return _page(part, "p_partkey", per_page, piece, head, '</ul><a class="next" href="?page=2">Next</a>', "http://shop.example.com/grid/%d")


def table_pages(orders: DataFrame, per_page: int = 25, header: bool = True) -> DataFrame:
    """Order pages: one ``tr`` per order, end tags left out."""
    def cell(c: Column) -> Column:
        return F.concat(F.lit("<td> "), c, F.lit("\n"))

    piece = F.concat(
        F.lit("<tr>"), cell(F.col("o_orderkey").cast("string")), cell(F.col("o_orderpriority")),
        cell(F.format_number("o_totalprice", 2)), cell(F.date_format("o_orderdate", "MM/dd/yyyy")),
    )
    head = "<table><tr><th>key<th>priority<th>total<th>date" if header else "<table><tr>"
    return _page(orders, "o_orderkey", per_page, piece, head, "</table>", "http://shop.example.com/orders/%d")
