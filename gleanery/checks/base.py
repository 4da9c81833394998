"""Registry of queries with their SQL counterparts, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import spread, staged, table
from gleanery.sources.nodes import parse_pages, scan_pages
from gleanery.sources.render import card_pages, table_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def heavy(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows cost much CPU each: uses all cores even when the file has few splits."""
    return spread(table(spark, sf, name))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Node table of the crawl, parsed once per application."""
    return staged(spark, f"nodes:{sf}", lambda: parse_pages(scan_pages(spark, sf)), ("kind",))


def cards(spark: SparkSession, sf: str, per_page: int = 20) -> DataFrame:
    return staged(spark, f"cards{per_page}:{sf}", lambda: card_pages(table(spark, sf, "part"), per_page))


def card_nodes(spark: SparkSession, sf: str, per_page: int = 20) -> DataFrame:
    return staged(spark, f"card_nodes{per_page}:{sf}", lambda: parse_pages(spread(cards(spark, sf, per_page), "page_id")), ("kind",))


def order_nodes(spark: SparkSession, sf: str, header: bool = True) -> DataFrame:
    drawn = staged(spark, f"orders{header}:{sf}", lambda: table_pages(table(spark, sf, "orders"), 25, header))
    made = lambda: parse_pages(spread(drawn, "page_id"))
    return staged(spark, f"order_nodes{header}:{sf}", made, ("kind",))


# --- SQL pieces shared by the counterparts ---

# White space of the page language, as an RE2 class.
SQL_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_unescape(x: str) -> str:
    for name, ch in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{ch}')"
    return x


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SQL_WS}+', ' ', 'g'))"


def sql_plain(x: str) -> str:
    """Markup without its tags, as squashed text."""
    return sql_squash(sql_unescape(f"regexp_replace({x}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"))


def sql_encode(x: str) -> str:
    return (
        f"array_to_string([CASE WHEN regexp_matches(ch, '[^!-~]|[\"<>`{{}}]') THEN url_encode(ch) ELSE ch END "
        f"FOR ch IN string_split({x}, '')], '')"
    )


SQL_LINKS = """
links AS (
  SELECT page_id, url, html, unnest(hrefs) AS href, unnest(texts) AS txt, generate_subscripts(hrefs, 1) AS pos, len(hrefs) AS n_links
  FROM (SELECT page_id, url, html, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
               regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages)
)"""
SQL_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
