"""Queries over what is learned from the data: sketches, URL templates, schemas, precision."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from gleanery.checks.base import SQL_HOST, card_nodes, cards, long, pages, query, table
from gleanery.functions.scalars import url_host
from gleanery.operators import batch, cache, recover, sketches
from gleanery.operators.selectors import select_css, select_xpath
from gleanery.session import scratch


@query(
    "field_outliers_robust",
    """SELECT l_returnflag, count(*) AS n, sum((l_orderkey % 50 = 7)::INT)::BIGINT AS n_outliers, true AS close FROM lineitem GROUP BY 1""",
)
def field_outliers_robust(spark, sf):
    """Planted outliers by quartile fences, and quartiles within their bound of the exact ranks."""
    planted = F.when(F.col("l_orderkey") % 50 == 7, F.col("l_extendedprice") * 1000).otherwise(F.col("l_extendedprice"))
    values = table(spark, sf, "lineitem").select("l_returnflag", planted.alias("price"))
    scored = sketches.robust_outliers(values, ["l_returnflag"], "price")
    # sketches of a part of the rows each, merged
    parts = sketches.value_sketches(values.withColumn("part", F.pmod(F.hash("price"), F.lit(7))), ["l_returnflag", "part"], "price")
    q = sketches.quantiles(sketches.merged_values(parts, ["l_returnflag"])).select("l_returnflag", "quantiles")
    ranks = [F.abs(F.count_if(F.col("price") <= F.element_at("quantiles", i + 1)) / F.count("*") - p) < 0.02 for i, p in enumerate(sketches.QUARTILES)]
    close = ranks[0] & ranks[1] & ranks[2]
    return scored.join(q, "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("n_outliers"), close.alias("close"))


@query(
    "run_overlap",
    f"""WITH u AS (SELECT {SQL_HOST} AS host, url, bool_or(page_id % 3 > 0) AS a, bool_or(page_id % 5 > 0) AS b FROM pages GROUP BY 1, 2)
        SELECT host, count_if(a)::BIGINT AS n_old, count_if(b)::BIGINT AS n_new, count_if(a AND b)::BIGINT AS kept, count_if(b AND NOT a)::BIGINT AS added, count_if(a AND NOT b)::BIGINT AS removed FROM u WHERE a OR b GROUP BY 1""",
)
def run_overlap(spark, sf):
    """New and gone URLs of two crawls from their stored sketches."""
    pg = pages(spark, sf).withColumn("host", url_host(F.col("url")))
    runs = [sketches.set_sketches(pg.filter(f"page_id % {m} > 0").withColumn("run", F.lit(n)), ["run", "host"], "url") for n, m in ((1, 3), (2, 5))]
    return sketches.run_overlap(runs[0].unionByName(runs[1]), "run", 1, 2, ["host"])


SQL_ORDER_URL = "'/' || ['en', 'de', 'fr'][o_orderkey % 3 + 1] || CASE WHEN o_orderkey % 4 = 0 THEN '/about' ELSE '/orders/' || strftime(o_orderdate, '%Y-%m-%d') || '/order-no-' || o_orderkey END"


@query(
    "url_templates",
    f"""WITH u AS (SELECT {SQL_ORDER_URL} AS path, o_orderkey FROM orders)
        SELECT CASE WHEN contains(path, 'about') THEN path ELSE left(path, 4) || 'orders/' || '{{date}}/{{text}}' END AS template, count(*) AS n_pages, count(DISTINCT path) AS n_paths FROM u GROUP BY 1""",
)
def url_templates(spark, sf):
    """Templates of URLs with language codes, sections, dates and slugs."""
    key, lang = F.col("o_orderkey"), F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    page = F.when(key % 4 == 0, F.lit("/about")).otherwise(F.concat(F.lit("/orders/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/order-no-"), key.cast("string")))
    urls = table(spark, sf, "orders").select(F.concat(F.lit("https://shop.example.com/"), lang, page, F.lit("?x=1")).alias("url"))
    return batch.url_templates(urls).groupBy("template").agg(F.sum("n_pages").alias("n_pages"), F.count("*").alias("n_paths"))


@query(
    "response_schema",
    """SELECT p_brand AS provider, count(*) AS n, count_if(p_partkey % 5 > 0)::BIGINT AS n_json,
         'OBJECT<items: ARRAY<OBJECT<name: STRING, size: ' || CASE WHEN count_if(p_partkey % 5 > 0 AND p_partkey % 7 = 0) = 0 THEN 'BIGINT' WHEN count_if(p_partkey % 5 > 0 AND p_partkey % 7 > 0) = 0 THEN 'STRING' ELSE 'VARIANT' END || '>>, total: DECIMAL(3,1)>' AS schema FROM part GROUP BY 1""",
)
def response_schema(spark, sf):
    """Merged shape of JSON answers; every fifth answer is cut off, and some give a size as text."""
    p = table(spark, sf, "part")
    size = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit('"'), "p_size", F.lit('"'))).otherwise(F.col("p_size").cast("string"))
    text = F.concat(F.lit('{"items": [{"name": "x", "size": '), size, F.lit('}], "total": 12.5'), F.when(F.col("p_partkey") % 5 > 0, F.lit("}")).otherwise(F.lit("")))
    return sketches.response_schemas(p.select(F.col("p_brand").alias("provider"), text.alias("text")), ["provider"])


@query(
    "selector_precision",
    """SELECT 'h2, p' AS selector, 2 * count(*) AS n_found, count(*) AS n_wanted, count(*) AS n_right, 0.5::DOUBLE AS precision, 1.0::DOUBLE AS recall FROM part
       UNION ALL SELECT 'li:first-child h2', count(DISTINCT p_partkey // 20), count(*), count(DISTINCT p_partkey // 20), 1.0, round(count(DISTINCT p_partkey // 20) / count(*), 4) FROM part""",
)
def selector_precision(spark, sf):
    """How much of what selectors find is meant, and the reverse."""
    ns = card_nodes(spark, sf)
    tried = ("h2, p", "li:first-child h2")
    found, wanted = None, select_css(ns, "h2.name")
    for s in tried:
        part = select_css(ns, s).withColumn("selector", F.lit(s))
        found = part if found is None else found.unionByName(part)
    wanted = wanted.withColumn("selector", F.explode(F.array(*map(F.lit, tried))))
    return recover.selector_precision(found, wanted, "selector")


@query("next_page_by_text", "SELECT DISTINCT p_partkey // 20 AS page_id, '?page=2' AS href, 'http://shop.example.com/grid/' || p_partkey // 20 || '?page=2' AS next_url FROM part")
def next_page_by_text(spark, sf):
    """Next-page links by what they say (M5)."""
    return batch.next_page_links(cards(spark, sf), card_nodes(spark, sf))


@query("css_child_join", "SELECT p_partkey // 20 AS page_id, count(*) AS n FROM part GROUP BY 1")
def css_child_join(spark, sf):
    """A parent with a class: the step is an equi join."""
    return select_css(card_nodes(spark, sf), "ul.grid > li.card > h2.name").groupBy("page_id").agg(F.count("*").alias("n"))


@query("css_descendant_window", "SELECT p_partkey // 20 AS page_id, 2 * count(*) AS n FROM part GROUP BY 1")
def css_descendant_window(spark, sf):
    """Ancestors with classes and attributes: the steps are a window over intervals."""
    ns = card_nodes(spark, sf)
    a = select_css(ns, "ul.grid li[data-key] .name")
    return a.unionByName(select_xpath(ns, "//ul[@class='grid']//li[@data-key]//img")).groupBy("page_id").agg(long(F.count("*")).alias("n"))


@query(
    "prompt_cache_rounds",
    """WITH p AS (SELECT conv_id * 1000 + turn AS prompt_id, text, role, conv_id % 2 = 0 AS early FROM conversations), k AS (SELECT *, bool_or(early) OVER (PARTITION BY text, role) AS known FROM p)
       SELECT 1::BIGINT AS round, prompt_id, 'answer ' || length(text) AS text, false AS from_cache FROM k WHERE early UNION ALL SELECT 2, prompt_id, 'answer ' || length(text), known FROM k""",
)
def prompt_cache_rounds(spark, sf):
    """Two runs over one cache: the second asks only what the first did not."""
    c = table(spark, sf, "conversations")
    asks = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), "conv_id", F.col("text").alias("prompt"), F.lit("m").alias("model"), F.col("role").alias("system"))
    path, out = scratch(spark, "prompt-cache"), None
    for n, part in ((1, asks.filter("conv_id % 2 = 0")), (2, asks)):
        # each round opens the folder under a name of its own, as another application would
        store = cache.PromptCache(spark, f"prompt_cache_{os.path.basename(path).replace('-', '_')}_{n}", path, 8)
        got = store.answers(part, lambda b: b.assign(text="answer " + b["prompt"].str.len().astype("string"))[["cache_key", "text"]])
        got = got.select(F.lit(n).cast("long").alias("round"), "prompt_id", "text", "from_cache")
        out = got if out is None else out.unionByName(got)
    return out


@query(
    "selector_history",
    """WITH v AS (SELECT p_partkey AS id, p_partkey // 10 AS chain, p_partkey % 10 AS step, p_size % 2 = 0 AS robust FROM part), t AS (SELECT chain, max(step) AS n FROM v GROUP BY chain)
       SELECT 'f' || v.chain AS field, '.s' || id AS selector, '.s' || 10 * v.chain AS first_selector, n AS n_improved, robust AS is_robust FROM v JOIN t ON v.chain = t.chain AND step = n""",
)
def selector_history(spark, sf):
    """Chains of up to ten improved selectors, some of them asked to be robust."""
    key = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        key.alias("selector_id"), F.format_string("f%d", F.floor(key / 10)).alias("field"), F.format_string(".s%d", key).alias("selector"),
        F.when(key % 10 > 0, key - 1).alias("improved_from"), (F.col("p_size") % 2 == 0).alias("is_robust"),
    )
    return batch.selector_history(rows)
