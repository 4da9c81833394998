"""Selection, text, attribute, table and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.checks.base import SQL_LINKS, long, nodes, order_nodes, pages, query, sql_encode, sql_plain, sql_trim, sql_unescape, table
from gleanery.functions.scalars import resolve_url
from gleanery.operators import batch, dom, paths, recover, tables
from gleanery.operators import selectors as sel
from gleanery.operators.prompts import CUT, bounded
from gleanery.sources.nodes import elements

SQL_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
SQL_LANG_DE = "html LIKE '<!DOCTYPE html><html lang=\"de\">%'"
SQL_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1)"
SQL_N = "len(regexp_extract_all(html, '{}'))::BIGINT"


def pos_of(df):
    from pyspark.sql import Window

    return df.withColumn("pos", long(F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))))


@query("nav_links", f"WITH {SQL_LINKS} SELECT page_id, pos, txt AS link_text, href, {sql_encode(SQL_ORIGIN + ' || href')} AS abs_url FROM links")
def nav_links(spark, sf):
    ns = nodes(spark, sf)
    links = dom.with_text(sel.select_css(ns, "nav ul li a", "attrs", "text"), ns)
    links = pos_of(links).join(pages(spark, sf).select("page_id", "url"), "page_id")
    href = dom.attr("href")
    return links.select(
        "page_id", "pos", F.col("value").alias("link_text"), href.alias("href"), resolve_url(href, F.col("url")).alias("abs_url")
    )


@query("node_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def node_tag_counts(spark, sf):
    return elements(nodes(spark, sf)).groupBy("tag").agg(F.count("*").alias("n"))


@query("css_select_all", f"WITH {SQL_LINKS} SELECT page_id, pos, href FROM links")
def css_select_all(spark, sf):
    found = pos_of(sel.select_css(nodes(spark, sf), "nav > ul li a[href^='/']", "attrs"))
    return found.select("page_id", "pos", dom.attr("href").alias("href"))


@query("css_select_first", f"WITH {SQL_LINKS} SELECT page_id, href FROM links WHERE pos = 1")
def css_select_first(spark, sf):
    found = sel.first_per_page(sel.select_css(nodes(spark, sf), "ul a", "attrs"))
    return found.select("page_id", dom.attr("href").alias("href"))


@query(
    "css_select_scoped",
    """SELECT page_id, pos, count(*) AS n FROM (SELECT page_id, generate_subscripts(l, 1) AS pos, unnest(l) AS x
       FROM (SELECT page_id, regexp_extract_all(html, '<li>') AS l FROM pages)) GROUP BY page_id, pos""",
)
def css_select_scoped(spark, sf):
    ns = nodes(spark, sf)
    boxes = pos_of(sel.select_css(ns, "li"))
    hits = sel.within(sel.select_css(ns, "nav li a", "anc"), boxes, "pos")
    return hits.groupBy("page_id", "pos").agg(F.count("*").alias("n"))


@query("css_child", f"SELECT page_id, {SQL_N.format('<p><b>')} AS n FROM pages WHERE html LIKE '%<p><b>%'")
def css_child(spark, sf):
    return sel.select_css(nodes(spark, sf), "article > p > b").groupBy("page_id").agg(F.count("*").alias("n"))


@query("css_descendant", f"SELECT page_id, {SQL_N.format('<p>')} AS n FROM pages WHERE html LIKE '%<p>%'")
def css_descendant(spark, sf):
    return sel.select_css(nodes(spark, sf), "html article p").groupBy("page_id").agg(F.count("*").alias("n"))


@query("css_siblings", f"WITH {SQL_LINKS} SELECT page_id, sum((pos = 2)::INT)::BIGINT AS n_next, sum((pos > 1)::INT)::BIGINT AS n_later FROM links GROUP BY page_id")
def css_siblings(spark, sf):
    ns = nodes(spark, sf)
    near = sel.select_css(ns, "li:first-child + li").groupBy("page_id").agg(F.count("*").alias("n_next"))
    far = sel.select_css(ns, "li:nth-child(1) ~ li").groupBy("page_id").agg(F.count("*").alias("n_later"))
    return near.join(far, "page_id")


@query("css_union", f"SELECT page_id, 1 + {SQL_N.format('<li>')} AS n FROM pages")
def css_union(spark, sf):
    return sel.select_css(nodes(spark, sf), "h1, nav li, article > h1, li:first-child").groupBy("page_id").agg(F.count("*").alias("n"))


@query("xpath_select_all", f"WITH {SQL_LINKS} SELECT page_id, href FROM links WHERE pos = 2")
def xpath_select_all(spark, sf):
    return sel.select_xpath(nodes(spark, sf), "/html/body/nav/ul/li[2]/a/@href").select("page_id", F.col("value").alias("href"))


@query(
    "xpath_first_preview",
    """SELECT page_id, h <> '' AS found, CASE WHEN h <> '' THEN left(h, 200) || '...' END AS preview
       FROM (SELECT page_id, regexp_extract(html, '(?s)<div class="ad">.*?</div>') AS h FROM pages)""",
)
def xpath_first_preview(spark, sf):
    pg = pages(spark, sf)
    found = sel.first_per_page(sel.select_xpath(nodes(spark, sf), "//div[@class='ad']", *dom.HTML_SPAN))
    html = dom.with_html(found, pg, inner=False)
    out = pg.select("page_id").join(html.select("page_id", "value"), "page_id", "left")
    return out.select("page_id", F.col("value").isNotNull().alias("found"), F.concat(F.substring("value", 1, 200), F.lit("...")).alias("preview"))


TESTED = ["li", "p > b", "div.ad", ".missing", "##bad", "//footer", "a:nth-child(1)"]


def sql_counts() -> str:
    n = {"li": SQL_N.format("<li>"), "p > b": SQL_N.format("<p><b>"), "div.ad": SQL_N.format('<div class="ad">'), ".missing": "0", "##bad": "0",
         "//footer": SQL_N.format("<footer>"), "a:nth-child(1)": SQL_N.format("<a ")}
    parts = [f"SELECT page_id, '{s}' AS selector, {x}::BIGINT AS n, {s != '##bad'} AS valid FROM pages" for s, x in n.items()]
    return " UNION ALL ".join(parts)


@query("selector_match_count", sql_counts())
def selector_match_count(spark, sf):
    return sel.match_counts(pages(spark, sf), nodes(spark, sf), TESTED)


@query("selector_works", f"SELECT page_id, selector, n > 0 AS works FROM ({sql_counts()})")
def selector_works(spark, sf):
    return sel.match_counts(pages(spark, sf), nodes(spark, sf), TESTED).select("page_id", "selector", (F.col("n") > 0).alias("works"))


@query("selector_unique", f"SELECT selector, sum((n = 1)::INT)::BIGINT AS n_unique FROM ({sql_counts()}) GROUP BY selector")
def selector_unique(spark, sf):
    counts = sel.match_counts(pages(spark, sf), nodes(spark, sf), TESTED)
    return counts.groupBy("selector").agg(F.count_if(F.col("n") == 1).alias("n_unique"))


@query(
    "css_then_xpath",
    f"""SELECT page_id, CASE WHEN {SQL_LANG_DE} THEN 'css' ELSE 'xpath' END AS selector_type, CASE WHEN {SQL_LANG_DE} THEN 'h1' ELSE 'title' END AS tag FROM pages""",
)
def css_then_xpath(spark, sf):
    return sel.css_then_xpath(nodes(spark, sf), "html[lang='de'] h1", "//head/title", "tag").select("page_id", "selector_type", "tag")


@query(
    "element_text",
    f"""SELECT page_id, {sql_trim(sql_unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
               {sql_trim(sql_unescape("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS h1 FROM pages""",
)
def element_text(spark, sf):
    ns = nodes(spark, sf)
    both = dom.with_text(sel.select_css(ns, "title, h1", "tag", "text"), ns)
    return both.groupBy("page_id").agg(*[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in ("title", "h1")])


SQL_BODY = "regexp_extract(html, '(?s)<body>(.*)', 1)"


@query("visible_text", f"SELECT page_id, {sql_plain(SQL_BODY)} AS visible FROM pages")
def visible_text(spark, sf):
    ns = nodes(spark, sf)
    return dom.with_visible_text(sel.select_css(ns, "body", "vtext"), ns).select("page_id", "visible")


@query(
    "text_prefer_visible",
    f"""SELECT page_id, 'style' AS tag, 'p{{margin:0}}' AS value FROM pages UNION ALL SELECT page_id, 'br', NULL FROM pages WHERE html LIKE '%<br>%'
        UNION ALL SELECT page_id, 'footer', {sql_plain("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")} FROM pages WHERE html LIKE '%</footer>%'""",
)
def text_prefer_visible(spark, sf):
    ns = nodes(spark, sf)
    found = sel.select_css(ns, "style, footer, br", "tag", "text", "vtext")
    return dom.with_best_text(found, ns).select("page_id", "tag", "value").distinct()


@query("attr_value", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, CAST(NULL AS VARCHAR) AS dir FROM pages")
def attr_value(spark, sf):
    return sel.select_css(nodes(spark, sf), "html", "attrs").select("page_id", dom.attr("lang").alias("lang"), dom.attr("DIR").alias("dir"))


@query(
    "attr_map",
    f"""WITH {SQL_LINKS} SELECT page_id, 'href' AS name, href AS value FROM links UNION ALL SELECT page_id, 'charset', 'utf-8' FROM pages
        UNION ALL SELECT page_id, 'class', 'ad' FROM pages UNION ALL SELECT page_id, 'lang', regexp_extract(html, '<html lang="([a-z]+)"', 1) FROM pages""",
)
def attr_map(spark, sf):
    return dom.attr_rows(sel.select_css(nodes(spark, sf), "*", "attrs")).select("page_id", "name", "value")


@query(
    "inner_html",
    """SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS inner_html, regexp_extract(html, '(?s)<nav>.*?</nav>') AS outer_html FROM pages""",
)
def inner_html(spark, sf):
    pg, found = pages(spark, sf), sel.select_css(nodes(spark, sf), "nav", *dom.HTML_SPAN)
    return dom.with_html(found, pg, both=True).select("page_id", "inner_html", "outer_html")


@query("extract_links", f"WITH {SQL_LINKS} SELECT page_id, (pos - 1)::BIGINT AS pos, href AS value FROM links")
def extract_links(spark, sf):
    return dom.extract_list(nodes(spark, sf), pages(spark, sf), "a[href]", "attribute").select("page_id", long("pos").alias("pos"), "value")


@query("element_xpath", f"WITH {SQL_LINKS} SELECT page_id, '/html/body/nav/ul/li[' || pos || ']/a' AS xpath FROM links")
def element_xpath(spark, sf):
    ns = nodes(spark, sf)
    return dom.element_xpath(sel.select_css(ns, "li a", "id", "anc"), ns).select("page_id", "xpath")


@query(
    "element_selector",
    f"""WITH {SQL_LINKS} SELECT page_id, 'li:nth-of-type(' || pos || ')' AS selector, 1::BIGINT AS n_matches FROM links
        UNION ALL SELECT page_id, 'li:nth-of-type(' || pos || ') > a', 1 FROM links UNION ALL SELECT page_id, 'div.ad', 1 FROM pages""",
)
def element_selector(spark, sf):
    ns = nodes(spark, sf)
    return paths.element_selectors(sel.select_css(ns, "li, li > a, div", "id", "anc"), ns).select("page_id", "selector", "n_matches")


@query("sibling_position", f"WITH {SQL_LINKS} SELECT page_id, pos, n_links::BIGINT AS cnt FROM links")
def sibling_position(spark, sf):
    at = dom.sibling_position(nodes(spark, sf)).filter(F.col("tag") == "li")
    return at.select("page_id", long("type_pos").alias("pos"), long("type_cnt").alias("cnt"))


@query("pages_with_match", f"SELECT page_id FROM pages WHERE {SQL_LANG_DE}")
def pages_with_match(spark, sf):
    return recover.pages_with_match(pages(spark, sf), nodes(spark, sf), "html[lang=de] li").select("page_id")


@query("css_not", f"WITH {SQL_LINKS} SELECT page_id, href FROM links WHERE pos > 1 AND pos < n_links")
def css_not(spark, sf):
    out = sel.select_css(nodes(spark, sf), "li:not(:first-child, :nth-last-child(1)) > a", "attrs")
    return out.select("page_id", F.try_element_at("attrs", F.lit("href")).alias("href"))


@query(
    "xpath_predicates",
    f"""WITH {SQL_LINKS} SELECT page_id, href FROM links WHERE contains(href, 'a') AND NOT contains({sql_unescape('txt')}, 'e')
        UNION SELECT page_id, href FROM links WHERE pos <= 2 AND NOT starts_with({sql_unescape('txt')}, 'e')""",
)
def xpath_predicates(spark, sf):
    path = "//a[contains(@href, 'a') and not(contains(., 'e'))] | //li[position() < 3]/a[not(starts-with(text(), 'e'))]"
    out = sel.select_xpath(nodes(spark, sf), path, "attrs")
    return out.select("page_id", F.try_element_at("attrs", F.lit("href")).alias("href")).distinct()


SQL_ORDER_ROWS = """
o AS (SELECT o_orderkey // 25 AS page_id, row_number() OVER (PARTITION BY o_orderkey // 25 ORDER BY o_orderkey) AS row_no, o_orderkey::VARCHAR AS key,
  o_orderpriority AS priority, format('{:,.2f}', o_totalprice) AS total, strftime(o_orderdate, '%m/%d/%Y') AS date FROM orders)"""


@query(
    "table_extract",
    f"WITH {SQL_ORDER_ROWS} SELECT page_id, row_no, col_name, value FROM o UNPIVOT (value FOR col_name IN (key, priority, total, date))",
)
def table_extract(spark, sf):
    return tables.table_rows(order_nodes(spark, sf)).select("page_id", long("row_no").alias("row_no"), "col_name", "value")


@query(
    "table_extract_noheader",
    f"""WITH {SQL_ORDER_ROWS}, c AS (SELECT page_id, row_no, key AS col0, priority AS col1, total AS col2, date AS col3 FROM o)
        SELECT page_id, row_no, col_name, value FROM c UNPIVOT (value FOR col_name IN (col0, col1, col2, col3))""",
)
def table_extract_noheader(spark, sf):
    return tables.table_rows(order_nodes(spark, sf, False)).select("page_id", long("row_no").alias("row_no"), "col_name", "value")


@query("main_content_text", f"SELECT page_id, {sql_plain(SQL_ARTICLE)} AS content FROM pages")
def main_content_text(spark, sf):
    return dom.main_content_text(nodes(spark, sf)).select("page_id", "content")


@query(
    "dom_context",
    f"""WITH a AS (SELECT page_id, {SQL_N.format('<li>')} AS n_li, {sql_trim(sql_unescape("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)"))} AS ad,
               regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, regexp_extract({SQL_ARTICLE}, '(?s)</h1>(.*)', 1) AS rest,
               html LIKE '%<footer>%' AS has_foot, regexp_extract(html, '(?s)<footer>(.*?)(?:</footer>|$)', 1) AS foot FROM pages),
        p AS (SELECT page_id, i, b, t, coalesce(sum(1 + b) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
               SELECT page_id, generate_subscripts(parts, 1) AS i, starts_with(unnest(parts), '<b>')::INT AS b,
                      {sql_trim(sql_unescape("regexp_replace(unnest(parts), '(?s)<[^>]*>', '', 'g')"))} AS t
               FROM (SELECT page_id, string_split(rest, '<p>')[2:] AS parts FROM a))),
        s AS (SELECT p.page_id, sum(1 + b) AS n_p, string_agg(CASE WHEN n_li + 6 + before < 100 THEN '<p>' || CASE WHEN n_li + 7 + before >= 100 THEN ''
                 WHEN b = 1 THEN '<b></b>' ELSE t END || '</p>' ELSE '' END, '' ORDER BY i) AS ps FROM p JOIN a USING (page_id) GROUP BY p.page_id)
        SELECT page_id, '<body><nav><ul>' || repeat('<li></li>', n_li) || '</ul></nav><div class="ad">' || ad || '</div><article><h1>'
          || {sql_trim(sql_unescape('h1'))} || '</h1>' || coalesce(ps, '') || '</article>' || CASE WHEN has_foot AND n_li + 6 + coalesce(n_p, 0) < 100
             THEN '<footer>' || CASE WHEN n_li + 7 + coalesce(n_p, 0) < 100 THEN {sql_trim(sql_unescape('foot'))} ELSE '' END || '</footer>' ELSE '' END || '</body>' AS context
        FROM a LEFT JOIN s USING (page_id)""",
)
def dom_context(spark, sf):
    return dom.dom_context(nodes(spark, sf), max_depth=3, max_elements=100)


@query(
    "truncate_html",
    """SELECT page_id, md5(CASE WHEN length(html) > 30000 THEN left(html, 30000) || chr(10) || '<!-- HTML truncated for size limits -->' ELSE html END) AS plan_md5,
        CASE WHEN length(html) > 10000 THEN left(html, 10000) || '...' ELSE html END AS recover_html, left(html, 100) AS feedback FROM pages""",
)
def truncate_html(spark, sf):
    h = F.col("html")
    return pages(spark, sf).select(
        "page_id", F.md5(bounded(h, 30_000, CUT)).alias("plan_md5"), bounded(h, 10_000, "...").alias("recover_html"), bounded(h, 100).alias("feedback")
    )


@query(
    "relevant_html",
    f"""SELECT page_id, CASE WHEN length(h) > 5000 THEN left(h, 5000) || '<!-- HTML truncated for size limits -->' ELSE h END AS html FROM (
          SELECT page_id, CASE WHEN {SQL_LANG_DE} THEN array_to_string([regexp_extract(html, '(?s)<ul>.*?</ul>') FOR x IN range({SQL_N.format('<li>')})], chr(10))
            ELSE regexp_extract(html, '(?s)<article>(?:.*?</article>|.*)') END AS h FROM pages)""",
)
def relevant_html(spark, sf):
    ns = nodes(spark, sf)
    hits = sel.select_css(ns, "html[lang='de'] nav li", "parent")
    return dom.relevant_html(pages(spark, sf), ns, hits, sel.select_css(ns, "article"), 100, 5000)


@query(
    "page_structure_groups",
    """WITH t AS (SELECT page_id, string_agg(tag, ' ' ORDER BY tag) AS tags, count(*) AS n_paths FROM (
         SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY page_id)
       SELECT n_paths, count(*) AS n_pages, min(page_id) AS first_page FROM t GROUP BY tags, n_paths""",
)
def page_structure_groups(spark, sf):
    """Groups by tag-path set; in the crawl's template each tag has one path, so SQL can group by tag set."""
    return batch.structure_groups(nodes(spark, sf)).select("n_paths", "n_pages", "first_page")


@query("page_near_groups", "SELECT page_id, (SELECT min(page_id) FROM pages) AS leader FROM pages")
def page_near_groups(spark, sf):
    """One template, hence one group of alike pages."""
    return batch.near_structure_groups(nodes(spark, sf))


@query(
    "next_page_links",
    f"WITH {SQL_LINKS} SELECT page_id, href, {sql_encode(SQL_ORIGIN + ' || href')} AS next_url FROM links WHERE pos = 3",
)
def next_page_links(spark, sf):
    return batch.next_page_links(pages(spark, sf), nodes(spark, sf), "li:nth-of-type(3) > a")
