"""Queries over plans, selectors and templates that are tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.checks.base import SQL_HOST, SQL_LINKS, card_nodes, cards, long, nodes, pages, query, table
from gleanery.functions.scalars import url_host
from gleanery.operators import batch, templates
from gleanery.operators.dom import with_text
from gleanery.operators.selector_table import matches_on
from gleanery.operators.selectors import select_many
from gleanery.plans import tables
from gleanery.session import scratch, written

# one plan for each group of card pages; group d has none
FIELDS = (
    ("a", "name", 0, "h2.name", "text", None, "string", True, ""),
    ("a", "price", 0, "span.price", "text", None, "number", True, "required"),
    ("b", "link", 0, "li.card > a", "attribute", "href", "url", True, "required"),
    ("b", "price", 0, ".price", "text", None, "number", False, None),
    ("b", "heading", 0, "h1", "text", None, "number", False, "Optional"),
    ("b", "gone", 0, ".gone", "text", None, "string", False, "must be there"),
    ("c", "brand", 0, ".nope", "text", None, "string", True, ""),
    ("c", "brand", 1, "//p[@class='brand']", "text", None, "string", True, ""),
    ("c", "price", 0, "li:nth-child(999) > .price", "text", None, "number", True, "required"),
    ("c", "broken", 0, "li[", "text", None, "string", True, "required"),
)
SQL_GRP = "CASE (p_partkey // 20) % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END"
SQL_PARTS = f"""p AS (SELECT p_partkey // 20 AS page_id, {SQL_GRP} AS grp, p_name, p_brand, round(p_retailprice, 2)::DOUBLE AS price, p_partkey,
  row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS pos FROM part)"""


def card_groups(pages):
    return pages.select("page_id", F.element_at(F.array(*map(F.lit, "abcd")), (F.col("page_id") % 4 + 1).cast("int")).alias("grp"))


def plan_rows(spark, rows=FIELDS):
    return spark.createDataFrame(list(rows), tables.PLAN_SCHEMA)


def planned_run(spark, sf):
    pg = cards(spark, sf)
    return tables.run_plans(pg, card_groups(pg), plan_rows(spark), nodes=card_nodes(spark, sf))


@query(
    "batch_plan_tables",
    f"""WITH {SQL_PARTS}
        SELECT page_id, 'name' AS dp_id, 'string' AS type, pos, trim(p_name) AS clean, NULL::DOUBLE AS num FROM p WHERE grp = 'a'
        UNION ALL SELECT page_id, 'price', 'number', pos, NULL, price FROM p WHERE grp IN ('a', 'c')
        UNION ALL SELECT page_id, 'link', 'url', pos, 'http://shop.example.com/part/' || p_partkey, NULL FROM p WHERE grp = 'b'
        UNION ALL SELECT page_id, 'price', 'number', 0, NULL, price FROM p WHERE grp = 'b' AND pos = 0
        UNION ALL SELECT page_id, 'heading', 'number', 0, 'Grid', NULL FROM p WHERE grp = 'b' AND pos = 0
        UNION ALL SELECT page_id, 'gone', 'string', 0, NULL, NULL FROM p WHERE grp = 'b' AND pos = 0
        UNION ALL SELECT page_id, 'brand', 'string', pos, p_brand, NULL FROM p WHERE grp = 'c'""",
)
def batch_plan_tables(spark, sf):
    """Clean values of the whole job where every group has fields, types and notes of its own; a failed selector is recovered."""
    v = planned_run(spark, sf).values
    clean = F.when((F.col("type") != "number") | F.col("num").isNull(), F.col("clean"))
    return v.select("page_id", "dp_id", "type", long("pos").alias("pos"), clean.alias("clean"), "num")


@query(
    "batch_plan_issues",
    f"""WITH {SQL_PARTS}, g AS (SELECT DISTINCT page_id, grp FROM p)
        SELECT page_id, c.dp_id, c.code, c.issue FROM g, (VALUES
          ('b', 'heading', 'number_unparsed', 'Type mismatch: Expected number, failed to parse from string "Grid".'),
          ('b', 'gone', 'no_match', 'No elements found using the provided selectors'), ('b', 'gone', 'required_item', 'Required item is missing or null.'),
          ('c', 'broken', 'no_match', 'Invalid selector'), ('c', 'broken', 'required_list', 'Required list is empty.'),
          ('d', NULL, 'no_plan', 'No plan for this group of pages')) c(grp, dp_id, code, issue) WHERE g.grp = c.grp""",
)
def batch_plan_issues(spark, sf):
    return planned_run(spark, sf).issues.select("page_id", "dp_id", "code", "issue")


@query(
    "batch_plan_selectors",
    f"""WITH {SQL_PARTS} SELECT s.grp, s.dp_id, s.selector, CASE WHEN s.recovered THEN 'li > .price' END AS recovered, CASE WHEN s.recovered THEN 'generalise' END AS strategy,
          CASE WHEN s.recovered THEN (SELECT count(DISTINCT page_id) FROM p WHERE grp = 'c') END AS n_pages
        FROM (VALUES {", ".join(f"('{f[0]}', '{f[1]}', '" + f[3].replace("'", "''") + f"', {str(f[:2] == ('c', 'price')).lower()})" for f in FIELDS if not f[2])}) s(grp, dp_id, selector, recovered)""",
)
def batch_plan_selectors(spark, sf):
    """Selectors used by each group's fields, and what stood in for them on how many pages."""
    return planned_run(spark, sf).selectors.select("grp", "dp_id", "selector", "recovered", "strategy", "n_pages")


@query(
    "batch_plan_summary",
    f"""WITH {SQL_PARTS} SELECT page_id, true AS success, CASE grp WHEN 'a' THEN 2 * count(*) WHEN 'b' THEN count(*) + 2 WHEN 'c' THEN 2 * count(*) ELSE 0 END AS n_values,
          CASE grp WHEN 'a' THEN 0 WHEN 'b' THEN 3 WHEN 'c' THEN 2 ELSE 1 END::BIGINT AS n_issues FROM p GROUP BY page_id, grp""",
)
def batch_plan_summary(spark, sf):
    """One row for each page, recovery inside the job."""
    return planned_run(spark, sf).summary


RECORD_PLANS = (("a", "li.card", None), ("b", ".none", "//li"), ("c", "h2.name", None))
RECORD_FIELDS = (
    ("a", "name", "h2", None, "trim"), ("a", "price", ".price", None, "number"), ("a", "gone", "video", None, None),
    ("b", "link", "a", "href", "url"), ("b", "brand", "p.brand", None, "lowercase"), ("b", "stocked", "img", "src", "boolean"), ("b", "key", None, "data-key", None),
    ("c", "text", None, None, "uppercase"),
)


@query(
    "batch_plan_records",
    f"""WITH {SQL_PARTS}, f AS (
          SELECT page_id, grp, pos, 'name' AS field, trim(p_name) AS value, NULL::DOUBLE AS num, NULL::BOOLEAN AS flag FROM p WHERE grp = 'a'
          UNION ALL SELECT page_id, grp, pos, 'price', NULL, price, NULL FROM p WHERE grp = 'a'
          UNION ALL SELECT page_id, grp, pos, 'gone', NULL, NULL, NULL FROM p WHERE grp = 'a'
          UNION ALL SELECT page_id, grp, pos, 'link', 'http://shop.example.com/part/' || p_partkey, NULL, NULL FROM p WHERE grp = 'b'
          UNION ALL SELECT page_id, grp, pos, 'brand', lower(p_brand), NULL, NULL FROM p WHERE grp = 'b'
          UNION ALL SELECT page_id, grp, pos, 'stocked', '/img/' || p_partkey || '.png', NULL, true FROM p WHERE grp = 'b'
          UNION ALL SELECT page_id, grp, pos, 'key', p_partkey::VARCHAR, NULL, NULL FROM p WHERE grp = 'b'
          UNION ALL SELECT page_id, grp, pos, 'text', upper(trim(p_name)), NULL, NULL FROM p WHERE grp = 'c')
        SELECT page_id, grp, 1 + pos AS rec_no, field, value, num, flag FROM f""",
)
def batch_plan_records(spark, sf):
    """Records of groups with containers and fields of their own."""
    pg = cards(spark, sf)
    plans = spark.createDataFrame(list(RECORD_PLANS), "grp string, css string, xpath string")
    fields = spark.createDataFrame(list(RECORD_FIELDS), "grp string, field string, selector string, attribute string, transform string")
    out, _ = batch.batch_records(card_nodes(spark, sf), card_groups(pg), plans, fields, pg)
    # the text of a price is not compared, only its number
    return out.select("page_id", "grp", long("rec_no").alias("rec_no"), "field", F.when(F.col("num").isNull(), F.col("value")).alias("value"), "num", "flag")


AXES = {
    "up": "//a[contains(@href, '/part/')]/../h2",
    "third": "(//li)[3]/h2",
    "second": "//li[@data-key][2]/span/preceding-sibling::h2",
    "two_on": "//li[position()<=4]/following-sibling::li[2]//h2",
    "before_last": "(//li[last()])[1]/preceding-sibling::li[1]/h2",
    "holder": "//h2/ancestor::ul[1]/preceding-sibling::h1",
    "kept": "//li[p/img][not(.//video)]/h2[1]",
    "after": "//ul/following::a[@class='next']",
}


@query(
    "xpath_axes",
    f"""WITH {SQL_PARTS}, s AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM p)
        SELECT page_id, 'up' AS label, trim(p_name) AS value FROM s UNION ALL SELECT page_id, 'third', trim(p_name) FROM s WHERE pos = 2
        UNION ALL SELECT page_id, 'second', trim(p_name) FROM s WHERE pos = 1 UNION ALL SELECT page_id, 'two_on', trim(p_name) FROM s WHERE pos BETWEEN 2 AND 5
        UNION ALL SELECT page_id, 'before_last', trim(p_name) FROM s WHERE pos = n - 2 UNION ALL SELECT DISTINCT page_id, 'holder', 'Grid' FROM s
        UNION ALL SELECT page_id, 'kept', trim(p_name) FROM s UNION ALL SELECT DISTINCT page_id, 'after', 'Next' FROM s""",
)
def xpath_axes(spark, sf):
    """Steps backwards and sideways, and positions inside a whole result."""
    ns = card_nodes(spark, sf)
    return with_text(select_many(ns, AXES, "text"), ns).select("page_id", "label", "value")


@query(
    "selectors_by_table_text",
    f"""WITH {SQL_PARTS}, s AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM p), f AS (SELECT page_id, trim(p_name) AS name, p_partkey FROM s WHERE pos = 1)
        SELECT s.page_id, 'same' AS label, s.p_partkey FROM s JOIN f ON s.page_id = f.page_id AND trim(s.p_name) = f.name
        UNION ALL SELECT page_id, 'long', p_partkey FROM s WHERE pos = 0 UNION ALL SELECT page_id, 'apart', p_partkey FROM s WHERE pos = 1
        UNION ALL SELECT page_id, 'priced', p_partkey FROM s WHERE p_partkey % 7 = 3""",
)
def selectors_by_table_text(spark, sf):
    """Selectors of single pages that test text, short and long."""
    ns, pg = card_nodes(spark, sf), cards(spark, sf)
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).cast("long").alias("page_id"), "p_partkey", F.trim("p_name").alias("name"), F.format_number("p_retailprice", 2).alias("price"))
    say = lambda label, text, *cols: (F.lit(label).alias("label"), F.format_string(text, *cols).alias("selector"))
    second = p.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("p_partkey"))).filter("pos = 2")
    asked = second.select("page_id", *say("same", '//h2[normalize-space()="%s"]', "name"))
    asked = asked.unionByName(p.groupBy("page_id").agg(F.max_by("name", "p_partkey").alias("name")).select("page_id", *say("long", '//ul[contains(., "%s")]/li[1]/h2', "name")))
    asked = asked.unionByName(pg.select("page_id", *say("apart", '//ul[not(contains(., "no such text %s"))]/li[2]/h2', F.col("page_id").cast("string"))))
    asked = asked.unionByName(p.filter("p_partkey % 7 = 3").select("page_id", *say("priced", '//li[@data-key="%s"]/span[starts-with(text(), "$%s")]', F.col("p_partkey").cast("string"), "price")))
    found = matches_on(ns, asked).join(asked, ["page_id", "selector"])
    held = ns.filter("tag = 'li'").select("page_id", F.col("pre").alias("parent"), F.try_element_at("attrs", F.lit("data-key")).cast("long").alias("p_partkey"))
    place = ns.filter("kind = 'element'").select("page_id", "pre", "parent")
    return found.join(place, ["page_id", "pre"]).join(held, ["page_id", "parent"]).select("page_id", "label", "p_partkey")


SQL_EVEN = f"length({SQL_HOST}) % 2 = 0"


@query(
    "template_store",
    f"""WITH {SQL_LINKS} SELECT 1::BIGINT AS version, page_id, pos AS rec_no, 'txt' AS field, trim(txt) AS value FROM links
        UNION ALL SELECT 2, page_id, pos, 'txt', trim(txt) FROM links WHERE NOT ({SQL_EVEN}) UNION ALL SELECT 2, page_id, pos, 'to', href FROM links WHERE {SQL_EVEN}
        UNION ALL SELECT 2, page_id, pos, 'text', lower(trim(txt)) FROM links WHERE {SQL_EVEN}
        UNION ALL SELECT 3, page_id, pos, 'to', href FROM links WHERE {SQL_EVEN} UNION ALL SELECT 3, page_id, pos, 'text', lower(trim(txt)) FROM links WHERE {SQL_EVEN}""",
)
def template_store(spark, sf):
    """Templates saved for every host, replaced for some and removed for others, each state read back from the folder and applied."""
    path, pg, ns = scratch(spark, "templates"), pages(spark, sf), nodes(spark, sf)
    hosts = pg.select(F.lit("menu").alias("name"), url_host(F.col("url")).alias("host")).distinct()
    even = F.length("host") % 2 == 0
    field = lambda *x: F.struct(*[F.lit(v).cast("string").alias(c) for v, c in zip(x, ("field", "selector", "attribute", "transform"))])
    body = {"css": F.lit("nav li"), "xpath": F.lit(None).cast("string")}
    templates.save(hosts.withColumns({**body, "fields": F.array(field("txt", "a", None, "trim"))}), path, 1)
    templates.save(hosts.filter(even).withColumns({"css": F.lit(".none"), "xpath": F.lit("//nav//li"), "fields": F.array(field("to", "a", "href", None), field("text", "a", None, "lowercase"))}), path, 2)
    templates.remove(hosts.filter(~even), path, 3)
    log, out = templates.versions(spark, path), None  # from the folder alone, as another application would
    for v in (1, 2, 3):
        got, _ = templates.apply(pg, ns, templates.as_of(log, v), "menu")
        got = written(got.select(F.lit(v).cast("long").alias("version"), "page_id", long("rec_no").alias("rec_no"), "field", "value"), "applied")
        out = got if out is None else out.unionByName(got)
    return out
