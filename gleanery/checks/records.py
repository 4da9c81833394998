"""Record extraction, transforms and response-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.checks.base import card_nodes, heavy, long, nodes, pages, query, sql_encode, sql_trim, table
from gleanery.checks.dom import SQL_LANG_DE, SQL_ORIGIN
from gleanery.checks.scans import CARD_FIELDS, card_records
from gleanery.functions.scalars import js_trim, strict_number, url_host
from gleanery.functions.transforms import apply_transform, type_setting
from gleanery.operators import batch, extract, prompts, responses, validate
from gleanery.operators import selectors as sel
from gleanery.plans.templates import PROMPTS, SETTINGS, SYSTEM_PROMPTS

CARD_COLS = [f.name for f in CARD_FIELDS]


def lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill_sql(template: str, **values: str) -> str:
    """SQL text of a filled template."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values.get(p, lit_sql("{" + p + "}")) if i % 2 else lit_sql(p) for i, p in enumerate(parts) if p or i % 2)


CARD_SQL = """CAST(p_partkey AS VARCHAR) AS key, p_name AS name, p_retailprice AS price, 'http://shop.example.com/part/' || p_partkey AS href,
  '/img/' || p_partkey || '.png' AS img, upper(p_brand) AS brand, CAST(NULL AS VARCHAR) AS nothing"""


@query("extract_records", f"SELECT {CARD_SQL} FROM part")
def extract_records(spark, sf):
    return card_records(spark, sf).select(*CARD_COLS)


@query(
    "dom_extract_capped",
    f"SELECT {CARD_SQL}, 1 + p_partkey % 150 AS rec_no FROM part WHERE p_partkey % 150 < 100",
)
def dom_extract_capped(spark, sf):
    return card_records(spark, sf, cap=100, per_page=150).select(*CARD_COLS, long("rec_no").alias("rec_no"))


@query("dom_extract_uncapped", f"SELECT {CARD_SQL}, 1 + p_partkey % 150 AS rec_no FROM part")
def dom_extract_uncapped(spark, sf):
    """More than a hundred records on a page, all of them read."""
    return card_records(spark, sf, cap=None, per_page=150).select(*CARD_COLS, long("rec_no").alias("rec_no"))


@query("multi_page_union", f"SELECT p_partkey // 20 AS page_id, p_partkey::VARCHAR AS key, p_name AS name FROM part UNION ALL SELECT p_partkey // 150, p_partkey::VARCHAR, p_name FROM part")
def multi_page_union(spark, sf):
    """Records of two crawls under one another."""
    cols = ["page_id", "key", "name"]
    return card_records(spark, sf).select(*cols).unionByName(card_records(spark, sf, 1000, 150).select(*cols))


@query(
    "extract_metadata",
    f"""SELECT page_id, CASE WHEN {SQL_LANG_DE} THEN len(regexp_extract_all(html, '<p>')) ELSE 0 END::BIGINT AS found,
          CASE WHEN {SQL_LANG_DE} THEN least(len(regexp_extract_all(html, '<p>')), 5) ELSE 0 END::BIGINT AS extracted,
          CASE WHEN {SQL_LANG_DE} THEN greatest(len(regexp_extract_all(html, '<p>')) - 5, 0) ELSE 0 END::BIGINT AS cut, 'table.grid' AS css_selector,
          '//html[@lang=''de'']//article/p' AS xpath_selector, CASE WHEN {SQL_LANG_DE} THEN 'xpath' END AS selector_type, {SQL_LANG_DE} AS success,
          CASE WHEN NOT {SQL_LANG_DE} THEN 'No elements found using the provided selectors' END AS error FROM pages""",
)
def extract_metadata(spark, sf):
    out = extract.extract_metadata(pages(spark, sf), nodes(spark, sf), "table.grid", "//html[@lang='de']//article/p", 5)
    return out.drop("run_ts").withColumns({c: long(c) for c in ("found", "extracted", "cut")})


def url_answers(spark, sf):
    """A JSON answer for every page, with one record."""
    text = F.concat(F.lit('Found it: {"txt": "'), url_host(F.col("url")), F.lit('", "n": 1}'))
    answers = pages(spark, sf).select("page_id", text.alias("text"))
    return responses.response_records(answers, "page_id", ["txt"])


def _link_texts(cap: int) -> str:
    from gleanery.checks.base import SQL_HOST, SQL_LINKS

    return f"""WITH {SQL_LINKS} SELECT page_id, pos AS rec_no, txt, 'dom' AS method FROM links WHERE {SQL_LANG_DE} AND pos <= {cap}
               UNION ALL SELECT page_id, 1, {SQL_HOST}, 'llm' FROM pages WHERE NOT {SQL_LANG_DE}"""


def _with_fallback(spark, sf, cap):
    ns = nodes(spark, sf)
    dom = extract.dom_extract(ns, "html[lang='de'] nav li", None, [extract.Field("txt", "a")], cap=cap).select("page_id", "rec_no", "txt")
    out = extract.dom_then_responses(dom, url_answers(spark, sf).select("page_id", "rec_no", "txt"))
    return out.withColumn("rec_no", long("rec_no"))


@query("sample_extract", _link_texts(5))
def sample_extract(spark, sf):
    return _with_fallback(spark, sf, 5)


@query("extract_with_fallback", _link_texts(100))
def extract_with_fallback(spark, sf):
    return _with_fallback(spark, sf, 100)


@query("tx_number", "SELECT c_custkey, c_acctbal AS n, CASE c_custkey % 3 WHEN 0 THEN c_custkey::DOUBLE WHEN 1 THEN 0.0 END AS odd FROM customer")
def tx_number(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    odd = F.when(F.col("c_custkey") % 3 == 0, F.concat(k, F.lit("d"))).when(F.col("c_custkey") % 3 == 1, F.lit("free")).otherwise(F.concat(F.lit("3-pack "), k))
    price = F.concat(F.lit("Bal: $"), F.format_number("c_acctbal", 2), F.lit(" USD"))
    return c.select("c_custkey", apply_transform(price, "number").alias("n"), strict_number(odd).alias("odd"))


@query("tx_boolean", "SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE true END AS flag FROM events")
def tx_boolean(spark, sf):
    t = F.col("event_type")
    raw = F.when(t == "error", F.lit("")).when(t == "view", F.lit("false")).when(t != "click", t)
    return table(spark, sf, "events").select("event_id", apply_transform(raw, "boolean").alias("flag"))


@query("tx_trim", f"SELECT doc_id, md5({sql_trim('text')}) AS text_md5, length({sql_trim('text')})::BIGINT AS n FROM documents")
def tx_trim(spark, sf):
    out = apply_transform(F.concat(F.lit(" \t\r\n﻿"), "text", F.lit("   \n")), "trim")
    return heavy(spark, sf, "documents").select("doc_id", F.md5(out).alias("text_md5"), long(F.length(out)).alias("n"))


@query("tx_case", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low FROM part")
def tx_case(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", apply_transform(F.col("p_name"), "uppercase").alias("up"), apply_transform(F.col("p_type"), "lowercase").alias("low")
    )


@query(
    "tx_url",
    f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN {SQL_ORIGIN} || '/x/' || page_id WHEN 1 THEN regexp_extract(url, '^(https?:)', 1) || '//cdn.example/x' ELSE 'x.html' END AS v FROM pages""",
)
def tx_url(spark, sf):
    k = F.col("page_id")
    raw = F.when(k % 3 == 0, F.concat(F.lit("/x/"), k.cast("string"))).when(k % 3 == 1, F.lit("//cdn.example/x")).otherwise(F.lit("x.html"))
    return pages(spark, sf).select("page_id", apply_transform(raw, "url", F.col("url")).alias("v"))


@query("tx_custom", "SELECT p_partkey::VARCHAR AS key, reverse(p_name) AS name FROM part")
def tx_custom(spark, sf):
    fields = [extract.Field("key", None, "data-key"), extract.Field("name", "h2", None, F.reverse)]
    return extract.dom_extract(card_nodes(spark, sf), "li.card", None, fields).select("key", "name")


@query(
    "response_records",
    """SELECT p_partkey AS prompt_id, 1::BIGINT AS rec_no, p_partkey::VARCHAR AS key, p_name AS name FROM part WHERE p_partkey % 4 <> 3
       UNION ALL SELECT p_partkey, 2, 'extra', NULL FROM part WHERE p_partkey % 4 IN (0, 2)""",
)
def response_records(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    one = F.concat(F.lit('{"key":"'), k.cast("string"), F.lit('","name":"'), "p_name", F.lit('"}'))
    two = F.concat(F.lit("["), one, F.lit(', {"key":"extra"}]'))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Sure:\n```json\n"), two, F.lit("\n```\nDone {ok}.")))
        .when(k % 4 == 1, F.concat(F.lit("The record is "), one, F.lit(" as asked.")))
        .when(k % 4 == 2, two)
        .otherwise(F.concat(one, F.lit(","), one))
    )
    out = responses.response_records(p.select(k.alias("prompt_id"), text.alias("text")), "prompt_id", ["key", "name"])
    return out.withColumn("rec_no", long("rec_no"))


@query(
    "response_json",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '[' || p_partkey || ']' WHEN 1 THEN '{"a":' || p_partkey || '}' WHEN 2 THEN '[{"a":1},{"a":2}]'
         WHEN 3 THEN NULL ELSE p_partkey::VARCHAR END AS json FROM part""",
)
def response_json(spark, sf):
    k = F.col("p_partkey")
    s = k.cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("```\n["), s, F.lit("]```")))
        .when(k % 5 == 1, F.concat(F.lit("see [note] {\"a\":"), s, F.lit("} end")))
        .when(k % 5 == 2, F.lit('[{"a":1},{"a":2}]'))
        .when(k % 5 == 3, F.concat(F.lit('{"a":NaN} '), s))
        .otherwise(s)
    )
    return table(spark, sf, "part").select("p_partkey", js_trim(responses.response_json(text)).alias("json"))


FIELD_TYPES = ["number", "integer", "boolean", "url", "link", "image", "date", "other"]


@query(
    "schema_from_fields",
    """SELECT p_partkey, CASE WHEN p_size % 8 IN (3, 4) THEN 'href' WHEN p_size % 8 = 5 THEN 'src' END AS attribute,
         CASE WHEN p_size % 8 < 2 THEN 'number' WHEN p_size % 8 = 2 THEN 'boolean' WHEN p_size % 8 IN (3, 4) THEN 'url' WHEN p_size % 8 > 5 THEN 'trim' END AS transform FROM part""",
)
def schema_from_fields(spark, sf):
    kind = F.array(*[F.lit(t) for t in FIELD_TYPES])[F.col("p_size") % 8]
    return table(spark, sf, "part").select("p_partkey", type_setting(kind, 0).alias("attribute"), type_setting(kind, 1).alias("transform"))


@query(
    "scalar_or_list",
    """SELECT user_id AS page_id, event_type AS dp_id, event_id AS pos, props AS value FROM events
       QUALIFY event_type IN ('click', 'view') OR event_id = min(event_id) OVER (PARTITION BY user_id, event_type)""",
)
def scalar_or_list(spark, sf):
    raw = table(spark, sf, "events").select(
        F.col("user_id").alias("page_id"), F.col("event_type").alias("dp_id"), F.col("event_id").alias("pos"), F.col("props").alias("value")
    )
    return extract.scalar_or_list(raw, ["click", "view"]).select("page_id", "dp_id", "pos", "value")


@query(
    "infer_column_types",
    """SELECT unnest(['total', 'open', 'day', 'link', 'priority']) AS field, count(*) AS n_values, unnest(['number', 'boolean', 'date', 'url', 'string']) AS type FROM orders""",
)
def infer_column_types(spark, sf):
    o = heavy(spark, sf, "orders")
    cells = {
        "total": F.concat(F.lit("$"), F.format_number("o_totalprice", 2)),
        "open": F.when(F.col("o_orderstatus") == "O", F.lit("Yes")).otherwise(F.lit("no")),
        "day": F.date_format("o_orderdate", "MMMM d, yyyy"),
        "link": F.concat(F.lit("https://shop.example.com/o/"), F.col("o_orderkey").cast("string")),
        "priority": F.col("o_orderpriority"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in cells.items()])
    return validate.infer_types(o.select(F.explode(rows).alias("r")).select("r.*"))


# --- plan responses: one per part ---


def plan_texts(spark, sf, with_schema=False):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    given = F.when(
        k % 3 == 0, F.concat(F.lit('```json\n{"sku": {"selector": null, "attribute": "data-'), k.cast("string"), F.lit('", "transform": "trim"}}\n```\n'))
    ).when(k % 3 == 1, F.lit('```json\n{"sku": {"selector": }}\n```\n')).otherwise(F.lit(""))
    text = F.concat(
        F.lit("Here is the plan.\n- Extraction Goal: parts of "), "p_brand", F.lit(" \n- data structure  "), F.lower("p_type"), F.lit(" table\n- Key Fields:\n- "), "p_name",
        F.lit(" [Number]\n- brand: number\n-\n  - size"), F.col("p_size").cast("string"), F.lit(" [ URL ]\n- Target Elements:\n- li.card\n- h"),
        (k % 6).cast("string"), F.lit("\n- Extraction Strategy: read "), k.cast("string"), F.lit("\nthen stop\n- Potential Challenges:\n- gaps in "), "p_brand",
        F.lit("\n- none\n"), given if with_schema else F.lit(""),
    )
    return p.select(k.alias("plan_id"), text.alias("text"))


@query("plan_goal_structure", "SELECT p_partkey AS plan_id, 'parts of ' || p_brand AS goal, lower(p_type) || ' table' AS structure FROM part")
def plan_goal_structure(spark, sf):
    t = F.col("text")
    return plan_texts(spark, sf).select("plan_id", responses.plan_goal(t).alias("goal"), responses.plan_structure(t).alias("structure"))


@query(
    "plan_key_fields",
    """SELECT p_partkey AS plan_id, 0::BIGINT AS pos, p_name AS name, 'number' AS type FROM part UNION ALL SELECT p_partkey, 1, 'brand', 'string' FROM part
       UNION ALL SELECT p_partkey, 2, 'size' || p_size, 'url' FROM part""",
)
def plan_key_fields(spark, sf):
    rows = plan_texts(spark, sf).select("plan_id", F.posexplode(responses.plan_fields(F.col("text"))).alias("pos", "f"))
    return rows.select("plan_id", long("pos").alias("pos"), "f.name", "f.type")


@query(
    "plan_lists",
    """SELECT p_partkey AS plan_id, 'element' AS kind, 0::BIGINT AS pos, 'li.card' AS item FROM part UNION ALL SELECT p_partkey, 'element', 1, 'h' || p_partkey % 6 FROM part
       UNION ALL SELECT p_partkey, 'challenge', 0, 'gaps in ' || p_brand FROM part UNION ALL SELECT p_partkey, 'challenge', 1, 'none' FROM part""",
)
def plan_lists(spark, sf):
    """The stray dash before the next heading is an empty bullet and drops out."""
    t = F.col("text")
    plans = plan_texts(spark, sf)
    parts = [("element", responses.plan_elements(t)), ("challenge", responses.plan_challenges(t))]
    both = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("items")) for k, v in parts])
    rows = plans.select("plan_id", F.explode(both).alias("b")).select("plan_id", "b.kind", F.posexplode("b.items").alias("pos", "item"))
    return rows.select("plan_id", "kind", long("pos").alias("pos"), "item")


@query("plan_strategy", "SELECT p_partkey AS plan_id, 'read ' || p_partkey || chr(10) || 'then stop' AS strategy FROM part")
def plan_strategy(spark, sf):
    return plan_texts(spark, sf).select("plan_id", responses.plan_strategy(F.col("text")).alias("strategy"))


@query(
    "plan_schema_json",
    """SELECT p_partkey AS plan_id, CASE WHEN p_partkey % 3 = 0 THEN '{"sku": {"selector": null, "attribute": "data-' || p_partkey || '", "transform": "trim"}}' END AS schema_json FROM part""",
)
def plan_schema_json(spark, sf):
    return plan_texts(spark, sf, True).select("plan_id", responses.plan_schema_json(F.col("text")).alias("schema_json"))


SCHEMA_DEFAULT_SQL = """
SELECT p_partkey AS plan_id, 'sku' AS field, 'data-' || p_partkey AS attribute, 'trim' AS transform, 'given' AS source FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, p_name, NULL, 'number', 'derived' FROM part WHERE p_partkey % 3 > 0
UNION ALL SELECT p_partkey, 'brand', NULL, 'trim', 'derived' FROM part WHERE p_partkey % 3 > 0
UNION ALL SELECT p_partkey, 'size' || p_size, 'href', 'url', 'derived' FROM part WHERE p_partkey % 3 > 0"""


@query("plan_schema_default", SCHEMA_DEFAULT_SQL)
def plan_schema_default(spark, sf):
    return responses.plan_schema_rows(plan_texts(spark, sf, True), "plan_id")


def paging_texts(spark, sf):
    k = F.col("p_partkey")
    s = k.cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("The next page link: `.next-"), s, F.lit(" a`. Pagination pattern: ?page=N. Maximum "), F.col("p_size").cast("string"), F.lit(" pages.")))
        .when(k % 5 == 1, F.concat(F.lit("Page URL pattern: /list/"), s, F.lit(". A total of 7 pages")))
        .when(k % 5 == 2, F.concat(F.lit("Page numbers are in '#pager"), s, F.lit("'")))
        .when(k % 5 == 3, F.lit("Next page button: a.next"))
        .otherwise(F.lit("One page only."))
    )
    return table(spark, sf, "part").select(k.alias("plan_id"), text.alias("text"))


PAGING_SQL = """SELECT p_partkey AS plan_id, CASE p_partkey % 5 WHEN 0 THEN 'next-button' WHEN 1 THEN 'url-pattern' WHEN 2 THEN 'page-numbers' END AS type,
 CASE WHEN p_partkey % 5 = 0 THEN '.next-' || p_partkey || ' a' END AS next_selector,
 CASE p_partkey % 5 WHEN 0 THEN '?page=N' WHEN 1 THEN '/list/' || p_partkey END AS url_pattern,
 CASE WHEN p_partkey % 5 = 2 THEN '#pager' || p_partkey END AS numbers_selector,
 CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN 7 ELSE 10 END::BIGINT AS max_pages, p_partkey % 5 < 3 AS has_pagination FROM part"""


@query("pagination_strategy", PAGING_SQL)
def pagination_strategy(spark, sf):
    out = paging_texts(spark, sf).select("plan_id", responses.pagination(F.col("text")).alias("p")).select("plan_id", "p.*")
    return out.withColumn("max_pages", long("max_pages"))


@query(
    "multi_page_plan",
    f"""SELECT p.plan_id, 'parts of ' || q.p_brand AS goal, p.type, p.max_pages, 3::BIGINT AS n_fields, true AS is_multi_page FROM ({PAGING_SQL}) p JOIN part q ON q.p_partkey = p.plan_id""",
)
def multi_page_plan(spark, sf):
    texts = plan_texts(spark, sf).select("plan_id", F.col("text").alias("plan")).join(paging_texts(spark, sf).select("plan_id", F.col("text").alias("paging")), "plan_id")
    both = texts.select("plan_id", F.concat_ws("\n", "plan", "paging").alias("text"), F.col("paging"))
    out = responses.multi_page_plans(both.select("plan_id", "text"))
    return out.select("plan_id", "goal", F.col("paging.type").alias("type"), long("paging.max_pages").alias("max_pages"), F.size("fields").cast("long").alias("n_fields"), "is_multi_page")


@query(
    "parse_selectors",
    """SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['#p' || p_partkey, '.a > b'] WHEN p_partkey % 3 = 1 THEN ['h' || p_size, '.alt'] ELSE ['.x'] END) AS selector,
         'css' AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'stable ids' || chr(10) || 'and names' END AS explanation FROM part
       UNION ALL SELECT p_partkey, '//p[' || p_partkey || ']', 'xpath', 'stable ids' || chr(10) || 'and names' FROM part WHERE p_partkey % 3 = 0
       UNION ALL SELECT p_partkey, '//h' || p_size, 'xpath', NULL FROM part WHERE p_partkey % 3 = 1""",
)
def parse_selectors(spark, sf):
    k, s, z = F.col("p_partkey"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = (
        F.when(
            k % 3 == 0,
            F.concat(F.lit("CSS: `#p"), s, F.lit("`\ncss selector: .a > b\nCSS: `#p"), s, F.lit("`\nXPath: `//p["), s, F.lit("]`\nExplanation: stable ids\nand names\n\nBye")),
        )
        .when(k % 3 == 1, F.concat(F.lit("- CSS Selectors:\n  - Primary: h"), z, F.lit("\n  - Alternate: `.alt`\n- XPath Selectors:\n  - Primary: //h"), z, F.lit("\n")))
        .otherwise(F.lit("css selector `.x`"))
    )
    t = F.col("text")
    rows = table(spark, sf, "part").select("p_partkey", text.alias("text")).select(
        "p_partkey", responses.explanation(t).alias("explanation"),
        F.explode(F.array(F.struct(F.lit("css").alias("kind"), responses.css_selectors(t).alias("s")), F.struct(F.lit("xpath").alias("kind"), responses.xpath_selectors(t).alias("s")))).alias("r"),
    )
    return rows.select("p_partkey", F.explode("r.s").alias("selector"), "r.kind", "explanation")


@query(
    "parse_multi_selectors",
    """SELECT p_partkey, 'name' AS field, 'h2.n' || p_partkey AS css, '//h2[' || p_size || ']' AS xpath, NULL AS explanation FROM part
       UNION ALL SELECT p_partkey, 'unit price', '.price', '', 'marked as ' || p_size FROM part UNION ALL SELECT p_partkey, 'a.b', '.ab', '//x', NULL FROM part WHERE p_partkey % 2 = 0""",
)
def parse_multi_selectors(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("Name: CSS: `h2.n"), s, F.lit("`  XPath: `//h2["), F.col("p_size").cast("string"), F.lit("]`\nUnit Price: css selector: .price\nExplanation: marked as "), F.col("p_size").cast("string"), F.lit("\n\n"),
        F.when(k % 2 == 0, F.lit("a.b: css `.ab` xpath `//x`\n")).otherwise(F.lit("")),
    )
    rows = responses.multi_field_selectors(table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey", ["Name", "Unit Price", "a.b"])
    return rows.select("p_partkey", "field", F.array_join("css", "|").alias("css"), F.array_join("xpath", "|").alias("xpath"), "explanation")


@query("clean_converted_selector", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '//li[' || p_partkey || ']' ELSE 'li.c' || p_partkey END AS selector FROM part")
def clean_converted_selector(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    text = F.when(k % 2 == 0, F.concat(F.lit("Here:\n`//li["), s, F.lit("]` and 'more'"))).otherwise(F.concat(F.lit("  li.c"), s, F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", responses.clean_converted(text).alias("selector"))


@query("selector_kind", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'xpath' ELSE 'css' END AS kind FROM part")
def selector_kind(spark, sf):
    s = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("//li["), F.col("p_partkey").cast("string"), F.lit("]"))).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", responses.selector_kind(s).alias("kind"))


@query("parse_alternatives", "SELECT p_partkey, unnest(['.a' || p_partkey, 'h2 \"x\"']) AS selector FROM part WHERE p_partkey % 4 < 2")
def parse_alternatives(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    good = F.concat(F.lit('[".a'), s, F.lit('", "  ", "h2 \\"x\\""]'))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(k % 4 == 1, good)
        .when(k % 4 == 2, F.concat(F.lit('[".a'), s, F.lit('", 5]')))
        .otherwise(F.concat(F.lit('[".a'), s, F.lit('"] trailing')))
    )
    return table(spark, sf, "part").select("p_partkey", F.explode(responses.alternatives(text)).alias("selector"))


# --- prompts ---


@query(
    "fill_template",
    "SELECT o_orderkey, 'Order ' || o_orderkey || ' by {key} is ' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END || '; {unknown} {' || o_orderkey || '}' AS text FROM orders",
)
def fill_template(spark, sf):
    values = prompts.value_map(
        key=F.col("o_orderkey"), cust=F.lit("{key}"), status=F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    )
    text = prompts.fill_template(F.lit("Order {key} by {cust} is {status}; {unknown} {{key}}"), values)
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


@query("template_missing_keys", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'other' ELSE o_orderstatus || '|other' END AS missing FROM orders")
def template_missing_keys(spark, sf):
    template = F.concat(F.lit("{"), "o_orderstatus", F.lit("} {total} {other} {other}"))
    values = prompts.value_map(total=F.col("o_totalprice"), F=F.lit("x"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(prompts.missing_keys(template, values), "|").alias("missing"))


@query(
    "system_prompt_lookup",
    f"""SELECT event_id, event_type AS agent, CASE event_type WHEN 'view' THEN {lit_sql(SYSTEM_PROMPTS['PLANNER'])} WHEN 'click' THEN {lit_sql(SYSTEM_PROMPTS['SELECTOR'])} END AS system,
         CASE WHEN event_type NOT IN ('view', 'click') THEN 'No system prompt found for agent type: ' || event_type END AS error FROM events""",
)
def system_prompt_lookup(spark, sf):
    t = F.col("event_type")
    kind = F.when(t == "view", F.lit("planner")).when(t == "click", F.lit("Selector")).otherwise(t)
    out = prompts.with_system_prompt(table(spark, sf, "events").select("event_id", t.alias("agent"), kind.alias("kind")), "kind")
    return out.select("event_id", "agent", "system", "error")


def _prompt_sql() -> str:
    cut = "CASE WHEN length(html) > 30000 THEN left(html, 30000) || chr(10) || '<!-- HTML truncated for size limits -->' ELSE html END"
    goal = lit_sql("all links")
    plan = fill_sql(PROMPTS["PLANNER_CREATE_PLAN"], targetUrl="url", extractionGoal=goal, htmlSample=cut)
    many = fill_sql(PROMPTS["MULTIPAGE_PLAN"], mainPageUrl="url", dataToCollect=goal, paginationPattern="'unknown'", htmlSample=cut)
    robust = fill_sql(PROMPTS["SELECTOR_ROBUST"], targetDescription=goal, htmlSample="left(html, 30000)")
    rows = [("PLANNER_CREATE_PLAN", "PLANNER", plan, 0.3, 2048), ("MULTIPAGE_PLAN", "PLANNER", many, 0.3, 2048), ("SELECTOR_ROBUST", "SELECTOR", robust, 0.2, 1024)]
    return " UNION ALL ".join(
        f"SELECT page_id, '{k}' AS kind, {lit_sql(SYSTEM_PROMPTS[a])} AS system, {p} AS prompt, {t}::DOUBLE AS temperature, {n}::BIGINT AS max_tokens FROM pages"
        for k, a, p, t, n in rows
    )


@query("build_prompts", _prompt_sql())
def build_prompts(spark, sf):
    return prompts.page_prompts(pages(spark, sf), F.lit("all links"), 30_000, prompts.CUT).withColumn("max_tokens", long("max_tokens"))


def _selector_prompt_sql() -> str:
    css, xpath = "CASE WHEN k % 4 IN (0, 2) THEN '.c' || k END", "CASE WHEN k % 4 IN (1, 2) THEN '//x' || k END"
    html, fb, err = "'<p>' || p_name || '</p>'", "CASE WHEN k % 3 = 0 THEN 'shorter' END", "CASE WHEN k % 5 = 0 THEN 'gone' END"
    now = f"concat_ws(chr(10), 'CSS: ' || {css}, 'XPath: ' || {xpath})"
    rows = [
        ("SELECTOR_GENERATE", "k % 4 = 3", dict(targetData="p_name", extractionGoal="'parts'", htmlSample=html)),
        ("SELECTOR_GENERATE_MULTI", "k % 7 = 0", dict(targetsDescription="p_type", htmlContext=html, preferredType="'css'")),
        ("EXTRACTOR_EXTRACT_DATA", "k % 6 = 0", dict(schema="'{\"name\": \"string\"}'", cssSelector=f"coalesce({css}, '')", xpathSelector=f"coalesce({xpath}, '')", htmlContent=html)),
        ("SELECTOR_IMPROVE", f"k % 4 < 3 AND {fb} IS NOT NULL", dict(currentSelectors=now, feedback=fb, htmlContext=html)),
        ("SELECTOR_CONVERT", "k % 4 = 0", dict(fromType="'CSS'", toType="'XPath'", selector=css)),
        ("SELECTOR_CONVERT", "k % 4 = 1", dict(fromType="'XPath'", toType="'CSS'", selector=xpath)),
        ("RECOVERY_ALTERNATIVES", f"{css} IS NOT NULL AND {err} IS NOT NULL", dict(description="p_name", type="'string'", failedSelector=css, errorMessage=err, notes="''", htmlSample=html)),
    ]
    parts = []
    for kind, where, values in rows:
        agent, heat, size = SETTINGS[kind]
        system = "NULL" if agent is None else lit_sql(SYSTEM_PROMPTS[agent])
        parts.append(f"SELECT k AS plan_id, '{kind}' AS kind, {system} AS system, {fill_sql(PROMPTS[kind], **values)} AS prompt, {heat}::DOUBLE AS temperature, {'NULL' if size is None else size}::BIGINT AS max_tokens FROM p WHERE {where}")
    return "WITH p AS (SELECT p_partkey AS k, * FROM part) " + " UNION ALL ".join(parts)


@query("selector_prompts", _selector_prompt_sql())
def selector_prompts(spark, sf):
    k = F.col("p_partkey")
    text = k.cast("string")
    rows = table(spark, sf, "part").select(
        k.alias("plan_id"), F.concat(F.lit("<p>"), "p_name", F.lit("</p>")).alias("page_html"), F.lit("parts").alias("goal"), F.col("p_name").alias("target"),
        F.when(k % 7 == 0, F.col("p_type")).alias("targets"), F.when(k % 6 == 0, F.lit('{"name": "string"}')).alias("schema"),
        F.when((k % 4).isin(0, 2), F.concat(F.lit(".c"), text)).alias("css"), F.when((k % 4).isin(1, 2), F.concat(F.lit("//x"), text)).alias("xpath"),
        F.when(k % 3 == 0, F.lit("shorter")).alias("feedback"), F.when(k % 5 == 0, F.lit("gone")).alias("error"),
    )
    return prompts.selector_prompts(rows, ["plan_id"]).withColumn("max_tokens", long("max_tokens"))


@query(
    "refine_prompts",
    "SELECT p_partkey AS plan_id, "
    + fill_sql(
        PROMPTS["PLAN_REFINE"],
        currentPlan="'Current Extraction Plan:' || chr(10) || '- Goal: parts of ' || p_brand || chr(10) || '- Data Structure: ' || lower(p_type) || ' table' || chr(10)"
        " || '- Fields: ' || p_name || ' [number], brand [string], size' || p_size || ' [url]' || chr(10) || '- Target Elements: li.card, h' || p_partkey % 6",
        feedback="'add ' || p_type",
        htmlSample="'<p>' || p_name || '</p>'",
    )
    + " AS prompt FROM part WHERE p_partkey % 2 = 0",
)
def refine_prompts(spark, sf):
    """Feedback joined to the latest plan of each id gives the next planning prompt (M8)."""
    plans = responses.parse_plans(plan_texts(spark, sf))
    feedback = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("plan_id"), F.concat(F.lit("add "), "p_type").alias("feedback"), F.concat(F.lit("<p>"), "p_name", F.lit("</p>")).alias("html")
    )
    new, old = plans.withColumns({"ts": F.lit(2), "version_id": F.lit(2)}), plans.withColumns({"goal": F.lit("an older goal"), "ts": F.lit(1), "version_id": F.lit(1)})
    return prompts.refine_prompts(new.unionByName(old), feedback, "plan_id", 15_000, prompts.CUT).select("plan_id", "prompt")


@query(
    "plan_summary_text",
    """SELECT p_partkey AS plan_id, 'Current Extraction Plan:' || chr(10) || '- Goal: parts of ' || p_brand || chr(10) || '- Data Structure: ' || lower(p_type) || ' table'
        || chr(10) || '- Fields: ' || p_name || ' [number], brand [string], size' || p_size || ' [url]' || chr(10) || '- Target Elements: li.card, h' || p_partkey % 6 AS summary FROM part""",
)
def plan_summary_text(spark, sf):
    p = responses.parse_plans(plan_texts(spark, sf))
    return p.select("plan_id", prompts.plan_summary(F.col("goal"), F.col("structure"), F.col("fields"), F.col("elements")).alias("summary"))


@query(
    "selector_summary_text",
    """SELECT p_partkey // 4 AS grp, string_agg(CASE WHEN p_partkey % 2 = 0 THEN 'CSS: .c' ELSE 'XPath: //x' END || p_partkey, chr(10) ORDER BY p_partkey % 2, p_partkey) AS summary
       FROM part GROUP BY 1""",
)
def selector_summary_text(spark, sf):
    k = F.col("p_partkey")
    css = k % 2 == 0
    rows = table(spark, sf, "part").select(
        F.floor(k / 4).alias("grp"), F.when(css, F.lit("css")).otherwise(F.lit("xpath")).alias("kind"), k.alias("rank"),
        F.concat(F.when(css, F.lit(".c")).otherwise(F.lit("//x")), k.cast("string")).alias("selector"),
    )
    return prompts.selector_summary(rows, "grp")


@query(
    "target_lines",
    """SELECT p_partkey, 'Field: ' || p_name || ' (' || CASE WHEN p_size % 2 = 0 THEN 'string' ELSE lower(p_type) END || ') - Description: '
         || CASE WHEN p_size % 3 = 0 THEN 'No description' ELSE p_brand END AS line FROM part""",
)
def target_lines(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 1, F.lower("p_type"))
    described = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", prompts.target_line(F.col("p_name"), kind, described).alias("line"))


# --- responses over providers ---


def provider_answers(spark, sf):
    """Two answers per turn: one provider fails on some, the other on others."""
    c = table(spark, sf, "conversations")
    pid = (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id")
    n = F.length("text")
    a = c.select(pid, F.lit("ollama").alias("provider"), F.concat(F.lit("m-"), "role").alias("model"), F.when(n % 3 > 0, F.col("text")).alias("text"),
                 F.when(n % 3 == 0, F.lit("down")).alias("error"), long(n).alias("prompt_tokens"), long(n % 7).alias("completion_tokens"), F.lit(None).cast("long").alias("total_tokens"))
    b = c.select(pid, F.lit("openai").alias("provider"), F.lit("m-big").alias("model"), F.when(n % 2 > 0, F.concat(F.lit("alt:"), "text")).alias("text"),
                 F.when(n % 2 == 0, F.lit("limit")).alias("error"), F.lit(None).cast("long").alias("prompt_tokens"), F.lit(5).cast("long").alias("completion_tokens"), long(n * 2).alias("total_tokens"))
    return a.unionByName(b)


@query(
    "response_fallback",
    """SELECT conv_id * 1000 + turn AS prompt_id, CASE WHEN length(text) % 3 > 0 THEN 'ollama' ELSE 'openai' END AS provider,
         CASE WHEN length(text) % 3 > 0 THEN md5(text) WHEN length(text) % 2 > 0 THEN md5('alt:' || text) END AS text_md5,
         CASE WHEN length(text) % 6 = 0 THEN 'limit' END AS error FROM conversations""",
)
def response_fallback(spark, sf):
    best = responses.with_fallback(provider_answers(spark, sf), "prompt_id", "ollama", "openai")
    return best.select("prompt_id", "provider", F.md5("text").alias("text_md5"), "error")


@query(
    "token_usage",
    """WITH r AS (SELECT 'ollama' AS provider, 'm-' || role AS model, length(text) AS p, length(text) % 7 AS c, length(text) + length(text) % 7 AS t FROM conversations
         UNION ALL SELECT 'openai', 'm-big', 0, 5, length(text) * 2 FROM conversations)
       SELECT provider, model, count(*) AS n_calls, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(t)::BIGINT AS total_tokens,
         grouping_id(provider, model)::BIGINT AS level FROM r GROUP BY ROLLUP (provider, model)""",
)
def token_usage(spark, sf):
    return responses.token_usage(provider_answers(spark, sf))


@query(
    "prompt_dedup",
    """WITH p AS (SELECT conv_id * 1000 + turn AS prompt_id, text AS prompt, role FROM conversations)
       SELECT min(prompt_id) AS prompt_id, count(*) AS n_copies FROM p GROUP BY prompt, role HAVING role <> 'system'""",
)
def prompt_dedup(spark, sf):
    c = table(spark, sf, "conversations")
    asks = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.col("text").alias("prompt"), F.lit("m").alias("model"), F.col("role").alias("system"))
    done = asks.filter("system = 'system'").select(responses.prompt_key(F.col("prompt"), F.col("model"), F.col("system")).alias("cache_key")).distinct()
    return responses.distinct_prompts(asks, "prompt_id", done).select("prompt_id", "n_copies")


@query(
    "extraction_accuracy",
    """SELECT 'name' AS field, count(*) AS n, count(*) AS n_right, 1.0::DOUBLE AS accuracy FROM part
       UNION ALL SELECT 'price', count(*), sum((p_partkey % 10 > 0)::INT)::BIGINT, round(sum((p_partkey % 10 > 0)::INT) / count(*), 6) FROM part""",
)
def extraction_accuracy(spark, sf):
    got = card_records(spark, sf).select(F.col("key").cast("long").alias("p_partkey"), "name", "price")
    gold = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 10 > 0, F.round("p_retailprice", 2)).otherwise(F.lit(-1.0)).alias("price")
    )
    return batch.accuracy(got, gold, ["p_partkey"], ["name", "price"])
