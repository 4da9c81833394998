"""Validation and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.checks.base import SQL_HOST, SQL_LINKS, heavy, long, nodes, pages, query, sql_encode, sql_squash, table
from gleanery.checks.dom import SQL_LANG_DE, SQL_ORIGIN
from gleanery.functions.scalars import is_http_url, squash
from gleanery.operators import validate
from gleanery.operators.validate import DataPoint
from gleanery.plans import extraction
from gleanery.plans.extraction import PlannedField


def raw_rows(df, page, dp, kind, pos, value, json_type=None):
    j = F.lit("string") if json_type is None else json_type
    none = F.lit(None).cast("string")
    return df.select(
        page.cast("long").alias("page_id"), dp.alias("dp_id"), kind.alias("raw_kind"), pos.cast("int").alias("pos"),
        F.coalesce(value, none).alias("value"), F.when(value.isNull(), F.lit("null")).otherwise(j).alias("json_type"),
    )


def part_pages(spark, sf):
    """One page per part."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.lit("http://shop.example.com/").alias("url"), "p_name", "p_size", "p_brand")


@query(
    "validate_outer",
    """SELECT p_partkey AS page_id, 'name' AS dp_id, p_name AS clean FROM part UNION ALL SELECT p_partkey, 'size', CASE WHEN p_size > 10 THEN p_size::VARCHAR END FROM part""",
)
def validate_outer(spark, sf):
    """Raw field ``extra`` is not planned and drops out; list ``tags`` is never found and stays empty."""
    p = part_pages(spark, sf)
    k, one, zero = F.col("page_id"), F.lit("scalar"), F.lit(0)
    raw = raw_rows(p, k, F.lit("name"), one, zero, F.col("p_name")).unionByName(
        raw_rows(p.filter("p_size > 10"), k, F.lit("size"), one, zero, F.col("p_size").cast("string"), F.lit("number"))
    ).unionByName(raw_rows(p, k, F.lit("extra"), one, zero, F.col("p_brand")))
    plan = [DataPoint("name"), DataPoint("size", "number"), DataPoint("tags", is_list=True)]
    values, _ = validate.validate(raw, p.select("page_id", "url"), plan)
    return values.select("page_id", "dp_id", "clean")


SHAPE_SQL = """
SELECT p_partkey AS page_id, 'tags' AS dp_id, 'list_expected' AS code, 'Type mismatch: Expected list, got single item.' AS issue,
  CASE WHEN p_partkey % 4 = 0 THEN p_name END AS value FROM part WHERE p_partkey % 4 < 2
UNION ALL SELECT p_partkey, 'name', 'scalar_expected', 'Type mismatch: Expected single item, got list.', p_name FROM part WHERE p_partkey % 4 = 2"""


def shape_raw(p):
    k, m = F.col("page_id"), F.col("page_id") % 4
    tags = raw_rows(p.filter(m < 2), k, F.lit("tags"), F.when(m == 0, F.lit("scalar")).otherwise(F.lit("null")), F.when(m == 0, F.lit(0)), F.when(m == 0, F.col("p_name")))
    listed = p.filter(m == 2).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    names = raw_rows(listed, k, F.lit("name"), F.lit("list"), F.col("i"), F.when(F.col("i") == 0, F.col("p_name")).otherwise(F.lit("second")))
    single = raw_rows(p.filter(m != 2), k, F.lit("name"), F.lit("scalar"), F.lit(0), F.col("p_name"))
    return tags.unionByName(names).unionByName(single)


@query("validate_shape", SHAPE_SQL)
def validate_shape(spark, sf):
    p = part_pages(spark, sf)
    _, issues = validate.validate(shape_raw(p), p.select("page_id", "url"), [DataPoint("name"), DataPoint("tags", is_list=True)])
    return issues.select("page_id", "dp_id", "code", "issue", "value")


@query("clean_whitespace", f"SELECT doc_id, md5({sql_squash('text')}) AS text_md5, length({sql_squash('text')})::BIGINT AS n FROM documents")
def clean_whitespace(spark, sf):
    c = squash(F.col("text"))
    return heavy(spark, sf, "documents").select("doc_id", F.md5(c).alias("text_md5"), long(F.length(c)).alias("n"))


def coerce(rows, kind):
    """rows(value, json_type, url) cleaned as one type."""
    return validate.clean_items(rows.withColumn("type", F.lit(kind)))


@query(
    "coerce_number",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 5 THEN NULL WHEN 4 THEN 1000.0 + c_custkey WHEN 3 THEN 0.5 ELSE c_acctbal END AS num,
         CASE c_custkey % 6 WHEN 5 THEN 'number_unparsed' END AS code FROM customer""",
)
def coerce_number(spark, sf):
    m, k = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    value = (
        F.when(m == 5, F.concat(F.lit("n/a "), k)).when(m == 4, F.concat(F.format_number(F.col("c_custkey") + 1000, 0), F.lit("kg")))
        .when(m == 3, F.lit(" .5e0x")).otherwise(F.concat(F.lit(" € "), F.format_number("c_acctbal", 2), F.lit(" each")))
    )
    rows = table(spark, sf, "customer").select("c_custkey", value.alias("value"), F.lit("string").alias("json_type"), F.lit(None).cast("string").alias("url"))
    return coerce(rows, "number").select("c_custkey", "num", "code")


@query(
    "coerce_boolean",
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false WHEN 5 THEN false END AS bool,
         CASE WHEN c_custkey % 7 = 6 THEN 'Type mismatch: Expected boolean, got string.' END AS issue FROM customer""",
)
def coerce_boolean(spark, sf):
    words = F.array(*[F.lit(w) for w in (" YES ", "On", "1", "no", "0", "FALSE\n", "maybe")])
    rows = table(spark, sf, "customer").select(
        "c_custkey", words[(F.col("c_custkey") % 7).cast("int")].alias("value"), F.lit("string").alias("json_type"), F.lit(None).cast("string").alias("url")
    )
    out = coerce(rows, "boolean")
    return out.select("c_custkey", "bool", validate.issue_text(F.col("code"), F.col("value"), F.col("json_type")).alias("issue"))


SQL_NOFRAG = "regexp_replace(url, '#.*$', '')"
SQL_FOLDER = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(https?://.*/)', 1)"


@query(
    "coerce_url",
    f"""WITH {SQL_LINKS} SELECT page_id, pos, CASE pos % 7 WHEN 0 THEN NULL WHEN 1 THEN {sql_encode(SQL_ORIGIN + ' || href')} WHEN 2 THEN {sql_encode(SQL_FOLDER + ' || href[2:]')}
          WHEN 3 THEN {sql_encode("regexp_extract(url, '^(https?:)', 1) || '//cdn.x' || href")} WHEN 4 THEN {sql_encode(SQL_NOFRAG + " || '#t'")}
          WHEN 5 THEN 'HTTP://EX.com' || href ELSE {sql_encode(SQL_ORIGIN + " || '/b' || href")} END AS abs_url,
          CASE WHEN pos % 7 = 0 THEN 'Invalid URL: Expected valid URL, got "mailto:' || href || '".' END AS issue FROM links""",
)
def coerce_url(spark, sf):
    from gleanery.checks.dom import pos_of
    from gleanery.operators.dom import attr
    from gleanery.operators.selectors import select_css

    links = pos_of(select_css(nodes(spark, sf), "nav a", "attrs")).join(pages(spark, sf).select("page_id", "url"), "page_id")
    h, m = attr("href"), F.col("pos") % 7
    value = (
        F.when(m == 0, F.concat(F.lit("mailto:"), h)).when(m == 1, h).when(m == 2, F.substring(h, 2, 1 << 30)).when(m == 3, F.concat(F.lit("//cdn.x"), h))
        .when(m == 4, F.lit("#t")).when(m == 5, F.concat(F.lit("HTTP://EX.com"), h)).otherwise(F.concat(F.lit("/a/./../b"), h))
    )
    out = coerce(links.select("page_id", "pos", "url", value.alias("value"), F.lit("string").alias("json_type")), "url")
    issue = validate.issue_text(F.col("code"), F.col("value"), F.col("json_type"))
    return out.select("page_id", "pos", F.when(F.col("code").isNull(), F.col("clean")).alias("abs_url"), issue.alias("issue"))


@query(
    "valid_http_url",
    "SELECT page_id, true AS whole, false AS ftp, false AS bare, true AS upper_case, false AS no_host FROM pages",
)
def valid_http_url(spark, sf):
    u = F.col("url")
    forms = {
        "whole": u, "ftp": F.regexp_replace(u, "^https?", "ftp"), "bare": F.regexp_replace(u, "^https?://", ""), "upper_case": F.upper(u),
        "no_host": F.regexp_extract(u, "^(https?://)", 1),
    }
    return pages(spark, sf).select("page_id", *[is_http_url(c).alias(k) for k, c in forms.items()])


@query(
    "coerce_date",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 6 THEN NULL WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%dT10:00:00.000Z') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') END AS iso,
         CASE WHEN o_orderkey % 7 = 6 THEN 'date_unparsed' END AS code FROM orders""",
)
def coerce_date(spark, sf):
    m, d = F.col("o_orderkey") % 7, F.col("o_orderdate").cast("timestamp")
    layouts = ["yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd'T'10:00:00'Z'"]
    value = F.when(m == 6, F.lit("garbage")).when(m == 5, F.unix_millis(d).cast("string"))
    for i, f in enumerate(layouts):
        value = value.when(m == i, F.date_format(d, f))
    rows = heavy(spark, sf, "orders").select(
        "o_orderkey", value.alias("value"), F.when(m == 5, F.lit("number")).otherwise(F.lit("string")).alias("json_type"), F.lit(None).cast("string").alias("url")
    )
    return coerce(rows, "date").select("o_orderkey", F.when(F.col("code").isNull(), F.col("clean")).alias("iso"), "code")


@query(
    "coerce_string",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_name END AS clean,
         CASE WHEN p_partkey % 2 = 0 THEN 'Type mismatch: Expected string, got number. Converting.' END AS issue FROM part""",
)
def coerce_string(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(even, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \n ")))).alias("value"),
        F.when(even, F.lit("number")).otherwise(F.lit("string")).alias("json_type"), F.lit(None).cast("string").alias("url"),
    )
    out = coerce(rows, "string")
    return out.select("p_partkey", "clean", validate.issue_text(F.col("code"), F.col("value"), F.col("json_type")).alias("issue"))


def pair_pages(spark, sf, notes):
    """Two list items per page, NULL for large sizes; validated under the given notes."""
    p = table(spark, sf, "part").select((F.floor(F.col("p_partkey") / 2)).alias("page_id"), "p_partkey", "p_size", "p_name")
    raw = raw_rows(p, F.col("page_id"), F.lit("names"), F.lit("list"), F.col("p_partkey") % 2, F.when(F.col("p_size") <= 25, F.col("p_name")))
    pg = p.select("page_id", F.lit("http://shop.example.com/").alias("url")).distinct()
    return validate.validate(raw, pg, [DataPoint("names", is_list=True, notes=notes), DataPoint("more", is_list=True, notes=notes), DataPoint("one", notes=notes)])


@query("clean_list", "SELECT p_partkey // 2 AS page_id, (p_partkey % 2)::BIGINT AS pos, p_name AS clean FROM part WHERE p_size <= 25")
def clean_list(spark, sf):
    values, _ = pair_pages(spark, sf, None)
    return values.filter("dp_id = 'names'").select("page_id", long("pos").alias("pos"), "clean")


@query(
    "list_emptied",
    "SELECT p_partkey // 2 AS page_id, 'List empty after validation/cleaning.' AS issue, count(*) AS original_count FROM part GROUP BY 1 HAVING min(p_size) > 25",
)
def list_emptied(spark, sf):
    _, issues = pair_pages(spark, sf, "Optional field")
    return issues.select("page_id", "issue", "original_count")


@query("required_list", "SELECT DISTINCT p_partkey // 2 AS page_id, 'more' AS dp_id, 'Required list is empty.' AS issue FROM part")
def required_list(spark, sf):
    _, issues = pair_pages(spark, sf, "must be there")
    return issues.filter("code = 'required_list'").select("page_id", "dp_id", "issue")


@query("required_item", "SELECT DISTINCT p_partkey // 2 AS page_id, 'one' AS dp_id, 'Required item is missing or null.' AS issue FROM part")
def required_item(spark, sf):
    _, issues = pair_pages(spark, sf, "must be there")
    return issues.filter("code = 'required_item'").select("page_id", "dp_id", "issue")


@query(
    "all_issues",
    f"SELECT page_id, dp_id, code, value FROM ({SHAPE_SQL}) UNION ALL SELECT p_partkey, 'price', 'no_match', NULL FROM part WHERE p_size = 1",
)
def all_issues(spark, sf):
    p = part_pages(spark, sf)
    _, issues = validate.validate(shape_raw(p), p.select("page_id", "url"), [DataPoint("name"), DataPoint("tags", is_list=True)])
    errors = p.filter("p_size = 1").select("page_id", F.lit("price").alias("dp_id"), F.lit("no_match").alias("code"))
    return validate.all_issues(errors, issues).select("page_id", "dp_id", "code", "value")


@query(
    "final_selectors",
    """SELECT p_name || p_size AS dp_id, min(CASE WHEN p_partkey % 3 > 0 THEN p_partkey END) AS first_key,
         '.c' || min(CASE WHEN p_partkey % 3 > 0 THEN p_partkey END) AS selector FROM part GROUP BY 1""",
)
def final_selectors(spark, sf):
    p = table(spark, sf, "part").withColumn("dp_id", F.concat("p_name", F.col("p_size").cast("string")))
    made = p.filter("p_partkey % 3 > 0").select("dp_id", F.concat(F.lit(".c"), F.col("p_partkey").cast("string")).alias("selector"), F.col("p_partkey").alias("rank"))
    out = validate.final_selectors(p.select("dp_id").distinct(), made)
    return out.select("dp_id", F.substring("selector", 3, 20).cast("long").alias("first_key"), "selector")


PLAN = [
    PlannedField(DataPoint("title", notes="required"), "article > h1"),
    PlannedField(DataPoint("links", "url", True, "required"), "nav a", "attribute"),
    PlannedField(DataPoint("de_only", notes="required"), "html[lang='de'] title"),
    PlannedField(DataPoint("price", "number", notes="Optional"), "span.price"),
]


def full_run(spark, sf):
    return extraction.run(pages(spark, sf), PLAN, (), nodes(spark, sf))


@query(
    "run_summary",
    f"""SELECT page_id, true AS success, (1 + len(regexp_extract_all(html, '<a ')) + ({SQL_LANG_DE})::INT)::BIGINT AS n_values,
          (CASE WHEN {SQL_LANG_DE} THEN 1 ELSE 3 END)::BIGINT AS n_issues FROM pages""",
)
def run_summary(spark, sf):
    """Whole job: extraction errors and validation issues per page."""
    return full_run(spark, sf).summary


@query(
    "quality_report",
    f"""WITH g AS (SELECT {SQL_HOST} AS host, d.dp_id, CASE d.dp_id WHEN 'price' THEN false WHEN 'de_only' THEN {SQL_LANG_DE} ELSE true END AS done
           FROM pages, (VALUES ('title'), ('links'), ('de_only'), ('price')) d(dp_id)),
        r AS (SELECT host, dp_id, grouping_id(host, dp_id)::BIGINT AS level, count(*) AS n_fields, sum(done::INT)::BIGINT AS n_complete,
           sum(done::INT)::BIGINT AS n_compliant, sum(CASE WHEN done THEN 0 WHEN dp_id = 'price' THEN 1 ELSE 2 END)::BIGINT AS n_issues FROM g GROUP BY ROLLUP (host, dp_id))
        SELECT *, round(100.0 * n_complete / n_fields, 2)::DOUBLE AS completeness, round(100.0 * n_compliant / n_fields, 2)::DOUBLE AS compliance,
          CASE WHEN n_complete = n_fields THEN 'PASSED' WHEN n_complete = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM r""",
)
def quality_report(spark, sf):
    res = full_run(spark, sf)
    pg = pages(spark, sf)
    planned = validate.plan_grid(pg, [f.point for f in PLAN])
    return validate.quality_report(res.values, pg, planned, res.issues)


@query(
    "field_outliers",
    """WITH s AS (SELECT l_returnflag AS g, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1)
       SELECT l_returnflag, count(*) AS n, sum((abs((l_extendedprice - m) / sd) > 1.8)::INT)::BIGINT AS n_outliers FROM lineitem JOIN s ON g = l_returnflag GROUP BY 1""",
)
def field_outliers(spark, sf):
    scored = validate.outliers(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", 1.8)
    return scored.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("n_outliers"))


@query(
    "field_patterns",
    """WITH p AS (SELECT p_type AS field, regexp_replace(regexp_replace(p_name || ' ' || p_size, '\\p{L}', 'a', 'g'), '[0-9]', '9', 'g') AS pattern, count(*) AS n FROM part GROUP BY 1, 2)
       SELECT field, arg_min(pattern, {'n': -n, 'p': pattern}) AS top_pattern, max(n) AS n_top, sum(n)::BIGINT AS n_values, count(*) AS n_patterns FROM p GROUP BY field""",
)
def field_patterns(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_type").alias("field"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("value"))
    return validate.field_patterns(v, "field", "value")
