"""Scans, sinks, store and template queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.checks.base import SQL_HOST, SQL_LINKS, card_nodes, cards, long, nodes, pages, query, table
from gleanery.functions.scalars import url_host
from gleanery.operators import batch, logs, store
from gleanery.operators.extract import Field, dom_extract
from gleanery.sources import export
from gleanery.sources.nodes import accepted

CARD_FIELDS = [
    Field("key", None, "data-key"),
    Field("name", "h2.name"),
    Field("price", ".price", None, "number"),
    Field("href", "a", "href", "url"),
    Field("img", "p > img", "src"),
    Field("brand", ".brand", None, "uppercase"),
    Field("nothing", ".absent"),
]


def card_records(spark, sf, cap=None, per_page=20):
    return dom_extract(card_nodes(spark, sf, per_page), "ul.grid > li.card", None, CARD_FIELDS, cards(spark, sf, per_page), cap)


@query("page_scan", "SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages WHERE html IS NOT NULL AND url IS NOT NULL")
def page_scan(spark, sf):
    return accepted(pages(spark, sf)).select("page_id", "url", long(F.length("html")).alias("n_chars"))


@query("page_content", "SELECT page_id, md5(html) AS html_md5, length(html)::BIGINT AS n_chars FROM pages")
def page_content(spark, sf):
    return pages(spark, sf).select("page_id", F.md5("html").alias("html_md5"), long(F.length("html")).alias("n_chars"))


@query("export_csv_lines", "SELECT p_partkey || ',' || p_name || ',' || p_retailprice AS line FROM part")
def export_csv_lines(spark, sf):
    return card_records(spark, sf).select(export.csv_line("key", "name", "price").alias("line"))


@query(
    "export_json_lines",
    """SELECT '{"key":"' || p_partkey || '","name":"' || p_name || '","price":' || p_retailprice || ',"nothing":null}' AS line FROM part""",
)
def export_json_lines(spark, sf):
    return card_records(spark, sf).select(export.json_line("key", "name", "price", "nothing").alias("line"))


@query(
    "result_preview",
    """SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, p_retailprice AS price FROM part
       WHERE p_retailprice < 950 ORDER BY p_retailprice DESC, p_partkey LIMIT 50""",
)
def result_preview(spark, sf):
    rows = card_records(spark, sf).select("key", "name", "price")
    return export.preview(rows, F.col("price") < 950, [F.desc("price"), F.col("key").cast("long")], 50)


@query(
    "result_nested_json",
    """SELECT page_id, '{"page_id":' || page_id || ',"records":[' || string_agg(r, ',' ORDER BY p_partkey) || ']}' AS json FROM (
         SELECT p_partkey // 20 AS page_id, p_partkey, '{"rec_no":' || (row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey))
           || ',"name":"' || p_name || '","price":' || p_retailprice || '}' AS r FROM part) GROUP BY page_id""",
)
def result_nested_json(spark, sf):
    return export.nested_json(card_records(spark, sf), "page_id", "rec_no", ["name", "price"])


LOG_SQL = """
log AS (SELECT ['local','sync','managed'][1 + user_id % 3] AS area, CAST(user_id AS VARCHAR) AS key, props AS value, ts, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'signup' AND user_id % 50 = 7 THEN 'clear' ELSE 'set' END AS op FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY area, key ORDER BY ts DESC, seq DESC) AS rn FROM log WHERE op <> 'clear') WHERE rn = 1),
wiped AS (SELECT area, max({'ts': ts, 'seq': seq}) AS c FROM log WHERE op = 'clear' GROUP BY area),
live AS (SELECT l.area, l.key, l.value FROM last l LEFT JOIN wiped w USING (area)
  WHERE op = 'set' AND (w.c IS NULL OR l.ts > w.c.ts OR (l.ts = w.c.ts AND l.seq > w.c.seq)))
"""


def change_log(spark, sf):
    e = table(spark, sf, "events")
    area = F.array(F.lit("local"), F.lit("sync"), F.lit("managed"))[(F.col("user_id") % 3).cast("int")]
    clear = (F.col("event_type") == "signup") & (F.col("user_id") % 50 == 7)
    op = F.when(F.col("event_type") == "error", F.lit("remove")).when(clear, F.lit("clear")).otherwise(F.lit("set"))
    return e.select(
        area.alias("area"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), op.alias("op"), "ts",
        F.col("event_id").alias("seq"),
    )


@query("store_latest", f"WITH {LOG_SQL} SELECT area, key, value FROM last WHERE op = 'set'")
def store_latest(spark, sf):
    return store.latest_ops(change_log(spark, sf)).filter("op = 'set'").select("area", "key", "value")


@query("store_remove", f"WITH {LOG_SQL} SELECT area, key FROM last WHERE op = 'remove'")
def store_remove(spark, sf):
    return store.removed_keys(change_log(spark, sf)).select("area", "key")


@query(
    "store_clear",
    f"""WITH {LOG_SQL} SELECT area, count(*) AS n_set, (SELECT count(*) FROM live v WHERE v.area = l.area) AS n_live
        FROM last l WHERE op = 'set' GROUP BY area""",
)
def store_clear(spark, sf):
    log = change_log(spark, sf)
    live = store.snapshot(log).groupBy("area").agg(F.count("*").alias("n_live"))
    kept = store.latest_ops(log).filter("op = 'set'").groupBy("area").agg(F.count("*").alias("n_set"))
    return kept.join(live, "area", "left").select("area", "n_set", F.coalesce("n_live", F.lit(0)).alias("n_live"))


@query("store_snapshot", f"WITH {LOG_SQL} SELECT area, key, value FROM live")
def store_snapshot(spark, sf):
    return store.snapshot(change_log(spark, sf)).select("area", "key", "value")


@query(
    "store_get",
    f"""WITH {LOG_SQL}, want AS (SELECT DISTINCT area, key FROM log UNION SELECT DISTINCT area, 'x' || key FROM log)
        SELECT w.area, w.key, v.area IS NOT NULL AS found, CASE WHEN v.area IS NULL THEN 'none' ELSE v.value END AS value
        FROM want w LEFT JOIN live v ON v.area = w.area AND v.key = w.key""",
)
def store_get(spark, sf):
    log = change_log(spark, sf)
    asked = log.select("area", F.explode(F.array("key", F.concat(F.lit("x"), "key"))).alias("key")).distinct()
    return store.get(store.snapshot(log), asked, F.lit("none"))


@query(
    "template_apply",
    f"""WITH p AS (SELECT page_id, {SQL_HOST} AS host FROM pages)
        SELECT p.page_id, p.host, 'tpl-' || t.first_page AS template, 'article h1' AS selector
        FROM p JOIN (SELECT host, min(page_id) AS first_page FROM p GROUP BY host) t USING (host)""",
)
def template_apply(spark, sf):
    pg = pages(spark, sf).select("page_id", "url")
    saved = pg.groupBy(url_host(F.col("url")).alias("host")).agg(F.min("page_id").alias("first_page"))
    saved = saved.select("host", F.concat(F.lit("tpl-"), F.col("first_page").cast("string")).alias("template"), F.lit("article h1").alias("selector"))
    return batch.apply_templates(pg, saved).select("page_id", "host", "template", "selector")


@query(
    "service_health",
    """SELECT s.service, coalesce(l.event_type <> 'error', false) AS healthy, coalesce(l.n, 0)::BIGINT AS n_checks
       FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS service FROM events UNION SELECT DISTINCT 'never-' || user_id FROM events) s
       LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS service, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type, count(*) AS n
                  FROM events GROUP BY 1) l USING (service)""",
)
def service_health(spark, sf):
    e = table(spark, sf, "events")
    checks = e.select(F.col("user_id").cast("string").alias("service"), (F.col("event_type") != "error").alias("ok"), "ts", F.col("event_id").alias("seq"))
    names = checks.select(F.explode(F.array("service", F.concat(F.lit("never-"), "service"))).alias("service")).distinct()
    return store.service_health(checks, names)


@query(
    "plan_latest_version",
    """SELECT user_id AS plan_id, body, n_versions, refined FROM (
         SELECT user_id, event_type AS body, event_type = 'purchase' AS refined, count(*) OVER (PARTITION BY user_id) AS n_versions,
                row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def plan_latest_version(spark, sf):
    e = table(spark, sf, "events")
    parent = F.when(F.col("event_type") == "purchase", F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    versions = e.select(
        F.col("user_id").alias("plan_id"), F.col("event_id").alias("version_id"), "ts", parent.alias("parent_ts"), F.col("event_type").alias("body")
    )
    return batch.latest_versions(versions, "plan_id").select("plan_id", "body", "n_versions", "refined")


@query("plan_lineage", "SELECT p_partkey AS version_id, 1 + (p_partkey - 1) % 25 AS original, (p_partkey - 1) // 25 AS depth FROM part")
def plan_lineage(spark, sf):
    """Every version refines the one 25 keys before it."""
    k = F.col("p_partkey")
    return batch.lineage(table(spark, sf, "part").select(k.alias("version_id"), F.when(k > 25, k - 25).alias("parent_id")))


@query(
    "template_extract",
    f"""WITH {SQL_LINKS} SELECT page_id, {SQL_HOST} AS grp, pos AS rec_no, trim(txt) AS txt, NULL AS code FROM links WHERE {SQL_HOST} LIKE '%.org'
        UNION ALL SELECT page_id, {SQL_HOST}, NULL, NULL, 'no_plan' FROM pages WHERE {SQL_HOST} NOT LIKE '%.org'""",
)
def template_extract(spark, sf):
    """Selectors saved for some hosts, applied to all pages; pages of other hosts are reported."""
    pg = pages(spark, sf)
    hosts = pg.select(url_host(F.col("url")).alias("host")).filter("host LIKE '%.org'").distinct()
    saved = hosts.select(F.lit("menu").alias("name"), "host", F.lit("nav li").alias("css"), F.lit(None).cast("string").alias("xpath"))
    out, missed = batch.template_extract(pg, nodes(spark, sf), saved, "menu", [Field("txt", "a")])
    return out.select("page_id", "grp", long("rec_no").alias("rec_no"), F.trim("txt").alias("txt"), F.lit(None).cast("string").alias("code")).unionByName(
        missed.select("page_id", "grp", "code"), allowMissingColumns=True
    )


LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info' WHEN 'click' THEN 'log' ELSE 'debug' END"


def event_logs(spark, sf):
    level = F.create_map(*[F.lit(x) for kv in (("error", "error"), ("purchase", "warn"), ("signup", "info"), ("click", "log"), ("view", "debug")) for x in kv])
    return table(spark, sf, "events").select(
        "event_id", "ts", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("context"),
        F.try_element_at(level, F.col("event_type")).alias("level"), F.col("props").alias("message"),
    )


@query("log_filter", f"SELECT event_id, {LEVEL_SQL} AS level FROM events WHERE event_type IN ('error', 'purchase', 'signup')")
def log_filter(spark, sf):
    return logs.at_least(event_logs(spark, sf), "info").select("event_id", "level")


@query(
    "log_format",
    "SELECT event_id, '[' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z] [user' || user_id || '] ' || props AS line FROM events",
)
def log_format(spark, sf):
    return event_logs(spark, sf).select("event_id", logs.log_line(F.col("ts"), F.col("context"), F.col("message")).alias("line"))


@query(
    "log_windows",
    f"""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, {LEVEL_SQL} AS level, count(*) AS n
        FROM events GROUP BY 1, 2""",
)
def log_windows(spark, sf):
    return logs.window_counts(event_logs(spark, sf), "6 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "level", "n")


@query(
    "log_windows_sliding",
    f"""SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, level, count(*) AS n FROM (
          SELECT {LEVEL_SQL} AS level, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events)
        GROUP BY 1, 2""",
)
def log_windows_sliding(spark, sf):
    out = logs.window_counts(event_logs(spark, sf), "12 hours", "6 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "level", "n")
