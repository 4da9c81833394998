"""Recovery, multi-page, multi-run and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.checks.base import SQL_HOST, SQL_LINKS, long, nodes, pages, query, sql_plain, table
from gleanery.checks.dom import SQL_LANG_DE
from gleanery.checks.scans import LOG_SQL, change_log, event_logs
from gleanery.operators import batch, extract, recover
from gleanery.operators.extract import Field
from gleanery.operators.selector_table import matches_on
from gleanery.operators.selectors import select_css
from gleanery.operators.validate import DataPoint
from gleanery.plans.extraction import PlannedField
from gleanery.session import scratch, written
from gleanery.sources.nodes import parse_pages
from gleanery.streaming import feeds

TRIED = [("first_link", "nav > ul.menu > li:nth-child(1) a"), ("second", "ul > li:nth-of-type(99)"), ("ad", "div#ad"), ("gone", "video.x")]
RULES_SQL = """(VALUES ('first_link', 'generalise', 'nav > ul.menu > li a'), ('first_link', 'parent_child', 'li:nth-child(1) a'), ('second', 'generalise', 'ul > li'))"""


def page_errors(spark, sf):
    """Every planned field failed on every page; one field is not in the plan."""
    return pages(spark, sf).select("page_id", F.explode(F.array(*[F.lit(d) for d, _ in TRIED], F.lit("unplanned"))).alias("dp_id"))


def failed(spark, sf):
    return recover.failed_fields(page_errors(spark, sf), dict(TRIED))


@query("failed_fields", "SELECT page_id, d.dp_id, d.selector FROM pages, (VALUES " + ", ".join(f"('{d}', '{s}')" for d, s in TRIED) + ") d(dp_id, selector)")
def failed_fields(spark, sf):
    return failed(spark, sf).select("page_id", "dp_id", "selector")


@query(
    "recovery_attempts",
    """SELECT user_id AS page_id, event_type AS dp_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events
       QUALIFY attempt <= 2""",
)
def recovery_attempts(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("page_id"), F.col("event_type").alias("dp_id"), "event_id", "ts")
    return recover.attempts(e, "ts", "event_id", limit=2).select("page_id", "dp_id", "event_id", long("attempt").alias("attempt"))


def working(spark, sf):
    return recover.working_alternatives(nodes(spark, sf), recover.proposals(failed(spark, sf)))


RECOVERED_SQL = """
SELECT page_id, 'first_link' AS dp_id, 'parent_child' AS strategy, 'li:nth-child(1) a' AS selector, 1::BIGINT AS n FROM pages
UNION ALL SELECT page_id, 'second', 'generalise', 'ul > li', len(regexp_extract_all(html, '<li>'))::BIGINT FROM pages"""


@query("recover_selectors", RECOVERED_SQL)
def recover_selectors(spark, sf):
    return working(spark, sf).select("page_id", "dp_id", "strategy", "selector", "n")


@query(
    "recover_reextract",
    f"""WITH {SQL_LINKS} SELECT page_id, 'first_link' AS dp_id, 'scalar' AS raw_kind, 0::BIGINT AS pos, href AS value FROM links WHERE pos = 1
        UNION ALL SELECT page_id, 'second', 'list', pos - 1, trim(txt) FROM links""",
)
def recover_reextract(spark, sf):
    chosen = written(recover.chosen_alternative(working(spark, sf)), "chosen")
    plan = {"first_link": (False, "attribute", "href"), "second": (True, "text", ""), "ad": (False, "text", ""), "gone": (False, "text", "")}
    out = recover.reextract(chosen, nodes(spark, sf), pages(spark, sf), plan)
    return out.select("page_id", "dp_id", "raw_kind", long("pos").alias("pos"), "value")


@query("errors_remaining", "SELECT page_id, d.dp_id FROM pages, (VALUES ('ad'), ('gone'), ('unplanned')) d(dp_id)")
def errors_remaining(spark, sf):
    return recover.errors_remaining(page_errors(spark, sf), recover.chosen_alternative(working(spark, sf))).select("page_id", "dp_id")


@query(
    "generalize_selector",
    """SELECT p_partkey, 'ul#g' || p_partkey || ' > li > a.x' AS generalised, 'li:nth-child(' || p_size || ') > a.x:first-child' AS without_lead,
         'ul[id*="g' || p_partkey || '"] > li:nth-child(' || p_size || ') > a[class*="x"]:first-child' AS by_attribute FROM part""",
)
def generalize_selector(spark, sf):
    s = F.format_string("ul#g%d > li:nth-child(%d) > a.x:first-child", "p_partkey", "p_size")
    forms = {"generalised": recover.generalised, "without_lead": recover.without_lead, "by_attribute": recover.by_attribute}
    return table(spark, sf, "part").select("p_partkey", *[f(s).alias(k) for k, f in forms.items()])


@query(
    "recovery_rate",
    f"SELECT {SQL_HOST} AS host, 4 * count(*) AS n_failed, 2 * count(*) AS n_recovered, 0.5::DOUBLE AS rate FROM pages GROUP BY 1",
)
def recovery_rate(spark, sf):
    lost = failed(spark, sf).join(batch.with_group(pages(spark, sf)).select("page_id", "host"), "page_id")
    return recover.recovery_rate(lost, recover.chosen_alternative(working(spark, sf)), "host")


@query(
    "distinct_selectors",
    """SELECT p_brand AS grp, '.c' || p_size AS selector, min(p_partkey) AS first_pos FROM part GROUP BY 1, 2""",
)
def distinct_selectors(spark, sf):
    """Ordered distinct over rows: each value at its first position."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.concat(F.lit(".c"), F.col("p_size").cast("string")).alias("selector"), "p_partkey")
    return p.groupBy("grp", "selector").agg(F.min("p_partkey").alias("first_pos"))


SQL_SHAPE = "regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[0-9]+', '{n}', 'g'), '/$', '')"


@query("url_groups", f"SELECT {SQL_HOST} AS host, {SQL_SHAPE} AS shape, count(*) AS n_pages, min(page_id) AS first_page FROM pages GROUP BY 1, 2")
def url_groups(spark, sf):
    return batch.url_groups(pages(spark, sf))


@query("host_profile", f"SELECT {SQL_HOST} AS host, count(*) AS n_pages, true AS close FROM pages GROUP BY 1")
def host_profile(spark, sf):
    """The estimate itself is not comparable in SQL; its error against the exact count is."""
    pg = pages(spark, sf)
    exact = pg.select("url").distinct().groupBy(batch.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n_urls"))
    both = batch.host_profile(pg).join(exact, "host")
    return both.select("host", "n_pages", (F.abs(F.col("approx_urls") - F.col("n_urls")) <= 1 + 0.1 * F.col("n_urls")).alias("close"))


@query(
    "pagination_series",
    """WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '([?&])page=[0-9]+&?', '\\1'), '#.*$', ''), '[?&]$', '') AS base_url,
         regexp_extract(url, '[?&]page=([0-9]+)', 1) AS no FROM pages)
       SELECT page_id, base_url, no::BIGINT AS page_no, row_number() OVER (PARTITION BY base_url ORDER BY no::BIGINT, page_id) AS place FROM s WHERE no <> '' QUALIFY place <= 10""",
)
def pagination_series(spark, sf):
    out = batch.pagination_series(pages(spark, sf), 10)
    return out.select("page_id", "base_url", long("page_no").alias("page_no"), long("place").alias("place"))


def grouped(spark, sf):
    return pages(spark, sf).select("page_id", F.regexp_extract("url", r"//[^/]*/([a-z]{2})/", 1).alias("grp"))


GROUP_PLANS = (("en", "nav li", None), ("fr", ".none", "//nav/ul/li[2]"), ("es", "video", "//video"), ("xx", "p", None))
SQL_GRP = "regexp_extract(url, '//[^/]*/([a-z]{2})/', 1)"


@query(
    "batch_extract",
    f"""WITH {SQL_LINKS} SELECT page_id, {SQL_GRP} AS grp, pos AS rec_no, txt FROM links WHERE {SQL_GRP} = 'en' OR ({SQL_GRP} = 'fr' AND pos = 2)""",
)
def batch_extract(spark, sf):
    out, _ = batched(spark, sf)
    rec = F.when(F.col("grp") == "fr", F.lit(2)).otherwise(F.col("rec_no"))
    return out.select("page_id", "grp", long(rec).alias("rec_no"), "txt")


def batched(spark, sf):
    rows = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(c).cast("string").alias("css"), F.lit(x).cast("string").alias("xpath")) for g, c, x in GROUP_PLANS])
    plans = spark.range(1).select(F.explode(rows).alias("_p")).select("_p.*")
    return batch.batch_extract(nodes(spark, sf), grouped(spark, sf), plans, [Field("txt", "a")], pages(spark, sf))


@query(
    "batch_issues",
    f"""SELECT page_id, {SQL_GRP} AS grp, CASE {SQL_GRP} WHEN 'es' THEN 'no_match' ELSE 'no_plan' END AS code FROM pages WHERE {SQL_GRP} NOT IN ('en', 'fr')""",
)
def batch_issues(spark, sf):
    """Pages without records: their group has no plan, or its selectors find nothing."""
    return batched(spark, sf)[1].select("page_id", "grp", "code")


@query(
    "selectors_by_table",
    f"""WITH {SQL_LINKS} SELECT page_id, 'li:nth-of-type(' || (1 + page_id % 7) || ') > a' AS selector, txt FROM links WHERE pos = 1 + page_id % 7
        UNION ALL SELECT page_id, '//a[@href="' || href || '"]', txt FROM links WHERE pos = 1""",
)
def selectors_by_table(spark, sf):
    """Two selectors of its own for every page, as many as there are pages."""
    ns = nodes(spark, sf)
    first = batch.next_page_links(pages(spark, sf), ns, "li:first-child > a").select("page_id", F.concat(F.lit('//a[@href="'), "href", F.lit('"]')).alias("selector"))
    place = pages(spark, sf).select("page_id", F.format_string("li:nth-of-type(%d) > a", F.col("page_id") % 7 + 1).alias("selector"))
    found = matches_on(ns, place.unionByName(first))
    return found.join(ns.filter("kind = 'element'").select("page_id", "pre", F.col("text").alias("txt")), ["page_id", "pre"]).select("page_id", "selector", "txt")


@query(
    "recover_from_responses",
    f"""WITH {SQL_LINKS} SELECT page_id, 'second' AS dp_id, 'answers' AS strategy, 'li:nth-of-type(' || (1 + page_id % 4) || ')' AS selector, txt AS value FROM links WHERE pos = 1 + page_id % 4
        UNION ALL SELECT page_id, 'ad', 'answers', 'div.ad', {sql_plain("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} FROM pages""",
)
def recover_from_responses(spark, sf):
    """Alternatives of each page from answers about it; the answers come from a stand-in for a model."""
    ns, pg = nodes(spark, sf), pages(spark, sf)
    lost = failed(spark, sf).filter("dp_id IN ('second', 'ad', 'gone')")
    strategies = (recover.from_answers(pg, stand_in), *recover.RULES)
    chosen = written(recover.chosen_alternative(recover.working_alternatives(ns, recover.proposals(lost, strategies))), "chosen")
    plan = {k: (False, "text", "") for k in ("second", "ad", "gone")}
    again = recover.reextract(chosen, ns, pg, plan)
    return again.join(chosen, ["page_id", "dp_id"]).select("page_id", "dp_id", "strategy", "selector", "value")


def stand_in(prompts):
    """Answers that depend on the page and the field; one field gets no usable proposal."""
    import json

    said = []
    for page, field in zip(prompts["page_id"], prompts["dp_id"]):
        good = [".none", f"li:nth-of-type({1 + page % 4})"] if field == "second" else ["div.ad"] if field == "ad" else ["video.y"]
        said.append(json.dumps(good))
    return prompts[["page_id", "dp_id"]].assign(text=said)


@query(
    "sample_per_group",
    f"""WITH {SQL_LINKS}, f AS (SELECT min(page_id) AS page_id FROM pages GROUP BY {SQL_GRP})
        SELECT page_id, pos AS rec_no, txt FROM links JOIN f USING (page_id) WHERE pos <= 5""",
)
def sample_per_group(spark, sf):
    first = batch.first_of_group(grouped(spark, sf))
    out = extract.dom_extract(nodes(spark, sf), "nav li", None, [Field("txt", "a")], cap=5, only=first)
    return out.select("page_id", long("rec_no").alias("rec_no"), "txt")


def day_runs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("run_ts"), F.col("user_id").alias("key")).agg(F.count("*").alias("value"))


DAY_SQL = "d AS (SELECT CAST(ts AS DATE) AS run_ts, user_id AS key, count(*) AS value FROM events GROUP BY 1, 2)"


@query(
    "run_diff",
    f"""WITH {DAY_SQL}, a AS (SELECT * FROM d WHERE run_ts = DATE '2024-01-05'), b AS (SELECT * FROM d WHERE run_ts = DATE '2024-01-06')
        SELECT coalesce(a.key, b.key) AS key, a.value AS old_value, b.value AS new_value,
          CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN a.value = b.value THEN 'same' ELSE 'changed' END AS change
        FROM a FULL JOIN b ON a.key = b.key""",
)
def run_diff(spark, sf):
    d = day_runs(spark, sf)
    return batch.run_diff(d.filter("run_ts = '2024-01-05'"), d.filter("run_ts = '2024-01-06'"), ["key"], "value")


@query(
    "run_trend",
    f"""WITH {DAY_SQL} SELECT key, strftime(run_ts, '%Y-%m-%d') AS run_day, value, lag(value) OVER w AS previous, value - lag(value) OVER w AS delta
        FROM d WINDOW w AS (PARTITION BY key ORDER BY run_ts)""",
)
def run_trend(spark, sf):
    out = batch.run_trend(day_runs(spark, sf), "key", "value")
    return out.select("key", F.date_format("run_ts", "yyyy-MM-dd").alias("run_day"), "value", "previous", "delta")


# --- streams: run over what is there, then read the sink ---


def _feed(spark, sf, name):
    """A file source wants a folder or a pattern; this pattern matches the one table file."""
    rows = feeds.file_feed(spark, f"{sf}/[{name[0]}]{name[1:]}.parquet", table(spark, sf, name).schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else rows


def _finish(q):
    q.awaitTermination()


@query("stream_page_extract", f"WITH {SQL_LINKS} SELECT page_id, href FROM links")
def stream_page_extract(spark, sf):
    out, ck = scratch(spark, "pages-out"), scratch(spark, "pages-ck")
    links = lambda p: select_css(parse_pages(p), "nav li a", "attrs").select("page_id", F.try_element_at("attrs", F.lit("href")).alias("href"))
    _finish(feeds.page_feed(_feed(spark, sf, "pages"), out, ck, links))
    return spark.read.schema("page_id long, href string, batch int").parquet(out).drop("batch")


@query(
    "stream_page_records",
    f"""WITH {SQL_LINKS} SELECT page_id, 'links' AS dp_id, pos - 1 AS pos, href AS value FROM links
        UNION ALL SELECT page_id, 'gone', NULL, 'no_match' FROM pages UNION ALL SELECT page_id, 'gone', NULL, 'required_item' FROM pages""",
)
def stream_page_records(spark, sf):
    """The whole job on arriving pages: values and, with their code as value, issues."""
    out, ck = scratch(spark, "job-out"), scratch(spark, "job-ck")
    plan = [PlannedField(DataPoint("links", is_list=True), "nav a", "attribute"), PlannedField(DataPoint("gone", notes="needed"), "video")]
    _finish(feeds.job_feed(_feed(spark, sf, "pages"), out, ck, plan))
    values = spark.read.schema("page_id long, dp_id string, pos int, clean string, batch int").parquet(f"{out}/values").filter("clean IS NOT NULL")
    issues = spark.read.schema("page_id long, dp_id string, pos int, code string, batch int").parquet(f"{out}/issues")
    return values.select("page_id", "dp_id", long("pos").alias("pos"), F.col("clean").alias("value")).unionByName(
        issues.select("page_id", "dp_id", long("pos").alias("pos"), F.col("code").alias("value"))
    )


@query(
    "stream_log_windows",
    """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type AS level, count(*) AS n FROM events GROUP BY 1, 2""",
)
def stream_log_windows(spark, sf):
    out, ck = scratch(spark, "win-out"), scratch(spark, "win-ck")
    logs = _feed(spark, sf, "events").select("ts", F.col("event_type").alias("level"))
    _finish(feeds.log_window_feed(logs, out, ck, "6 hours", None, "1 day"))
    rows = spark.read.schema("start timestamp, end timestamp, level string, n long, batch int").parquet(out)
    return feeds.newest(rows, ["start", "level"], ["n"]).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "level", "n")


@query("stream_store", f"WITH {LOG_SQL} SELECT area, key, value FROM live")
def stream_store(spark, sf):
    """The change log in three batches that overlap in time; each writes the keys it changed."""
    feed, out, ck = (scratch(spark, f"store-{n}") for n in ("in", "out", "ck"))
    log = change_log_of(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    for third in range(3):
        log.filter(F.col("seq") % 3 == third).write.mode("append").parquet(feed)
        _finish(feeds.state_feed(feeds.file_feed(spark, feed, log.schema), out, ck))
    rows = spark.read.schema("area string, key string, op string, value string, ts timestamp, seq long, batch int").parquet(out)
    return feeds.live_entries(feeds.current_of(rows)).select("area", "key", "value")


def change_log_of(events):
    """Change log of an events stream; an area clear is an operation on key ``*``."""
    area = F.array(F.lit("local"), F.lit("sync"), F.lit("managed"))[(F.col("user_id") % 3).cast("int")]
    clear = (F.col("event_type") == "signup") & (F.col("user_id") % 50 == 7)
    op = F.when(F.col("event_type") == "error", F.lit("remove")).when(clear, F.lit("clear")).otherwise(F.lit("set"))
    key = F.when(clear, F.lit("*")).otherwise(F.col("user_id").cast("string"))
    return events.select(area.alias("area"), key.alias("key"), F.col("props").alias("value"), op.alias("op"), "ts", F.col("event_id").alias("seq"))


@query(
    "stream_page_changes",
    """WITH u AS (SELECT url, max(page_id) AS last, max(CASE WHEN page_id % 3 > 0 THEN page_id END) AS first, max(CASE WHEN page_id % 5 > 0 THEN page_id END) AS middle FROM pages GROUP BY url),
       c(crawl, url, body) AS (SELECT 1, url, first::VARCHAR FROM u WHERE first IS NOT NULL UNION ALL SELECT 2, url, middle || CASE WHEN middle % 3 = 1 THEN 'e' ELSE '' END FROM u WHERE middle IS NOT NULL
         UNION ALL SELECT 3, url, last || CASE last % 3 WHEN 1 THEN 'e' WHEN 2 THEN 't' ELSE '' END FROM u)
       SELECT coalesce(b.url, a.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' ELSE 'changed' END AS change
       FROM c b FULL JOIN (SELECT crawl + 1 AS crawl, url, body FROM c WHERE crawl < 3) a ON a.crawl = b.crawl AND a.url = b.url
       WHERE a.body IS DISTINCT FROM b.body""",
)
def stream_page_changes(spark, sf):
    """Three crawls of the page table: a third of the pages comes with the second, which edits another third and lacks a fifth; the third has all and edits the rest."""
    feed, out, ck = (scratch(spark, f"crawl-{n}") for n in ("in", "out", "ck"))
    crawls = page_crawls(pages(spark, sf))
    for crawl in crawls:
        crawl.write.mode("append").parquet(feed)
        _finish(feeds.change_feed(feeds.file_feed(spark, feed, crawl.schema), out, ck, gone_after_s=1 << 29))
    return spark.read.schema("url string, change string, batch int").parquet(out).drop("batch")


def page_crawls(pg):
    """Crawls lie a number of seconds apart that no page id reaches."""
    third = F.col("page_id") % 3
    edited = F.when(third == 1, F.concat("html", F.lit("<!-- edited -->"))).otherwise(F.col("html"))
    late = F.when(third == 1, F.concat("html", F.lit("<!-- edited -->"))).when(third == 2, F.concat("html", F.lit("<!-- too -->"))).otherwise(F.col("html"))
    at = lambda n: F.timestamp_seconds(F.col("page_id") + n * (1 << 30)).alias("ts")
    return [pg.filter(third > 0).select("url", at(0), "html"), pg.filter("page_id % 5 > 0").select("url", at(1), edited.alias("html")), pg.select("url", at(2), late.alias("html"))]


@query("stream_dedup", "SELECT DISTINCT event_type, props FROM events")
def stream_dedup(spark, sf):
    out, ck = scratch(spark, "dedup-out"), scratch(spark, "dedup-ck")
    rows = _feed(spark, sf, "events").select("ts", "event_type", "props")
    _finish(feeds.first_seen_feed(rows, ["event_type", "props"], out, ck, "90 days"))
    return spark.read.schema("event_type string, props string, batch int").parquet(out).select("event_type", "props")
