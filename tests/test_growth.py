"""Plans and partitions that must hold up when the tables grow."""

from pyspark.sql import functions as F

from gleanery.checks import QUERIES
from gleanery.operators import batch, selector_table, tables
from gleanery.session import spread, written
from gleanery.sources import nodes as N


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_rows_are_dealt_once(spark, tmp_path):
    html = "<table><tr><th>a<th>b<tr><td>1<td>2<td>3<tr><td>4<td>" + "x" * 600 + "</table><table><tr><td>p<tr><td>q</table>"
    short = html.replace("x" * 600, "y")
    for name, page in (("long", html), ("short", short)):
        pages = spark.createDataFrame([(1, page), (2, page.replace("<th>b", ""))], "page_id long, html string")
        N.parse_pages(pages).write.parquet(str(tmp_path / name))
        found = tables.table_rows(spark.read.parquet(str(tmp_path / name)))
        last = "x" * 600 if name == "long" else "y"
        got = sorted((x.page_id, x.table_pre, x.row_no, x.col_name, x.value) for x in found.collect())
        one = [("a", 1, "1"), ("b", 1, "2"), ("a", 2, "4"), ("b", 2, last)]
        want = [(1, r, c, v) for c, r, v in one] + [(2, r, c, v) for c, r, v in one if c == "a"] + [(1, 1, "p", "q"), (2, 1, "p", "q")]
        assert sorted((p, r, c, v) for p, _, r, c, v in got) == sorted(want)
    again = tables.table_rows(spark.read.parquet(str(tmp_path / "short")))  # not run yet, so its plan is there once
    assert plan(again).count("Exchange hashpartitioning") == 1


def test_rows_of_one_group_are_spread(spark, tmp_path):
    """A file with many splits whose rows all lie in one row group is read by one task."""
    rows = [(i, f"{i * 7919 % 9973:x} " * 40) for i in range(2000)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, "4096")
    try:
        scan = spark.read.parquet(str(tmp_path / "pages"))
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [len(p) for p in spread(scan, "page_id").select("page_id").rdd.glom().collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(sizes) == 2000 and max(sizes) < 1000


def test_lineage_sends_no_table_through_the_driver(spark, monkeypatch):
    plans, write = [], batch.written
    monkeypatch.setattr(batch, "written", lambda df, name: plans.append(plan(df)) or write(df, name))
    versions = spark.createDataFrame([(i, i - 25 if i > 25 else None) for i in range(1, 301)], "version_id long, parent_id long")
    got = {(x.version_id, x.original, x.depth) for x in batch.lineage(versions).collect()}
    assert got == {(i, 1 + (i - 1) % 25, (i - 1) // 25) for i in range(1, 301)}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_plain_tags_are_read_in_one_match(monkeypatch):
    """Tags as nearly all are written skip the parser's own reading, with the same nodes and places."""
    html = '<div id="a" class="b c"><p title="x y">é<b>1</b>\n</p ><IMG src=q alt="&lt;"><textarea a="b"><i>&amp;</textarea>t</div>'
    columns = lambda: {k: [] for k in N._ARROW.names}
    fast, slow, read = columns(), columns(), []
    start = N.HTMLParser.parse_starttag
    monkeypatch.setattr(N.HTMLParser, "parse_starttag", lambda self, i: read.append(self.rawdata[i:]) or start(self, i))
    N._rows(1, html, fast)
    assert [r[:4].lower() for r in read] == ["<img", "<tex"]
    for name in ("parse_starttag", "parse_endtag"):
        monkeypatch.delattr(N._Tree, name)
    N._rows(1, html, slow)
    assert fast == slow and fast["tag"].count("p") == 1


def test_keys_of_pages_are_not_sent_to_all_tasks(spark):
    """Half a million keys are a file of a few megabytes, and a hash table of ten times as many."""
    keys = written(spark.range(500_000).select(F.col("id").alias("page_id"), F.lit("li > .price").alias("selector")), "packed")
    joined = spark.range(10**9).withColumnRenamed("id", "page_id").join(keys, "page_id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    few = written(spark.range(50).withColumnRenamed("id", "page_id"), "few")
    joined = spark.range(10**9).withColumnRenamed("id", "page_id").join(few, "page_id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()


def test_elements_without_a_step_are_not_shuffled(parse, spark, monkeypatch):
    """Matches are the same whether or not the keys of the steps go to every task."""
    _, nodes = parse(*["<nav><ul><li id=a><a href=x>one</a><li class='b c'><a>two</a></ul></nav><p>rest<p class=b>of it"] * 3)
    asked = spark.createDataFrame([(0, "nav li > a"), (1, ".b"), (1, "#a"), (2, "p + *"), (2, "//li[contains(., 'two')]"), (9, "a"), (0, "!")], "page_id long, selector string")
    found = lambda: sorted(map(tuple, selector_table.matches_on(nodes, asked).collect()))
    sent = found()
    assert len(sent) == 2 + 2 + 1 + 1 + 1
    monkeypatch.setattr(selector_table, "SENT_STEPS", 0)
    assert found() == sent


def test_versions_of_templates_are_read_one_after_the_other(spark, tmp_path):
    """The result is a union of written tables, so no two versions are joined at the same time."""
    html = "<nav><ul><li><a href='/x'> One </a><li><a href='/y'>Two</a></ul></nav>"
    spark.createDataFrame([(1, "http://aa.de/1", html), (2, "http://b.de/2", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = QUERIES["template_store"](spark, str(tmp_path))
    assert "Join" not in plan(out) and "Exchange" not in plan(out)
    even, odd = 2, 1  # by the length of the host
    want = [(1, p, n, "txt", t) for p in (1, 2) for n, t in ((1, "One"), (2, "Two"))] + [(2, odd, n, "txt", t) for n, t in ((1, "One"), (2, "Two"))]
    want += [(v, even, n, f, x) for v in (2, 3) for n, to, text in ((1, "/x", "one"), (2, "/y", "two")) for f, x in (("to", to), ("text", text))]
    assert sorted(map(tuple, out.collect())) == sorted(want)
