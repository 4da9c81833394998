import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import batch as B
from gleanery.operators import logs, store
from gleanery.operators import extract as E
from gleanery.session import scratch
from gleanery.sources import export
from gleanery.sources.nodes import elements
from gleanery.streaming import feeds


def test_store_rules(spark):
    rows = [
        ("l", "a", "1", "set", 1), ("l", "a", "2", "set", 2), ("l", "b", "1", "set", 1), ("l", "b", None, "remove", 3), ("s", "c", "1", "set", 1), ("s", None, None, "clear", 2),
        ("s", "d", "9", "set", 3), ("s", "c2", "1", "set", 2), ("l", "n", None, "set", 4),
    ]
    log = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "area string, key string, value string, op string, ts int, seq int")
    state = store.snapshot(log)
    assert sorted((r["area"], r["key"], r["value"]) for r in state.collect()) == [("l", "a", "2"), ("l", "n", None), ("s", "c2", "1"), ("s", "d", "9")]
    assert [r["key"] for r in store.removed_keys(log).collect()] == ["b"]
    asked = spark.createDataFrame([("l", "n"), ("l", "b"), ("s", "d")], "area string, key string")
    got = {r["key"]: (r["value"], r["found"]) for r in store.get(state, asked, F.lit("dflt")).collect()}
    assert got == {"n": (None, True), "b": ("dflt", False), "d": ("9", True)}


def test_log_levels(spark):
    df = spark.createDataFrame([(k,) for k in logs.LEVELS], "level string")
    names = lambda t, cur="log": sorted(r["level"] for r in logs.at_least(df, t, cur).collect())
    assert names("warn") == ["error", "warn"] and names("none") == [] and names("bogus", "error") == ["error"] and len(names("debug")) == 5


def test_url_groups_and_series(spark):
    urls = ["http://A.x/p/1", "http://a.x/p/22/", "http://a.x/p/x?page=2&ref=y", "http://a.x/p/x?page=1&ref=y#t", "http://b.x"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {(r["host"], r["shape"]): (r["n_pages"], r["first_page"]) for r in B.url_groups(pages).collect()}
    assert got == {("a.x", "/p/{n}"): (2, 0), ("a.x", "/p/x"): (2, 2), ("b.x", ""): (1, 4)}
    series = B.pagination_series(pages, 1).collect()
    assert [(r["page_id"], r["base_url"], r["page_no"]) for r in series] == [(3, "http://a.x/p/x?ref=y", 1)]


def test_structure_groups(parse):
    many = "".join(f"<i{k}>x</i{k}>" for k in range(60))
    other = "".join(f"<q{k}>x</q{k}>" for k in range(20))
    _, n = parse("<p>a", "<p>b<p>c", other, many, many + "<p>one more")
    groups = {r["first_page"]: r["n_pages"] for r in B.structure_groups(n).collect()}
    assert groups == {0: 2, 2: 1, 3: 1, 4: 1}
    lead = {r["page_id"]: r["leader"] for r in B.near_structure_groups(n).collect()}
    assert lead[1] == 0 and lead[2] == 2 and lead[3] == 3 and lead[4] == 3


def test_near_structures_against_brute_force(parse):
    """Many structures around the bound, and pages whose buckets are led by a smaller foreign one."""
    r = random.Random(2)
    sets = []
    for g in range(4):
        base = [f"g{g}x{i}" for i in range(24)]
        for _ in range(15):
            sets.append(sorted(set(r.sample(base, r.randint(15, 24)) + [f"o{r.randrange(40)}" for _ in range(r.randint(0, 4))])))
    pages, n = parse(*["".join(f"<{t}></{t}>" for t in s) for s in sets])
    paths = {}
    for x in elements(n).select("page_id", "path").collect():
        paths.setdefault(x["page_id"], set()).add(x["path"])
    root = {i: i for i in paths}
    for _ in paths:  # the smallest page along links
        for a in paths:
            for b in paths:
                if len(paths[a] & paths[b]) >= 0.7 * len(paths[a] | paths[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert 4 < len(set(root.values())) < len(sets)
    for bands in (8, 1):
        assert {x["page_id"]: x["leader"] for x in B.near_structure_groups(n, bands=bands).collect()} == root


def test_next_links(parse):
    pages, n = parse("<a href=x>back</a><a href='/p2'> Next &raquo; </a><a href=/p3>next</a>", "<a class=n href='?page=3'>3</a>", "<a>next</a>")
    assert {r["page_id"]: r["next_url"] for r in B.next_page_links(pages, n).collect()} == {0: "http://h0.example.com/p2"}
    assert {r["page_id"]: r["next_url"] for r in B.next_page_links(pages, n, "a.n").collect()} == {1: "http://h1.example.com/a/b?page=3"}


def test_batch_plans(parse, spark):
    pages, n = parse("<b>1</b><i>2</i>", "<b>3</b><i>4</i>", "<b>5</b>")
    groups = spark.createDataFrame([(0, "g"), (1, "h"), (2, "h")], "page_id long, grp string")
    plans = spark.createDataFrame([("g", "b", None), ("h", "i", "//b")], "grp string, css string, xpath string")
    groups3 = groups.unionByName(spark.createDataFrame([(9, "z")], "page_id long, grp string"))
    out, issues = B.batch_extract(n, groups3, plans, [E.Field("v")], pages)
    assert [(r["page_id"], r["code"]) for r in issues.collect()] == [(9, "no_plan")]
    out = out.collect()
    assert sorted((r["page_id"], r["grp"], r["v"]) for r in out) == [(0, "g", "1"), (1, "h", "4"), (2, "h", "5")]
    assert {r["grp"]: r["page_id"] for r in B.first_of_group(groups).collect()} == {"g": 0, "h": 1}


def test_run_comparison(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert {r["k"]: r["change"] for r in B.run_diff(a, b, ["k"], "v").collect()} == {1: "removed", 2: "changed", 3: "same", 4: "added"}
    runs = spark.createDataFrame([(1, "k", 5), (2, "k", 8), (1, "j", 1)], "run_ts int, key string, n int")
    assert {(r["key"], r["run_ts"]): r["delta"] for r in B.run_trend(runs, "key", "n").collect()} == {("k", 1): None, ("k", 2): 3, ("j", 1): None}


def test_accuracy_counts_missing_records(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = spark.createDataFrame([(1, "a")], "k int, v string")
    assert [(r["n"], r["n_right"]) for r in B.accuracy(got, gold, ["k"], ["v"]).collect()] == [(2, 1)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, "b,c", None), (1, "a", 1.5)], "id int, name string, x double")
    export.write_csv(df, str(tmp_path / "c"), ["name", "x"])
    export.write_json(df, str(tmp_path / "j"), ["id", "x"])
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == [("a", "1.5"), ("b,c", None)]
    assert '{"id":2,"x":null}' in [r[0] for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert [r["id"] for r in export.preview(df, F.col("id") > 0, [F.col("id")], 1).collect()] == [1]
    top = export.preview(df, F.lit(True), [F.col("id")], 1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_health(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    checks = spark.createDataFrame([("a", True, t(1), 1), ("a", False, t(2), 2), ("b", False, t(1), 1), ("b", True, t(1), 2)], "service string, ok boolean, ts timestamp, seq int")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "service string")
    assert {r["service"]: r["healthy"] for r in store.service_health(checks, known).collect()} == {"a": False, "b": True, "c": False}


def drop_in(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped_and_restarts_continue(spark):
    src, out, ck = (scratch(spark, f"late-{n}") for n in ("in", "out", "ck"))
    schema = "ts timestamp, level string"
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)

    def go():
        stream = feeds.file_feed(spark, src, spark.createDataFrame([], schema).schema)
        feeds.log_window_feed(stream, out, ck, "1 hour", None, "2 hours").awaitTermination()

    drop_in(spark, [(day(1), "warn"), (day(2), "warn")], schema, src)
    go()
    drop_in(spark, [(day(1), "warn"), (day(2), "warn"), (day(2, 1), "log")], schema, src)  # the first row is a day late
    go()
    rows = feeds.newest(spark.read.schema("start timestamp, end timestamp, level string, n long, batch int").parquet(out), ["start", "level"], ["n"])
    assert {(r["start"].day, r["start"].hour, r["level"]): r["n"] for r in rows.collect()} == {(1, 0, "warn"): 1, (2, 0, "warn"): 2, (2, 1, "log"): 1}


def test_latest_state_over_restarts(spark):
    src, out, ck = (scratch(spark, f"state-{n}") for n in ("in", "out", "ck"))
    schema = "area string, key string, value string, op string, ts timestamp, seq long"
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)

    def go():
        stream = feeds.file_feed(spark, src, spark.createDataFrame([], schema).schema)
        feeds.latest_feed(stream, out, ck).awaitTermination()

    drop_in(spark, [("l", "a", "1", "set", t(1), 1), ("l", "b", "1", "set", t(1), 2), ("s", "c", "1", "set", t(1), 3)], schema, src)
    go()
    drop_in(spark, [("l", "a", "0", "set", t(0), 4), ("l", "b", None, "remove", t(2), 5), ("s", "*", None, "clear", t(3), 6), ("s", "d", "1", "set", t(4), 7)], schema, src)
    go()
    rows = spark.read.schema("area string, key string, op string, value string, ts timestamp, seq long, bucket int").parquet(out)
    assert rows.count() == 5  # one row for each key, whatever the number of batches
    assert sorted((r["area"], r["key"], r["value"]) for r in feeds.live_entries(rows).collect()) == [("l", "a", "1"), ("s", "d", "1")]


def test_change_feed_keeps_old_hashes(spark):
    src, out, ck = (scratch(spark, f"chg-{n}") for n in ("in", "out", "ck"))
    schema = "url string, ts timestamp, html string"
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    crawls = [[("a", t(1), "1"), ("b", t(1), "1")], [("a", t(2), "2")], [("a", t(3), "2"), ("b", t(3), "1"), ("c", t(3), "1")]]
    for rows in crawls:
        drop_in(spark, rows, schema, src)
        feeds.change_feed(feeds.file_feed(spark, src, spark.createDataFrame([], schema).schema), out, ck).awaitTermination()
    got = sorted((r["batch"], r["url"], r["change"]) for r in spark.read.schema("url string, change string, batch int").parquet(out).collect())
    assert got == [(0, "a", "added"), (0, "b", "added"), (1, "a", "changed"), (2, "c", "added")]


def test_page_feed_equals_batch(spark, sf):
    from gleanery.checks import QUERIES

    stream = QUERIES["stream_page_extract"](spark, sf)
    batch = QUERIES["nav_links"](spark, sf).select("page_id", "href")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_no_cluster_folder_is_refused(monkeypatch, spark):
    from gleanery import session

    class Fake:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_dir(Fake)


def test_scratch_is_cleared(spark):
    from gleanery.session import app_folder, clear_scratch, written

    kept = written(spark.range(3), "x")
    assert kept.count() == 3
    import os

    assert os.path.isdir(app_folder(spark).removeprefix("file:"))
    clear_scratch(spark)
    assert not os.path.exists(app_folder(spark).removeprefix("file:"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_facts_are_looked_up_on_the_row(spark, sf):
    """Nothing is shuffled by a handful of agents, fields or flags."""
    from gleanery.operators import prompts, recover, validate

    events = spark.read.parquet(f"{sf}/events.parquet")
    assert "Exchange" not in plan_of(prompts.with_system_prompt(events, "event_type"))
    errors = events.select(F.col("user_id").alias("page_id"), F.col("event_type").alias("dp_id"))
    lost = recover.failed_fields(errors, {"click": "a > b:first-child", "view": "p"})
    assert "Exchange" not in plan_of(lost)
    assert "dp_id" not in plan_of(recover.proposals(lost)).split("hashpartitioning(")[1].split(")")[0].split(",")[0]
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = plan_of(validate.outliers(items.select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice"))
    assert "BuildRight" in plan and "hashpartitioning" not in plan


def test_lineage_of_a_broken_chain(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (9, 8), (10, 9)]
    got = {r["version_id"]: (r["original"], r["depth"]) for r in B.lineage(spark.createDataFrame(rows, "version_id long, parent_id long")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 9: (8, 1), 10: (8, 2)}


def test_state_feed_writes_what_changed(spark):
    src, out, ck = (scratch(spark, f"keyed-{n}") for n in ("in", "out", "ck"))
    schema = "area string, key string, value string, op string, ts timestamp, seq long"
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [
        [("l", "a", "1", "set", t(1), 1), ("l", "a", "2", "set", t(1), 2), ("l", "b", "1", "set", t(1), 2), ("s", "c", "1", "set", t(1), 3), ("s", None, "1", "set", t(1), 3)],
        [("l", "a", "0", "set", t(0), 4), ("l", "b", None, "remove", t(2), 5), ("s", "*", None, "clear", t(3), 6), ("s", "d", "1", "set", t(4), 7)],
        [("l", "a", "2", "set", t(1), 2), ("l", "b", "9", "set", t(1), 9)],
    ]
    for rows in batches:
        drop_in(spark, rows, schema, src)
        feeds.state_feed(feeds.file_feed(spark, src, spark.createDataFrame([], schema).schema), out, ck).awaitTermination()
    got = spark.read.schema("area string, key string, op string, value string, ts timestamp, seq long, batch int").parquet(out)
    assert sorted((r["batch"], r["key"], r["op"]) for r in got.collect()) == [(0, "a", "set"), (0, "b", "set"), (0, "c", "set"), (1, "*", "clear"), (1, "b", "remove"), (1, "d", "set")]
    assert sorted((r["area"], r["key"], r["value"]) for r in feeds.live_entries(feeds.current_of(got)).collect()) == [("l", "a", "2"), ("s", "d", "1")]


def test_state_feed_forgets_removed_keys(spark):
    src, out, ck = (scratch(spark, f"forget-{n}") for n in ("in", "out", "ck"))
    schema = "area string, key string, value string, op string, ts timestamp, seq long"
    day = lambda d: dt.datetime(2024, 1, d)
    batches = [[("l", "a", None, "remove", day(1), 1), ("l", "b", "1", "set", day(1), 2)], [("l", "c", "1", "set", day(9), 3)], [("l", "a", "old", "set", day(1), 0), ("l", "a", "new", "set", day(9), 4)]]
    for rows in batches:
        drop_in(spark, rows, schema, src)
        feeds.state_feed(feeds.file_feed(spark, src, spark.createDataFrame([], schema).schema), out, ck, "1 hour", 2).awaitTermination()
    got = spark.read.schema("area string, key string, op string, value string, ts timestamp, seq long, batch int").parquet(out)
    assert sorted((r["area"], r["key"], r["value"]) for r in feeds.live_entries(feeds.current_of(got)).collect()) == [("l", "a", "new"), ("l", "b", "1"), ("l", "c", "1")]


def test_change_feed_reports_removed_pages(spark):
    src, out, ck = (scratch(spark, f"gone-{n}") for n in ("in", "out", "ck"))
    schema = "url string, ts timestamp, html string"
    t = lambda h: dt.datetime(2024, 1, 1, h)
    crawls = [[("a", t(0), "1"), ("b", t(0), "1"), (None, t(0), "1")], [("a", t(6), "1")], [("a", t(12), "2"), ("b", t(12), "1")], [("a", t(18), "2"), ("b", t(18), None)]]
    for rows in crawls:
        drop_in(spark, rows, schema, src)
        feeds.change_feed(feeds.file_feed(spark, src, spark.createDataFrame([], schema).schema), out, ck, gone_after_s=5 * 3600).awaitTermination()
    got = spark.read.schema("url string, change string, batch int").parquet(out).orderBy("batch", "url").collect()
    assert [(r["url"], r["change"]) for r in got] == [("a", "added"), ("b", "added"), ("b", "removed"), ("a", "changed"), ("b", "added"), ("b", "changed")]


def test_combiner_keeps_the_newest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "k string, n int, v string").coalesce(1)
    assert sorted(map(tuple, feeds.newest_in_task(rows, ["k"], ["n"]).collect())) == [("a", 3, "z"), ("b", 1, "q")]


def test_plan_feed(spark):
    from gleanery.plans import tables

    src, out, ck = (scratch(spark, f"plan-{n}") for n in ("in", "out", "ck"))
    schema = "page_id long, url string, html string"
    plan = spark.createDataFrame([("even", "title", 0, "h1", "text", None, "string", False, "needed"), ("odd", "n", 0, "b", "text", None, "number", True, None)], tables.PLAN_SCHEMA)
    groups = lambda p: p.select("page_id", F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("grp"))
    for rows in ([(0, "http://x.example.com/", "<h1>T</h1>"), (1, "http://x.example.com/", "<b>1</b><b>2</b>")], [(2, "http://x.example.com/", "<p>")]):
        drop_in(spark, rows, schema, src)
        feeds.plan_feed(feeds.file_feed(spark, src, spark.createDataFrame([], schema).schema), out, ck, groups, plan).awaitTermination()
    values = spark.read.schema("page_id long, dp_id string, clean string, batch int").parquet(f"{out}/values").filter("clean IS NOT NULL")
    assert sorted(map(tuple, values.select("batch", "page_id", "dp_id", "clean").collect())) == [(0, 0, "title", "T"), (0, 1, "n", "1"), (0, 1, "n", "2")]
    issues = spark.read.schema("page_id long, dp_id string, code string, batch int").parquet(f"{out}/issues")
    assert sorted(map(tuple, issues.select("batch", "page_id", "code").collect())) == [(1, 2, "no_match"), (1, 2, "required_item")]
