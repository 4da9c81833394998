"""Sketches against exact answers, learned URL templates, schemas, precision."""

import pytest
from pyspark.sql import functions as F

from gleanery.operators import batch, recover, sketches


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_quartiles_of_parts_and_wholes(spark):
    values = spark.range(20001).select((F.col("id") % 2).alias("g"), (F.col("id") % 8).alias("part"), F.col("id").cast("double").alias("v"))
    merged = sketches.merged_values(sketches.value_sketches(values, ["g", "part"], "v"), ["g"])
    for r in sketches.quantiles(merged).collect():
        assert r.n in (10000, 10001) and all(abs(q / 20000 - p) < 0.01 for q, p in zip(r.quantiles, sketches.QUARTILES))


def test_outliers_do_not_hide_each_other(spark):
    data = [("a", float(i % 10)) for i in range(100)] + [("a", 1e9)] * 12 + [("b", 5.0)] * 9 + [("b", 6.0), ("c", None), ("c", float("nan")), (None, 1.0), (None, 2.0)]
    values = spark.createDataFrame([(g, v, 0.0) for g, v in data], "g string, v double, lower_ double")
    out = sketches.robust_outliers(values, ["g"], "v")
    assert out.count() == len(data)
    assert rows(out.filter("is_outlier").groupBy("g", "v").count(), "g", "v", "count") == [("a", 1e9, 12), ("b", 6.0, 1)]
    assert sketches.robust_outliers(values.limit(0), ["g"], "v").count() == 0


@pytest.mark.parametrize("few", [10_000, 1])
def test_fences_by_broadcast_and_by_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(sketches, "SMALL_GROUPS", few)
    values = spark.range(400).select((F.col("id") % 4).alias("g"), F.when(F.col("id") % 100 == 3, F.lit(1e6)).otherwise(F.col("id") % 7).alias("v"))
    assert sketches.robust_outliers(values, ["g"], "v").filter("is_outlier").count() == 4


def test_runs_from_sketches_alone(spark):
    old = spark.range(3000).select(F.lit("x").alias("host"), F.col("id").cast("string").alias("url"))
    new = spark.range(1000, 3500).select(F.lit("x").alias("host"), F.col("id").cast("string").alias("url"))
    only = spark.createDataFrame([("y", "1"), ("y", "1"), ("z", "2")], "host string, url string")
    kept = sketches.set_sketches(old.unionByName(only.filter("host = 'y'")).withColumn("run", F.lit("a")).unionByName(new.unionByName(only.filter("host = 'z'")).withColumn("run", F.lit("b"))), ["run", "host"], "url")
    got = rows(sketches.run_overlap(kept, "run", "a", "b", ["host"]), "host", "n_old", "n_new", "kept", "added", "removed")
    assert got == [("x", 3000, 2500, 2000, 500, 1000), ("y", 1, 0, 0, 0, 1), ("z", 0, 1, 0, 1, 0)]
    # beyond the size of a sketch the numbers are estimates
    big = spark.range(200_000).select(F.lit("a").alias("run"), F.col("id").cast("string").alias("url"))
    n = sketches.run_overlap(sketches.set_sketches(big.unionByName(big.withColumn("run", F.lit("b")).filter("length(url) = 6")), ["run"], "url").withColumn("host", F.lit(1)), "run", "a", "b", ["host"]).first()
    assert abs(n.n_old / 200_000 - 1) < 0.03 and abs(n.kept / 100_000 - 1) < 0.05 and n.added < 2000
    assert rows(sketches.merged_sets(kept, ["host"]).select("host", F.theta_sketch_estimate("sketch").alias("n")), "host", "n") == [("x", 3500), ("y", 1), ("z", 1)]


def urls(spark, items):
    return spark.createDataFrame([(i, u) for i, u in enumerate(items)], "page_id long, url string")


def templates(df):
    return {(r.host, r.path): r.template for r in df.collect()}


def test_url_templates(spark):
    items = [f"http://a.example.com/{lang}/{kind}/{i}" for lang in ("en", "de") for kind in ("item", "user") for i in range(8)]
    items += [f"http://a.example.com/en/news/2024-01-{d:02d}/story-{d}" for d in range(1, 10)] + ["http://a.example.com/en/news/archive"]
    items += ["http://b.example.com/", "http://b.example.com/x//y/", "http://b.example.com/x/y?z=1", None]
    got = templates(batch.url_templates(urls(spark, items)))
    assert got[("a.example.com", "/de/user/3")] == "/de/user/{n}" and got[("a.example.com", "/en/item/0")] == "/en/item/{n}"
    # one value that is no date makes the place a text
    assert got[("a.example.com", "/en/news/2024-01-03/story-3")] == "/en/news/{text}/{text}" and got[("a.example.com", "/en/news/archive")] == "/en/news/{text}"
    assert got[("b.example.com", "/")] == "" and got[("b.example.com", "/x/y")] == "/x/y"
    assert batch.url_templates(urls(spark, [])).count() == 0


def test_places_with_few_values_stay(spark):
    many = [f"http://a.example.com/s{i % 15}/p{i}" for i in range(300)]
    got = set(templates(batch.url_templates(urls(spark, many))).values())
    assert got == {f"/s{i}/{{text}}" for i in range(15)}
    assert set(templates(batch.url_templates(urls(spark, many), fixed=10)).values()) == {"/{text}/{text}"}


def test_response_schemas(spark):
    data = [("p", '{"a": 1}'), ("p", '{"a": "x", "b": [true]}'), ("p", "no json"), ("p", None), ("q", "[1, 2.5]"), ("r", "")]
    got = rows(sketches.response_schemas(spark.createDataFrame(data, "provider string, text string"), ["provider"]), "provider", "n", "n_json", "schema")
    assert got[0] == ("p", 4, 2, "OBJECT<a: VARIANT, b: ARRAY<BOOLEAN>>") and got[1][:3] == ("q", 1, 1) and got[2][:3] == ("r", 1, 0)


def test_selector_precision(spark):
    found = spark.createDataFrame([(1, 2, "s"), (1, 3, "s"), (1, 3, "s"), (2, 2, "t")], "page_id long, pre int, selector string")
    wanted = spark.createDataFrame([(1, 3, "s"), (1, 4, "s"), (2, 5, "u")], "page_id long, pre int, selector string")
    got = rows(recover.selector_precision(found, wanted, "selector"), "selector", "n_found", "n_wanted", "n_right", "precision", "recall")
    assert got == [("s", 2, 2, 1, 0.5, 0.5), ("t", 1, 0, 0, 0.0, None), ("u", 0, 1, 0, None, 0.0)]


def test_selector_history(spark):
    v = [(1, "a", "h1", None, False), (2, "a", ".t", 1, None), (3, "a", "#t", 2, True), (4, "a", ".t > b", 2, False), (5, "b", "p", 99, True), (6, "c", "q", None, None)]
    df = spark.createDataFrame(v, "selector_id long, field string, selector string, improved_from long, is_robust boolean")
    got = rows(batch.selector_history(df), "field", "selector", "first_selector", "n_improved", "is_robust")
    assert got == [("a", "#t", "h1", 2, True), ("a", ".t > b", "h1", 2, False), ("b", "p", "p", 0, True), ("c", "q", "q", 0, False)]
    assert batch.selector_history(df.limit(0)).count() == 0
