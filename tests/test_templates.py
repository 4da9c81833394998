"""Saved templates: versions, as-of reads, other sessions, application."""

from pyspark.sql import functions as F

from gleanery.operators import templates


def rows(spark, *items):
    return spark.createDataFrame([(n, h, css, xpath, [tuple(f) for f in fields]) for n, h, css, xpath, fields in items], f"name string, host string, {templates.BODY}")


def state(df):
    return sorted((r["name"], r["host"], r["version"], r["css"], tuple(f["field"] for f in r["fields"] or [])) for r in df.collect())


TITLE = ("title", "b", None, "trim")
PRICE = ("price", "i", None, "number")


def test_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    assert templates.versions(spark, path).count() == 0 and templates.as_of(templates.versions(spark, path)).count() == 0
    templates.save(rows(spark, ("shop", "h0", "li", None, [TITLE]), ("shop", "h1", "p", None, [TITLE]), (None, "h1", "p", None, []), ("x", None, "p", None, [])), path, 10)
    templates.save(rows(spark, ("shop", "h1", "ul > li", None, [TITLE, PRICE])), path, 20)
    templates.remove(spark.createDataFrame([("shop", "h0"), ("no", "such")], "name string, host string"), path, 30)
    log = templates.versions(spark.newSession(), path)
    assert state(templates.as_of(log, 5)) == []
    assert state(templates.as_of(log, 15)) == [("shop", "h0", 10, "li", ("title",)), ("shop", "h1", 10, "p", ("title",))]
    assert state(templates.as_of(log, 25)) == [("shop", "h0", 10, "li", ("title",)), ("shop", "h1", 20, "ul > li", ("title", "price"))]
    now = [("shop", "h1", 20, "ul > li", ("title", "price"))]
    assert state(templates.as_of(log)) == now
    # a save that is run again, and one that comes late with an older version
    templates.save(rows(spark, ("shop", "h1", "ul > li", None, [TITLE, PRICE])), path, 20)
    templates.save(rows(spark, ("shop", "h1", "old", None, [])), path, 12)
    assert state(templates.as_of(templates.versions(spark, path))) == now
    # saved again after a removal
    templates.save(rows(spark, ("shop", "h0", "tr", None, [])), path, F.lit(40))
    assert state(templates.as_of(templates.versions(spark, path))) == [("shop", "h0", 40, "tr", ()), *now]
    templates.compact(spark, path, str(tmp_path / "small"), 30)
    small = templates.versions(spark, str(tmp_path / "small"))
    assert small.count() == 2 and state(templates.as_of(small)) == [("shop", "h0", 40, "tr", ()), *now] and state(templates.as_of(small, 30)) == now


def test_apply(spark, parse, tmp_path):
    html = "<ul><li><b> A </b><i>$3</i><li><b>B</b></ul>"
    pages, nodes = parse(html, html, html)  # hosts h0, h1 and h2.example.com
    path = str(tmp_path / "store")
    templates.save(rows(spark, ("shop", "h0.example.com", "li", None, [TITLE, PRICE]), ("shop", "h1.example.com", None, "//ul", [TITLE]), ("other", "h2.example.com", "li", None, [TITLE])), path, 1)
    got, missed = templates.apply(pages, nodes, templates.as_of(templates.versions(spark, path)), "shop")
    assert sorted((r.page_id, r.rec_no, r.field, r.value, r.num) for r in got.collect()) == [
        (0, 1, "price", "$3", 3.0), (0, 1, "title", "A", None), (0, 2, "price", None, None), (0, 2, "title", "B", None), (1, 1, "title", "A", None),
    ]
    assert [(r.page_id, r.code) for r in missed.collect()] == [(2, "no_plan")]
