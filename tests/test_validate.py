import pytest

from gleanery.operators import recover as Rc
from gleanery.operators import validate as V
from gleanery.operators.validate import DataPoint
from gleanery.plans import extraction as X

RAW = "page_id long, dp_id string, raw_kind string, pos int, value string, json_type string"


@pytest.fixture
def run(spark):
    def go(raw, plan, url="https://ex.com/a/b?x=1"):
        pages = spark.createDataFrame([(1, url)], "page_id long, url string")
        values, issues = V.validate(spark.createDataFrame(raw, RAW), pages, plan)
        v = {}
        for r in values.orderBy("dp_id", "pos").collect():
            v.setdefault(r["dp_id"], []).append(r["clean"])
        return v, sorted((r["dp_id"], r["code"], r["issue"], r["original_count"]) for r in issues.collect())

    return go


def s(dp, value, j="string", kind="scalar", pos=0):
    return (1, dp, kind, pos, value, j)


def test_shape_rules(run):
    raw = [s("tags", "x"), s("name", "a", kind="list"), s("name", "b", kind="list", pos=1), s("none", None, "null", "null", None),
           s("gaps", None, "null", "list", 0), s("gaps", None, "null", "list", 1)]
    plan = [DataPoint("tags", is_list=True), DataPoint("name"), DataPoint("none", is_list=True), DataPoint("gaps", is_list=True, notes="required"),
            DataPoint("away", notes="required"), DataPoint("opt", notes="Optional"), DataPoint("plain"), DataPoint("far", is_list=True, notes="need it")]
    values, issues = run(raw, plan)
    assert values == {"tags": ["x"], "name": ["a"], "away": [None], "opt": [None], "plain": [None]}
    assert [(d, c, n) for d, c, _, n in issues] == [
        ("away", "required_item", None), ("far", "required_list", None), ("gaps", "list_emptied", 2), ("name", "scalar_expected", None), ("none", "list_expected", None), ("tags", "list_expected", None),
    ]


def test_failed_coercion_keeps_the_text_and_is_not_missing(run):
    values, issues = run([s("n", " abc "), s("b", "maybe"), s("d", "garbage"), s("u", "mailto:a@b.c")],
                         [DataPoint("n", "number", notes="required"), DataPoint("b", "boolean"), DataPoint("d", "date"), DataPoint("u", "url")])
    assert values == {"n": ["abc"], "b": ["maybe"], "d": ["garbage"], "u": ["mailto:a@b.c"]}
    assert [i for _, _, i, _ in issues] == [
        "Type mismatch: Expected boolean, got string.", 'Type mismatch: Expected date, failed to parse from "garbage".',
        'Type mismatch: Expected number, failed to parse from string " abc ".', 'Invalid URL: Expected valid URL, got "mailto:a@b.c".',
    ]


def test_json_types(run):
    values, issues = run([s("n", "5", "number"), s("b", "true", "boolean"), s("d", "86400000", "number"), s("t", "7", "number"), s("x", "true", "boolean"), s("u", "5", "number")],
                         [DataPoint("n", "number"), DataPoint("b", "boolean"), DataPoint("d", "date"), DataPoint("t"), DataPoint("x", "number"), DataPoint("u", "url")])
    assert values == {"n": ["5"], "b": ["true"], "d": ["1970-01-02T00:00:00.000Z"], "t": ["7"], "x": ["true"], "u": ["5"]}
    assert [(d, i) for d, _, i, _ in issues] == [
        ("t", "Type mismatch: Expected string, got number. Converting."), ("u", "Type mismatch: Expected valid URL string, got number."), ("x", "Type mismatch: Expected number, got boolean."),
    ]


def test_urls_without_a_page(run):
    values, issues = run([s("u", "/c"), s("v", "HTTP://EX.com")], [DataPoint("u", "url"), DataPoint("v", "image_url")], None)
    assert values["v"] == ["HTTP://EX.com"] and issues[0][1] == "url_type"
    assert run([s("u", "/c")], [DataPoint("u", "url")])[0] == {"u": ["https://ex.com/c"]}


def test_outliers_and_patterns(spark):
    df = spark.createDataFrame([("a", float(i % 3)) for i in range(30)] + [("a", 900.0), ("b", 1.0)], "g string, v double")
    assert [r["v"] for r in V.outliers(df, "g", "v").filter("is_outlier").collect()] == [900.0]
    p = V.field_patterns(spark.createDataFrame([("f", "A-12"), ("f", "b-34"), ("f", "c5")], "field string, value string"), "field", "value").first()
    assert (p["top_pattern"], p["n_top"], p["n_patterns"]) == ("a-99", 2, 2)


def test_whole_job_with_recovery(parse):
    pages, nodes = parse("<ul><li>a<li>b</ul><b class=price>$5</b>", "<ul><li>c</ul><b>none</b>")
    plan = [
        X.PlannedField(DataPoint("items", is_list=True, notes="required"), "ul.menu > li"),
        X.PlannedField(DataPoint("price", "number", notes="required"), "b.price"),
        X.PlannedField(DataPoint("gone", notes="optional"), "video"),
    ]
    res = X.run(pages, plan, nodes=nodes)
    got = sorted((r["page_id"], r["dp_id"], r["pos"], r["clean"]) for r in res.values.filter("clean is not null").collect())
    assert got == [(0, "items", 0, "a"), (0, "items", 1, "b"), (0, "price", 0, "5"), (1, "items", 0, "c")]
    assert res.values.filter("dp_id = 'price' and page_id = 0").first()["num"] == 5.0
    issues = sorted((r["page_id"], r["dp_id"], r["code"]) for r in res.issues.collect())
    assert issues == [(0, "gone", "no_match"), (1, "gone", "no_match"), (1, "price", "no_match"), (1, "price", "required_item")]
    assert [(r["n_values"], r["n_issues"]) for r in res.summary.orderBy("page_id").collect()] == [(3, 1), (1, 3)]
    with pytest.raises(ValueError):
        X.run(pages, [])


def test_selector_rules(values):
    sels = ["ul.a > li:nth-child(2) a", "#x .y", "p"]
    assert values(Rc.generalised, sels) == ["ul.a > li a", "#x .y", "p"]
    assert values(Rc.without_lead, sels) == ["li:nth-child(2) a", ".y", "p"]
    assert values(Rc.by_attribute, sels) == ['ul[class*="a"] > li:nth-child(2) a', '[id*="x"] [class*="y"]', "p"]


def test_first_strategy_with_a_hit_wins(parse, spark):
    _, nodes = parse("<b>x</b>", "<i>y</i>", "<u>z</u>")
    alts = spark.createDataFrame(
        [(k, *r) for k in range(3) for r in (("f", "p", "one", 0, 0), ("f", "b", "one", 0, 1), ("f", "*", "two", 1, 0), ("f", "i", "two", 1, 1), ("f", "i", "two", 1, 2))],
        "page_id long, dp_id string, selector string, strategy string, strategy_rank int, alt_rank int",
    )
    got = sorted((r["page_id"], r["selector"], r["alt_rank"]) for r in Rc.working_alternatives(nodes, alts).collect())
    assert got == [(0, "b", 1), (1, "*", 0), (1, "i", 1), (2, "*", 0)]


def test_attempt_limit_is_pushed_below_the_shuffle(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id as page_id", "event_type as dp_id", "event_id as ts")
    plan = Rc.attempts(e, "ts", limit=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
