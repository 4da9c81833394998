from pyspark.sql import functions as F

from gleanery.operators import prompts as P
from gleanery.operators import responses as R

PLAN = """Extraction Goal: get parts
Data Structure table of parts
- Key Fields:
- name [Number]
- price: number
-
plain
- [odd] tail
- Target Elements:
- li
-
h2
- Extraction Strategy: look
closely
- Potential Challenges:
- gaps"""


def test_plan_parts(values):
    assert values(R.plan_goal, [PLAN, "no plan", "EXTRACTION GOAL   x \n"]) == ["get parts", None, "x"]
    assert values(R.plan_structure, [PLAN]) == ["table of parts"]
    fields = values(R.plan_fields, [PLAN, "nothing", "Key Fields:\n- a"])
    assert [(f["name"], f["type"]) for f in fields[0]] == [("name", "number"), ("price", "string"), ("plain", "string"), ("odd", "string")]
    assert fields[1] is None and [(f["name"], f["type"]) for f in fields[2]] == [("a", "string")]
    assert values(R.plan_elements, [PLAN]) == [["li", "h2"]]
    assert values(R.plan_strategy, [PLAN]) == ["look\nclosely"]
    assert values(R.plan_challenges, [PLAN]) == [["gaps"]]


def test_schema_block(values):
    good = '```json\n{ "a": {"selector": null} }\n```'
    assert values(R.plan_schema_json, [good, '```{"a": nope}```', "none"]) == ['{ "a": {"selector": null} }', None, None]


def test_response_json(values):
    cases = [
        ('```json\n[1, 2]\n```', "[1, 2]"), ('x {"a":1} y', '{"a":1}'), ('[{"a":1},{"a":2}]', '[{"a":1},{"a":2}]'), ('{"a":1},{"a":2}', None), ("```\nbad\n``` {}", None),
        ('see [1] {"a":[2]}', '{"a":[2]}'), ("42", "42"), ('{"a":NaN}', None), ("text", None), ('a [1, {"b":2}] c', '[1, {"b":2}]'), (None, None),
    ]
    got = values(R.response_json, [k for k, _ in cases])
    assert [g.strip() if g else g for g in got] == [v for _, v in cases]


def test_records_and_failures(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":"x"}'), (2, '[{"a":2},{"b":null}]'), (3, "sorry")], "id int, text string")
    rows = R.response_records(df, "id", ["a", "b"]).orderBy("id", "rec_no").collect()
    assert [(r["id"], r["rec_no"], r["a"], r["b"]) for r in rows] == [(1, 1, "1", "x"), (2, 1, "2", None), (2, 2, None, None)]
    assert [r["id"] for r in R.response_failures(df, "id").collect()] == [3]


def test_pagination(values):
    text = "Next page link: `.next a`\nPagination pattern: ?page=N. Maximum 25 pages"
    got = values(R.pagination, [text, "nothing", "page numbers selector: '#p li'", "next page button: next", "Total of 3 pages"])
    assert (got[0]["type"], got[0]["next_selector"], got[0]["url_pattern"], got[0]["max_pages"]) == ("next-button", ".next a", "?page=N", 25)
    assert (got[1]["type"], got[1]["max_pages"], got[1]["has_pagination"]) == (None, 10, False)
    assert (got[2]["type"], got[2]["numbers_selector"]) == ("page-numbers", "#p li")
    assert got[3]["has_pagination"] is False and got[4]["max_pages"] == 3


def test_selectors(values):
    listed = "- CSS Selectors:\n  - Primary: h1\n  - Alternate: `.b > c`\n- XPath Selectors:\n  - Primary: //h1\n- Selector Logic: css is fine"
    texts = ["CSS: `h1`\ncss selector: .a > b\nCSS: `h1`", listed, "XPath: `//h1`", "none"]
    assert values(R.css_selectors, texts) == [["h1", ".a > b"], ["is fine", "h1", ".b > c"], [], []]
    assert values(R.xpath_selectors, texts) == [[], ["//h1"], ["//h1"], []]
    assert values(R.explanation, ["Explanation: a\nb\n\nc", "x"]) == ["a\nb", None]


def test_multi_field(spark):
    df = spark.createDataFrame([(1, "Name:\n CSS: `h2`\n XPath: `//h2`\nPrice (now): css `.p`\nReasoning: why")], "id int, text string")
    rows = {r["field"]: (r["css"], r["xpath"]) for r in R.multi_field_selectors(df, "id", ["Name", "Price (now)", "other"]).collect()}
    assert rows == {"name": (["h2"], ["//h2"]), "price (now)": ([".p"], [])}


def test_small_parsers(values):
    assert values(R.clean_converted, ["Use `//a`, ok", " .x ", "'a' or 'b'"]) == ["//a", ".x", "a"]
    assert values(R.selector_kind, ["//a", ".b"]) == ["xpath", "css"]
    alts = ['["a", " ", "b"]', '```json\n["a"]```', '["a", 1]', '{"a":1}', '["a"] x', '[]', '["q\\"q"]', "nope"]
    assert values(R.alternatives, alts) == [["a", "b"], ["a"], [], [], [], [], ['q"q'], []]


def test_fallback_order(spark):
    rows = [(1, "a", "A", None), (1, "b", "B", None), (2, "a", None, "down"), (2, "b", "B", None), (3, "a", None, "down"), (3, "b", None, "limit"), (4, "c", "C", None)]
    df = spark.createDataFrame(rows, "id int, provider string, text string, error string")
    got = {r["id"]: (r["provider"], r["text"], r["error"]) for r in R.with_fallback(df, "id", "a", "b").collect()}
    assert got == {1: ("a", "A", None), 2: ("b", "B", None), 3: ("b", None, "limit")}
    assert {r["id"]: r["error"] for r in R.with_fallback(df, "id", "a", None).collect()} == {1: None, 2: "down", 3: "down"}


def test_prompt_keys_do_not_run_together(values):
    a, b = values(lambda p, m, s: R.prompt_key(p, m, s), [("ab", "c", ""), ("a", "bc", "")])
    assert a != b


def test_templates(values):
    def fill(t, v):
        return P.fill_template(t, P.value_map(goal=v, n=F.lit(3)))

    got = values(fill, [("{goal} {n} {missing} {", "x {n}"), ("a{goal}b", None), ("{{goal}}", "z"), ("{go al}", "z")])
    assert got == ["x {n} 3 {missing} {", "ab", "{z}", "{go al}"]
    assert values(lambda t: P.missing_keys(t, P.value_map(a=F.lit(1))), ["{a} {b} {b} {c}"]) == [["b", "c"]]


def test_ask_runs_batches(spark):
    def answer(batch):
        return batch[["id"]].assign(text=batch["prompt"].str.upper())

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    assert {r["text"] for r in R.ask(df, answer, "id long, text string").collect()} == {"A", "B"}
