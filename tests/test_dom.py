from pyspark.sql import functions as F

from gleanery.operators import dom
from gleanery.operators import selectors as sel
from gleanery.operators.extract import Field, containers, dom_extract, extract_metadata
from gleanery.operators.tables import table_rows
from gleanery.sources.nodes import SHORT_TEXT


def one(df, col):
    rows = df.orderBy("page_id").collect()
    return [r[col] for r in rows]


def test_context_text(parse):
    _, n = parse('<div id="m" data-x="1" onclick="f()"><p>hi <b>x</b></p><script>1</script></div>', "<body>" + "<i>a</i>" * 150 + "tail", "<p>a<p style='display:none'>b<i>c</i></p>d")
    got = one(dom.dom_context(n, max_depth=3, max_elements=100), "context")
    assert got[0] == '<body><div id="m"><p>hi<b></b></p></div></body>'
    assert got[1] == "<body>" + "<i>a</i>" * 98 + "<i></i></body>"
    assert got[2] == "<body><p>a</p>d</body>"
    deep = one(dom.dom_context(n, root_tag="div"), "context")
    assert deep == ['<div id="m"><p>hi<b>x</b></p></div>']
    assert one(dom.dom_context(n, root_tag="div", text=False, attrs=False), "context") == ["<div><p><b></b></p></div>"]


def test_long_and_short_text_agree(parse):
    long = "word " * (SHORT_TEXT // 2)
    _, n = parse(f"<div><p> {long}<b>end</b></p><p>short<script>var s;</script></p><p hidden>gone {long}</p></div>")
    rows = dom.with_text(sel.select_css(n, "div, p", "tag", "text"), n).orderBy("pre").collect()
    assert [r["value"] for r in rows] == [(f" {long}end" + "shortvar s;" + f"gone {long}").strip(), f"{long}end".strip(), "shortvar s;", f"gone {long}".strip()]
    seen = dom.with_visible_text(sel.select_css(n, "div, p", "vtext"), n).orderBy("pre").collect()
    assert [r["visible"] for r in seen] == [f"{long}end short".replace("  ", " "), f"{long}end".strip(), "short", ""]
    best = dom.with_best_text(sel.select_css(n, "p, script", "text", "vtext"), n).orderBy("pre").collect()
    assert [r["value"] for r in best] == [f"{long}end".strip(), "short", "var s;", f"gone {long}".strip()]


def test_lists_by_kind(parse):
    pages, n = parse("<p>é</p><a href=/1>x<b>y</b></a><a>z</a>")
    wanted = {"t": ("a", "text", ""), "h": ("a", "html", ""), "a": ("a", "attribute", "href"), "bad": ("!!", "text", "")}
    rows = dom.extract_many(n, pages, wanted).collect()
    got = {(r["label"], r["pos"]): r["value"] for r in rows}
    assert got == {("t", 0): "x y", ("t", 1): "z", ("h", 0): "x<b>y</b>", ("h", 1): "z", ("a", 0): "/1", ("a", 1): None}


def test_element_xpath(parse):
    _, n = parse("<div id=d><i>1</i></div><p>a</p><p><i>b</i></p>")
    got = {r["xpath"] for r in dom.element_xpath(sel.select_css(n, "div, i, p", "id", "anc"), n).collect()}
    assert got == {'//*[@id="d"]', "/html/body/div/i", "/html/body/p[1]", "/html/body/p[2]", "/html/body/p[2]/i"}


def test_main_content_prefers_marked_areas(parse):
    _, n = parse("<nav>menu</nav><article>one <i>two</i><div class=ad>buy</div></article><p>outside is longer</p>", "<p>plain</p><footer>f</footer>")
    assert one(dom.main_content_text(n), "content") == ["one two", "plain"]


def test_relevant_html(parse):
    pages, n = parse("<ul><li>a<li>b</ul>", "<main><p>x</p></main>", "<p>y</p>")
    out = dom.relevant_html(pages, n, sel.select_css(n, "li", "parent"), sel.select_css(n, "main"))
    assert one(out, "html") == ["<ul><li>a<li>b</ul>\n<ul><li>a<li>b</ul>", "<main><p>x</p></main>", "<p>y</p>"]


def grid(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["page_id"], r["table_pre"], r["row_no"]), {})[r["col_name"]] = r["value"]
    return [v for _, v in sorted(out.items())]


def test_tables(parse):
    cases = [
        ("<table><thead><tr><th>a<th>b<tbody><tr><td>1<td>2<td>3</table>", [{"a": "1", "b": "2"}]),
        ("<table><tr><th>a<th>b<tr><td>1<td>2</table>", [{"a": "1", "b": "2"}]),
        ("<table><tr><td>a<td>b<tr><td>1<td>2<tr><td>3</table>", [{"a": "1", "b": "2"}, {"a": "3"}]),
        ("<table><tr><th>a<th>a<tr><td>1<td>2</table>", [{"a": "2"}]),
        ("<table><tr></tr><tr><td>1<td>2</table>", [{"col0": "1", "col1": "2"}]),
        ("<table><thead><tr><th>x<th>y<tbody><tr><th>r1<td>1<td>2<td>3<tr><th>r2<td>4</table>", [{"x": "1", "y": "2", "r1": "3"}, {"x": "4"}]),
        ("<table><tr><th>a<tr><th>only<tr><td>1</table>", [{"a": "1"}]),
    ]
    _, n = parse(*[h for h, _ in cases])
    rows = table_rows(n)
    for i, (html, want) in enumerate(cases):
        assert grid(rows.filter(F.col("page_id") == i)) == want, html


def test_nested_table_rows_count_for_the_outer_table(parse):
    _, n = parse("<table><tr><th>h<tr><td>o<table><tr><td>i1<tr><td>i2</table></table>")
    # first-row headers of the outer table: its own th only; inner rows and cells are read by both tables
    assert grid(table_rows(n)) == [{"h": "oi1i2"}, {"h": "i1"}, {"h": "i2"}, {"i1": "i2"}]


def test_records_and_caps(parse):
    pages, n = parse("<ul>" + "".join(f"<li data-k={i}><b> n{i} </b><i>{i}.50 $</i></li>" for i in range(7)) + "</ul>", "<p>none</p>")
    fields = [Field("k", None, "data-k"), Field("name", "b"), Field("price", "i", None, "number"), Field("gone", "u"), Field("all")]
    rows = dom_extract(n, "li", None, fields, cap=3).orderBy("rec_no").collect()
    assert [(r["k"], r["name"], r["price"], r["gone"], r["all"]) for r in rows] == [(str(i), f"n{i}", i + 0.5, None, f"n{i} {i}.50 $") for i in range(3)]
    meta = extract_metadata(pages, n, "li", None, 3).orderBy("page_id").collect()
    assert [(m["found"], m["extracted"], m["success"], m["selector_type"]) for m in meta] == [(7, 3, True, "css"), (0, 0, False, None)]
    assert "WindowGroupLimit" in containers(n, "li", None, 3)._jdf.queryExecution().executedPlan().toString()
