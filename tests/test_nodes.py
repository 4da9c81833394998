from pyspark.sql import functions as F

from gleanery.sources.nodes import _Tree, accepted, rejected, save_nodes


def shape(html):
    """Nested text form of the tree, to compare with what a browser builds."""
    t = _Tree(html)

    def show(n):
        kids = "".join(show(k) for k in t.nodes if k.parent is n)
        return {"text": n.text, "comment": f"<!--{n.text}-->"}.get(n.kind, f"{n.tag}({kids})" if n.tag else kids)

    return show(t.nodes[0])


def body(html):
    out = shape(html)
    return out[len("html(body("):-2]


def test_implied_structure():
    assert shape("<title>t</title><p>x") == "html(head(title(t))body(p(x)))"
    assert shape("plain") == "html(body(plain))"
    assert shape("<html><head></head><body>a</body></html>") == "html(head()body(a))"
    assert shape("") == ""


def test_optional_end_tags():
    assert body("<p>a<p>b") == "p(a)p(b)"
    assert body("<p><b>x<br><p>y") == "p(b(xbr()))p(y)"
    assert body("<ul><li>a<ul><li>b</ul><li>c</ul>") == "ul(li(aul(li(b)))li(c))"
    assert body("<p>a<div>b</div>") == "p(a)div(b)"
    assert body("<dl><dt>a<dd>b<dt>c</dl>") == "dl(dt(a)dd(b)dt(c))"
    assert body("<select><option>a<option>b</select>") == "select(option(a)option(b))"


def test_tables_get_bodies_and_rows():
    assert body("<table><tr><td>1<td>2<tr><td>3</table>") == "table(tbody(tr(td(1)td(2))tr(td(3))))"
    assert body("<table><td>1</table>") == "table(tbody(tr(td(1))))"
    assert body("<table><thead><tr><th>h<tbody><tr><td>1</table>") == "table(thead(tr(th(h)))tbody(tr(td(1))))"
    assert body("<table><tr><td><table><tr><td>i</table></td><td>o</table>") == "table(tbody(tr(td(table(tbody(tr(td(i)))))td(o))))"


def test_loose_markup():
    assert body("</i>x</div>") == "x"
    assert body("<DIV CLASS=a>x</Div>") == "div(x)"
    assert body("<p>a<![foo bar>b") == "p(a<!--[foo bar-->b)"
    assert body("a<p") == "a"
    assert body("a<!-- open") == "a<!-- open-->"
    assert body("<p>x<script>if(a<b){'</p>'}</script>y") == "p(xscript(if(a<b){'</p>'})y)"
    assert shape("<title>a <b>&amp;c</title><textarea><i>&lt;") == "html(head(title(a <b>&c))body(textarea(<i><)))"
    assert shape("<script>open") == "html(head(script(open)))"


def test_deep_nesting_is_kept_flat():
    t = _Tree("<div>" * 3000 + "x")
    assert sum(n.tag == "div" for n in t.nodes) == 3000 and max(n.depth for n in t.nodes) == 512


def test_node_columns(parse):
    html = '<ul id=u><li class="a b">é<b>x</b></li><li hidden>y</li></ul><p style="opacity:0">z</p>'
    pages, nodes = parse(html)
    rows = {r["pre"]: r for r in nodes.collect()}
    ul, li1, li2 = (next(r for r in rows.values() if r["tag"] == "ul"), *[r for r in sorted(rows.values(), key=lambda r: r["pre"]) if r["tag"] == "li"])
    assert (ul["id"], ul["last"] - ul["pre"]) == ("u", 6) and ul["anc"] == [0, 1, 2] and ul["path"] == "/html/body/ul"
    assert li1["classes"] == ["a", "b"] and (li1["sib_pos"], li1["sib_cnt"], li1["type_pos"], li1["type_cnt"]) == (1, 2, 1, 2)
    assert li1["text"] == "éx" and li1["vtext"] == "é x"
    assert li2["hidden"] and li2["vtext"] == "" and ul["vtext"] == "é x" and ul["text"] == "éxy"
    src = html.encode()
    assert src[li1["i0"]:li1["i1"]].decode() == "é<b>x</b>" and src[li2["o0"]:li2["o1"]].decode() == "<li hidden>y</li>"


def test_bad_pages_become_issues(spark):
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "u", None), (3, None, "x")], "page_id long, url string, html string")
    assert [r[0] for r in accepted(pages).select("page_id").collect()] == [1]
    assert sorted(r["page_id"] for r in rejected(pages).collect()) == [2, 3]


def test_bucketed_nodes_join_without_shuffle(spark, parse, tmp_path):
    from gleanery.operators.selectors import select_css

    _, nodes = parse("<ul><li>a</li></ul>", "<ul><li>b</li></ul>")
    save_nodes(nodes, "t_nodes", str(tmp_path / "n"), 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = select_css(spark.table("t_nodes"), "ul > li")
        assert found.count() == 2
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE t_nodes")
