"""XPath axes and positions against a plain evaluator over the same nodes."""

import random

import pytest

from gleanery.operators import selectors as sel
from gleanery.operators import xpath_axes

HTML = (
    "<div id=top class=a><h1>T</h1><ul><li class=a><b>x</b><li><b>y</b><i>z</i><li class=a><p>q<b>r</b></p><li class=b>s</ul><p class=a>one<p>two<p class=b><i>k</i><i>m</i></p></div>"
    "<div><ul class=b><li>1<li class=a>2<ul><li>3<li class=a>4</ul><li>5</ul><h1>U</h1><p>three<table><tr><td>a<td>b<tr><td>c<td>d</table></div>"
)


class Tree:
    def __init__(self, rows):
        self.els = sorted((r for r in rows if r["kind"] == "element"), key=lambda r: r["pre"])
        self.by = {r["pre"]: r for r in self.els}

    def axis(self, ctx, name):
        """In axis order; ctx None is the document."""
        e = self.els
        if ctx is None:
            return {"child": [x for x in e if x["depth"] == 1], "descendant": e, "descendant-or-self": e}.get(name, [])
        up = [self.by[a] for a in ctx["anc"] if a in self.by][::-1]
        return {
            "self": [ctx], "child": [x for x in e if x["parent"] == ctx["pre"]], "parent": up[:1], "ancestor": up, "ancestor-or-self": [ctx, *up],
            "descendant": [x for x in e if ctx["pre"] in x["anc"]], "descendant-or-self": [x for x in e if x is ctx or ctx["pre"] in x["anc"]],
            "following-sibling": [x for x in e if x["parent"] == ctx["parent"] and x["pre"] > ctx["pre"]],
            "preceding-sibling": [x for x in e if x["parent"] == ctx["parent"] and x["pre"] < ctx["pre"]][::-1],
            "following": [x for x in e if x["pre"] > ctx["last"]], "preceding": [x for x in e if x["last"] < ctx["pre"]][::-1],
        }[name]

    def holds(self, x, pos, size, pred):
        kind, *a = pred
        if kind == "pos":
            return pos == a[0]
        if kind == "last":
            return pos == size - a[0]
        if kind == "upto":
            return pos <= a[0]
        if kind == "class":
            return dict(x["attrs"]).get("class") == a[0]
        if kind == "has":
            return dict(x["attrs"]).get("class") is not None
        if kind == "path":
            return bool(self.run([x], a[0]))
        if kind == "not":
            return not self.holds(x, pos, size, a[0])
        return self.holds(x, pos, size, a[0]) and self.holds(x, pos, size, a[1])

    def filtered(self, xs, preds):
        for p in preds:
            xs = [x for i, x in enumerate(xs, 1) if self.holds(x, i, len(xs), p)]
        return xs

    def run(self, now, steps):
        for axis, tag, preds in steps:
            out = {}
            if axis == "//":
                for c in now:
                    for d in [c, *([] if c is not None else [])] + self.axis(c, "descendant" if c is not None else "descendant"):
                        for x in self.filtered([y for y in self.axis(d, "child") if tag in ("*", y["tag"])], preds):
                            out[x["pre"]] = x
            else:
                for c in now:
                    for x in self.filtered([y for y in self.axis(c, axis) if tag in ("*", y["tag"])], preds):
                        out[x["pre"]] = x
            now = list(out.values())
        return now


def text_of_pred(p):
    kind, *a = p
    if kind == "pos":
        return str(a[0])
    if kind == "last":
        return f"last()-{a[0]}" if a[0] else "last()"
    if kind == "upto":
        return f"position()<={a[0]}"
    if kind == "class":
        return f"@class='{a[0]}'"
    if kind == "has":
        return "@class"
    if kind == "path":
        return text_of(a[0], True)
    if kind == "not":
        return f"not({text_of_pred(a[0])})"
    return f"{text_of_pred(a[0])} and {text_of_pred(a[1])}"


def text_of(steps, relative=False):
    out = ""
    for i, (axis, tag, preds) in enumerate(steps):
        sep = "" if relative and not i else "/"
        body = ".." if axis == "parent" and tag == "*" and not preds else tag if axis in ("child", "//") else f"{axis}::{tag}"
        if axis == "//":
            sep = ".//" if relative and not i else "//"
        out += sep + body + "".join(f"[{text_of_pred(p)}]" for p in preds)
    return out


TAGS = ["li", "b", "p", "ul", "div", "*", "i", "td"]


def made(r, first):
    def pred(deep=True):
        kind = r.choice(["pos", "pos", "last", "upto", "class", "has", "path", "not", "and"] if deep else ["pos", "class", "has"])
        if kind in ("pos", "upto"):
            return (kind, r.randint(1, 3))
        if kind == "last":
            return (kind, r.randint(0, 1))
        if kind == "class":
            return (kind, r.choice("ab"))
        if kind == "path":
            return (kind, [(r.choice(["child", "//", "following-sibling", "ancestor", "parent"]), r.choice(TAGS), [])])
        if kind == "not":
            return (kind, pred(False))
        if kind == "and":
            return (kind, pred(False), pred(False))
        return (kind,)

    def step(axes):
        return (r.choice(axes), r.choice(TAGS), [pred() for _ in range(r.choice([0, 0, 1, 1, 2]))])

    return [step(["//", "//", "descendant"] if first else ["child"]), *[step([*xpath_axes.AXES, "//", "child", "following-sibling", "preceding-sibling"]) for _ in range(r.randint(0, 2))]]


@pytest.fixture(scope="module")
def page(spark):
    from gleanery.session import written
    from gleanery.sources.nodes import parse_pages

    pages = spark.createDataFrame([(7, "u", HTML), (8, "u", "<p>other")], "page_id long, url string, html string")
    return written(parse_pages(pages), "axes-nodes")


def found(df):
    return sorted(r["pre"] for r in df.collect() if r["page_id"] == 7)


def test_axes_against_a_plain_evaluator(page):
    tree = Tree([r for r in page.collect() if r["page_id"] == 7])
    r = random.Random(3)
    some = 0
    for _ in range(60):
        steps = made(r, True)
        want = sorted(x["pre"] for x in tree.run([None], steps))
        text = text_of(steps)
        assert sel.is_valid(text), text
        assert found(xpath_axes.select_axes(page, text)) == want, text
        some += bool(want)
    assert some > 20


@pytest.mark.parametrize(
    "steps",
    [
        [("//", "li", [("pos", 1)]), ("following-sibling", "li", [("class", "a"), ("pos", 1)])],
        [("//", "li", []), ("preceding-sibling", "*", [("pos", 2)])],
        [("//", "b", []), ("following", "li", [("pos", 1)])],
        [("//", "b", []), ("following", "li", [("last", 0)])],
        [("//", "b", []), ("preceding", "li", [("pos", 1)])],
        [("//", "li", [("class", "a"), ("pos", 2)])],
        [("//", "b", []), ("ancestor", "*", [("pos", 2)])],
        [("//", "td", []), ("parent", "*", []), ("following-sibling", "tr", [("pos", 1)]), ("child", "td", [("last", 0)])],
        [("//", "ul", [("path", [("child", "li", [("class", "b")])])])],
        [("//", "li", [("not", ("path", [("//", "li", [])]))])],
        [("descendant", "li", [("pos", 3)])],
    ],
    ids=text_of,
)
def test_chosen_axes(page, steps):
    tree = Tree([r for r in page.collect() if r["page_id"] == 7])
    want = sorted(x["pre"] for x in tree.run([None], steps))
    assert want and found(sel.select_xpath(page, text_of(steps))) == want


def test_positions_in_the_whole_result(page):
    li = found(sel.select_xpath(page, "//li"))
    assert found(sel.select_xpath(page, "(//li)[3]")) == li[2:3]
    assert found(sel.select_xpath(page, "(//li)[last()]")) == li[-1:]
    assert found(sel.select_xpath(page, "(//li | //b)[position()<=2]/..")) == sorted({found(sel.select_xpath(page, "//ul"))[0], li[0]})
    assert found(sel.select_xpath(page, "(//ul)[2]/li[@class]")) == found(sel.select_xpath(page, "//ul[@class='b']/li[@class='a']"))
    assert found(sel.select_xpath(page, "(//li[2])[1]")) == li[1:2]


def test_values_and_texts(page):
    got = sel.select_xpath(page, "//b/../@class").filter("page_id = 7").collect()
    assert [r["value"] for r in got] == ["a"]
    got = sel.select_xpath(page, "//h1/following-sibling::p[1]/text()").filter("page_id = 7").collect()
    assert sorted(r["value"] for r in got) == ["one", "three"]
    assert [r["value"] for r in sel.select_xpath(page, "//tr[td='c']/td[2]/text()").collect()] == ["d"]
    assert found(sel.select_xpath(page, "//ul[li/b/text()='x']")) == found(sel.select_xpath(page, "//ul"))[:1]
    assert found(sel.select_xpath(page, "//*[contains(., 'three')][2]")) == []
    assert found(sel.select_xpath(page, "//p[contains(., 'three')]/preceding-sibling::h1")) == found(sel.select_xpath(page, "//h1"))[1:]


def test_labelled_with_others(page):
    got = {(r.label, r.page_id) for r in sel.select_many(page, {"up": "//li/..", "css": "p", "bad": "//li[", "is": ":is(ul, table) li"}).collect()}
    assert got == {("up", 7), ("css", 7), ("css", 8), ("is", 7)}
    assert found(sel.select_css(page, ":is(ul, table).b > li:where(.a)")) == found(sel.select_xpath(page, "//ul[@class='b']/li[@class='a']"))


@pytest.mark.parametrize("bad", ["//li/bogus::p", "//li[", "(//li", "//li/..p", "//li[foo()]", "//", "//li/following-sibling::", "ancestor::p", "(//li/@class)[1]", "//li/@a/b"])
def test_refused(bad):
    assert not sel.is_valid(bad) or sel.selector_kind(bad) == "css"


def test_positions_do_not_pair_siblings(spark, parse):
    """The k-th sibling after each of many is found by counting, not by pairs."""
    pages, nodes = parse("<table>" + "<tr><td>x" * 4000 + "</table>")
    df = sel.select_xpath(nodes, "//tr[@x or not(@x)]/following-sibling::tr[2]")
    assert df.count() == 3998
    assert "BroadcastNestedLoopJoin" not in df._jdf.queryExecution().executedPlan().toString() and "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
