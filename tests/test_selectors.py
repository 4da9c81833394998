import re

import pytest
from pyspark.sql import functions as F

from gleanery.operators import selectors as sel
from gleanery.operators.paths import element_selectors
from gleanery.sources.nodes import _Tree

HTML = """<html lang=en><body><div id=main class="wrap a"><h1>T</h1><p class=x>1<b>q</b></p><p class="x y">2</p><div class=a><p>3</p>
<ul class=a><li>i<li class=on>j<ul><li data-k="v w">k</ul><li>l</ul></div></div><div class=a><p class=y>4<a href="/u/1.png">m</a><a>n</a></p><span>s</span><p>5</p></div>
<div id="1st"><em>z</em></div></body></html>"""
CSS = [
    "p", "*", ".a", "#main", "div p", "div > p", "div div p", "ul li ul li", "ul > li > ul", "h1 + p", "h1 ~ p", "p ~ p", "p + span + p", ".a .a li", "p.x.y", "li.on",
    "[data-k]", "[data-k='v w']", "[data-k~=w]", "[href^='/u']", "[href$=png]", "[href*='1.']", "li:first-child", "li:last-child", "p:nth-child(2)", "p:nth-of-type(2)",
    "li:nth-child(odd)", "li:nth-child(2n)", "a, b, li.on", "div a, p a, a", "body > div.a > p > a", "div > div ~ div", "#main ul > li:nth-of-type(3)", "html li", "li li",
    "div.a p:first-child, h1", "#\\31 st em", "li:nth-of-type(n+2)", "[lang|=en]", "DIV.a",
]


class Brute:
    """Selector matching by walking a small tree, to compare with."""

    def __init__(self, html):
        self.els = [n for n in _Tree(html).nodes if n.kind == "element"]

    def parent(self, n):
        return n.parent if n.parent and n.parent.kind == "element" else None

    def before(self, n):
        return [k for k in self.els if k.parent is n.parent and k.pre < n.pre]

    def simple(self, n, text):
        ident = r"(?:\\[0-9a-f]+ |[\w-])+"
        a = dict(n.attrs)
        for m in re.finditer(rf"(?P<tag>^[\w*]+)|#(?P<id>{ident})|\.(?P<cls>[\w-]+)|\[(?P<at>[\w-]+)(?:(?P<op>[~|^$*]?=)['\"]?(?P<v>[^'\"\]]*)['\"]?)?\]|:(?P<ps>[\w-]+)(?:\((?P<arg>[^)]*)\))?", text):
            g = m.groupdict()
            if g["tag"] and g["tag"] not in ("*", n.tag) and g["tag"].lower() != n.tag:
                return False
            if g["id"] and a.get("id") != g["id"].replace("\\31 ", "1"):
                return False
            if g["cls"] and g["cls"] not in a.get("class", "").split():
                return False
            if g["at"]:
                v, w = a.get(g["at"]), g["v"]
                ok = v is not None and {None: True, "=": v == w, "~=": w in v.split(), "|=": v == w or v.startswith(f"{w}-"), "^=": v.startswith(w or "?"),
                                        "$=": v.endswith(w or "?"), "*=": (w or "?") in v}[g["op"]]
                if not ok:
                    return False
            if g["ps"]:
                pos, cnt = (n.type_pos, n.type_cnt) if "type" in g["ps"] else (n.sib_pos, n.sib_cnt)
                arg = g["arg"]
                ok = {"first-child": pos == 1, "last-child": pos == cnt}.get(g["ps"])
                if ok is None:
                    ok = {"odd": pos % 2 == 1, "2n": pos % 2 == 0, "n+2": pos >= 2}.get(arg)
                if not (ok if ok is not None else pos == int(arg)):
                    return False
        return True

    def chain(self, n, parts):
        if not self.simple(n, parts[-1]):
            return False
        if len(parts) == 1:
            return True
        link, rest = parts[-2], parts[:-2]
        up = []
        if link == ">":
            up = [self.parent(n)]
        elif link == " ":
            while n := self.parent(n):
                up.append(n)
        elif link == "+":
            up = [k for k in self.before(n) if k.sib_pos == n.sib_pos - 1]
        else:
            up = self.before(n)
        return any(u is not None and self.chain(u, rest) for u in up)

    def find(self, selector):
        out = set()
        for alt in selector.split(","):
            hide = str.maketrans(" +~", "\0\1\2")
            alt = re.sub(r"\\31 |\([^)]*\)|\[[^\]]*\]", lambda m: m.group().translate(hide), alt.strip())
            parts = [p.strip() or " " for p in re.split(r"(\s*[>+~]\s*|\s+)", alt)]
            parts = [p.translate(str.maketrans("\0\1\2", " +~")) for p in parts]
            out |= {n.pre for n in self.els if self.chain(n, parts)}
        return sorted(out)


@pytest.fixture(scope="module")
def page(spark):
    from gleanery.session import written
    from gleanery.sources.nodes import parse_pages

    return written(parse_pages(spark.createDataFrame([(1, HTML), (2, "<p>other</p>")], "page_id long, html string")), "sel")


def found(df):
    return sorted(r["pre"] for r in df.collect() if r["page_id"] == 1)


def test_css_against_brute_force(page):
    brute = Brute(HTML)
    rows = sel.select_many(page, {s: s for s in CSS}).collect()
    for s in CSS:
        assert sorted(r["pre"] for r in rows if r["label"] == s and r["page_id"] == 1) == brute.find(s), s


@pytest.mark.parametrize("css", ["div div p", "h1 ~ p", "div > div ul li", "a, b"])
def test_single_selectors(page, css):
    assert found(sel.select_css(page, css)) == Brute(HTML).find(css)


def test_xpath(page):
    brute = Brute(HTML)
    same = {
        "//p": "p", "/html/body/div[1]/p[2]": "body > div:nth-of-type(1) > p:nth-of-type(2)", "//ul/li[last()]": "ul > li:last-child", "//*[@id='main']": "#main",
        "//li[@class]": "li.on", '//*[@data-k="v w"]': "[data-k]", "//a[contains(@href, '1')]": "[href*='1.']", ".//em": "em", "//div//li//li": "li li", "//div/*[1]": "div > *:first-child",
        "//a[starts-with(@href,'/u')]": "[href^='/u']",
    }
    for xpath, css in same.items():
        assert found(sel.select_xpath(page, xpath)) == brute.find(css), xpath
    assert [r["value"] for r in sel.select_xpath(page, "//a/@href").collect()] == ["/u/1.png"]
    assert [r["value"] for r in sel.select_xpath(page, "//em/text()").collect()] == ["z"]


@pytest.mark.parametrize("bad", ["", "##x", "p >", "> p", "p[", "p:hover", "p::before", "li:nth-child(x)", "a,,b", "p )", "//", "/", "//p[position()=x]", "p:not(a b)", "//p[@a][", "//p[f()]"])
def test_unusable_selectors_match_nothing(page, bad):
    assert not sel.is_valid(bad)
    assert sel.select_or_empty(page, bad).count() == 0


def test_counts_keep_zeros(page, spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id long")
    got = {(r["page_id"], r["selector"]): (r["n"], r["valid"]) for r in sel.match_counts(pages, page, ["p", "ul li", "!!"]).collect()}
    assert got[(1, "p")] == (5, True) or got[(1, "p")][0] == len(Brute(HTML).find("p"))
    assert got[(2, "ul li")] == (0, True) and got[(3, "p")] == (0, True) and got[(1, "!!")] == (0, False)


def test_scoped_pairs_nest(page):
    boxes = sel.select_css(page, "ul, div.a")
    pairs = {(r["ctx_pre"], r["pre"]) for r in sel.within(sel.select_css(page, "li", "anc"), boxes).collect()}
    brute = Brute(HTML)
    want = {(b.pre, k.pre) for b in brute.els if b.pre in brute.find("ul, div.a") for k in brute.els if k.tag == "li" and b.pre < k.pre <= b.last}
    assert pairs == want


def test_generated_selectors_are_unique_where_they_say_so(page):
    brute = Brute(HTML)
    rows = [r for r in element_selectors(sel.select_css(page, "*", "id", "anc"), page).collect() if r["page_id"] == 1]
    assert len(rows) == len(brute.els)
    for r in rows:
        hits = brute.find(r["selector"])
        assert r["pre"] in hits, r
        if r["n_matches"] is not None:
            assert len(hits) == r["n_matches"], r
            parts = r["selector"].split(" > ")
            for k in range(1, len(parts)):
                assert len(brute.find(" > ".join(parts[k:]))) > 1, r


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(page):
    by_path = plan_of(sel.select_css(page, "div ul > li a.x, nav b"))
    assert by_path.count("FileScan") == 1 and "Exchange" not in by_path
    by_window = plan_of(sel.select_css(page, "div.a ul li a"))
    assert by_window.count("FileScan") == 1 and by_window.count("Exchange") == 1
    assert "Cartesian" not in by_window and "NestedLoop" not in by_window
    assert "In(tag, [a,div,li,ul])" in by_window.split("PushedFilters")[1]


def test_path_pattern_does_not_backtrack(parse):
    deep = "<div>" * 500 + "<b>x</b>"
    _, n = parse(deep)
    assert sel.select_css(n, "div div div div div div ul div b").count() == 0
    assert sel.select_css(n, "div div > div div > div > div b").count() == 1

MORE = {
    "p:not(.x)": lambda n, b: n.tag == "p" and not b.simple(n, ".x"), "li:not(.on, :first-child)": lambda n, b: n.tag == "li" and not b.simple(n, ".on") and n.sib_pos > 1,
    "li:nth-last-child(2)": lambda n, b: n.tag == "li" and n.sib_cnt - n.sib_pos == 1, "p:nth-last-of-type(1)": lambda n, b: n.tag == "p" and n.type_pos == n.type_cnt,
    "a:only-of-type, em:only-child": lambda n, b: n.tag == "em", "p:not(:nth-child(2))": lambda n, b: n.tag == "p" and n.sib_pos != 2, "[data-k='V W' i]": lambda n, b: "data-k" in dict(n.attrs),
    "//p[@class and position()=2]": lambda n, b: n.tag == "p" and "class" in dict(n.attrs) and n.type_pos == 2, "//li[not(@class)]": lambda n, b: n.tag == "li" and "class" not in dict(n.attrs),
    "//li[position()<3]": lambda n, b: n.tag == "li" and n.type_pos < 3, "//li[position()>=2]": lambda n, b: n.tag == "li" and n.type_pos >= 2, "//li[last()-1]": lambda n, b: n.tag == "li" and n.type_cnt - n.type_pos == 1,
    "//li[position()!=last()]": lambda n, b: n.tag == "li" and n.type_pos < n.type_cnt, "//h1 | //em": lambda n, b: n.tag in ("h1", "em"), "//p[@class='x' or @class='y']": lambda n, b: n.tag == "p" and dict(n.attrs).get("class") in ("x", "y"),
    "//p[@class!='x']": lambda n, b: n.tag == "p" and dict(n.attrs).get("class", "x") != "x", "//li[normalize-space(@data-k)='v w']": lambda n, b: "data-k" in dict(n.attrs), "//*[contains(@class,'a or b') or @id='main']": lambda n, b: dict(n.attrs).get("id") == "main",
}


def test_more_grammar_against_brute_force(page):
    b = Brute(HTML)
    for text, want in MORE.items():
        expect = sorted(n.pre for n in b.els if want(n, b))
        assert expect and found(sel.select(page, text)) == expect, text


def test_selectors_from_a_table(page, spark):
    """The same matches from rows of a table, and a plan that does not grow with the rows."""
    from gleanery.operators import selector_table as st

    texts = [*CSS, *MORE, "//ul/li[2]", "//div[@class='a']//li", ".//p/b", "!!", "", "nav | a"]
    rows = spark.createDataFrame([(t,) for t in texts], "selector string")
    got = {}
    for r in st.matches(page, rows).collect():
        if r["page_id"] == 1:
            got.setdefault(r["selector"], set()).add(r["pre"])
    for t in texts:
        assert sorted(got.get(t, ())) == found(sel.select_or_empty(page, t)), t
    asked = spark.createDataFrame([(1, "p"), (2, "p"), (2, "li")], "page_id long, selector string")
    assert {(r["page_id"], r["selector"]) for r in st.matches_on(page, asked).collect()} == {(1, "p"), (2, "p")}
    scans = lambda n: st.matches(page, spark.createDataFrame([(f".c{i} > p",) for i in range(n)], "selector string"))._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert scans(5) == scans(500)


def text_of(n):
    return "".join(k.text or "" if k.kind == "text" else text_of(k) for k in ALL if k.parent is n and k.kind in ("text", "element"))


ALL = []


def test_text_predicates(page, spark):
    ALL[:] = _Tree(HTML).nodes
    els = [n for n in ALL if n.kind == "element"]
    first = lambda n: next((k.text for k in ALL if k.parent is n and k.kind == "text"), "")
    want = {
        "//p[contains(., 'q')]": lambda n: n.tag == "p" and "q" in text_of(n), "//p[contains(text(), '1')]": lambda n: n.tag == "p" and "1" in first(n), "//li[.='l']": lambda n: n.tag == "li" and text_of(n) == "l",
        "//*[normalize-space()='T']": lambda n: text_of(n).split() == ["T"], "//li[text()='i']/../nothing": None, "//a[text()='n']": lambda n: n.tag == "a" and first(n) == "n",
        "//div[contains(., 'z')]//em": lambda n: n.tag == "em", "//p[starts-with(text(), '4') and @class]": lambda n: n.tag == "p" and first(n).startswith("4"), "//li[not(contains(., 'k'))]": lambda n: n.tag == "li" and "k" not in text_of(n),
    }
    for text, test in want.items():
        if test is None:
            assert found(sel.select(page, text)) == []
            continue
        expect = sorted(n.pre for n in els if test(n))
        assert expect and found(sel.select(page, text)) == expect, text
    got = {r["label"]: r["pre"] for r in sel.select_many(page, {"a": "//a[text()='n']", "b": "//h1"}).collect() if r["page_id"] == 1}
    assert set(got) == {"a", "b"}


def test_text_predicates_on_long_text(parse):
    _, n = parse("<div><p>" + "word " * 300 + "<b>needle</b> tail</p></div><p>" + "x" * 700 + "</p>")
    assert sel.select(n, "//p[contains(., 'needle tail')]").count() == 1
    assert sel.select(n, "//div[contains(., 'needle')]/p").count() == 1
    assert sel.select(n, "//p[contains(text(), 'needle')]").count() == 0


def test_text_tests_in_table_selectors(page, spark, parse):
    """The same as for a single selector, whatever the length of the text."""
    from gleanery.operators import selector_table as st

    long = "x" * 600
    _, nodes = parse(f"<div><p>one<b>two</b>tail</p><p class=a> one </p><p>{long}<i>end</i></p><ul><li>a<li>b<li class=a>{long}</ul></div>", "<p>one")
    texts = [
        "//p[contains(., 'two')]", "//p[text()='tail']", "//p[text()!='tail']", "//p[starts-with(text(), 'one')]", "//p[normalize-space()='one']", "//*[contains(text(), 'end')]", "//p[contains(., 'xend')]",
        "//p[not(contains(., 'x'))]", "//div[contains(., 'end')]/ul/li[2]", "//li[.='a' or .='b']", "//li[@class='a' and contains(., 'xx')]", "//ul[contains(., 'nothing')]/li", "//b[.='']", "//p[contains(., 'one')][@class] | //li[text()='b']",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "selector string")
    got = {}
    for r in st.matches(nodes, rows).collect():
        got.setdefault(r["selector"], set()).add((r["page_id"], r["pre"]))
    for t in texts:
        want = {(r["page_id"], r["pre"]) for r in sel.select(nodes, t).collect()}
        assert got.get(t, set()) == want, t
    assert sum(map(bool, got.values())) >= 11


@pytest.mark.parametrize("n", [511, 512, 513])
def test_text_tests_about_the_stored_length(spark, parse, n):
    from gleanery.operators import selector_table as st

    _, nodes = parse(f"<p>{'y' * (n - 1)}z")
    rows = spark.createDataFrame([("//p[contains(., 'yz')]",), (f"//p[.='{'y' * (n - 1)}z']",), ("//p[contains(., 'zz')]",)], "selector string")
    assert st.matches(nodes, rows).count() == 2


def test_many_alternatives_in_a_table(page, spark):
    """Long lists of compound alternatives are no product."""
    from gleanery.operators import selector_table as st

    many = ":is(" + ", ".join(f"li.k{i}[title=t{i}]" for i in range(40)) + ", p.a) , :not(:is(" + ", ".join(f"b.k{i}" for i in range(40)) + ", p, li, ul, div))"
    assert st.usable(spark.createDataFrame([(many,)], "selector string")).first().valid
    got = sorted(r["pre"] for r in st.matches(page, spark.createDataFrame([(many,)], "selector string")).collect() if r["page_id"] == 1)
    assert got == found(sel.select(page, many)) and got


def test_counts_of_asked_pairs_keep_zeros(page, spark):
    from gleanery.operators import selector_table as st

    asked = spark.createDataFrame([(1, "p"), (1, "p"), (1, "video"), (2, "li["), (9, "p"), (1, None)], "page_id long, selector string")
    got = {(r.page_id, r.selector): (r.n, r.valid) for r in st.counts_on(page, asked).collect()}
    n = len(found(sel.select(page, "p")))
    assert got == {(1, "p"): (n, True), (1, "video"): (0, True), (2, "li["): (0, False), (9, "p"): (0, True), (1, None): (0, False)}


def test_a_model_answer_with_text_recovers_a_field(spark, parse):
    from gleanery.operators import recover

    pages, nodes = parse("<ul><li>Name: A<li>Price: 5</ul>", "<ul><li>Price: 7<li>x</ul>")
    lost = spark.createDataFrame([(0, "price", ".gone"), (1, "price", ".gone")], "page_id long, dp_id string, selector string")
    answer = recover.Strategy("answers", from_errors=lambda e: e.select("page_id", "dp_id", F.lit(0).alias("alt_rank"), F.lit("//li[contains(., 'Price')]").alias("selector")))
    chosen = recover.chosen_alternative(recover.working_alternatives(nodes, recover.proposals(lost, (answer,))))
    again = recover.reextract(chosen, nodes, pages, {"price": (False, "text", "")})
    assert {(r.page_id, r.value) for r in again.collect()} == {(0, "Price: 5"), (1, "Price: 7")}
