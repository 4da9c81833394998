"""CSS and XPath selection as DataFrame steps over the node table.

A selector text becomes a short list of steps; each step is a Column
predicate plus how it hangs off the step before it:

* steps whose ancestors are plain tags (``nav ul > li a.x``) are decided on the
  row itself, by its tag path: a filter, no shuffle.
* other descendant steps: one window per step over ``(page_id, pre)``. Pre-order
  intervals nest, so "some matched row before me ends after me" means "a
  matched ancestor". A run of such steps shares one scan, one shuffle and one
  sort, and never compares pairs of nodes.
* child and adjacent-sibling steps: left-semi equi joins.
* general-sibling steps: first matched position per parent, then a join.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.scalars import squash
from gleanery.operators.texts import elements_with
from gleanery.sources.nodes import elements

KEY = ("page_id", "pre")
_LINKS = ("page_id", "pre", "last", "parent", "sib_pos")


class InvalidSelector(ValueError):
    pass


@dataclass
class Step:
    link: str  # " " descendant, ">" child, "+" next sibling, "~" later sibling
    tests: list[tuple] = field(default_factory=list)  # plain data, so that a parsed selector can also be rows of a table
    tag: str = "*"
    plain: bool = True  # nothing but a tag is asked for
    root: bool = False  # must be the top element

    def test(self) -> Column:
        """Plain conjunction, so that a filter on it reaches the parquet scan."""
        tests = [as_column(t) for t in self.tests] or [F.lit(True)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


_IDENT = r"(?:\\[0-9a-fA-F]{1,6}\s?|\\.|[\w-]|[^\x00-\x7f])+"
_CSS_TOKEN = re.compile(
    rf"""(?P<link>\s*[>+~]\s*|\s+)|(?P<tag>\*|{_IDENT})|\#(?P<id>{_IDENT})|\.(?P<cls>{_IDENT})
    |\[\s*(?P<attr>{_IDENT})\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>{_IDENT}))\s*(?P<case>[iI]\s*)?)?\]
    |:(?P<pseudo>[a-z-]+)(?:\(\s*(?P<arg>(?:[^()]|\([^()]*\))*?)\s*\))?""",
    re.X,
)


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _plain(ident: str) -> str:
    hexed = re.sub(r"\\([0-9a-fA-F]{1,6})\s?", lambda m: chr(int(m.group(1), 16)), ident)
    return re.sub(r"\\(.)", r"\1", hexed)


def _attr_test(name: str, op: str | None, value: str | None, any_case: bool) -> Column:
    a = _attr(name)
    if op is None:
        return a.isNotNull()
    if any_case:
        a, value = F.lower(a), value.lower()
    if op == "=":
        return a == value
    if op == "~=":
        return F.array_contains(F.split(a, r"\s+"), value) if value and not re.search(r"\s", value) else F.lit(False)
    if op == "|=":
        return (a == value) | a.startswith(value + "-")
    if op == "==":  # white space trimmed and squeezed
        return squash(a) == value
    if not value:
        return F.lit(False)
    return {"^=": a.startswith, "$=": a.endswith, "*=": a.contains}[op](value)


def _flag(test: tuple) -> str:
    return "_t" + hashlib.md5(repr(test).encode()).hexdigest()[:12]


def _text_tests(test: tuple) -> list[tuple]:
    if test[0] == "text":
        return [test]
    return [t for a in test[1:] if isinstance(a, tuple) for t in _text_tests(a)]


def _flagged(nodes: DataFrame, steps: list[Step]) -> DataFrame:
    """Elements, with a flag for each text test of the steps."""
    return with_text_flags(elements(nodes), nodes, {t: s.tag for s in steps for test in s.tests for t in _text_tests(test)})


def with_text_flags(els: DataFrame, nodes: DataFrame, wanted: dict[tuple, str]) -> DataFrame:
    """Elements with a flag for each text test, asked of a tag: text is read once for each, and only keys are joined."""
    for test, tag in wanted.items():
        found = elements_with(nodes, *test[1:], tag=tag).withColumn(_flag(test), F.lit(True))
        els = els.join(found, list(KEY), "left").withColumn(_flag(test), F.coalesce(_flag(test), F.lit(False)))
    return els


def as_column(test: tuple) -> Column:
    """A test over one element row. Tests are tuples: a kind, then its arguments.

    ``nth`` compares ``a * n + b`` with a position counted from the first or, if
    ``back``, from the last sibling.
    """
    kind, *args = test
    if kind == "tag":
        return F.lit(True) if args[0] == "*" else F.col("tag") == args[0]
    if kind == "id":
        return F.col("id") == args[0]
    if kind == "class":
        return F.array_contains("classes", args[0])
    if kind == "attr":
        return _attr_test(*args)
    if kind == "text":
        return F.col(_flag(test))
    if kind == "top":
        return F.col("depth") == 1
    if kind == "alone":
        return F.col(f"{args[0]}_cnt") == 1
    if kind == "empty":
        return (F.col("last") == F.col("pre")) & (F.coalesce("text", F.lit("")) == "")
    if kind == "not":
        return ~F.coalesce(as_column(args[0]), F.lit(False))
    if kind in ("and", "or"):
        out = as_column(args[0])
        for t in args[1:]:
            out = out & as_column(t) if kind == "and" else out | as_column(t)
        return out
    if kind == "nth":
        which, back, a, b = args
        pos = F.col(f"{which}_pos")
        off = (F.col(f"{which}_cnt") - pos + 1 if back else pos) - b
        return (off == 0) if a == 0 else ((off * (1 if a > 0 else -1) >= 0) & (off % abs(a) == 0))
    raise InvalidSelector(kind)


def _nth(which: str, back: bool, arg: str | None) -> tuple:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg or "", arg or "").replace(" ", "")
    if re.fullmatch(r"\+?\d+", arg):
        return ("nth", which, back, 0, int(arg))
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", arg)
    if not m:
        raise InvalidSelector(arg)
    a = int(m.group(1) + "1") if m.group(1) in ("", "+", "-") else int(m.group(1))
    return ("nth", which, back, a, int(m.group(2) or 0))


# Pseudo-classes with an argument, and those without.
_NTH = {"nth-child": ("sib", False), "nth-of-type": ("type", False), "nth-last-child": ("sib", True), "nth-last-of-type": ("type", True)}
_FIXED = {
    "first-child": ("nth", "sib", False, 0, 1), "last-child": ("nth", "sib", True, 0, 1), "first-of-type": ("nth", "type", False, 0, 1),
    "last-of-type": ("nth", "type", True, 0, 1), "only-child": ("alone", "sib"), "only-of-type": ("alone", "type"), "empty": ("empty",), "root": ("top",),
}


def _pseudo_test(name: str, arg: str | None) -> tuple:
    if name in _NTH:
        return _nth(*_NTH[name], arg)
    if name in ("not", "is", "where") and arg:
        # a list of simple selectors without steps
        chains = [_css_chain(part.strip()) for part in _css_parts(arg)]
        if any(len(c) > 1 for c in chains):
            raise InvalidSelector(arg)
        each = ("or", *[("and", *c[0].tests) for c in chains])
        return ("not", each) if name == "not" else each
    if name not in _FIXED or arg is not None:
        raise InvalidSelector(name)
    return _FIXED[name]


def _css_parts(selector: str) -> list[str]:
    """Split a selector list at commas outside brackets and quotes."""
    parts = re.findall(r"(?:\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)|\\.|[^,\[(\\]|[\[(\\])+|,", selector)
    out = [""]
    for p in parts:
        out.append("") if p == "," else out.__setitem__(-1, out[-1] + p)
    return out


def css_steps(selector: str) -> list[list[Step]]:
    return [_css_chain(part.strip()) for part in _css_parts(selector)]


def _css_chain(text: str) -> list[Step]:
    steps, at, link, fresh = [], 0, " ", True
    while at < len(text):
        m = _CSS_TOKEN.match(text, at)
        if not m:
            raise InvalidSelector(text)
        at, g = m.end(), m.groupdict()
        if g["link"] is not None:
            if fresh:
                raise InvalidSelector(text)
            link, fresh = g["link"].strip() or " ", True
            continue
        if fresh:
            steps.append(Step(link))
        elif g["tag"] is not None:
            raise InvalidSelector(text)
        fresh = False
        steps[-1].plain &= g["tag"] is not None
        if g["tag"] is not None:
            steps[-1].tag = _plain(g["tag"]).lower()
            test = ("tag", steps[-1].tag)
        elif g["id"] is not None:
            test = ("id", _plain(g["id"]))
        elif g["cls"] is not None:
            test = ("class", _plain(g["cls"]))
        elif g["attr"] is not None:
            value = next((g[k] for k in ("dq", "sq") if g[k] is not None), g["bare"] and _plain(g["bare"]))
            test = ("attr", g["attr"].lower(), g["op"], value, g["case"] is not None)
        else:
            test = _pseudo_test(g["pseudo"], g["arg"])
        steps[-1].tests.append(test)
    if fresh:
        raise InvalidSelector(text)
    return steps


_QUOTED = r"\"[^\"]*\"|'[^']*'"
_XPATH_STEP = re.compile(rf"(?P<axis>//|/)(?:(?P<out>text\(\)|@[\w:-]+)\Z|(?P<tag>\*|[\w-]+)(?P<preds>(?:\[(?:{_QUOTED}|[^\]\"'])*\])*))")
_XPATH_ATTR = re.compile(rf"@([\w:-]+)\s*(?:(!?=)\s*({_QUOTED}))?\Z")
_XPATH_CALL = re.compile(rf"(contains|starts-with)\(\s*@([\w:-]+)\s*,\s*({_QUOTED})\s*\)\Z")
_XPATH_TRIM = re.compile(rf"normalize-space\(\s*@([\w:-]+)\s*\)\s*=\s*({_QUOTED})\Z")
_XPATH_POS = re.compile(r"position\(\)\s*(!=|<=|>=|=|<|>)\s*(\d+|last\(\))\Z")
_OPERAND = r"(text\(\)|\.|normalize-space\(\s*(?:text\(\)|\.)?\s*\))"
_XPATH_TEXT_CALL = re.compile(rf"(contains|starts-with)\(\s*{_OPERAND}\s*,\s*({_QUOTED})\s*\)\Z")
_XPATH_TEXT_EQ = re.compile(rf"{_OPERAND}\s*(!?=)\s*({_QUOTED})\Z")
_XPATH_LAST = re.compile(r"last\(\)(?:\s*-\s*(\d+))?\Z")


def _split_top(text: str, words: str) -> list[str]:
    """Parts of ``text`` between ``words`` that stand outside quotes and brackets."""
    out, depth, at = [""], 0, 0
    for m in re.finditer(rf"{_QUOTED}|[\[(]|[\])]|{words}|.", text, re.S):
        t = m[0]
        depth += t in "[(" if len(t) == 1 else 0
        depth -= t in "])" if len(t) == 1 else 0
        if depth == 0 and re.fullmatch(words, t) and m.start() >= at:
            out.append("")
        else:
            out[-1] += t
    return [p.strip() for p in out]


def xpath_parts(xpath: str) -> list[tuple[list[Step], str | None]]:
    """The paths of a union ``a | b``."""
    return [xpath_steps(p) for p in _split_top(xpath.strip(), r"\|")]


def xpath_steps(xpath: str) -> tuple[list[Step], str | None]:
    """Steps plus what the path ends in: None (elements), ``text()`` or ``@name``."""
    text, at, steps, out = xpath.strip(), 0, [], None
    text = text[1:] if text.startswith(".//") else text
    while at < len(text):
        m = _XPATH_STEP.match(text, at)
        if not m:
            raise InvalidSelector(xpath)
        at = m.end()
        if m["out"]:
            out = m["out"]
            break
        step = Step(" " if m["axis"] == "//" else ">")
        if not steps and step.link == ">":
            step = Step(" ", [("top",)], root=True)
        step.tag, step.plain = m["tag"].lower(), not m["preds"]
        if m["tag"] != "*":
            step.tests.append(("tag", step.tag))
        preds = re.findall(rf"\[((?:{_QUOTED}|[^\]\"'])*)\]", m["preds"])
        for i, pred in enumerate(preds):
            step.tests.append(_xpath_test(pred.strip(), "sib" if m["tag"] == "*" else "type", i > 0))
        steps.append(step)
    if not steps:
        raise InvalidSelector(xpath)
    return steps, out


def _text_test(operand: str, op: str, value: str) -> tuple:
    return ("text", "text()" not in operand, op, value, operand.startswith("normalize"))


def _xpath_test(pred: str, which: str, later: bool) -> tuple:
    """``later``: after another predicate, where a position is not a stored one."""
    for word in ("or", "and"):
        parts = _split_top(pred, rf"\s{word}\s")
        if len(parts) > 1:
            return (word, *[_xpath_test(p, which, later) for p in parts])
    if pred.startswith("(") and pred.endswith(")") and len(_split_top(pred[1:-1], r"\)")) == 1:
        return _xpath_test(pred[1:-1].strip(), which, later)
    if m := re.match(r"not\((.*)\)\Z", pred, re.S):
        return ("not", _xpath_test(m[1].strip(), which, later))
    if m := _XPATH_ATTR.match(pred):
        value = None if m[3] is None else m[3][1:-1]
        test = ("attr", m[1].lower(), None if value is None else "=", value, False)
        # an absent attribute equals nothing and differs from nothing
        return ("and", ("attr", m[1].lower(), None, None, False), ("not", test)) if m[2] == "!=" else test
    if m := _XPATH_CALL.match(pred):
        return ("attr", m[2].lower(), "*=" if m[1] == "contains" else "^=", m[3][1:-1], False)
    if m := _XPATH_TRIM.match(pred):
        return ("attr", m[1].lower(), "==", m[2][1:-1], False)
    if m := _XPATH_TEXT_CALL.match(pred):
        return _text_test(m[2], "*=" if m[1] == "contains" else "^=", m[3][1:-1])
    if m := _XPATH_TEXT_EQ.match(pred):
        test = _text_test(m[1], "=", m[3][1:-1])
        return ("not", test) if m[2] == "!=" else test
    if later:
        raise InvalidSelector(pred)
    if pred.isdigit():
        return ("nth", which, False, 0, int(pred))
    if m := _XPATH_LAST.match(pred):
        return ("nth", which, True, 0, int(m[1] or 0) + 1)
    if m := _XPATH_POS.match(pred):
        op, back, n = m[1], m[2] == "last()", 1 if m[2] == "last()" else int(m[2])
        equal = ("nth", which, back, 0, n)
        if op in ("=", "!="):
            return equal if op == "=" else ("not", equal)
        # positions up to the last one are all but those beyond it
        if back:
            every = ("nth", which, False, 1, 1)
            return {"<=": every, ">=": equal, "<": ("not", equal), ">": ("not", every)}[op]
        return {"<=": ("nth", which, False, -1, n), "<": ("nth", which, False, -1, n - 1), ">=": ("nth", which, False, 1, n), ">": ("nth", which, False, 1, n + 1)}[op]
    raise InvalidSelector(pred)


def selector_kind(selector: str) -> str:
    return "xpath" if re.match(r"\(*\s*\.{0,2}/", selector) else "css"


def _path_pattern(steps: list[Step]) -> str:
    """Regex over tag paths. Blocks joined by ``>`` are matched at their earliest
    place and never given back, so deep pages cannot make it backtrack."""
    blocks: list[str] = []
    for s in steps:
        seg = "/" + ("[^/]+" if s.tag == "*" else rf"\Q{s.tag}\E")
        if s.link == " ":
            blocks.append(seg)
        else:
            blocks[-1] += seg
    skips = ["" if s.root else "(?:/[^/]+)*" for s in steps if s.link == " "]
    lead = "".join(f"(?>{skip and skip + '?'}{b})" for skip, b in zip(skips[:-1], blocks[:-1]))
    return rf"\A{lead}{skips[-1]}{blocks[-1]}\z"


def _row_test(steps: list[Step]) -> Column | None:
    """A predicate that decides the whole chain on the element's own row, if there is one."""
    last = steps[-1]
    if len(steps) == 1:
        return last.test()
    tags = all(s.tag == "*" or re.fullmatch(r"[\w:-]+", s.tag) for s in steps)
    if not tags or any(s.link not in (" ", ">") for s in steps) or not all(s.plain for s in steps[:-1]):
        return None
    return last.test() & F.col("path").rlike(_path_pattern(steps))


def _row_tests(chains: list[list[Step]]) -> Column | None:
    out = None
    for chain in chains:
        test = _row_test(chain)
        if test is None:
            return None
        out = test if out is None else out | test
    return out


def _run(nodes: DataFrame, steps: list[Step], cols: tuple[str, ...]) -> DataFrame:
    els, cur, i = _flagged(nodes, steps), None, 0
    if (test := _row_test(steps)) is not None:
        return els.filter(test).select(*_columns(cols))
    while i < len(steps):
        stop = i + 1
        if steps[i].link == " ":
            while stop < len(steps) and steps[stop].link == " ":
                stop += 1
        wide = cols if stop == len(steps) else ()
        if steps[i].link == " ":
            cur = _descend(els, cur, steps[i:stop], wide)
        else:
            cur = _beside(els, cur, steps[i], wide)
        i = stop
    return cur


def _columns(wide: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys((*_LINKS, *wide)))


def _with_tags(els: DataFrame, steps: list[Step]) -> DataFrame:
    """Keep only the tags the steps name; unlike the full tests this reaches the parquet scan."""
    tags = sorted({s.tag for s in steps})
    return els if "*" in tags else els.filter(F.col("tag").isin(tags))


def _descend(els: DataFrame, cur: DataFrame | None, run: list[Step], wide: tuple[str, ...]) -> DataFrame:
    tests = [s.test() for s in run]
    any_test = tests[0]
    for t in tests[1:]:
        any_test = any_test | t
    els = _with_tags(els, run)
    if cur is None and len(run) == 1:
        return els.filter(any_test).select(*_columns(wide))
    rows = els.filter(any_test).select(*_columns(wide), *[F.coalesce(t, F.lit(False)).alias(f"_f{k}") for k, t in enumerate(tests)])
    if cur is None:
        matched, first = F.col("_f0"), 1
    else:
        # earlier matches join the window as extra rows; at equal pre the
        # element itself sorts first, so it is never its own ancestor
        rows = rows.withColumn("_m", F.lit(0)).unionByName(
            cur.select("page_id", "pre", "last", F.lit(1).alias("_m")), allowMissingColumns=True
        )
        matched, first = F.col("_m") == 1, 0
    order = ["pre"] if cur is None else ["pre", "_m"]
    before = Window.partitionBy("page_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for k in range(first, len(run)):
        reach = F.max(F.when(matched, F.col("last"))).over(before)
        rows = rows.withColumn(f"_m{k}", F.coalesce(F.col(f"_f{k}") & (reach >= F.col("pre")), F.lit(False)))
        matched = F.col(f"_m{k}")
    return rows.filter(matched).select(*_columns(wide))


def _beside(els: DataFrame, cur: DataFrame, step: Step, wide: tuple[str, ...]) -> DataFrame:
    rows = els.filter(step.test()).select(*_columns(wide))
    if step.link == ">":
        left = cur.select("page_id", F.col("pre").alias("parent"))
        return rows.join(left, ["page_id", "parent"], "left_semi")
    if step.link == "+":
        left = cur.select("page_id", "parent", (F.col("sib_pos") + 1).alias("sib_pos"))
        return rows.join(left, ["page_id", "parent", "sib_pos"], "left_semi")
    left = cur.groupBy("page_id", "parent").agg(F.min("sib_pos").alias("_from"))
    return rows.join(left, ["page_id", "parent"]).filter(F.col("sib_pos") > F.col("_from")).drop("_from")


def select_css(nodes: DataFrame, selector: str, *cols: str) -> DataFrame:
    """Elements matching a CSS selector list, each once (S3)."""
    parsed = css_steps(selector)
    if (test := _row_tests(parsed)) is not None:
        last = _with_tags(elements(nodes), [c[-1] for c in parsed])
        return last.filter(test).select(*dict.fromkeys((*KEY, *cols)))
    chains = [_run(nodes, steps, cols) for steps in parsed]
    out = chains[0]
    for c in chains[1:]:
        out = out.unionByName(c)
    if len(chains) > 1:
        out = out.dropDuplicates(list(KEY))
    return out.select(*dict.fromkeys((*KEY, *cols)))


def select_xpath(nodes: DataFrame, xpath: str, *cols: str) -> DataFrame:
    """Elements an XPath leads to, each once; a trailing text() or @name step adds ``value``."""
    if not _is_plain(xpath):
        return _axes().select_axes(nodes, xpath, *cols)
    parts = _split_top(xpath.strip(), r"\|")
    if len(parts) > 1:
        found = [select_xpath(nodes, p, *cols) for p in parts]
        if len({tuple(f.columns) for f in found}) > 1:
            raise InvalidSelector(xpath)
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.dropDuplicates(list(KEY) + (["value"] if "value" in out.columns else []))
    steps, out = xpath_steps(xpath)
    found = _run(nodes, steps, (*cols, "attrs") if out and out[0] == "@" else cols)
    if out is None:
        return found.select(*dict.fromkeys((*KEY, *cols)))
    if out[0] == "@":
        found = found.withColumn("value", _attr(out[1:].lower())).filter(F.col("value").isNotNull())
        return found.select(*dict.fromkeys((*KEY, *cols, "value")))
    texts = nodes.filter(F.col("kind") == "text").select(
        "page_id", F.col("parent").alias("pre"), F.col("pre").alias("text_pre"), F.col("text").alias("value")
    )
    return found.select(*dict.fromkeys((*KEY, *cols))).join(texts, list(KEY))


def _axes():
    from gleanery.operators import xpath_axes  # it builds on the tests of this module

    return xpath_axes


def _is_plain(xpath: str) -> bool:
    """Whether steps down with stored positions say it all."""
    try:
        xpath_parts(xpath)
    except InvalidSelector:
        return False
    return True


def select(nodes: DataFrame, selector: str, *cols: str) -> DataFrame:
    pick = select_xpath if selector_kind(selector) == "xpath" else select_css
    return pick(nodes, selector, *cols)


def is_valid(selector: str) -> bool:
    try:
        if selector_kind(selector) == "css":
            css_steps(selector)
        elif not _is_plain(selector):
            _axes().parse(selector)
    except InvalidSelector:
        return False
    return True


def select_or_empty(nodes: DataFrame, selector: str, *cols: str) -> DataFrame:
    """Like ``select``; an unusable selector matches nothing (B2)."""
    if is_valid(selector):
        return select(nodes, selector, *cols)
    return nodes.filter(F.lit(False)).select(*dict.fromkeys((*KEY, *cols)))


def select_many(nodes: DataFrame, selectors: dict[str, str], *cols: str) -> DataFrame:
    """Matches of several labelled selectors as (label, page_id, pre, cols).

    All selectors decided on the row itself share a single scan; each other
    one adds a branch.
    Unusable selectors match nothing.
    """
    simple, lasts, out = {}, [], None
    for label, sel in selectors.items():
        if not is_valid(sel):
            continue
        xpath = selector_kind(sel) == "xpath"
        paths = [(c, None) for c in css_steps(sel)] if not xpath else xpath_parts(sel) if _is_plain(sel) else []
        chains = [c for c, _ in paths]
        test = _row_tests(chains)
        if test is not None and not any(end for _, end in paths) and not any(_text_tests(t) for c in chains for s in c for t in s.tests):
            simple[label] = test
            lasts += [c[-1] for c in chains]
        else:
            rows = select(nodes, sel, *cols).select(F.lit(label).alias("label"), *KEY, *cols)
            out = rows if out is None else out.unionByName(rows)
    if simple or out is None:
        any_test = F.lit(False)
        for t in simple.values():
            any_test = any_test | t
        labels = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in simple.items()])).cast("array<string>")
        els = _with_tags(elements(nodes), lasts) if lasts else elements(nodes)
        rows = els.filter(any_test).select(F.explode(labels).alias("label"), *KEY, *cols)
        out = rows if out is None else out.unionByName(rows)
    return out


def within(matches: DataFrame, contexts: DataFrame, *ctx_cols: str) -> DataFrame:
    """Pair each match with every context element around it.

    ``matches`` must carry ``anc``. The ancestor list makes containment an
    equi join: the work is matches x depth, not matches x contexts.
    """
    ctx = contexts.select("page_id", F.col("pre").alias("ctx_pre"), *ctx_cols)
    return matches.withColumn("ctx_pre", F.explode("anc")).drop("anc").join(ctx, ["page_id", "ctx_pre"])


def first_per_page(matches: DataFrame) -> DataFrame:
    """The first match of each page in document order."""
    rest = [c for c in matches.columns if c not in KEY]
    best = matches.groupBy("page_id").agg(F.min_by(F.struct("pre", *rest), "pre").alias("_r"))
    return best.select("page_id", "_r.*")


def match_counts(pages: DataFrame, nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """(page_id, selector, n, valid) for every page and selector, zeros included.

    Selectors are plan-level text known on the driver, so the grid of pages
    and selectors is an explode.
    """
    found = select_many(nodes, {s: s for s in selectors}).groupBy("page_id", F.col("label").alias("selector"))
    counts = found.agg(F.count("*").alias("n"))
    grid = pages.select("page_id", F.explode(F.array(*[F.lit(s) for s in selectors])).alias("selector"))
    valid = F.col("selector").isin([s for s in selectors if is_valid(s)])
    return grid.join(counts, ["page_id", "selector"], "left").select(
        "page_id", "selector", F.coalesce("n", F.lit(0)).alias("n"), valid.alias("valid")
    )


def css_then_xpath(nodes: DataFrame, css: str | None, xpath: str | None, *cols: str) -> DataFrame:
    """CSS matches; on pages where CSS found nothing, XPath matches.

    ``selector_type`` names the selector that matched.
    """
    first = select_or_empty(nodes, css, *cols) if css else select_or_empty(nodes, "!", *cols)
    first = first.withColumn("selector_type", F.lit("css"))
    if not xpath:
        return first
    second = select_or_empty(nodes, xpath, *cols).withColumn("selector_type", F.lit("xpath"))
    if not css:
        return second
    return first.unionByName(second.join(first.select("page_id"), "page_id", "left_anti"))
