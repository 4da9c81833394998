"""XPath steps that look backwards or sideways, and positions inside a result.

``selectors`` decides plain paths on stored facts of a row. This module takes what
that cannot say: ``..`` and the other axes, positions after another predicate,
``(path)[n]``, and predicates that are paths themselves. A path is evaluated step
by step over tables of context elements:

* child, parent and sibling steps are equi joins; ancestors come from the stored
  ancestor list, so nothing compares the nodes of a page with each other;
* a position is a rank. For steps down it is one among the children of a parent; for
  sibling and following steps the k-th element after a context element is found by
  counting both in one window and joining on the sum, so long lists of siblings
  cost a sort and not their square;
* ``(path)[n]`` ranks the whole result of a page in document order.

Other positions on those axes (``last()``, ranges) and on ``preceding`` pair each context
element with what its axis holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.selectors import (
    KEY, InvalidSelector, _attr, _split_top, _text_tests, _xpath_test, as_column, with_text_flags,
)
from gleanery.sources.nodes import elements, text_nodes

# The axes, and whether positions count backwards.
AXES = {
    "child": False, "descendant": False, "descendant-or-self": False, "self": False, "following-sibling": False, "following": False,
    "parent": True, "ancestor": True, "ancestor-or-self": True, "preceding-sibling": True, "preceding": True,
}
_PLACE = ["page_id", "pre", "last", "parent", "sib_pos", "anc"]
_TOKEN = re.compile(r"(?P<sep>//|/)?(?:(?P<dots>\.\.|\.)|(?P<attr>@[\w:-]+)\Z|(?P<text>text\(\))\Z|(?:(?P<axis>[a-z-]+)::)?(?P<tag>\*|[A-Za-z_][\w-]*|node\(\))(?!\())")


@dataclass
class AxisStep:
    axis: str
    tag: str = "*"
    preds: list = field(default_factory=list)  # tests of ``selectors``, or ("path", Path)
    each_parent: bool = False  # positions count among the children of one parent, whatever the context


@dataclass
class Path:
    steps: list[AxisStep] = field(default_factory=list)
    absolute: bool = False
    group: list["Path"] | None = None  # ``(a | b)[...]`` in front of the steps
    group_preds: list = field(default_factory=list)
    end: str | None = None  # text() or @name
    value: tuple | None = None  # what the end has to be, in a predicate


def parse(xpath: str) -> list[Path]:
    """The paths of a union; a leading dot means the document."""
    return [_path(p[1:] if p.startswith("./") else p, False) for p in _split_top(xpath.strip(), r"\|")]


def _brackets(text: str, at: int) -> tuple[list[str], int]:
    """Predicates from ``at`` on, and where they end; brackets may be nested."""
    out = []
    while at < len(text) and text[at] == "[":
        depth, quote, start = 0, "", at
        while True:
            if at >= len(text):
                raise InvalidSelector(text)
            c = text[at]
            at += 1
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            else:
                depth += (c == "[") - (c == "]")
                if depth == 0:
                    break
        out.append(text[start + 1 : at - 1].strip())
    return out, at


def _closing(text: str) -> int:
    depth, quote = 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
            if depth == 0:
                return i
    raise InvalidSelector(text)


def _path(text: str, relative: bool) -> Path:
    text, out, at = text.strip(), Path(), 0
    if text.startswith("("):
        stop = _closing(text)
        out.group = [_path(p, relative) for p in _split_top(text[1:stop], r"\|")]
        preds, at = _brackets(text, stop + 1)
        out.group_preds = [_predicate(p) for p in preds]
        if any(p.end for p in out.group):
            raise InvalidSelector(text)
    elif text.startswith("/"):
        out.absolute = not relative
    elif not relative and not text.startswith("."):
        raise InvalidSelector(text)
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or (not m["sep"] and (out.steps or out.group)):
            raise InvalidSelector(text)
        at, deep = m.end(), m["sep"] == "//"
        if m["attr"] or m["text"]:
            if deep:
                out.steps.append(AxisStep("descendant-or-self"))
            out.end = m["attr"] or m["text"]
            break
        if m["dots"]:
            if deep:
                out.steps.append(AxisStep("descendant-or-self"))
            step = AxisStep("self" if m["dots"] == "." else "parent")
        else:
            axis = m["axis"] or "child"
            if axis not in AXES:
                raise InvalidSelector(axis)
            if deep and axis != "child":
                out.steps.append(AxisStep("descendant-or-self"))
                deep = False
            tag = "*" if m["tag"] == "node()" else m["tag"].lower()
            step = AxisStep("descendant" if deep else axis, tag, each_parent=deep)
        preds, at = _brackets(text, at)
        step.preds = [_predicate(p) for p in preds]
        out.steps.append(step)
    if not (out.steps or out.group):
        raise InvalidSelector(text)
    return out


_COMPARED = re.compile(r"(.+?)\s*=\s*(\"[^\"]*\"|'[^']*')\Z", re.S)


def _predicate(text: str) -> tuple:
    """A test; positions are ranks of the step, and whatever is no plain test is a path that has to lead somewhere."""
    try:
        return _xpath_test(text, "rank", False)
    except InvalidSelector:
        pass
    for word in ("or", "and"):
        parts = _split_top(text, rf"\s{word}\s")
        if len(parts) > 1:
            return (word, *[_predicate(p) for p in parts])
    if m := re.match(r"not\((.*)\)\Z", text, re.S):
        return ("not", _predicate(m[1].strip()))
    wanted = None
    if m := _COMPARED.match(text):
        text, wanted = m[1], m[2][1:-1]
    path = _path(text, True)
    if path.group or (wanted is not None and not path.end):
        # an element compared with a text is compared by all the text it holds
        if path.group:
            raise InvalidSelector(text)
        path.steps[-1].preds.append(("text", True, "=", wanted, False))
        wanted = None
    path.value = None if wanted is None else ("=", wanted)
    return ("path", _Frozen(path))


class _Frozen:
    """A path inside a test tuple; equal only to itself."""

    def __init__(self, path: Path):
        self.path = path


def _paths(test: tuple) -> list[_Frozen]:
    if test[0] == "path":
        return [test[1]]
    return [p for a in test[1:] if isinstance(a, tuple) for p in _paths(a)]


def _ranked(test: tuple) -> bool:
    return test[:2] == ("nth", "rank") or any(_ranked(a) for a in test[1:] if isinstance(a, tuple))


def _column(test: tuple):
    if test[0] == "path":
        return F.col(f"_p{id(test[1])}")
    if test[0] in ("and", "or"):
        out = _column(test[1])
        for t in test[2:]:
            out = out & _column(t) if test[0] == "and" else out | _column(t)
        return out
    if test[0] == "not":
        return ~F.coalesce(_column(test[1]), F.lit(False))
    return as_column(test)


def _tests_of(paths: list[Path]) -> dict[tuple, str]:
    """Text tests of all steps with the tag they are asked of."""
    out: dict[tuple, str] = {}
    for p in paths:
        out |= _tests_of(p.group or [])
        for preds, tag in [(p.group_preds, "*"), *[(s.preds, s.tag) for s in p.steps]]:
            for t in preds:
                for own in _text_tests(t):
                    out[own] = tag if out.get(own, tag) == tag else "*"
                out |= _tests_of([f.path for f in _paths(t)])
    return out


class _Walk:
    """Evaluates paths over one node table."""

    def __init__(self, nodes: DataFrame, els: DataFrame):
        self.nodes, self.els = nodes, els

    def marked(self, rows: DataFrame, test: tuple) -> DataFrame:
        """``rows`` with a flag for each path predicate in the test."""
        for f in _paths(test):
            name = f"_p{id(f)}"
            found = self.relative(rows.select(*_PLACE).dropDuplicates(list(KEY)), f.path).withColumn(name, F.lit(True))
            rows = rows.join(found, list(KEY), "left").withColumn(name, F.coalesce(name, F.lit(False)))
        return rows

    def relative(self, contexts: DataFrame, path: Path) -> DataFrame:
        """Contexts (page_id, pre) from which the path leads somewhere. Their place travels along as ``org``."""
        now = self.steps(contexts.withColumn("org", F.col("pre")), path.steps, ["org"])
        if path.end:
            now = self.ended(now, path.end, ["org"])
            if path.value:
                now = now.filter(F.col("value") == path.value[1])
        return now.select("page_id", F.col("org").alias("pre")).distinct()

    def whole(self, path: Path, cols: tuple[str, ...]) -> DataFrame:
        """Elements (or values, if the path ends in text or an attribute) of all pages."""
        if path.group is not None:
            now = None
            for p in path.group:
                part = self.whole(p, ()).select(*KEY)
                now = part if now is None else now.unionByName(part)
            now = self.els.join(now.distinct(), list(KEY))
            for t in path.group_preds:
                page = Window.partitionBy("page_id")
                now = now.withColumns({"rank_pos": F.row_number().over(page.orderBy("pre")), "rank_cnt": F.count("*").over(page)}) if _ranked(t) else now
                now = self.marked(now, t).filter(_column(t))
            now = self.steps(now.select(*_PLACE), path.steps, [])
        else:
            now = self.steps(None, path.steps, [])
        if path.end:
            now = self.ended(now, path.end, [])
        rest = [c for c in cols if c not in _PLACE]
        now = now.join(self.els.select(*KEY, *rest), list(KEY)) if rest else now
        return now.select(*dict.fromkeys((*KEY, *cols, *(["value"] if path.end else []))))

    def ended(self, now: DataFrame, end: str, carry: list[str]) -> DataFrame:
        if end[0] == "@":
            held = self.els.select(*KEY, _attr(end[1:].lower()).alias("value")).filter(F.col("value").isNotNull())
            return now.join(held, list(KEY))
        texts = text_nodes(self.nodes).select("page_id", F.col("parent").alias("pre"), F.col("pre").alias("text_pre"), F.col("text").alias("value"))
        return now.join(texts, list(KEY))

    def steps(self, now: DataFrame | None, steps: list[AxisStep], carry: list[str]) -> DataFrame:
        """``now`` holds _PLACE and ``carry``; None stands for the document."""
        for s in steps:
            now = self.step(now, s, carry)
        return now

    def step(self, now: DataFrame | None, s: AxisStep, carry: list[str]) -> DataFrame:
        els = self.els if s.tag == "*" else self.els.filter(F.col("tag") == s.tag)
        plain = [t for t in s.preds if not _ranked(t)]
        if len(plain) == len(s.preds) or s.axis in ("self", "parent"):
            # without positions the axis gives a set of elements
            out = self.reached(now, els, s, carry)
            for t in s.preds:
                out = out.withColumns({"rank_pos": F.lit(1), "rank_cnt": F.lit(1)}) if _ranked(t) else out
                out = self.marked(out, t).filter(_column(t))
            return out.select(*_PLACE, *carry)
        head = 0
        while not _ranked(s.preds[head]):
            els = self.marked(els, s.preds[head]).filter(_column(s.preds[head]))
            head += 1
        rest = s.preds[head:]
        kth = rest[0][:3] == ("nth", "rank", False) and rest[0][3] == 0 and len(rest) == 1
        if kth and now is not None and s.axis in ("following-sibling", "preceding-sibling", "following"):
            return self.kth(now, els, s.axis, rest[0][4], carry)
        out, group = self.grouped(now, els, s, carry)
        for t in rest:
            if _ranked(t):
                order = F.col("pre").desc() if AXES[s.axis] else F.col("pre")
                w = Window.partitionBy(*group)
                out = out.withColumns({"rank_pos": F.row_number().over(w.orderBy(order)), "rank_cnt": F.count("*").over(w)})
            out = self.marked(out, t).filter(_column(t))
        return out.select(*_PLACE, *carry).dropDuplicates([*KEY, *carry])

    def reached(self, now: DataFrame | None, els: DataFrame, s: AxisStep, carry: list[str]) -> DataFrame:
        """Elements of the axis, each once for every value of ``carry``."""
        axis = s.axis
        if now is None:
            if axis == "child":
                return els.filter(F.col("depth") == 1)
            if axis in ("descendant", "descendant-or-self"):
                return els
            return els.filter(F.lit(False))
        if axis == "self":
            return els.join(now.select(*KEY, *carry), list(KEY))
        if axis == "child":
            return els.join(now.select("page_id", F.col("pre").alias("parent"), *carry), ["page_id", "parent"])
        if axis == "parent":
            return els.join(now.select("page_id", F.col("parent").alias("pre"), *carry).distinct(), list(KEY))
        if axis in ("ancestor", "ancestor-or-self"):
            up = F.concat("anc", F.array("pre")) if axis.endswith("self") else F.col("anc")
            return els.join(now.select("page_id", F.explode(up).alias("pre"), *carry).distinct(), list(KEY))
        if axis in ("descendant", "descendant-or-self"):
            up = F.concat("anc", F.array("pre")) if axis.endswith("self") else F.col("anc")
            above = now.select("page_id", F.col("pre").alias("up"), *carry)
            held = els.select(*KEY, F.explode(up).alias("up")).join(above, ["page_id", "up"]).select(*KEY, *carry).distinct()
            return els.join(held, list(KEY))
        if axis in ("following-sibling", "preceding-sibling"):
            ahead = axis[0] == "f"
            edge = now.groupBy("page_id", "parent", *carry).agg((F.min if ahead else F.max)("sib_pos").alias("_edge"))
            out = els.join(edge, ["page_id", "parent"])
            return out.filter(F.col("sib_pos") > F.col("_edge") if ahead else F.col("sib_pos") < F.col("_edge")).drop("_edge")
        ahead = axis == "following"
        edge = now.groupBy("page_id", *carry).agg((F.min("last") if ahead else F.max("pre")).alias("_edge"))
        out = els.join(edge, "page_id")
        return out.filter(F.col("pre") > F.col("_edge") if ahead else F.col("last") < F.col("_edge")).drop("_edge")

    def grouped(self, now: DataFrame | None, els: DataFrame, s: AxisStep, carry: list[str]) -> tuple[DataFrame, list[str]]:
        """Elements of the axis with what tells apart the groups that are ranked."""
        if now is None or s.each_parent or s.axis == "child":
            by_page = now is None and not s.each_parent
            return self.reached(now, els, s, carry), ["page_id", *([] if by_page else ["parent"]), *carry]
        here = now.select("page_id", F.col("pre").alias("ctx"), F.col("last").alias("c_last"), F.col("parent").alias("c_parent"), F.col("sib_pos").alias("c_pos"), F.col("anc").alias("c_anc"), *carry)
        group = ["page_id", "ctx", *carry]
        if s.axis.startswith("ancestor"):
            up = F.concat("c_anc", F.array("ctx")) if s.axis.endswith("self") else F.col("c_anc")
            return els.join(here.select(*group, F.explode(up).alias("pre")), list(KEY)), group
        if s.axis.startswith("descendant"):
            up = F.concat("anc", F.array("pre")) if s.axis.endswith("self") else F.col("anc")
            held = els.select(*KEY, F.explode(up).alias("ctx")).join(here.select(*group), ["page_id", "ctx"])
            return els.join(held, list(KEY)), group
        if s.axis.endswith("sibling"):
            beside = F.col("sib_pos") > F.col("c_pos") if s.axis[0] == "f" else F.col("sib_pos") < F.col("c_pos")
            return els.join(here.select(*group, F.col("c_parent").alias("parent"), "c_pos"), ["page_id", "parent"]).filter(beside), group
        beside = F.col("pre") > F.col("c_last") if s.axis == "following" else F.col("last") < F.col("ctx")
        return els.join(here.select(*group, "c_last"), "page_id").filter(beside), group

    def kth(self, now: DataFrame, els: DataFrame, axis: str, k: int, carry: list[str]) -> DataFrame:
        """The k-th element of each context's axis: both are counted in one window and joined on the count."""
        place = ["page_id", "parent"] if axis.endswith("sibling") else ["page_id"]
        at = "sib_pos" if axis.endswith("sibling") else "pre"
        edge = "sib_pos" if axis.endswith("sibling") else "last"
        rows = els.select(*place, F.col(at).alias("at"), F.lit(1).alias("is_el"), F.col("pre").alias("own"), *[F.lit(None).cast(now.schema[c].dataType).alias(c) for c in carry])
        asked = now.select(*place, F.col(edge).alias("at"), F.lit(0).alias("is_el"), F.lit(None).cast("int").alias("own"), *carry)
        # a context is counted after an element of its place looking ahead, and before it looking back
        tie = F.col("is_el").desc() if axis[0] == "f" else F.col("is_el")
        w = Window.partitionBy(*place).orderBy("at", tie).rowsBetween(Window.unboundedPreceding, 0)
        counted = rows.unionByName(asked).withColumn("n", F.sum("is_el").over(w))
        wanted = counted.filter("is_el = 0").select(*place, (F.col("n") + k if axis[0] == "f" else F.col("n") - k + 1).alias("n"), *carry).distinct()
        hit = counted.filter("is_el = 1").select(*place, "n", F.col("own").alias("pre")).join(wanted, [*place, "n"]).select(*KEY, *carry)
        return els.join(hit, list(KEY)).select(*_PLACE, *carry)


def select_axes(nodes: DataFrame, xpath: str, *cols: str) -> DataFrame:
    """Elements an XPath with any axes leads to, each once; a trailing text() or @name step adds ``value``."""
    paths = parse(xpath)
    if len({p.end is None for p in paths}) > 1:
        raise InvalidSelector(xpath)
    walk = _Walk(nodes, with_text_flags(elements(nodes), nodes, _tests_of(paths)))
    out = None
    for p in paths:
        part = walk.whole(p, cols)
        out = part if out is None else out.unionByName(part)
    if len(paths) > 1:
        out = out.dropDuplicates([*KEY, *(["value"] if "value" in out.columns else [])])
    return out
