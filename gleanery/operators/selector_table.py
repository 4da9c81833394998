"""Selectors as rows of a table, matched over all pages at once.

A selector text becomes one row for each step of each of its alternatives: how
the step hangs off the one before, a key that an element must have (its id, one
class, or its tag), and the remaining tests. Elements meet steps in an equi join
on the key, and steps are chained by equi joins on ancestors, parents or sibling
places. Plans grow with the longest selector, not with the number of selectors.

Tests of text are left open in that join. Elements that passed all their other tests
get their texts, long ones put together once for all selectors, and are then tested again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators import selectors as sel
from gleanery.operators.texts import with_text
from gleanery.session import written
from gleanery.sources.nodes import elements, text_nodes

_TESTS = "array<array<array<struct<neg: boolean, kind: string, name: string, op: string, value: string, fold: boolean, which: string, back: boolean, a: int, b: int>>>>"
_STEPS = f"selector string, chain int, step int, steps int, link string, key string, texts boolean, tests {_TESTS}"
#: Most step rows whose keys go to every task.
SENT_STEPS = 20_000
#: Products of alternatives inside alternatives; a selector beyond it is reported as unusable.
MAX_CLAUSES = 64


def _atom(test: tuple, neg: bool) -> dict:
    kind, *args = test
    out = {"neg": neg, "kind": kind, "name": None, "op": None, "value": None, "fold": False, "which": None, "back": False, "a": 0, "b": 0}
    if kind in ("tag", "id", "class"):
        out["value"] = args[0]
    elif kind == "attr":
        out.update(name=args[0], op=args[1], value=args[2], fold=bool(args[3]))
    elif kind == "text":
        whole, op, value, squeezed = args
        out.update(kind="text" if whole else "own", op=op, value=value, fold=squeezed)
    elif kind == "nth":
        out.update(which=args[0], back=args[1], a=args[2], b=args[3])
    elif kind == "alone":
        out["which"] = args[0]
    return out


def _clauses(test: tuple, neg: bool = False) -> list[list[list[dict]]]:
    """All clauses must hold; a clause holds if all tests of one of its parts do."""
    kind, *args = test
    if kind == "not":
        return _clauses(args[0], not neg)
    if kind not in ("and", "or"):
        return [[[_atom(test, neg)]]]
    parts = [_clauses(a, neg) for a in args]
    if (kind == "and") != neg:
        return [c for p in parts for c in p]
    if all(len(c) == 1 for p in parts for c in p):
        # alternatives that are plain conjunctions stay as they are, however many
        return [[[a for c in p for a in c[0]] for p in parts]]
    out: list[list[list[dict]]] = [[]]
    for p in parts:
        out = [a + b for a in out for b in p]
        if len(out) > MAX_CLAUSES:
            raise sel.InvalidSelector("alternatives nested too deep")
    return out


def step_rows(selector: str) -> list[tuple]:
    """Rows of one selector; none if it is unusable, needs other axes, or ends in text() or an attribute."""
    try:
        if sel.selector_kind(selector) == "xpath":
            parts = sel.xpath_parts(selector)
            if any(end for _, end in parts):
                return []
            chains = [c for c, _ in parts]
        else:
            chains = sel.css_steps(selector)
        rows = []
        for c, chain in enumerate(chains):
            for i, s in enumerate(chain):
                # the rarest kind of key that the step has to have
                keys = {t[0]: t[1] for t in s.tests if t[0] in ("tag", "class", "id") and t[1] != "*"}
                key = next((f"{k}:{keys[k]}" for k in ("id", "class", "tag") if k in keys), "*")
                rest = [c for t in s.tests if t != ("tag", "*") for c in _clauses(t)]
                rows.append((selector, c, i, len(chain), s.link, key, any(a["kind"] in ("text", "own") for clause in rest for part in clause for a in part), rest))
        return rows
    except sel.InvalidSelector:
        return []


def steps(selectors: DataFrame) -> DataFrame:
    """selectors(selector) -> one row for each step of each distinct selector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["selector", "chain", "step", "steps", "link", "key", "texts", "tests"]
        for b in batches:
            yield pd.DataFrame([r for text in b["selector"] for r in step_rows(text)], columns=names)

    return selectors.where("selector IS NOT NULL").select("selector").distinct().mapInPandas(run, _STEPS)


def _may_hold(t: Column) -> Column:
    """One test of a clause, over an element row; tests of text stay open."""
    return t["kind"].isin("text", "own") | _holds(t)


def _reads(t: Column) -> Column:
    """One test of a text, over a row with ``_whole`` (all text inside) and ``_own`` (its own text nodes)."""
    op, value = t["op"], t["value"]
    first = F.try_element_at("_own", F.lit(1))
    text = F.when(t["kind"] == "text", F.col("_whole")).otherwise(first)
    text = F.when(t["fold"], sel.squash(text)).otherwise(text)
    one = F.when(op == "*=", F.contains(text, value)).when(op == "^=", F.startswith(text, value)).otherwise(text == value)
    # an own text equals a value if any of the text nodes does
    any_own = (t["kind"] == "own") & (op == "=") & ~t["fold"]
    return F.coalesce(F.when(any_own, F.array_contains("_own", value)).otherwise(one), F.lit(False)) != t["neg"]


def _holds(t: Column) -> Column:
    """One test of a clause, over an element row."""
    kind, name, op, value = t["kind"], t["name"], t["op"], t["value"]
    a = F.try_element_at("attrs", name)
    a, v = F.when(t["fold"], F.lower(a)).otherwise(a), F.when(t["fold"], F.lower(value)).otherwise(value)
    full = v != ""
    attr = (
        F.when(op.isNull(), a.isNotNull())
        .when(op == "=", a == v)
        .when(op == "~=", full & ~v.rlike(r"\s") & F.array_contains(F.split(a, r"\s+"), v))
        .when(op == "|=", (a == v) | F.startswith(a, F.concat(v, F.lit("-"))))
        .when(op == "==", sel.squash(a) == v)
        .when(op == "^=", full & F.startswith(a, v))
        .when(op == "$=", full & F.endswith(a, v))
        .when(op == "*=", full & F.contains(a, v))
    )
    sib = t["which"] == "sib"
    pos, cnt = F.when(sib, F.col("sib_pos")).otherwise(F.col("type_pos")), F.when(sib, F.col("sib_cnt")).otherwise(F.col("type_cnt"))
    off = F.when(t["back"], cnt - pos + 1).otherwise(pos) - t["b"]
    step = F.when(t["a"] == 0, F.lit(1)).otherwise(F.abs(t["a"]))
    nth = F.when(t["a"] == 0, off == 0).otherwise((off * F.signum(t["a"]) >= 0) & (off % step == 0))
    ok = (
        F.when(kind == "tag", F.col("tag") == value)
        .when(kind == "id", F.col("id") == value)
        .when(kind == "class", F.array_contains("classes", value))
        .when(kind == "attr", attr)
        .when(kind == "nth", nth)
        .when(kind == "alone", cnt == 1)
        .when(kind == "top", F.col("depth") == 1)
        .when(kind == "empty", (F.col("last") == F.col("pre")) & (F.coalesce("text", F.lit("")) == ""))
    )
    return F.coalesce(ok, F.lit(False)) != t["neg"]


def _all(tests: str, holds) -> Column:
    return F.forall(tests, lambda clause: F.exists(clause, lambda part: F.forall(part, holds)))


def _candidates(nodes: DataFrame, asked: DataFrame | None, step_table: DataFrame, texts: bool, few: bool) -> DataFrame:
    """(page_id, pre, anc, parent, sib_pos, selector, chain, step, steps, link): elements that pass a single step's tests."""
    keys = F.array_union(
        F.array_union(F.array(F.lit("*"), F.concat(F.lit("tag:"), "tag")), F.array_compact(F.array(F.concat(F.lit("id:"), "id")))),
        F.transform(F.coalesce("classes", F.array().cast("array<string>")), lambda c: F.concat(F.lit("class:"), c)),
    )
    held = ["page_id", "pre", "last", "anc", "parent", "depth", "sib_pos", "sib_cnt", "type_pos", "type_cnt", "tag", "id", "classes", "attrs", "text"]
    els = elements(nodes).select(*held).withColumn("key", F.explode(keys))
    wanted, on = step_table, ["key"]
    if asked is not None:
        # selectors of single pages: every step goes to its page only
        wanted, on = asked.select("page_id", "selector").distinct().join(step_table, "selector"), ["page_id", "key"]
        if few:  # elements that no step asks for stay where they are
            els = els.join(F.broadcast(step_table.select("key").distinct()), "key", "left_semi")
    rows = els.join(wanted, on).where(_all("tests", _may_hold))
    out = ["page_id", "pre", "anc", "parent", "sib_pos", "selector", "chain", "step", "steps", "link"]
    if not texts:
        return rows.select(*out)
    rows = written(rows, "selector-open")
    to_read = rows.where("texts")
    places = to_read.select("page_id", "pre", "text").distinct()
    whole = with_text(places, nodes, trim=False).withColumnRenamed("value", "_whole")
    own = text_nodes(nodes).select("page_id", F.col("parent").alias("pre"), F.struct(F.col("pre").alias("at"), "text").alias("_t"))
    own = own.join(places.select("page_id", "pre"), ["page_id", "pre"], "left_semi").groupBy("page_id", "pre").agg(F.transform(F.sort_array(F.collect_list("_t")), lambda x: x["text"]).alias("_own"))
    read = to_read.join(whole, ["page_id", "pre"]).join(own, ["page_id", "pre"], "left")
    text_test = lambda t: F.when(t["kind"].isin("text", "own"), _reads(t)).otherwise(_holds(t))
    read = read.where(_all("tests", text_test))
    return rows.where("NOT texts").select(*out).unionByName(read.select(*out))


def _chained(nodes: DataFrame, asked: DataFrame | None, selectors: DataFrame) -> DataFrame:
    table = written(steps(selectors), "selector-steps")
    deepest, texts, n = table.agg(F.max("steps"), F.bool_or("texts"), F.count(F.lit(1))).first()
    deepest = deepest or 1
    rows = _candidates(nodes, asked, table, bool(texts), n <= SENT_STEPS)
    rows = written(rows, "selector-candidates") if deepest > 1 else rows
    own = ["page_id", "selector", "chain"]
    now = rows.where("step = 0")
    done = now.where("steps = 1").select("page_id", "selector", "pre")
    minus = F.lit(-1)
    for k in range(1, deepest):
        # an element offers itself as an ancestor or parent, and its place among its siblings
        offered = now.select(*own, F.explode(F.array(F.struct(F.col("pre").alias("x"), minus.alias("y")), F.struct(F.col("parent").alias("x"), F.col("sib_pos").alias("y")))).alias("at"))
        places = (
            F.when(F.col("link") == " ", F.transform("anc", lambda x: F.struct(x.cast("int").alias("x"), minus.alias("y"))))
            .when(F.col("link") == ">", F.array(F.struct(F.col("parent").alias("x"), minus.alias("y"))))
            .when(F.col("link") == "+", F.array(F.struct(F.col("parent").alias("x"), (F.col("sib_pos") - 1).alias("y"))))
            .otherwise(F.transform(F.when(F.col("sib_pos") > 1, F.sequence(F.lit(1), F.col("sib_pos") - 1)), lambda i: F.struct(F.col("parent").alias("x"), i.cast("int").alias("y"))))
        )
        here = rows.where(F.col("step") == k).withColumn("at", F.explode(places))
        now = here.join(offered, [*own, "at"], "left_semi").drop("at").dropDuplicates([*own, "pre"])
        if k < deepest - 1:
            now = written(now, "selector-step")
        done = done.unionByName(now.where(F.col("steps") == k + 1).select("page_id", "selector", "pre"))
    return done.distinct()


def matches(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """selectors(selector) -> (page_id, selector, pre): every match of every selector in every page."""
    return _chained(nodes, None, selectors)


def matches_on(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(page_id, selector) -> (page_id, selector, pre): matches of each selector in its own page."""
    return _chained(nodes, asked, asked)


def usable(selectors: DataFrame) -> DataFrame:
    """(selector, valid) for each distinct selector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(valid=[bool(step_rows(t)) for t in b["selector"]])

    return selectors.where("selector IS NOT NULL").select("selector").distinct().mapInPandas(run, "selector string, valid boolean")


def counts_on(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(page_id, selector) -> (page_id, selector, n, valid), zeros included (B7): one row for each distinct pair."""
    pairs = asked.select("page_id", "selector").distinct()
    counts = matches_on(nodes, pairs).groupBy("page_id", "selector").agg(F.count("*").alias("n"))
    valid = usable(pairs)
    out = pairs.join(counts, ["page_id", "selector"], "left").join(valid, "selector", "left")
    return out.select("page_id", "selector", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("valid", F.lit(False)).alias("valid"))
