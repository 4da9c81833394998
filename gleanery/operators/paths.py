"""Generated CSS selectors (B18): the shortest child path that is unique in its page.

Uniqueness is counted, not tested pair by pair. Every element is expanded to
the few step texts it satisfies (its own and more general ones), and a path
is matched upward through equi joins on ``(page_id, element)`` and
``(page_id, path, step)``; work grows with the elements, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scalars import css_escape
from gleanery.session import written
from gleanery.sources.nodes import elements


def step_text() -> Column:
    """Tag, classes, and the position where same-tag siblings exist.

    The position is written as ``:nth-of-type``, which is what it counts.
    """
    names = F.array_join(F.transform("classes", lambda c: F.concat(F.lit("."), css_escape(c))), "")
    nth = F.when(F.col("type_cnt") > 1, F.format_string(":nth-of-type(%d)", "type_pos")).otherwise(F.lit(""))
    return F.concat("tag", names, nth)


def _steps(nodes: DataFrame) -> DataFrame:
    return elements(nodes).select(
        "page_id",
        "pre",
        "parent",
        "tag",
        F.array_distinct("classes").alias("classes"),
        "type_pos",
        F.when(F.col("type_cnt") > 1, F.col("type_pos")).otherwise(F.lit(0)).alias("nth"),
        step_text().alias("step"),
    )


def _paths(found: DataFrame, steps: DataFrame, most: int | None) -> DataFrame:
    """found -> (page_id, pre, path ARRAY of step texts from the element upward)."""
    line = F.reverse(F.concat("anc", F.array("pre")))
    line = line if most is None else F.slice(line, 1, most)
    up = found.select("page_id", "pre", F.posexplode(line).alias("level", "up_pre"))
    named = up.join(steps.select("page_id", F.col("pre").alias("up_pre"), "step"), ["page_id", "up_pre"])
    rows = F.array_sort(F.collect_list(F.struct("level", "step")))
    return named.groupBy("page_id", "pre").agg(F.transform(rows, lambda r: r["step"]).alias("path"))


def _satisfied(steps: DataFrame) -> DataFrame:
    """(page_id, pre, parent, step) for every step text an element satisfies.

    A step asks for a tag, a class set and maybe a position. Elements are
    keyed by each of their classes and by position/no position; a step looks
    itself up under the rarest of its classes. So candidates come from an equi
    join on a short list, and only the remaining classes are left to check.
    """
    asked = steps.select("page_id", "tag", "nth", "step", F.col("classes").alias("need")).distinct()
    common = steps.select("page_id", "tag", F.explode("classes").alias("anchor")).groupBy("page_id", "tag", "anchor").agg(
        F.count("*").alias("n")
    )
    rarest = (
        asked.withColumn("anchor", F.explode("need"))
        .join(common, ["page_id", "tag", "anchor"])
        .groupBy("page_id", "tag", "nth", "step")
        .agg(F.min_by("anchor", F.struct("n", "anchor")).alias("anchor"), F.first("need").alias("need"))
    )
    bare = asked.filter(F.size("need") == 0).select("page_id", "tag", "nth", "step", F.lit("").alias("anchor"), "need")
    offered = steps.select(
        "page_id", "pre", "parent", "tag", "classes",
        F.explode(F.array_union("classes", F.array(F.lit("")))).alias("anchor"), "type_pos",
    ).withColumn("nth", F.explode(F.array(F.lit(0), "type_pos")))
    return (
        offered.join(rarest.unionByName(bare), ["page_id", "tag", "nth", "anchor"])
        .filter(F.size(F.array_except("need", "classes")) == 0)
        .select("page_id", "pre", "parent", "step")
    )


def _text_upto(level: int) -> Column:
    return F.array_join(F.reverse(F.slice("path", 1, level)), " > ")


def element_selectors(found: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, pre, selector, n_matches) for elements carrying ``id`` and ``anc``.

    Paths grow until they are unique, to the root if need be, or to ``most`` steps.

    Works level by level and stops as soon as no path is open. Each level is
    written out, so its plan stays small and a lost executor costs one level.
    """
    steps = _steps(nodes)
    sat = written(_satisfied(steps), "steps")
    out = found.filter(F.col("id").isNotNull()).select(
        "page_id", "pre", F.concat(F.lit("#"), css_escape(F.col("id"))).alias("selector"), F.lit(None).cast("long").alias("n_matches")
    )
    paths = _paths(found.filter(F.col("id").isNull()), steps, most)
    reach = sat.select("page_id", F.col("step").alias("chain"), F.col("parent").alias("cur"))
    level = 0
    while True:
        level += 1
        counts = reach.groupBy("page_id", "chain").agg(F.count("*").alias("n_matches"))
        scored = written(paths.withColumn("chain", _text_upto(level)).join(counts, ["page_id", "chain"]), "paths")
        done = (F.col("n_matches") == 1) | (F.size("path") == level) | F.lit(level == most)
        out = out.unionByName(scored.filter(done).select("page_id", "pre", F.col("chain").alias("selector"), "n_matches"))
        paths = scored.filter(~done).select("page_id", "pre", "path")
        if level == most or paths.isEmpty():
            break
        wanted = paths.select(
            "page_id", _text_upto(level).alias("chain"), F.col("path")[level].alias("step"), _text_upto(level + 1).alias("longer")
        ).distinct()
        hop = sat.select("page_id", F.col("pre").alias("cur"), "step", F.col("parent").alias("up"))
        reach = written(
            reach.join(wanted.select("page_id", "chain").distinct(), ["page_id", "chain"], "left_semi")
            .join(hop, ["page_id", "cur"])
            .join(wanted, ["page_id", "chain", "step"])
            .select("page_id", F.col("longer").alias("chain"), F.col("up").alias("cur")),
            "reach",
        )
    return out
