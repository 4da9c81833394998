"""Failed selectors -> working alternatives -> re-extraction.

Alternatives are rows (page_id, dp_id, strategy, strategy_rank, alt_rank,
selector): rules derive them from the failed selector on the error's own row, and
other strategies make a table from all errors (for example from model answers).
All of them are tested at once, each on its own page; nothing is brought to the
driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.scalars import truncated
from gleanery.operators.dom import HTML_SPAN, with_best_text, with_html
from gleanery.operators.prompts import prompt_of, prompt_rows
from gleanery.operators.responses import alternatives, ask
from gleanery.operators.selector_table import matches_on
from gleanery.operators.selectors import KEY, select_or_empty
from gleanery.sources.nodes import elements

ALTERNATIVE = ["page_id", "dp_id", "failed", "strategy", "strategy_rank", "alt_rank", "selector"]


@dataclass(frozen=True)
class Strategy:
    """A ranked way to propose selectors.

    ``propose`` gives an array of alternatives from the failed selector.
    ``from_errors`` sees all errors(page_id, dp_id, selector, ...) and gives
    rows (page_id, dp_id, alt_rank, selector).
    """

    name: str
    propose: Callable[[Column], Column] | None = None
    from_errors: Callable[[DataFrame], DataFrame] | None = None


def generalised(selector: Column) -> Column:
    """Drop positions: ``li:nth-of-type(3) > a`` -> ``li > a``."""
    return F.regexp_replace(selector, r":nth-(child|of-type)\([^)]*\)|:(first|last)-(child|of-type)", "")


def without_lead(selector: Column) -> Column:
    """Drop the leading step."""
    return F.regexp_replace(selector, r"^\s*[^\s>+~]+\s*[\s>+~]\s*", "")


def by_attribute(selector: Column) -> Column:
    """Ids and classes become partial attribute tests."""
    ids = F.regexp_replace(selector, r"#([\w-]+)", '[id*="$1"]')
    return F.regexp_replace(ids, r"\.([A-Za-z_][\w-]*)", '[class*="$1"]')


RULES = (
    Strategy("generalise", lambda s: F.array(generalised(s))),
    Strategy("parent_child", lambda s: F.array(without_lead(s), without_lead(without_lead(s)))),
    Strategy("attribute", lambda s: F.array(by_attribute(s))),
)


def failed_fields(errors: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Errors with the selector that was planned for their field; ids outside the plan are skipped.

    The plan is a short list, so it is a map on the row: nothing is shuffled by field.
    """
    if not plan:
        return errors.withColumn("selector", F.lit(None).cast("string")).filter(F.lit(False))
    planned = F.create_map(*[F.lit(x) for pair in plan.items() for x in pair])
    return errors.filter(F.map_contains_key(planned, F.col("dp_id"))).withColumn("selector", F.element_at(planned, F.col("dp_id")))


def attempts(errors: DataFrame, *order: str, limit: int) -> DataFrame:
    """At most ``limit`` recovery attempts per page and field, in order (R2).

    The rank limit is applied before the shuffle as well (WindowGroupLimit),
    so one field failing everywhere does not gather in one task.
    """
    w = Window.partitionBy("page_id", "dp_id").orderBy(*order)
    return errors.withColumn("attempt", F.row_number().over(w)).filter(F.col("attempt") <= limit)


def _ranked(s: Strategy, rank: int) -> Column:
    name, place = F.lit(s.name).alias("strategy"), F.lit(rank).alias("strategy_rank")
    return F.transform(s.propose(F.col("selector")), lambda alt, i: F.struct(name, place, i.alias("alt_rank"), alt.alias("alt")))


def proposals(failed: DataFrame, strategies: tuple[Strategy, ...] = RULES) -> DataFrame:
    """failed(page_id, dp_id, selector) -> alternatives, in the order of the strategies."""
    out = None
    rules = [_ranked(s, rank) for rank, s in enumerate(strategies) if s.propose]
    base = failed.select("page_id", "dp_id", F.col("selector").alias("failed")).distinct()
    if rules:
        got = base.withColumn("selector", F.col("failed")).select("page_id", "dp_id", "failed", F.explode(F.concat(*rules)).alias("_a"))
        out = got.select("page_id", "dp_id", "failed", "_a.strategy", "_a.strategy_rank", "_a.alt_rank", F.col("_a.alt").alias("selector"))
    for rank, s in enumerate(strategies):
        if s.from_errors:
            got = s.from_errors(failed).select("page_id", "dp_id", F.lit(s.name).alias("strategy"), F.lit(rank).alias("strategy_rank"), F.col("alt_rank").cast("int"), "selector")
            got = got.join(base, ["page_id", "dp_id"]).select(*ALTERNATIVE)
            out = got if out is None else out.unionByName(got)
    if out is None:
        out = base.select("page_id", "dp_id", "failed", *[F.lit(None).cast(t).alias(c) for c, t in zip(ALTERNATIVE[3:], ("string", "int", "int", "string"))])
    return out.filter((F.col("selector") != "") & ~F.col("selector").eqNullSafe(F.col("failed")))


def from_answers(pages: DataFrame, answer_batch: Callable, kind: str = "RECOVERY_ALTERNATIVES", limit: int | None = None) -> Strategy:
    """Alternatives from model answers: failed fields become prompts, answers become selectors.

    ``answer_batch`` takes a batch of prompts(page_id, dp_id, kind, system,
    prompt, temperature, max_tokens) and returns page_id, dp_id and text.
    ``limit`` cuts the page source in the prompt; without it the source is whole.
    """

    def rows(errors: DataFrame) -> DataFrame:
        source = F.col("html") if limit is None else truncated(F.col("html"), limit, "...")
        held = errors.select("page_id", "dp_id", "selector").distinct().join(pages.select("page_id", "html"), "page_id")
        prompt = prompt_of(
            kind, description=F.col("dp_id"), type=F.lit("string"), failedSelector=F.col("selector"), notes=F.lit(""), htmlSample=source,
            errorMessage=F.lit("No elements found using the provided selectors"),
        )
        answers = ask(prompt_rows(held, ["page_id", "dp_id"], prompt), answer_batch, "page_id long, dp_id string, text string")
        return answers.select("page_id", "dp_id", F.posexplode(alternatives(F.col("text"))).alias("alt_rank", "selector"))

    return Strategy("answers", from_errors=rows)


def working_alternatives(nodes: DataFrame, alts: DataFrame) -> DataFrame:
    """Alternatives that match something, from the first strategy with a hit.

    Every selector is tested once on each page it is proposed for, in one pass
    over the nodes of these pages.
    """
    counts = matches_on(nodes, alts).groupBy("page_id", "selector").agg(F.count("*").alias("n"))
    hits = alts.join(counts, ["page_id", "selector"])
    best = hits.groupBy("page_id", "dp_id").agg(F.min("strategy_rank").alias("strategy_rank"))
    kept = hits.join(best, ["page_id", "dp_id", "strategy_rank"])
    # the same selector proposed twice counts once, at its first place
    return kept.groupBy("page_id", "dp_id", "selector", "strategy", "strategy_rank").agg(
        F.min("alt_rank").alias("alt_rank"), F.max("n").alias("n")
    )


def chosen_alternative(working: DataFrame) -> DataFrame:
    """The first working alternative of each page and field."""
    first = Window.partitionBy("page_id", "dp_id").orderBy("strategy_rank", "alt_rank")
    ranked = working.withColumn("_no", F.row_number().over(first)).filter(F.col("_no") == 1)
    return ranked.select("page_id", "dp_id", "selector", "strategy")


def read_values(found: DataFrame, nodes: DataFrame, pages: DataFrame, kinds: tuple[str, ...] = ("text", "html", "attribute")) -> DataFrame:
    """Raw values of found(page_id, pre, dp_id, is_list, kind, name): each row is read the way it says.

    Lists keep all matches, scalars the first. Rows of one kind are read
    together, so plans grow with ``kinds`` and not with fields.
    """
    held = elements(nodes).select(*KEY, "text", "vtext", "attrs", *HTML_SPAN)
    rows = found.select(*KEY, "dp_id", "is_list", "kind", "name").join(held, list(KEY))
    parts = []
    if "text" in kinds:
        parts.append(with_best_text(rows.filter("kind = 'text'").select(*KEY, "dp_id", "is_list", "text", "vtext"), nodes))
    if "html" in kinds:
        parts.append(with_html(rows.filter("kind = 'html'").select(*KEY, "dp_id", "is_list", *HTML_SPAN), pages))
    if "attribute" in kinds:
        parts.append(rows.filter("kind = 'attribute'").withColumn("value", F.try_element_at("attrs", F.lower("name"))))
    out = None
    for p in parts:
        p = p.select(*KEY, "dp_id", "is_list", "value")
        out = p if out is None else out.unionByName(p)
    pos = F.row_number().over(Window.partitionBy("page_id", "dp_id").orderBy("pre")) - 1
    return out.withColumn("pos", pos).filter(F.col("is_list") | (F.col("pos") == 0)).select(
        "page_id", "dp_id", F.when(F.col("is_list"), F.lit("list")).otherwise(F.lit("scalar")).alias("raw_kind"), "pos", "value",
        F.lit("string").alias("json_type"),
    )


def reextract(chosen: DataFrame, nodes: DataFrame, pages: DataFrame, plan: dict[str, tuple[bool, str, str]] | DataFrame) -> DataFrame:
    """Raw values of recovered fields through their new selector.

    plan: dp_id -> (is_list, kind text|html|attribute, attribute); a map on the
    row, so nothing is shuffled by field. Or a table (page_id, dp_id, is_list, kind, name),
    where pages have plans of their own.
    """
    if isinstance(plan, dict) and not plan:
        return nodes.select("page_id", *[F.lit(None).cast(t).alias(c) for c, t in (("dp_id", "string"), ("raw_kind", "string"), ("pos", "int"), ("value", "string"), ("json_type", "string"))]).limit(0)
    found = matches_on(nodes, chosen).join(chosen.select("page_id", "dp_id", "selector"), ["page_id", "selector"])
    if not isinstance(plan, dict):
        return read_values(found.join(plan, ["page_id", "dp_id"]), nodes, pages)
    fact = F.create_map(*[x for k, (is_list, kind, name) in plan.items() for x in (F.lit(k), F.struct(F.lit(is_list).alias("is_list"), F.lit(kind).alias("kind"), F.lit(name).alias("name")))])
    found = found.withColumn("_f", F.element_at(fact, F.col("dp_id"))).select("page_id", "pre", "dp_id", "_f.*")
    used = {kind for _, kind, _ in plan.values()}
    return read_values(found, nodes, pages, tuple(k for k in ("text", "html", "attribute") if k in used))


def errors_remaining(errors: DataFrame, recovered: DataFrame) -> DataFrame:
    """Errors whose field was not recovered."""
    return errors.join(recovered, ["page_id", "dp_id"], "left_anti")


def override_raw(raw: DataFrame, recovered: DataFrame) -> DataFrame:
    """Raw table with recovered fields replaced."""
    kept = raw.join(recovered.select("page_id", "dp_id").distinct(), ["page_id", "dp_id"], "left_anti")
    return kept.unionByName(recovered)


def recovery_rate(failed: DataFrame, recovered: DataFrame, *by: str) -> DataFrame:
    """Share of failed fields that were recovered."""
    marked = failed.join(recovered.select("page_id", "dp_id").distinct().withColumn("_ok", F.lit(1)), ["page_id", "dp_id"], "left")
    return marked.groupBy(*by).agg(
        F.count("*").alias("n_failed"), F.count("_ok").alias("n_recovered"), F.round(F.count("_ok") / F.count("*"), 4).alias("rate")
    )


def selector_precision(found: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """Share of matched elements that were meant, and of meant elements that were matched.

    found and wanted hold (page_id, pre) and the columns ``by``, as the selector or the field.
    """
    key = list(dict.fromkeys([*KEY, *by]))
    a = found.select(*key).distinct().withColumn("_f", F.lit(1))
    b = wanted.select(*key).distinct().withColumn("_w", F.lit(1))
    hits = F.count_if(F.col("_f").isNotNull() & F.col("_w").isNotNull())
    return a.join(b, key, "full").groupBy(*by).agg(
        F.count("_f").alias("n_found"), F.count("_w").alias("n_wanted"), hits.alias("n_right"),
        F.round(hits / F.nullif(F.count("_f"), F.lit(0)), 4).alias("precision"), F.round(hits / F.nullif(F.count("_w"), F.lit(0)), 4).alias("recall"),
    )


def pages_with_match(pages: DataFrame, nodes: DataFrame, selector: str) -> DataFrame:
    """Pages where the selector finds something."""
    return pages.join(select_or_empty(nodes, selector).select("page_id"), "page_id", "left_semi")
