"""The end-to-end job: pages -> nodes -> raw values -> recovery -> clean values, issues, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.dom import extract_many
from gleanery.operators.recover import (
    RULES, Strategy, attempts, chosen_alternative, errors_remaining, override_raw, proposals, reextract, working_alternatives,
)
from gleanery.operators.selectors import is_valid
from gleanery.operators.validate import DataPoint, all_issues, run_summary, validate
from gleanery.session import written
from gleanery.sources.nodes import accepted, parse_pages, rejected

ATTEMPTS = 2  # fixed value: recovery attempts per page and field


@dataclass(frozen=True)
class PlannedField:
    """A data point with the selector to try first."""

    point: DataPoint
    selector: str
    kind: str = "text"  # text, html or attribute
    attribute: str = "href"


@dataclass
class Result:
    values: DataFrame
    issues: DataFrame
    summary: DataFrame
    selectors: DataFrame


def raw_values(nodes: DataFrame, pages: DataFrame, plan: list[PlannedField]) -> DataFrame:
    """Raw value rows of every planned field: lists keep all matches, scalars the first."""
    got = extract_many(nodes, pages, {f.point.dp_id: (f.selector, f.kind, f.attribute) for f in plan})
    lists = F.col("label").isin([f.point.dp_id for f in plan if f.point.is_list])
    return got.filter(lists | (F.col("pos") == 0)).select(
        "page_id", F.col("label").alias("dp_id"), F.when(lists, F.lit("list")).otherwise(F.lit("scalar")).alias("raw_kind"),
        "pos", "value", F.lit("string").alias("json_type"),
    )


def extraction_errors(pages: DataFrame, raw: DataFrame, plan: list[PlannedField]) -> DataFrame:
    """One row per page and field without a raw value: the plan on every page, without what was found."""
    facts = F.array(*[F.struct(F.lit(f.point.dp_id).alias("dp_id"), F.lit(f.selector).alias("selector"), F.lit(is_valid(f.selector)).alias("valid")) for f in plan])
    grid = pages.select("page_id", F.explode(facts).alias("_f")).select("page_id", "_f.*")
    return grid.join(raw.select("page_id", "dp_id"), ["page_id", "dp_id"], "left_anti").select(
        "page_id", "dp_id", "selector", F.lit("no_match").alias("code"),
        F.when(F.col("valid"), F.lit("No elements found using the provided selectors")).otherwise(F.lit("Invalid selector")).alias("issue"),
    )


def recovered(nodes: DataFrame, pages: DataFrame, raw: DataFrame, errors: DataFrame, how, strategies: tuple[Strategy, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw, errors, chosen): failed fields read again through the first working alternative. ``how`` is for ``reextract``."""
    errors = written(errors, "errors")
    alts = written(proposals(errors, strategies), "alternatives")
    chosen = written(chosen_alternative(working_alternatives(nodes, alts)), "chosen")
    again = written(reextract(chosen, nodes, pages, how), "again")
    return override_raw(raw, again), errors_remaining(errors, again), chosen


def run(
    pages: DataFrame, plan: list[PlannedField], strategies: tuple[Strategy, ...] = RULES, nodes: DataFrame | None = None, max_attempts: int = ATTEMPTS
) -> Result:
    """Extract, recover, validate and report.

    Selectors run once; errors are what the plan asks for and the raw table
    lacks. Results that several steps read are written first, so a lost executor
    costs one step. Pass a written ``nodes`` table to share the parse between runs.
    """
    if not plan:
        raise ValueError("Planning failed: no data points")
    good, bad = accepted(pages), rejected(pages)
    nodes = nodes if nodes is not None else written(parse_pages(good), "nodes")
    raw = written(raw_values(nodes, good, plan), "raw")
    errors = attempts(extraction_errors(good, raw, plan), "selector", limit=max_attempts)
    used = good.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(f.point.dp_id).alias("dp_id"), F.lit(f.selector).alias("selector")) for f in plan])).alias("_f")).select("_f.*")
    if strategies:
        how = {f.point.dp_id: (f.point.is_list, f.kind, f.attribute) for f in plan}
        raw, errors, chosen = recovered(nodes, good, raw, errors, how, strategies)
        # which selector stood in for the planned one, and on how many pages
        stood = chosen.groupBy("dp_id", "selector", "strategy").agg(F.count("*").alias("n_pages"))
        used = used.join(stood.withColumnsRenamed({"selector": "recovered"}), "dp_id", "left").select("dp_id", "selector", "recovered", "strategy", "n_pages")
    else:
        used = used.select("dp_id", "selector", *[F.lit(None).cast(t).alias(c) for c, t in (("recovered", "string"), ("strategy", "string"), ("n_pages", "long"))])
    values, found = validate(raw, good, [f.point for f in plan])
    issues = all_issues(errors.drop("attempt", "selector"), found, bad)
    return Result(values, issues, run_summary(good, values, issues, bad), used)
