"""The end-to-end job with plans as tables: any number of groups of pages, each with its own fields.

plan_fields(grp, dp_id, rank, selector, kind, attribute, type, is_list, notes) has
one row for each candidate selector of a field, the lowest rank first; the other
columns say the same on each of them. ``kind`` is text, html or attribute.
A page belongs to one group: page_groups(page_id, grp).

Nothing of a plan is brought to the driver. Fields meet pages in one equi join on
the group, selectors are matched by ``selector_table``, and validation takes the
grid of pages and fields as a table. So plans grow neither with groups nor with fields.

Rows without a group or a field id take no part; a field without a usable selector, or
with none, finds nothing and is reported; a page whose group has no plan gets one issue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.recover import RULES, Strategy, attempts, read_values
from gleanery.operators.selector_table import matches_on, usable
from gleanery.operators.validate import all_issues, run_summary, validate_grid
from gleanery.plans.extraction import ATTEMPTS, Result, recovered
from gleanery.session import written
from gleanery.sources.nodes import accepted, parse_pages, rejected

PLAN_SCHEMA = "grp string, dp_id string, rank int, selector string, kind string, attribute string, type string, is_list boolean, notes string"
_FACTS = ("type", "is_list", "notes", "kind", "attribute")


def field_facts(plan_fields: DataFrame) -> DataFrame:
    """One row for each group and field: its settings, and the selector to try first."""
    first = F.min_by(F.struct("selector", *_FACTS), F.struct(F.coalesce("rank", F.lit(0)).alias("r"), "selector")).alias("_f")
    return plan_fields.filter(F.col("grp").isNotNull() & F.col("dp_id").isNotNull()).groupBy("grp", "dp_id").agg(first).select("grp", "dp_id", "_f.*")


def planned_grid(pages: DataFrame, page_groups: DataFrame, facts: DataFrame) -> DataFrame:
    """Every page with the fields of its group: (page_id, grp, url, dp_id, selector, type, is_list, notes, kind, name)."""
    settings = facts.select(
        "grp", "dp_id", "selector", F.coalesce("type", F.lit("string")).alias("type"), F.coalesce("is_list", F.lit(False)).alias("is_list"), "notes",
        F.coalesce("kind", F.lit("text")).alias("kind"), F.coalesce("attribute", F.lit("href")).alias("name"),
    )
    return pages.select("page_id", "url").join(page_groups.select("page_id", "grp"), "page_id").join(settings, "grp")


def raw_by_plan(nodes: DataFrame, pages: DataFrame, grid: DataFrame, plan_fields: DataFrame) -> DataFrame:
    """Raw values of every planned field: by the first of its candidate selectors that finds something on the page."""
    candidates = plan_fields.select("grp", "dp_id", F.coalesce("rank", F.lit(0)).alias("rank"), F.col("selector").alias("tried")).filter(F.col("tried").isNotNull())
    asked = grid.select("page_id", "grp", "dp_id", "is_list", "kind", "name").join(candidates, ["grp", "dp_id"])
    asked = written(asked.select("page_id", "dp_id", "is_list", "kind", "name", "rank", F.col("tried").alias("selector")), "asked-fields")
    found = written(matches_on(nodes, asked).join(asked, ["page_id", "selector"]), "found-fields")
    best = found.groupBy("page_id", "dp_id").agg(F.min(F.struct("rank", "selector")).alias("_b")).select("page_id", "dp_id", "_b.*")
    return read_values(found.join(best, ["page_id", "dp_id", "rank", "selector"], "left_semi"), nodes, pages)


def missing_fields(grid: DataFrame, raw: DataFrame, plan_fields: DataFrame) -> DataFrame:
    """One row for each page and planned field without a raw value."""
    valid = usable(plan_fields).withColumnRenamed("valid", "_valid")
    lost = grid.join(raw.select("page_id", "dp_id"), ["page_id", "dp_id"], "left_anti").join(valid, "selector", "left")
    return lost.select(
        "page_id", "dp_id", "selector", F.lit("no_match").alias("code"),
        F.when(F.col("_valid"), F.lit("No elements found using the provided selectors")).otherwise(F.lit("Invalid selector")).alias("issue"),
    )


def unplanned(page_groups: DataFrame, facts: DataFrame) -> DataFrame:
    """Pages whose group has no plan."""
    return page_groups.join(facts.select("grp"), "grp", "left_anti").select("page_id", F.lit("no_plan").alias("code"), F.lit("No plan for this group of pages").alias("issue"))


def run_plans(
    pages: DataFrame, page_groups: DataFrame, plan_fields: DataFrame, strategies: tuple[Strategy, ...] = RULES, nodes: DataFrame | None = None, max_attempts: int = ATTEMPTS
) -> Result:
    """Extract, recover, validate and report, each page by the plan of its group.

    ``Result.selectors`` has (grp, dp_id, selector, recovered, strategy, n_pages).
    """
    good, bad = accepted(pages), rejected(pages)
    nodes = nodes if nodes is not None else written(parse_pages(good), "nodes")
    facts = written(field_facts(plan_fields), "field-facts")
    grid = written(planned_grid(good, page_groups, facts), "planned")
    raw = written(raw_by_plan(nodes, good, grid, plan_fields), "raw")
    errors = attempts(missing_fields(grid, raw, plan_fields), "selector", limit=max_attempts)
    used = facts.select("grp", "dp_id", "selector")
    if strategies:
        how = grid.select("page_id", "dp_id", "is_list", "kind", "name")
        raw, errors, chosen = recovered(nodes, good, raw, errors, how, strategies)
        stood = chosen.join(page_groups.select("page_id", "grp"), "page_id").groupBy("grp", "dp_id", F.col("selector").alias("recovered"), "strategy").agg(F.count("*").alias("n_pages"))
        used = used.join(stood, ["grp", "dp_id"], "left")
    else:
        used = used.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("recovered", "string"), ("strategy", "string"), ("n_pages", "long"))])
    values, found = validate_grid(raw, grid.select("page_id", "url", "dp_id", "type", "is_list", "notes"))
    issues = all_issues(errors.drop("attempt", "selector"), found, bad, unplanned(good.select("page_id").join(page_groups, "page_id"), facts))
    return Result(values, issues, run_summary(good, values, issues, bad), used)
