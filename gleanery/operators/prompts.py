"""Bounded prompt text from pages, plans and selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.scalars import truncated
from gleanery.plans.templates import PROMPTS, SETTINGS, SYSTEM_PROMPTS

CUT = "\n<!-- HTML truncated for size limits -->"


def bounded(c: Column, limit: int | None = None, mark: str = "") -> Column:
    """The first ``limit`` characters with a mark where it was cut; whole without a limit."""
    return c if limit is None else truncated(c, limit, mark)


def fill_template(template: Column, values: Column) -> Column:
    """Fill ``{name}`` holes from a map in one pass (C4).

    NULL values become empty; unknown names stay; filled-in text is never
    scanned again, because the template is cut into pieces first.
    """
    pieces = F.regexp_extract_all(template, F.lit(r"\{\w+\}|[^{]+|\{"), 0)

    def fill(p: Column) -> Column:
        name = F.regexp_extract(p, r"^\{(\w+)\}$", 1)
        return F.when((name != "") & F.map_contains_key(values, name), F.coalesce(F.try_element_at(values, name), F.lit(""))).otherwise(p)

    return F.array_join(F.transform(pieces, fill), "")


def hole_names(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), 1))


def missing_keys(template: Column, values: Column) -> Column:
    """Hole names without a value."""
    return F.array_except(hole_names(template), F.map_keys(values))


def value_map(**cols: Column) -> Column:
    return F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c.cast("string"))])


def with_system_prompt(rows: DataFrame, agent_col: str) -> DataFrame:
    """Add ``system`` by agent type, any case; unknown types get NULL and an ``error``."""
    known = F.create_map(*[F.lit(x) for pair in sorted(SYSTEM_PROMPTS.items()) for x in pair])  # a few texts, so no join
    out = rows.withColumn("system", F.try_element_at(known, F.upper(F.col(agent_col))))
    return out.withColumn(
        "error", F.when(F.col("system").isNull(), F.concat(F.lit("No system prompt found for agent type: "), F.col(agent_col)))
    )


def prompt_of(kind: str, **cols: Column) -> Column:
    """STRUCT<kind, system, prompt, temperature, max_tokens> of one prompt kind."""
    agent, temperature, max_tokens = SETTINGS[kind]
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(SYSTEM_PROMPTS.get(agent)).cast("string").alias("system"),
        fill_template(F.lit(PROMPTS[kind]), value_map(**cols)).alias("prompt"),
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
    )


def prompt_rows(rows: DataFrame, key: list[str], *prompts: Column) -> DataFrame:
    """One row per prompt; several prompts about a row still read that row once."""
    return rows.select(*key, F.explode(F.array(*prompts)).alias("_p")).select(*key, "_p.*")


def page_prompts(pages: DataFrame, goal: Column, limit: int | None = None, mark: str = "") -> DataFrame:
    """Plan, multi-page plan and robust-selector prompts for every page; ``limit`` cuts the page source."""
    html, url = F.col("html"), F.col("url")
    plan = prompt_of("PLANNER_CREATE_PLAN", targetUrl=url, extractionGoal=goal, htmlSample=bounded(html, limit, mark))
    many = prompt_of("MULTIPAGE_PLAN", mainPageUrl=url, dataToCollect=goal, paginationPattern=F.lit("unknown"), htmlSample=bounded(html, limit, mark))
    robust = prompt_of("SELECTOR_ROBUST", targetDescription=goal, htmlSample=bounded(html, limit))
    return prompt_rows(pages, ["page_id"], plan, many, robust)


def selector_prompts(rows: DataFrame, key: list[str], limit: int | None = None, mark: str = "") -> DataFrame:
    """The prompts about selectors and records (C7): generate, several fields, extract, improve, convert and recover.

    rows(key, page_html, goal, target, targets, schema, css, xpath, feedback,
    error). A prompt whose own inputs are NULL is not made.
    """
    html, c = bounded(F.col("page_html"), limit, mark), F.col
    css, xpath = c("css").isNotNull(), c("xpath").isNotNull()
    now = F.concat_ws("\n", F.when(css, F.concat(F.lit("CSS: "), "css")), F.when(xpath, F.concat(F.lit("XPath: "), "xpath")))
    text = F.lit("string")
    made = [
        (c("target").isNotNull() & ~css & ~xpath, prompt_of("SELECTOR_GENERATE", targetData=c("target"), extractionGoal=c("goal"), htmlSample=html)),
        (c("targets").isNotNull(), prompt_of("SELECTOR_GENERATE_MULTI", targetsDescription=c("targets"), htmlContext=html, preferredType=F.lit("css"))),
        (c("schema").isNotNull(), prompt_of("EXTRACTOR_EXTRACT_DATA", schema=c("schema"), cssSelector=c("css"), xpathSelector=c("xpath"), htmlContent=html)),
        ((css | xpath) & c("feedback").isNotNull(), prompt_of("SELECTOR_IMPROVE", currentSelectors=now, feedback=c("feedback"), htmlContext=html)),
        (css & ~xpath, prompt_of("SELECTOR_CONVERT", fromType=F.lit("CSS"), toType=F.lit("XPath"), selector=c("css"))),
        (xpath & ~css, prompt_of("SELECTOR_CONVERT", fromType=F.lit("XPath"), toType=F.lit("CSS"), selector=c("xpath"))),
        (
            c("error").isNotNull() & css,
            prompt_of("RECOVERY_ALTERNATIVES", description=c("target"), type=text, failedSelector=c("css"), errorMessage=c("error"), notes=F.lit(""), htmlSample=html),
        ),
    ]
    asked = F.array_compact(F.array(*[F.when(wanted, prompt) for wanted, prompt in made]))
    return rows.select(*key, F.explode(asked).alias("_p")).select(*key, "_p.*")


def refine_prompts(plans: DataFrame, feedback: DataFrame, key: str, limit: int | None = None, mark: str = "") -> DataFrame:
    """Feedback on the latest version of each plan gives the next planning prompt (M8).

    plans(key, ts, version_id, goal, structure, fields, elements); feedback(key, feedback, html).
    """
    newest = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("version_id"))
    latest = plans.withColumn("_no", F.row_number().over(newest)).filter(F.col("_no") == 1).drop("_no")
    summary = plan_summary(F.col("goal"), F.col("structure"), F.col("fields"), F.col("elements"))
    ask = prompt_of("PLAN_REFINE", currentPlan=summary, feedback=F.col("feedback"), htmlSample=bounded(F.col("html"), limit, mark))
    return prompt_rows(latest.join(feedback, key), [key], ask)


def selector_summary(selectors: DataFrame, *key: str) -> DataFrame:
    """``CSS: ...`` lines, then ``XPath: ...`` lines, per key.

    The lines of one key are the selectors of one field: a handful.
    """
    label = F.when(F.col("kind") == "css", F.lit("CSS: ")).otherwise(F.lit("XPath: "))
    row = F.struct((F.col("kind") != "css").cast("int").alias("side"), "rank", F.concat(label, "selector").alias("text"))
    return selectors.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda s: s["text"]), "\n").alias("summary")
    )


def target_line(name: Column, kind: Column, description: Column) -> Column:
    def default(c: Column, text: str) -> Column:
        return F.when(c.isNull() | (c == ""), F.lit(text)).otherwise(c)

    return F.format_string(
        "Field: %s (%s) - Description: %s", name, default(kind, "string"), default(description, "No description")
    )


def plan_summary(goal: Column, structure: Column, fields: Column, elements: Column) -> Column:
    """Text form of a plan; ``fields`` is ARRAY<STRUCT<name, type>>."""
    listed = F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit(" ["), f["type"], F.lit("]"))), ", ")
    return F.concat(
        F.lit("Current Extraction Plan:\n- Goal: "), F.coalesce(goal, F.lit("null")),
        F.lit("\n- Data Structure: "), F.coalesce(structure, F.lit("null")),
        F.lit("\n- Fields: "), listed, F.lit("\n- Target Elements: "), F.array_join(elements, ", "),
    )
