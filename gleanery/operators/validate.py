"""Typed cleaning of raw values with an issues table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scalars import (
    is_http_url, iso_utc, parse_date, prefix_number, resolve_url, squash, url_host, word_boolean,
)
from gleanery.session import written

KEY = ["page_id", "dp_id"]


@dataclass(frozen=True)
class DataPoint:
    """One planned field."""

    dp_id: str
    type: str = "string"
    is_list: bool = False
    notes: str | None = None


# Issue texts by code; {v} is the raw value, {t} its JSON type.
ISSUES = {
    "list_expected": "Type mismatch: Expected list, got single item.",
    "scalar_expected": "Type mismatch: Expected single item, got list.",
    "number_unparsed": 'Type mismatch: Expected number, failed to parse from string "{v}".',
    "number_type": "Type mismatch: Expected number, got {t}.",
    "boolean_type": "Type mismatch: Expected boolean, got {t}.",
    "url_invalid": 'Invalid URL: Expected valid URL, got "{v}".',
    "url_unresolved": 'Invalid URL: Failed to parse or resolve "{v}".',
    "url_type": "Type mismatch: Expected valid URL string, got {t}.",
    "date_unparsed": 'Type mismatch: Expected date, failed to parse from "{v}".',
    "string_type": "Type mismatch: Expected string, got {t}. Converting.",
    "list_emptied": "List empty after validation/cleaning.",
    "required_list": "Required list is empty.",
    "required_item": "Required item is missing or null.",
}


def issue_text(code: Column, value: Column, json_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, text in ISSUES.items():
        filled = F.replace(F.replace(F.lit(text), F.lit("{t}"), F.coalesce(json_type, F.lit(""))), F.lit("{v}"), F.coalesce(value, F.lit("")))
        out = F.when(code == k, filled).otherwise(out)
    return out


def plan_grid(pages: DataFrame, plan: list[DataPoint], *carry: str) -> DataFrame:
    """Every page with every planned field; the plan is a short list, so this is an explode."""
    points = F.array(
        *[
            F.struct(
                F.lit(p.dp_id).alias("dp_id"), F.lit(p.type).alias("type"), F.lit(p.is_list).alias("is_list"),
                F.lit(p.notes).cast("string").alias("notes"),
            )
            for p in plan
        ]
    )
    return pages.select("page_id", *carry, F.explode(points).alias("_p")).select("page_id", *carry, "_p.*")


def required(notes: Column) -> Column:
    """Notes that are present and do not say optional make a field required."""
    return F.coalesce((notes != "") & ~F.lower(notes).contains("optional"), F.lit(False))


def clean_items(rows: DataFrame) -> DataFrame:
    """Coerce rows(type, value, json_type, url).

    Adds ``clean`` (text form of the result; the raw text where coercion
    failed), typed columns ``num``, ``bool``, ``ts`` and the issue ``code``.
    """
    t, v, j = F.col("type"), F.col("value"), F.col("json_type")
    text, url, resolved = F.col("_text"), F.col("url"), F.col("_resolved")
    is_str, is_num, is_url = j == "string", j == "number", t.isin("url", "image_url")
    missing = v.isNull() | (j == "null")
    # separate projections: each costly expression is computed once
    rows = rows.withColumn("_text", F.when(is_str, squash(v)).otherwise(v))
    rows = rows.withColumn("_kept", is_url & is_str & is_http_url(text))
    rows = rows.withColumn("_resolved", F.when(is_url & is_str & ~F.col("_kept") & url.isNotNull(), resolve_url(text, url)))
    rows = rows.withColumns(
        {
            "num": F.when(t == "number", F.when(is_str, prefix_number(text)).when(is_num, v.try_cast("double"))),
            "bool": F.when(t == "boolean", word_boolean(text)),
            "ts": F.when(
                t == "date", F.when(is_num, F.timestamp_millis(v.try_cast("double").cast("long"))).otherwise(parse_date(text))
            ),
            "_ok": F.col("_kept") | (is_url & resolved.isNotNull() & is_http_url(resolved)),
        }
    )
    code = F.when(missing, F.lit(None)).otherwise(
        F.when((t == "number") & F.col("num").isNull(), F.when(is_str, F.lit("number_unparsed")).otherwise(F.lit("number_type")))
        .when((t == "boolean") & F.col("bool").isNull(), F.lit("boolean_type"))
        .when(
            is_url & ~F.col("_ok"),
            F.when(~is_str | url.isNull(), F.lit("url_type"))
            .when(resolved.isNull(), F.lit("url_unresolved"))
            .otherwise(F.lit("url_invalid")),
        )
        .when((t == "date") & F.col("ts").isNull(), F.lit("date_unparsed"))
        .when(~t.isin("number", "boolean", "url", "image_url", "date") & ~is_str, F.lit("string_type"))
    )
    clean = F.when(missing, F.lit(None)).otherwise(
        F.coalesce(
            F.col("bool").cast("string"),
            F.regexp_replace(F.col("num").cast("string"), r"\.0\z", ""),
            F.when(F.col("_ok"), F.coalesce(resolved, text)),
            iso_utc(F.col("ts")),
            text,
        )
    )
    return rows.withColumns({"code": code, "clean": clean}).drop("_text", "_kept", "_resolved", "_ok")


def shaped(raw: DataFrame, grid: DataFrame) -> DataFrame:
    """Planned fields left-joined to raw values, with list/scalar shape settled (V1-V3).

    grid(page_id, url, dp_id, type, is_list, notes): what is planned for each page.

    raw(page_id, dp_id, raw_kind null|scalar|list, pos, value, json_type).
    Raw fields outside the plan drop out; planned fields without a raw row stay
    with ``raw_kind`` absent. A scalar field keeps only the first list item.
    """
    rows = grid.join(raw, KEY, "left").withColumn("raw_kind", F.coalesce("raw_kind", F.lit("absent")))
    wrong_list = F.col("is_list") & F.col("raw_kind").isin("scalar", "null")
    wrong_item = ~F.col("is_list") & (F.col("raw_kind") == "list")
    rows = rows.withColumn("shape_code", F.when(wrong_list, F.lit("list_expected")).when(wrong_item, F.lit("scalar_expected")))
    return rows.filter(F.col("is_list") | F.coalesce(F.col("pos") == 0, F.lit(True)))


def validate(raw: DataFrame, pages: DataFrame, plan: list[DataPoint]) -> tuple[DataFrame, DataFrame]:
    """(clean values, issues) of one plan for all pages."""
    return validate_grid(raw, plan_grid(pages, plan, "url"))


def validate_grid(raw: DataFrame, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean values, issues) where each page has the fields of its rows in ``grid``.

    Values: one row per kept item; a scalar field without a value keeps a NULL
    row, an empty list has none. Group facts are counts, so a very long list
    is pre-aggregated before it is shuffled.
    """
    n_raw = raw.filter(F.col("raw_kind") == "list").groupBy(*KEY).agg(F.count("pos").alias("n_raw"))
    # read three times below: coerce once
    items = written(clean_items(shaped(raw, grid)), "items")
    values = items.filter(~F.col("is_list") | F.col("clean").isNotNull()).select(
        *KEY, "type", "is_list", F.coalesce("pos", F.lit(0)).alias("pos"), "clean", "num", "bool", "ts", "code"
    )
    none = F.lit(None).cast("long").alias("original_count")
    item_issues = items.filter(F.col("code").isNotNull()).select(
        *KEY, "pos", "code", issue_text(F.col("code"), F.col("value"), F.col("json_type")).alias("issue"), "value", none
    )
    groups = items.groupBy(*KEY, "is_list", "notes").agg(
        F.max("shape_code").alias("shape_code"), F.count("clean").alias("n_clean"), F.max("raw_kind").alias("raw_kind"),
        F.min_by("value", "pos").alias("value"),
    ).join(n_raw, KEY, "left")
    emptied = F.col("is_list") & (F.coalesce("n_raw", F.lit(0)) > 0) & (F.col("n_clean") == 0)
    lacking = required(F.col("notes")) & (F.col("n_clean") == 0)
    codes = F.array_compact(
        F.array(
            F.col("shape_code"),
            F.when(emptied, F.lit("list_emptied")).when(
                lacking, F.when(F.col("is_list"), F.lit("required_list")).otherwise(F.lit("required_item"))
            ),
        )
    )
    group_issues = groups.select(*KEY, F.explode(codes).alias("code"), "value", "n_raw").select(
        *KEY,
        F.lit(None).cast("int").alias("pos"),
        "code",
        issue_text(F.col("code"), F.col("value"), F.lit("")).alias("issue"),
        F.when(F.col("code").isin("list_expected", "scalar_expected"), F.col("value")).alias("value"),
        F.when(F.col("code") == "list_emptied", F.col("n_raw")).alias("original_count"),
    )
    return values, group_issues.unionByName(item_issues)


def all_issues(*parts: DataFrame) -> DataFrame:
    """Issue tables under one another; missing columns are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def final_selectors(fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """First candidate per field, or NULL."""
    first = candidates.groupBy("dp_id").agg(F.min_by("selector", "rank").alias("selector"))
    return fields.join(first, "dp_id", "left")


def run_summary(pages: DataFrame, values: DataFrame, issues: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """One row per page: success, value and issue counts (V17). Rejected pages keep a failed row."""
    n_val = values.filter(F.col("clean").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n_values"))
    n_iss = issues.groupBy("page_id").agg(F.count("*").alias("n_issues"))
    out = pages.select("page_id", F.lit(True).alias("success"))
    if rejects is not None:
        out = out.unionByName(rejects.select("page_id", F.lit(False).alias("success")))
    return out.join(n_val, "page_id", "left").join(n_iss, "page_id", "left").na.fill(0, ["n_values", "n_issues"])


def quality_report(values: DataFrame, pages: DataFrame, planned: DataFrame, issues: DataFrame) -> DataFrame:
    """Compliance, completeness and number of issues per host and field, with subtotals.

    Status: PASSED when both are 100 %, FAILED when nothing is complete, else PARTIAL.
    """
    bad = issues.filter(F.col("dp_id").isNotNull()).groupBy(*KEY).agg(F.count("*").alias("_bad"))
    full = values.filter(F.col("clean").isNotNull()).select(*KEY).distinct().withColumn("_full", F.lit(1))
    base = (
        planned.select(*KEY).join(full, KEY, "left").join(bad, KEY, "left")
        .join(pages.select("page_id", url_host(F.col("url")).alias("host")), "page_id")
    )
    n = F.count("*")
    rolled = base.rollup("host", "dp_id").agg(
        F.grouping_id().alias("level"), n.alias("n_fields"), F.count("_full").alias("n_complete"), (n - F.count("_bad")).alias("n_compliant"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("n_issues"),
    )
    whole, ok = F.col("n_complete") / F.col("n_fields"), F.col("n_compliant") / F.col("n_fields")
    status = F.when((whole == 1) & (ok == 1), F.lit("PASSED")).when(whole == 0, F.lit("FAILED")).otherwise(F.lit("PARTIAL"))
    return rolled.select(
        "host", "dp_id", "level", "n_fields", "n_complete", "n_compliant", "n_issues",
        F.round(100 * whole, 2).alias("completeness"), F.round(100 * ok, 2).alias("compliance"), status.alias("status"),
    )


SMALL_GROUPS = 10_000


def outliers(values: DataFrame, group: str, value: str, limit: float = 3.0) -> DataFrame:
    """Rows with their z-score inside the group and an outlier flag.

    Statistics fold before they are shuffled. They are broadcast back only if
    they are counted to be at most SMALL_GROUPS rows, so a hot group stays on its
    scan splits; more groups than that are joined by shuffle.
    """
    stats = written(values.groupBy(group).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd")), "group-stats")
    if stats.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS:
        stats = F.broadcast(stats)
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    scored = values.join(stats, group).withColumn("z", z).drop("_mean", "_sd")
    return scored.withColumn("is_outlier", F.abs(F.col("z")) > limit)


def value_pattern(c: Column) -> Column:
    """Letters as ``a``, digits as ``9``."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}", "a"), r"[0-9]", "9")


def field_patterns(values: DataFrame, field: str, value: str) -> DataFrame:
    """Most frequent pattern of each field and how many values follow it."""
    counts = values.groupBy(field, value_pattern(F.col(value)).alias("pattern")).agg(F.count("*").alias("n"))
    return counts.groupBy(field).agg(
        F.min_by("pattern", F.struct((-F.col("n")).alias("n"), "pattern")).alias("top_pattern"),
        F.max("n").alias("n_top"), F.sum("n").alias("n_values"), F.count("*").alias("n_patterns"),
    )


def infer_types(values: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Type of each column: the first of number, boolean, url, date that every value passes."""
    v = squash(F.col(value))
    strict = v.rlike(r"^[$€£¥]?\s*-?[\d,]*\.?\d+\z")
    tests = {
        "number": strict & prefix_number(v).isNotNull(),
        "boolean": word_boolean(v).isNotNull(),
        "url": is_http_url(v),
        "date": parse_date(v).isNotNull(),
    }
    n = F.count("v")
    shares = values.select(field, v.alias("v"), *[t.alias(k) for k, t in tests.items()]).groupBy(field).agg(
        n.alias("n_values"), *[F.count_if(F.col(k)).alias(k) for k in tests]
    )
    kind = F.lit("string")
    for k in reversed(tests):
        kind = F.when((F.col("n_values") > 0) & (F.col(k) == F.col("n_values")), F.lit(k)).otherwise(kind)
    return shares.select(field, "n_values", kind.alias("type"))
