"""Quantiles, distinct counts and schemas from mergeable sketches.

A sketch is a few kilobytes whatever it stands for. It folds on each scan
split, is kept as a column of a table, one row for each run and group, and merges
with those of other runs; so values and URLs themselves are never shuffled, and
runs are compared without reading their pages again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.validate import SMALL_GROUPS
from gleanery.session import written

#: Size of quantile sketches (rank error about 1.7 / K, half a per cent here) and logarithm of the size of set sketches
#: (exact up to 2 ** LG_K distinct values of a group, then a relative error of about 2 ** (-LG_K / 2), under one per cent here).
K, LG_K = 350, 14
QUARTILES = (0.25, 0.5, 0.75)


def value_sketches(values: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One quantile sketch of the numbers of each group: (keys, sketch). NULL and NaN are left out."""
    number = F.col(value).cast("double")
    return values.filter(number.isNotNull() & ~F.isnan(number)).groupBy(*keys).agg(F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"))


def merged_values(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups, or of several runs, as those of coarser ones."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, at: tuple[float, ...] = QUARTILES) -> DataFrame:
    """Adds ``n`` and an array ``quantiles`` to rows with a sketch."""
    return sketches.withColumns({"n": F.kll_sketch_get_n_double("sketch"), "quantiles": F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, at)))}).drop("sketch")


def robust_outliers(values: DataFrame, keys: list[str], value: str, fence: float = 1.5, k: int = K) -> DataFrame:
    """Rows with the fences of their group and an outlier flag.

    A value is an outlier if it lies more than ``fence`` times the distance of
    the quartiles outside of them. Unlike a z-score this is not moved by the outliers. Quartiles go
    back by broadcast if they are counted to be few, else by shuffle. Rows
    without a number are no outliers.
    """
    stats = quantiles(value_sketches(values, keys, value, k))
    low, high = F.element_at("quantiles", 1), F.element_at("quantiles", 3)
    stats = written(stats.select(*[F.col(c).alias(f"_{c}") for c in keys], (low - fence * (high - low)).alias("lower"), (high + fence * (high - low)).alias("upper")), "fences")
    if stats.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS:
        stats = F.broadcast(stats)
    same = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = one if same is None else same & one
    number = F.col(value).cast("double")
    outside = (number < F.col("lower")) | (number > F.col("upper"))
    scored = values.join(stats, same, "left").drop(*[f"_{c}" for c in keys])
    return scored.withColumn("is_outlier", F.coalesce(outside & ~F.isnan(number), F.lit(False)))


def set_sketches(rows: DataFrame, keys: list[str], member: str, lg_k: int = LG_K) -> DataFrame:
    """One sketch of the distinct members (as the URLs of a run) of each group: (keys, sketch)."""
    return rows.groupBy(*keys).agg(F.theta_sketch_agg(member, F.lit(lg_k)).alias("sketch"))


def merged_sets(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.theta_union_agg("sketch").alias("sketch"))


def _estimate(c: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(c).cast("long"), F.lit(0).cast("long"))


def run_overlap(sketches: DataFrame, run: str, old, new, keys: list[str]) -> DataFrame:
    """(keys, n_old, n_new, kept, added, removed): distinct members of two runs, from their sketches alone (M9).

    A group that only one of the runs has counts as all added or all removed.
    """
    sides = [sketches.filter(F.col(run) == F.lit(r)).select(*keys, F.col("sketch").alias(n)) for r, n in ((old, "_a"), (new, "_b"))]
    both = sides[0].join(sides[1], keys, "full")
    a, b = F.col("_a"), F.col("_b")
    return both.select(
        *keys, _estimate(a).alias("n_old"), _estimate(b).alias("n_new"), _estimate(F.when(a.isNotNull() & b.isNotNull(), F.theta_intersection(a, b))).alias("kept"),
        _estimate(F.when(a.isNull(), b).otherwise(F.when(b.isNotNull(), F.theta_difference(b, a)))).alias("added"),
        _estimate(F.when(b.isNull(), a).otherwise(F.when(a.isNotNull(), F.theta_difference(a, b)))).alias("removed"),
    )


def response_schemas(responses: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n, n_json, schema): what the JSON answers of each group look like together.

    Answers become VARIANT values and their types are merged in one aggregate, without Python
    and without a schema given beforehand; text that is no JSON counts only in ``n``.
    """
    parsed = responses.select(*keys, F.try_parse_json(F.col(text)).alias("_v"))
    return parsed.groupBy(*keys).agg(F.count("*").alias("n"), F.count("_v").alias("n_json"), F.schema_of_variant_agg("_v").alias("schema"))
