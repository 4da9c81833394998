"""Log records: severity filter, line format, windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scalars import iso_utc

# Severity order.
LEVELS = {"debug": 0, "log": 1, "info": 2, "warn": 3, "error": 4, "none": 5}


def level_rank(level: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))]), level)


def at_least(logs: DataFrame, threshold: str, current: str = "log") -> DataFrame:
    """Records at or above the threshold; an unknown threshold keeps the current one."""
    rank = LEVELS.get(threshold, LEVELS[current])
    return logs.filter((level_rank(F.col("level")) >= rank) & (F.col("level") != "none"))


def log_line(ts: Column, context: Column, message: Column) -> Column:
    return F.concat(F.lit("["), iso_utc(ts), F.lit("] ["), context, F.lit("] "), message)


def window_counts(logs: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Records per level in tumbling or sliding windows; the same code runs on streams."""
    return logs.groupBy(F.window("ts", size, slide).alias("w"), "level").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "level", "n"
    )
