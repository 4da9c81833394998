"""Result sinks and previews (A3-A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_line(*cols: str) -> Column:
    return F.to_csv(F.struct(*cols))


def json_line(*cols: str) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def write_csv(df: DataFrame, path: str, cols: list[str]) -> None:
    df.select(*cols).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str, cols: list[str]) -> None:
    df.select(*cols).write.option("ignoreNullFields", False).json(path)


def preview(df: DataFrame, where: Column, order: list[Column], limit: int) -> DataFrame:
    """Filtered, sorted top rows: one bounded heap per task, no full sort."""
    return df.filter(where).orderBy(*order).limit(limit)


def nested_json(records: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One JSON tree per page: its records in order. A page holds at most the record cap."""
    row = F.struct(order, *[c for c in cols if c != order])
    return records.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("records")).select(
        key, F.to_json(F.struct(F.col(key), F.col("records")), {"ignoreNullFields": "false"}).alias("json")
    )
