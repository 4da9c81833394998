"""Registry of the queries in this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts have kilobytes each and some far more; a task holds a few batches at a time.
BATCH_ROWS = 500

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in small batches; holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """``rest`` (all columns but the text as a struct, whatever their names) and ``text``, which may be null."""
    return docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("rest"), F.col(text_col).alias("text"))


def unpacked(names: list[str], text_col: str) -> list[Column]:
    """The columns of ``packed`` under their names again."""
    return [F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_in_worker(key: str, make: Callable[[], object]) -> object:
    """What a Python worker builds once and uses in many tasks, such as a vocabulary."""
    kept = sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
