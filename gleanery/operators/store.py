"""Key/value state and service health from change logs.

State is never kept by collecting a key's history: ``max_by`` folds partial
results on each scan split, so a key with a third of all rows costs no more
shuffle than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _newest(what: Column) -> Column:
    return F.max_by(what, F.struct("ts", "seq"))


def latest_ops(log: DataFrame) -> DataFrame:
    """The last set/remove of each key: log(area, key, value, op, ts, seq)."""
    return (
        log.filter(F.col("op").isin("set", "remove"))
        .groupBy("area", "key")
        .agg(_newest(F.struct("op", "value", "ts", "seq")).alias("_l"), F.count("*").alias("n_ops"))
        .select("area", "key", "_l.*", "n_ops")
    )


def cleared(log: DataFrame) -> DataFrame:
    """When each area was last cleared."""
    return log.filter(F.col("op") == "clear").groupBy("area").agg(F.max(F.struct("ts", "seq")).alias("cleared_at"))


def snapshot(log: DataFrame) -> DataFrame:
    """All live entries (A10): last write wins, removes and area clears honoured."""
    last = latest_ops(log).join(cleared(log), "area", "left")
    newer = F.col("cleared_at").isNull() | (F.struct("ts", "seq") > F.col("cleared_at"))
    return last.filter((F.col("op") == "set") & newer).select("area", "key", "value", "ts")


def get(state: DataFrame, keys: DataFrame, default: Column) -> DataFrame:
    """Stored value per requested (area, key); the default only where the key is absent."""
    held = state.select("area", "key", "value", F.lit(True).alias("found"))
    joined = keys.join(held, ["area", "key"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return joined.withColumn("value", F.when(F.col("found"), F.col("value")).otherwise(default))


def removed_keys(log: DataFrame) -> DataFrame:
    """Keys whose last operation is a remove."""
    return latest_ops(log).filter(F.col("op") == "remove").select("area", "key", "ts")


def service_health(checks: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Latest check per service; failing or missing checks are unhealthy."""
    last = checks.groupBy("service").agg(_newest(F.col("ok")).alias("ok"), F.count("*").alias("n_checks"))
    if services is not None:
        last = services.join(last, "service", "left")
    return last.select("service", F.coalesce("ok", F.lit(False)).alias("healthy"), F.coalesce("n_checks", F.lit(0)).alias("n_checks"))
