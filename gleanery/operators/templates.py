"""Saved extraction templates: a versioned table, kept by name and host.

A template holds container selectors and fields. The store is an append-only
log in one folder: saving, replacing and removing add rows, and a read folds them
to the newest version of each (name, host) at a point in time. So several
applications can write and read the same folder, a job that is run again
after a failure repeats its own rows and changes nothing, and every earlier state stays
readable. ``compact`` folds what nobody wants to go back behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.scalars import url_host
from gleanery.operators.batch import batch_records

FIELDS = "array<struct<field: string, selector: string, attribute: string, transform: string>>"
BODY = "css string, xpath string, fields " + FIELDS
LOG = f"name string, host string, version long, op string, {BODY}"
KEY = ["name", "host"]
_COLS = [*KEY, "version", "op", "css", "xpath", "fields"]


def _append(rows: DataFrame, path: str) -> None:
    rows.select(*_COLS).write.mode("append").parquet(path)


def save(templates: DataFrame, path: str, version: int | Column) -> None:
    """Add templates(name, host, css, xpath, fields) or replace those of the same name and host.

    ``version`` orders saves, a number or a column (as a time in microseconds); of
    two rows of one version the larger body counts, so all readers agree.
    """
    at = version if isinstance(version, Column) else F.lit(version)
    known = templates.filter(F.col("name").isNotNull() & F.col("host").isNotNull())
    _append(known.withColumns({"version": at.cast("long"), "op": F.lit("save"), "fields": F.col("fields").cast(FIELDS)}), path)


def remove(keys: DataFrame, path: str, version: int | Column) -> None:
    """Remove templates by keys(name, host)."""
    at = version if isinstance(version, Column) else F.lit(version)
    body = {"css": F.lit(None).cast("string"), "xpath": F.lit(None).cast("string"), "fields": F.lit(None).cast(FIELDS)}
    _append(keys.select(*KEY).withColumns({"version": at.cast("long"), "op": F.lit("remove"), **body}), path)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the log; none before the first save."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path)


def as_of(log: DataFrame, version: int | None = None) -> DataFrame:
    """Templates that were valid at a version, or are now: (name, host, version, css, xpath, fields)."""
    seen = log if version is None else log.filter(F.col("version") <= version)
    rest = F.struct("op", "css", "xpath", "fields")
    last = seen.groupBy(*KEY).agg(F.max(F.struct("version", rest.alias("body"))).alias("_l"))
    return last.filter(F.col("_l.body.op") == "save").select(*KEY, "_l.version", "_l.body.css", "_l.body.xpath", "_l.body.fields")


def compact(spark: SparkSession, path: str, to: str, version: int) -> None:
    """Write the log to another folder with one row for each template that was valid at ``version``, and all later rows."""
    log = versions(spark, path)
    base = as_of(log, version).withColumn("op", F.lit("save"))
    _append(base.select(*_COLS).unionByName(log.filter(F.col("version") > version)), to)


def apply(pages: DataFrame, nodes: DataFrame, templates: DataFrame, name: str, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of pages by the template of that name for their host, each with its own fields.

    Records are long, see ``batch_records``; ``grp`` is the host. Pages of hosts
    without the template give an issue.
    """
    own = templates.filter(F.col("name") == name)
    plans = own.select(F.col("host").alias("grp"), "css", "xpath")
    fields = own.select(F.col("host").alias("grp"), F.explode("fields").alias("_f")).select("grp", "_f.*")
    return batch_records(nodes, pages.select("page_id", url_host(F.col("url")).alias("grp")), plans, fields, pages, cap)
