"""Session settings and the two places where physical layout is decided."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a row takes in a join's hash table for each byte it takes in a file.
PACKED = 40

_staged: dict[tuple[str, str], tuple[str, object]] = {}
_local_root: dict[str, str] = {}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is written for.

    ``requireAllClusterKeysForCoPartition=false`` lets joins on
    ``(page_id, parent)`` reuse a table bucketed on ``page_id`` alone.
    """
    b = SparkSession.builder.appName("gleanery")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.sources.fileCompressionFactor": str(PACKED),
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Split a file scan whose rows would keep only some of the cluster's cores busy.

    Python parsing is CPU bound, so a few large row groups would leave cores
    idle. A row group is read by one task however many splits its file has, so
    rows count here, not splits (the file footers tell, no column is read). A scan
    that deals its rows evenly over all cores is returned untouched: then no page is
    shuffled before it is parsed.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    if splits >= cores:
        held = scan.groupBy(F.spark_partition_id().alias("split")).count().agg(F.max("count").alias("most"), F.sum("count").alias("total")).first()
        if (held.most or 0) * cores <= 2 * (held.total or 0):
            return scan
    return scan.repartition(max(splits, 4 * cores), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, for staged tables and stream state."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="gleanery-")
    return _local_root[app]


def app_folder(spark: SparkSession) -> str:
    """All that one application writes besides its results lies in this folder."""
    return os.path.join(shared_dir(spark), "gleanery", spark.sparkContext.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the application's; never reused."""
    return os.path.join(app_folder(spark), f"{name}-{os.urandom(6).hex()}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete the application's folder.

    Call it when all results are written: DataFrames that were returned before
    may still read from there. A cluster that expires ``spark.checkpoint.dir``
    by age does the same without a call.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(app_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _staged if k[0] == spark.sparkContext.applicationId]:
        del _staged[key]


def judged_by_rows(spark: SparkSession) -> None:
    """Let the planner count a file PACKED times when it looks for tables to broadcast; holds for the session.

    Keys of pages and selectors pack to a few bytes a row, so a table of millions of rows
    is small as a file. Sent whole, it would be put together in the driver's memory.
    A session with a factor of its own keeps it.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) == 1:
        spark.conf.set(name, str(PACKED))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder."""
    judged_by_rows(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, key: str, build, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``build()`` once per application and read it back as a table.

    Used where many steps read the same costly result (the parsed nodes).
    Unlike ``persist`` the copy survives lost executors, and later reads get
    column pruning, partition pruning and filter pushdown.
    """
    judged_by_rows(spark)
    app = spark.sparkContext.applicationId
    if (app, key) not in _staged:
        df = build()
        name = hashlib.sha1(key.encode()).hexdigest()[:12]
        path = scratch(spark, name)
        df.write.partitionBy(*partition_by).parquet(path)
        _staged[(app, key)] = (path, df.schema)
    path, schema = _staged[(app, key)]
    return spark.read.schema(schema).parquet(path)
