"""The same steps as Structured Streaming jobs.

Every job is restartable: offsets and state live in the checkpoint folder,
and ``foreachBatch`` sinks write into a folder named after the batch, so a
batch that is replayed replaces its own output.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gleanery.operators.logs import window_counts
from gleanery.plans.extraction import run
from gleanery.plans.tables import run_plans
from gleanery.session import written


def file_feed(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def batch_folder(out: str, batch_id: int) -> str:
    return os.path.join(out, f"batch={batch_id}")


def to_batches(stream: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], mode: str = "append") -> StreamingQuery:
    """Run ``work`` on each micro-batch and write its result; processes what is there, then stops."""

    def sink(df: DataFrame, batch_id: int) -> None:
        work(df).write.mode("overwrite").parquet(batch_folder(out, batch_id))

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    )


def page_feed(pages: DataFrame, out: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Pages as they arrive -> whatever ``extract`` makes of a page table.

    Stateless: each micro-batch is parsed and extracted on its own.
    """
    return to_batches(pages, out, checkpoint, extract)


def job_feed(pages: DataFrame, out: str, checkpoint: str, plan: list, **how) -> StreamingQuery:
    """Pages as they arrive through the whole job (T1): values under ``out/values``, issues under ``out/issues``."""

    def sink(df: DataFrame, batch_id: int) -> None:
        result = run(written(df, "arrived"), plan, **how)
        result.values.write.mode("overwrite").parquet(batch_folder(os.path.join(out, "values"), batch_id))
        result.issues.write.mode("overwrite").parquet(batch_folder(os.path.join(out, "issues"), batch_id))

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def plan_feed(pages: DataFrame, out: str, checkpoint: str, groups: Callable[[DataFrame], DataFrame], plan_fields: DataFrame, **how) -> StreamingQuery:
    """Pages as they arrive, each by the plan of its group (T1, M6): values under ``out/values``, issues under ``out/issues``.

    ``groups`` gives (page_id, grp) of arrived pages. The plan is read anew for each batch, so a
    table of plans may grow while the stream runs.
    """

    def sink(df: DataFrame, batch_id: int) -> None:
        arrived = written(df, "arrived")
        result = run_plans(arrived, groups(arrived), plan_fields, **how)
        result.values.write.mode("overwrite").parquet(batch_folder(os.path.join(out, "values"), batch_id))
        result.issues.write.mode("overwrite").parquet(batch_folder(os.path.join(out, "issues"), batch_id))

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def log_window_feed(logs: DataFrame, out: str, checkpoint: str, size: str, slide: str | None, late: str) -> StreamingQuery:
    """Windowed counts per level; rows later than ``late`` are dropped.

    Update mode: a window may be written several times, the newest batch counts.
    """
    return to_batches(window_counts(logs.withWatermark("ts", late), size, slide), out, checkpoint, lambda df: df, "update")


def newest(out: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Read an update-mode output: the last written row of each key."""
    best = F.max_by(F.struct(*values), "batch")
    return out.groupBy(*key).agg(best.alias("_v")).select(*key, "_v.*")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def upsert(rows: DataFrame, out: str, key: list[str], order: list[str], buckets: int = 64) -> None:
    """Merge rows into a table that holds the newest row of each key.

    The table is partitioned by key bucket and only buckets with new rows are
    read and written, so it grows with keys, not with batches. Merging the same
    rows again changes nothing, so a replayed batch is harmless.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))

    def newest_of(df: DataFrame) -> DataFrame:
        return df.groupBy("bucket", *key).agg(best.alias("_l")).select("bucket", *key, "_l.*")

    new = written(newest_of(rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))), "upsert-new")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if touched and _exists(spark, out):
        old = spark.read.schema(new.schema).parquet(out).filter(F.col("bucket").isin(touched))
        new = written(newest_of(new.unionByName(old)), "upsert-merged")
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)


def latest_feed(changes: DataFrame, out: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Latest operation per (area, key), tombstones included, as a table that each batch updates.

    Rows of a batch fold before they are shuffled, so a hot key sends one row per
    task. changes(area, key, value, op, ts, seq).
    """

    def sink(df: DataFrame, batch_id: int) -> None:
        upsert(df.select("area", "key", "op", "value", "ts", "seq"), out, ["area", "key"], ["ts", "seq"], buckets)

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def live_entries(last: DataFrame) -> DataFrame:
    """Live entries of a ``latest_feed`` table; a clear is an operation on key ``*``."""
    wiped = last.filter(F.col("op") == "clear").select("area", F.struct("ts", "seq").alias("cleared_at"))
    kept = last.filter(F.col("op") == "set").join(wiped, "area", "left")
    newer = F.col("cleared_at").isNull() | (F.struct("ts", "seq") > F.col("cleared_at"))
    return kept.filter(newer).select("area", "key", "value", "ts")


def newest_in_task(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key in every batch of rows that a task sees.

    A stateless combiner: of a key that has a third of all rows, each task sends
    a row for some thousands.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values(order, kind="stable").drop_duplicates(key, keep="last")

    return rows.mapInPandas(fold, rows.schema)


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs this store; a query keeps the setting it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Latest(StatefulProcessor):
    """Newest operation of one (area, key); hands on what changes it. With ``forget``, tombstones leave the state after so many milliseconds."""

    def __init__(self, forget: int | None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "op string, us long, seq long")

    def handleInputRows(self, key, rows, timerValues):
        newest = max(rows, key=lambda r: (r["us"], r["seq"]))
        old = self.last.get() if self.last.exists() else None
        if old is not None and (old[1], old[2]) >= (newest["us"], newest["seq"]):
            return
        self.last.update((newest["op"], newest["us"], newest["seq"]))
        if self.forget is not None and newest["op"] == "remove":
            self.handle.registerTimer(newest["us"] // 1000 + self.forget)
        yield Row(area=key[0], key=key[1], op=newest["op"], value=newest["value"], us=newest["us"], seq=newest["seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.last.get() if self.last.exists() else None
        # a timer of an older removal says nothing about the newest operation
        if old is not None and old[0] == "remove" and old[1] // 1000 + self.forget <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def state_feed(changes: DataFrame, out: str, checkpoint: str, late: str | None = None, forget_days: float | None = None) -> StreamingQuery:
    """Latest operation per (area, key) as keyed state; each batch writes the keys that it changed and nothing else.

    changes(area, key, value, op, ts, seq). An operation older than the one known
    is no news, in whichever batch it comes. With ``forget_days`` a removed key leaves
    the state that long after its removal, as told by the watermark (``late`` behind the newest row); rows later than that
    are dropped, so they cannot bring it back. ``current_of`` folds the output.
    """
    spark = changes.sparkSession
    rows = changes.select("area", "key", "value", "op", "ts", "seq").filter(F.col("ts").isNotNull() & F.col("key").isNotNull())
    timed = forget_days is not None
    rows = newest_in_task(rows.withColumn("us", F.unix_micros("ts")), ["area", "key"], ["us", "seq"])
    rows = rows.withWatermark("ts", late or "0 seconds") if timed else rows
    news = rows.groupBy("area", "key").transformWithState(
        _Latest(round(forget_days * 86_400_000) if timed else None), "area string, key string, op string, value string, us long, seq long", "Append", "EventTime" if timed else "None"
    )
    with _keyed_state(spark):
        return to_batches(news.select("area", "key", "op", "value", F.timestamp_micros("us").alias("ts"), "seq"), out, checkpoint, lambda df: df)


def current_of(changed: DataFrame) -> DataFrame:
    """The newest row of each key in the output of ``state_feed``; ``live_entries`` reads it."""
    best = F.max_by(F.struct("op", "value", "ts", "seq"), F.struct("ts", "seq"))
    return changed.groupBy("area", "key").agg(best.alias("_l")).select("area", "key", "_l.*")


class _Seen(StatefulProcessor):
    """Hash and time of one URL when it was last seen. With ``gone``, a timer reports it removed so many milliseconds after that."""

    def __init__(self, gone: int | None):
        self.gone = gone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string, us long")

    def handleInputRows(self, key, rows, timerValues):
        newest = max(rows, key=lambda r: r["us"])
        old = self.last.get() if self.last.exists() else None
        if old is not None and old[1] >= newest["us"]:
            return
        self.last.update((newest["hash"], newest["us"]))
        if self.gone is not None:
            if old is not None:
                self.handle.deleteTimer(old[1] // 1000 + self.gone)
            self.handle.registerTimer(newest["us"] // 1000 + self.gone)
        if old is None or old[0] != newest["hash"]:
            yield Row(url=key[0], change="added" if old is None else "changed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            self.last.clear()
            yield Row(url=key[0], change="removed")

    def close(self) -> None:
        pass


def change_feed(crawl: DataFrame, out: str, checkpoint: str, gone_after_s: float | None = None, late: str = "0 seconds") -> StreamingQuery:
    """Pages that are new, changed or, with ``gone_after_s``, no longer seen (T4).

    crawl(url, ts, html). The state is one hash and time for each URL, kept by
    key, so a batch touches only the URLs in it; pages are hashed and folded before the
    shuffle. A page older than the one known is no news. A URL is removed when the
    watermark (``late`` behind the newest page) is ``gone_after_s`` past its last
    sighting: choose the time between two crawls. If it comes back it is added again.
    """
    hashed = crawl.filter(F.col("url").isNotNull() & F.col("ts").isNotNull()).select("url", "ts", F.sha2(F.coalesce("html", F.lit("")), 256).alias("hash"))
    timed = gone_after_s is not None
    rows = newest_in_task(hashed.withColumn("us", F.unix_micros("ts")), ["url"], ["us"])
    rows = rows.withWatermark("ts", late) if timed else rows
    news = rows.groupBy("url").transformWithState(_Seen(round(gone_after_s * 1000) if timed else None), "url string, change string", "Append", "EventTime" if timed else "None")
    with _keyed_state(crawl.sparkSession):
        return to_batches(news, out, checkpoint, lambda df: df)


def first_seen_feed(rows: DataFrame, key: list[str], out: str, checkpoint: str, within: str) -> StreamingQuery:
    """Each key once per watermark span (T5)."""
    once = rows.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)
    return to_batches(once, out, checkpoint, lambda df: df)
