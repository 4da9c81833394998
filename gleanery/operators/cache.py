"""A cache of model answers that lasts over runs.

Answers are kept by prompt in a table that is bucketed on the prompt's key. A run folds its prompts
to distinct ones, deals them over the same buckets, asks what the
cache lacks and adds the answers. The cache is read where it lies and is never
shuffled, however large it has grown; a run costs its own prompts and one scan of two columns.

The folder is the cache: any application that opens it with the same number of buckets sees
what others stored. A run that is repeated after a failure may store an answer twice; readers
take one of them, the same for all. Prompts without an answer are not stored and are asked again next time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.responses import ask, prompt_key
from gleanery.session import written

BUCKETS = 64


class PromptCache:
    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        if not re.fullmatch(r"\w+(\.\w+)?", name):
            raise ValueError("a table name is needed")
        self.spark, self.name, self.buckets = spark, name, buckets
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (cache_key STRING, text STRING) USING parquet CLUSTERED BY (cache_key) INTO {buckets} BUCKETS LOCATION '{place}'")

    def stored(self) -> DataFrame:
        """(cache_key, text), each key once; buckets hold whole keys, so this needs no shuffle."""
        return self.spark.table(self.name).groupBy("cache_key").agg(F.min("text").alias("text"))

    def answers(self, prompts: DataFrame, answer_batch: Callable) -> DataFrame:
        """``prompts`` with ``text`` and ``from_cache``; new answers are stored.

        prompts(prompt, model, system, ...). ``answer_batch`` takes a batch of (cache_key, prompt, model,
        system) and returns cache_key and text.
        """
        row = F.struct("*").alias("_row")
        keyed = prompts.select(prompt_key(F.col("prompt"), F.col("model"), F.col("system")).alias("cache_key"), row)
        one = F.struct("_row.prompt", "_row.model", "_row.system").alias("_p")
        once = keyed.groupBy("cache_key").agg(F.first(one).alias("_p")).repartition(self.buckets, "cache_key")
        held = self.stored().select("cache_key", F.col("text").alias("_known"))
        looked = written(once.join(held, "cache_key", "left"), "looked-up")
        fresh = looked.filter(F.col("_known").isNull()).select("cache_key", "_p.*")
        got = written(ask(fresh, answer_batch, "cache_key string, text string").filter(F.col("text").isNotNull()), "answered")
        got.repartition(self.buckets, "cache_key").write.insertInto(self.name)
        # the same answer for every run, should another one have stored its own meanwhile
        every = looked.select("cache_key", "_known").join(got, "cache_key", "left")
        known = every.select("cache_key", F.coalesce("_known", "text").alias("text"), F.col("_known").isNotNull().alias("from_cache"))
        return keyed.join(known, "cache_key").select("_row.*", "text", "from_cache")
