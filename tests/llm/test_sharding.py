"""Rendezvous hashing and slots."""

import hashlib
import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gleanery.llm import sharding
from gleanery.llm.base import QUERIES


def brute(key, weights):
    def score(j, w):
        h = int(hashlib.md5(f"{'' if key is None else key}:{j}".encode()).hexdigest()[:12], 16)
        return -w / math.log((h + 0.5) / 16.0**12)

    return max(range(len(weights)), key=lambda j: (score(j, weights[j]), -j))


def test_against_brute_force(spark):
    keys = [*range(500), None, -7, 2**62]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for weights in ([1.0] * 5, [1.0, 2.5, 0.5], [3.0]):
        got = {r.k: r.s for r in df.select("k", sharding.rendezvous(F.col("k"), weights).alias("s")).collect()}
        assert got == {k: brute(k, weights) for k in keys}


def test_few_records_move(spark):
    n = 20_000
    df = spark.range(n).select("id", *[sharding.rendezvous(F.col("id"), [1.0] * k).alias(f"s{k}") for k in (8, 9)])
    df = df.withColumn("heavy", sharding.rendezvous(F.col("id"), [1.0] * 7 + [3.0])).toPandas()
    moved = df[df.s8 != df.s9]
    assert set(moved.s9) == {8} and abs(len(moved) / n - 1 / 9) < 0.01
    share = Counter(df.heavy)
    assert abs(share[7] / n - 0.3) < 0.02 and all(abs(share[j] / n - 0.1) < 0.02 for j in range(7))


def test_slots_are_gapless(spark):
    rows = [(i % 3, i // 2 if i % 50 else None, "x") for i in range(3000)] + [(9, 5, "a")] * 40
    df = spark.createDataFrame(rows, "shard int, k long, t string")
    got = {}
    for r in sharding.slots(df, "shard", "k", ["t"]).collect():
        got.setdefault(r.shard, []).append(r.slot)
    assert {s: sorted(v) for s, v in got.items()} == {s: list(range(n)) for s, n in Counter(s for s, _, _ in rows).items()}
    assert sharding.slots(df.where("false"), "shard", "k").collect() == []


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, None, 1), (2, "", 1), (None, "é", 1), (2, "", 1), (3, "x" * 100_000, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, slot int").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op3_rendezvous_shards"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows), key=str)
    assert all(r.shard == brute(r.doc_id, [1.0] * 16) and r.grown_shard in (r.shard, 16) for r in got)
    assert sorted(r.slot for r in got if r.doc_id == 2) == [0, 1]
