"""Weighted rendezvous hashing of record keys, with gapless slots inside each shard.

Every record goes to the shard with the highest score ``-weight / ln(u)``, where
``u`` in (0, 1) comes from the MD5 digest of ``"key:shard"``. A score depends on
the key and one shard only, so adding a shard moves records into it and nowhere
else, and removing one moves only its own records.

Defined results: a null key hashes as the empty string; null text has size 1 (no
bytes plus one) and checksum 0; records with equal keys go to the same shard and
get different slots; an empty table gives an empty result. Further columns of
the input, whatever their names, are ignored unless asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.llm.base import query, table

SHARDS = 16
#: Slots are numbered inside so many key-hashed buckets of each shard: no task sorts a whole shard.
BUCKETS = 4096
_DIGITS = 12


def _digest_number(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), start, digits), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of each key. ``weights[j]`` is the weight of shard j; equal scores go to the lowest shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for j, weight in enumerate(weights):
        h = _digest_number(F.concat(name, F.lit(f":{j}")), 1, _DIGITS)
        score = -F.lit(float(weight)) / F.ln((h + F.lit(0.5)) / F.lit(float(16**_DIGITS)))
        scores.append(F.struct(score.alias("score"), F.lit(-j).alias("neg")))
    return -F.array_max(F.array(*scores))["neg"]


def slots(df: DataFrame, shard: str, key: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``slot``: numbers 0, 1, 2, ... without gaps inside each shard.

    Rows are counted per (shard, key bucket) first. The running totals of those
    counts, at most shards x BUCKETS rows, are joined back, and a row number inside
    each bucket is added to them. No row of a shard needs all others in its task.
    """
    bucket = _digest_number(F.coalesce(F.col(key).cast("string"), F.lit("")), 1, 3)
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = W.partitionBy(shard, "_bucket").orderBy(F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ties])
    numbered = rows.withColumn("_row", F.row_number().over(inside))
    # at most shards x BUCKETS rows of three numbers
    return numbered.join(F.broadcast(first), [shard, "_bucket"]).withColumn("slot", F.col("_first") + F.col("_row") - 1).drop("_bucket", "_first", "_row")


_SQL_SCORE = "-1.0 / ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || j), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


# CRC-32 by its rule: eight shifts of each byte value give the table, one look-up per byte the checksum.
_SQL_CRC = """
bits AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS b)
),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits),
crcs AS (
  SELECT rn, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT)),
    lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INTEGER) + 1])), 4294967295::BIGINT) AS crc
  FROM docs, crc_table
)"""


@query(
    "op3_rendezvous_shards",
    f"""
WITH docs AS (SELECT *, row_number() OVER () AS rn FROM documents),
{_SQL_CRC},
scored AS (SELECT rn, doc_id, j, {_SQL_SCORE} AS score FROM docs, range({SHARDS + 1}) r(j)),
best AS (
  SELECT rn, arg_max(j, score) FILTER (WHERE j < {SHARDS}) AS shard, arg_max(j, score) AS grown FROM scored GROUP BY rn
),
sized AS (
  SELECT d.doc_id, coalesce(octet_length(encode(d.text)), 0) + 1 AS size, c.crc, CAST(b.shard AS INTEGER) AS shard, CAST(b.grown AS INTEGER) AS grown_shard,
         ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 3))::BIGINT AS bucket
  FROM docs d JOIN best b USING (rn) JOIN crcs c USING (rn)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, crc) - 1 AS slot, grown_shard
FROM sized
""",
)
def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards by key, and over 17."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * SHARDS).cast("int").alias("shard"),
        rendezvous(F.col("doc_id"), [1.0] * (SHARDS + 1)).cast("int").alias("grown_shard"),
    )
    return slots(placed, "shard", "doc_id", ["size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
