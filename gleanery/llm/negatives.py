"""Hard negatives by slots: every positive's score window is answered from shared top-k lists.

An anchor has a few positives: its best rows of the same label. Positive i with
score p allows negatives (rows of another label) with scores from low * p to
high * p. Windows of one anchor overlap, and each wants its own best k.

The upper limits of an anchor's windows, in descending order, cut the scores into
disjoint slots; a score belongs to the slot of the lowest limit that it does not
exceed. Only the best k of a slot can be in any answer, so tasks keep k rows a
slot (the combiner) and the merge of all tasks does the same. The rows a window
allows below its upper limit are the slots from its own downwards, so one list
of a slot answers all windows that reach over it: an answer is the first k of the
descending merge of those slots, cut at the window's lower limit.

Anchors against all rows are a grid: rows are packed into blobs of vectors,
anchors into blocks, and each pair of a row group and an anchor block is one
matrix product at a time inside a task. What crosses the shuffle are packed vectors and
at most k rows a slot and task, never scored pairs.

Scores are integer inner products; products of up to 2**53 are computed in
floating point, which is exact there, larger ones in 64-bit integers.

Defined results: rows with a null id, label or vector, and rows with null or non-finite
components take no part; equal rows (id, label, vector) count once; different rows of one id
are different anchors and candidates, but never meet; vectors meet only vectors
of their own length; fewer candidates give fewer rows; an anchor without
positives gives none; ties go to the smaller id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.llm.base import query, table
from gleanery.session import written

SCALE, POSITIVES, K = 256, 5, 10
#: A window goes from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Anchors of a block, rows of a group (of which a task may take several), bytes of a blob, scores held at once.
ANCHORS, GROUP, BLOB, CELL = 4096, 65536, 1 << 20, 1 << 20
_NONE = np.iinfo(np.int64).min


def scaled(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def whole(vector: Column) -> Column:
    """The vector is there, and all its components are numbers."""
    inf = float("inf")
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x.cast("double") < inf) & (x.cast("double") > -inf))


def _pack(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``dim, ids, labels, matrix`` of at most BLOB bytes each; rows of ``id, label, v``."""
    ids, labels = (rows.column(i).to_numpy() for i in (0, 1))
    v = rows.column(2)
    sizes = v.value_lengths().to_numpy()
    flat = v.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        step = max(1, BLOB // (8 * max(1, dim)))
        for s in range(0, len(at), step):
            own = at[s : s + step]
            yield dim, ids[own], labels[own], flat[starts[own][:, None] + np.arange(dim)[None, :]].astype(np.int64)


def _blobs(rows: DataFrame) -> DataFrame:
    """Packed rows ``dim, ids, labels, v`` of ``rows (id, label, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, ids, labels, v in _pack(b):
                yield pa.RecordBatch.from_pylist([{"dim": dim, "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "v": v.astype("<i8").tobytes()}], _BLOB)

    return rows.select("id", "label", "v").mapInArrow(run, "dim int, ids binary, labels binary, v binary")


_BLOB = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("v", pa.binary())])


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _firsts(owner: np.ndarray, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best ``k`` of every (owner, slot): higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~scores, slot, owner))
    o, s = owner[order], slot[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1])
    heads = np.flatnonzero(new)
    rank = np.arange(len(o)) - np.repeat(heads, np.diff(np.append(heads, len(o))))
    return order[rank < k]


def _best_of_cell(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all scores that can be in a row's best ``k``; ``_NONE`` is no score."""
    if scores.shape[1] > k:
        bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        return np.nonzero((scores >= bar[:, None]) & (scores != _NONE))
    return np.nonzero(scores != _NONE)


def _grid(blobs: DataFrame, anchors: DataFrame, groups: int, pick: Callable, k: int) -> DataFrame:
    """``block, pos, slot, id, score``: the best ``k`` of each anchor's slots among the rows of each task.

    ``blobs`` and ``anchors`` are packed; ``pick`` turns the scores of a cell into those of each slot.
    """
    blocks = anchors.groupBy("dim").agg(F.collect_set("block").alias("blocks"))  # one number for ANCHORS anchors
    left = blobs.withColumn("part", F.pmod(F.xxhash64("ids", "labels", "v"), F.lit(groups)).cast("int")).join(blocks, "dim")
    left = left.select("part", F.explode("blocks").alias("block"), "dim", "ids", "labels", "v")
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "*")
    met = left.join(right, ["part", "block", "dim"]).drop("part").sortWithinPartitions("block", "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None  # what the block at hand has so far; rows come block by block

        def out() -> pa.RecordBatch:
            at, slot, ids, score = best
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key[0], np.int32)), pa.array(at), pa.array(slot), pa.array(ids), pa.array(score)], ["block", "pos", "slot", "id", "score"])

        for b in batches:
            for row in range(len(b)):
                r = {c: b.column(i)[row].as_py() for i, c in enumerate(b.schema.names)}
                if key != (r["block"], r["dim"]):
                    if best is not None:
                        yield out()
                    key, best = (r["block"], r["dim"]), None
                ids, labels, at, q_ids, q_labels = (_longs(r[c]) for c in ("ids", "labels", "at", "q_ids", "q_labels"))
                x, q, limits = _longs(r["v"]).reshape(len(ids), -1), _longs(r["q"]).reshape(len(at), -1), _longs(r["limits"]).reshape(len(at), -1)
                found = [] if best is None else [best]
                step = max(1, CELL // len(ids))
                for s in range(0, len(at), step):
                    own = slice(s, s + step)
                    scores = _products(q[own], x)
                    same, self_ = labels[None, :] == q_labels[own, None], ids[None, :] == q_ids[own, None]
                    for slot, part in pick(scores, same, self_, limits[own]):
                        i, j = _best_of_cell(part, k)
                        found.append((at[own][i], np.full(len(i), slot, np.int64), ids[j], part[i, j]))
                if found:
                    every = [np.concatenate(c) for c in zip(*found)]
                    keep = _firsts(*every, k)
                    best = tuple(c[keep] for c in every)
        if best is not None:
            yield out()

    return met.mapInArrow(run, "block int, pos long, slot long, id long, score long")


def _alike(scores: np.ndarray, same: np.ndarray, own: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    yield 0, np.where(same & ~own, scores, _NONE)


def _by_slot(scores: np.ndarray, same: np.ndarray, own: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of each slot. ``limits``: an anchor's lowest lower limit, then its upper limits in descending order."""
    free = ~same & ~own & (scores >= limits[:, :1])
    uppers = limits[:, 1:]
    for slot in range(uppers.shape[1]):
        # equal limits leave the slots between them empty
        inside = free & (scores <= uppers[:, slot : slot + 1])
        if slot + 1 < uppers.shape[1]:
            inside &= scores > uppers[:, slot + 1 : slot + 2]
        if inside.any():
            yield slot, np.where(inside, scores, _NONE)


def _packed_anchors(asked: DataFrame) -> DataFrame:
    """One row for each block and vector length of ``asked (block, pos, id, label, v, limits)``: about ANCHORS anchors."""
    held = asked.groupBy("block", F.size("v").alias("dim")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "label", "v", "limits"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                cells = {c: np.array([x[f] for x in r["rows"]], "<i8").tobytes() for c, f in (("at", "pos"), ("q_ids", "id"), ("q_labels", "label"), ("q", "v"), ("limits", "limits"))}
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "dim": r["dim"], **cells}], _ASKED)

    return written(held.mapInArrow(run, "block int, dim int, at binary, q_ids binary, q_labels binary, q binary, limits binary"), "negatives-asked")


_ASKED = pa.schema([("block", pa.int32()), ("dim", pa.int32()), *[(c, pa.binary()) for c in ("at", "q_ids", "q_labels", "q", "limits")]])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each anchor's slot over all tasks."""
    order = W.partitionBy("block", "pos", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= k).drop("_no")


def _hundredths(x: Column, h: int) -> Column:
    """Floor of ``h`` hundredths of ``x``, without a product larger than the result."""
    rest = F.pmod(x, F.lit(100))
    whole_, part = F.call_function("div", x - rest, F.lit(100)), rest * h
    return whole_ * h + F.call_function("div", part - F.pmod(part, F.lit(100)), F.lit(100))


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    k: int = K,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    anchors: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id`` (long), ``label`` (long) and ``v`` (scaled vector).
    ``low`` and ``high`` are hundredths of the positive's score.
    """
    spark = rows.sparkSession
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & whole(F.col(vec_col))
    clean = rows.where(good).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled(F.col(vec_col), scale).alias("v")).distinct()
    clean = written(clean, "negatives-rows")
    n, n_anchors = clean.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    blobs = written(_blobs(clean), "negatives-blobs")
    groups = max(-(-n // GROUP), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    n_blocks = max(1, -(-n_anchors // anchors))
    asked = clean.where(is_anchor).withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_blocks)).cast("int"))
    asked = asked.withColumn("pos", F.row_number().over(W.partitionBy("block").orderBy("id", "label", "v")))
    asked = written(asked, "negatives-anchors")
    best = _grid(blobs, _packed_anchors(asked.withColumn("limits", F.array(F.lit(0).cast("long")))), groups, _alike, positives)
    best = _merged(best, positives)
    # no window where the limits cross, as they do for negative scores
    windows = best.select("block", "pos", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (-_hundredths(F.col("score"), -low)).alias("lower"), _hundredths(F.col("score"), high).alias("upper"))
    windows = written(windows.where("lower <= upper"), "negatives-windows")  # at most ``positives`` an anchor
    uppers = F.sort_array(F.collect_list("upper"), asc=False)
    limits = windows.groupBy("block", "pos").agg(F.min("lower").alias("least"), uppers.alias("uppers"))
    padded = F.concat(F.array("least"), "uppers", F.array_repeat(F.element_at("uppers", -1), F.lit(positives) - F.size("uppers")))
    limited = asked.join(limits.select("block", "pos", padded.alias("limits")), ["block", "pos"])
    slots = _merged(_grid(blobs, _packed_anchors(limited), groups, _by_slot, k), k)
    # the descending merge of an anchor's slots: at most ``positives * k`` rows
    lists = slots.groupBy("block", "pos").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("found"))
    reach = F.slice(F.filter("found", lambda x: -x["down"] <= F.col("upper")), 1, k)
    answers = windows.join(lists, ["block", "pos"]).withColumn("found", F.filter(reach, lambda x: -x["down"] >= F.col("lower")))
    named = answers.join(asked.select("block", "pos", F.col("id").alias("anchor_id")), ["block", "pos"])
    return named.select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("at", "x")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.down")).alias("negative_score")
    )


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose id is divisible by ``every`` carry the next label."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


@query(
    "op13_slot_negatives",
    f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT alike AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= {K}
""",
)
def op13_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)
