"""Hard negatives against brute force, with ties, copies, overlapping windows and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import negatives


def brute(rows, positives=5, k=10, scale=256, low=30, high=90):
    good = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(float(np.float32(x)) * scale) for x in v)))
    out = []
    for a, own, av in good:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, label == own) for i, label, v in good if i != a and len(v) == len(av))
        for p, who, _ in [x for x in scored if x[2]][:positives]:
            inside = [x for x in scored if not x[2] and -low * p <= -100 * x[0] <= -high * p][:k]
            out += [(a, who, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, block int, pos int")


def mined(df, **how):
    return sorted(map(tuple, negatives.hard_negatives(negatives.relabelled(df), F.col("id") % 100 == 0, **how).collect()))


def rows_of(seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, 8)) + 0.4
    rows = [(int(i), [float(x) for x in centres[i % 4] + r.normal(size=8) * 0.3], int(r.integers(0, 4))) for i in range(900)]
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(200)]  # a common vector: every tie there is
    rows += [(2000 + i, [round(float(x)) / 4 for x in r.normal(size=8)], i % 5) for i in range(200)]
    rows += [rows[0], (0, rows[9][1], 2), (3000, None, 1), (3100, [1.0, None] + [0.0] * 6, 1), (3200, [float("nan")] * 8, 1), (3300, [float("-inf")] * 8, 1), (3400, rows[3][1], None), (None, rows[7][1], 1)]
    rows += [(4000 + 100 * i, [0.5 * i, -1.0], i % 2) for i in range(8)] + [(5000, [], 1), (5001, [], 1), (5002, [], 2), (6000, [0.0] * 8, 3), (-100, rows[4][1], 2), (-700, rows[8][1], 3)]
    return rows


@pytest.mark.parametrize("anchors,cell", [(4096, 1 << 20), (3, 500)])
def test_against_brute_force(spark, monkeypatch, anchors, cell):
    monkeypatch.setattr(negatives, "CELL", cell)
    monkeypatch.setattr(negatives, "BLOB", 8 * 8 * 37)
    rows = rows_of(anchors)
    want = brute(rows)
    assert len(want) > 500
    assert mined(frame(spark, rows), anchors=anchors) == want


def test_parameters(spark):
    rows = rows_of(5)[:400]
    got = mined(frame(spark, rows), positives=3, k=2, low=50, high=120, scale=16)
    assert got == brute(rows, 3, 2, 16, 50, 120)


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert mined(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_large_components_and_empty(spark):
    big = [(i, [float(2**22 + i), float(-(2**22) * (i % 3))], i % 2) for i in range(300)]
    assert mined(frame(spark, big)) == brute(big)
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(100, [1.0], 1)])) == []


def test_slot_lists_are_short():
    """A task hands on at most k rows of an anchor's slot, whatever the ties."""
    s = np.zeros((3, 1000), np.int64)
    i, j = negatives._best_of_cell(s, 10)
    keep = negatives._firsts(i, np.zeros(len(i), np.int64), j, s[i, j], 10)
    assert len(keep) == 30 and sorted(set(j[keep])) == list(range(10))
