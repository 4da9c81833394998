"""The label model, the classifier, and held-out accuracy."""

import random

import numpy as np
import pytest

from gleanery.llm import toxicity as T
from gleanery.llm.base import QUERIES


def test_label_model_finds_rates_and_correlations():
    r = np.random.default_rng(1)
    n, lex = 6000, len(T.LEXICONS)
    y = r.random(n) < 0.2
    good = [np.where(y, r.random(n) < 0.6, r.random(n) < 0.02) for _ in range(3)]
    copy = [good[0] ^ (r.random(n) < 0.01) for _ in range(3)]  # voters that follow the first one
    noise = [r.random(n) < 0.1 for _ in range(lex)]
    votes = np.stack([*good, *copy, *noise], 1).astype(np.uint8)
    gold = np.where(r.random(n) < 0.3, y, -1)
    q, found = T.label_model(votes, gold, np.ones(n))
    assert np.abs(found["hit"][:3] - 0.6).max() < 0.08 and np.abs(found["false"][:3] - 0.02).max() < 0.03
    assert abs(found["prior"][0] - 0.2) < 0.03 and found["gold"][0] > 0.9
    assert found["share"][3] < 0.6 * found["share"][1] and found["share"][1] > 0.6
    assert ((q > 0.5) == y).mean() > 0.9


def corpus(spark, path, n=900, labels=True):
    r = random.Random(2)
    base = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        ws = [r.choice(base) for _ in range(r.randint(5, 80))]
        bad = i % 6 == 0
        if bad:
            ws.insert(r.randrange(len(ws)), r.choice(["idiot,", "Zzorq" + r.choice(base), "PATHETIC"]))
        rows.append((i, " ".join(ws), "en"))
        marks.append((i, 1, int(bad)))
    rows += [(n, None, None), (n + 1, "", None), (None, "idiot", None), (0, rows[0][1], "en"), (n + 2, "word " * 50_000, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks if labels else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, {k: t for k, _, t in marks}


def test_held_out_accuracy(spark, tmp_path):
    rows, truth = corpus(spark, str(tmp_path))
    got = QUERIES["op1_toxicity_scores"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    import zlib

    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 100 and all(x.held_out == (zlib.crc32(str(x.doc_id if x.doc_id is not None else "").encode()) % 4 == 2) for x in got)
    assert sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    by = {x.doc_id: x.predicted for x in got}
    assert by[900] == by[901] == by[902] == 0 and by[None] == 1


@pytest.mark.parametrize("kind", ["no labels", "no documents"])
def test_little_to_learn_from(spark, tmp_path, kind):
    corpus(spark, str(tmp_path), 60, labels=kind != "no labels")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    if kind == "no documents":
        docs = docs.where("false")
        assert T.keep_clean(docs, labels).collect() == []
    else:
        kept = T.keep_clean(docs, labels)
        assert kept.columns == docs.columns
        texts = [x.text or "" for x in kept.collect()]
        assert not any("idiot" in t for t in texts) and len(texts) > 40


def test_held_out_labels_are_not_read(spark, tmp_path):
    corpus(spark, str(tmp_path), 300)
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(T.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    (m1, c1), (m2, c2) = T.fit(docs, labels), T.fit(docs, flipped)
    assert m1 == m2 and np.allclose(c1, c2)
