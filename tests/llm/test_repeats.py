"""Repeated words and bytes against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm.debruijn import remove_repeated_words
from gleanery.llm.suffixes import remove_repeated_bytes


def brute_bytes(rows, w):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(b[i : i + w]) for b in data for i in range(len(b) - w + 1))
    out = []
    for (key, _), b in zip(rows, data):
        gone = [False] * len(b)
        for i in range(len(b) - w + 1):
            if seen[hash(b[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, w):
    words = [(t or "").encode().split() for _, t in rows]
    order = [float("inf") if k is None else k for k, _ in rows]
    first = {}
    for key, ws in zip(order, words):
        for i in range(len(ws) - w + 1):
            s = tuple(ws[i : i + w])
            first[s] = min(first.get(s, key), key)
    out = []
    for (key, _), rank, ws in zip(rows, order, words):
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i : i + w])] < rank:
                gone[i : i + w] = [True] * w
        out.append((key, len(ws), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(ws, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=60):
    r = random.Random(seed)
    passage = " ".join(r.choice("aé bcd e") * r.randint(1, 3) for _ in range(40))
    rows = []
    for i in range(n):
        t = " ".join(r.choice(["ab", "c", "d\t", "ñandú", "x\n"]) for _ in range(r.randint(0, 60)))
        if i % 3 == 0:
            t += passage[r.randint(0, 20) :] + t
        rows.append((i, t))
    rows += [(3, rows[3][1]), (None, rows[6][1]), (n, None), (n + 1, ""), (n + 2, "a" * 700), (n + 3, "a" * 300 + "b" + "a" * 320), (n + 4, rows[9][1]), (n + 5, "q " * 500)]
    return rows


@pytest.mark.parametrize("seed,window,gram,block", [(1, 20, 6, 4), (2, 33, 8, 16), (3, 7, 7, 3)])
def test_bytes(spark, seed, window, gram, block):
    rows = made(seed)
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, _n string")
    got = remove_repeated_bytes(docs, window=window, gram=gram, block=block, keep_text=False).collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, window)


@pytest.mark.parametrize("seed,window,gram", [(4, 5, 2), (5, 9, 4), (6, 3, 3)])
def test_words(spark, seed, window, gram):
    rows = made(seed)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, _key int")
    got = remove_repeated_words(docs, window=window, gram=gram, keep_text=False).collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows, window)


def test_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 400)
    assert any(r.n_removed for r in got)


def test_long_text(spark, monkeypatch):
    from gleanery.llm import arrays

    monkeypatch.setattr(arrays, "SEGMENT", 64)  # segments of a long text, in the driver's process
    rows = made(7)
    import numpy as np
    import pyarrow as pa

    data, offsets = arrays.buffers(pa.array([t for _, t in rows]))
    values, before = arrays.word_values(data, offsets, arrays.unspaced_table())
    assert np.diff(before).tolist() == [len((t or "").encode().split()) for _, t in rows]
    words = [w for _, t in rows for w in (t or "").encode().split()]
    assert len(set(words)) == len({(w, int(v)) for w, v in zip(words, values)}) == len(set(values.tolist()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(docs).collect() == [] and remove_repeated_words(docs).collect() == []


def test_what_is_left_keeps_its_white_space(spark):
    from gleanery.llm.suffixes import without_repeats

    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "\n one\ttwo  " + shared + "\n\nthree ", 0), (2, shared.replace(" ", "\n"), 5), (3, "  left\n as  it was\t", 0), (4, None, None), (5, "é x " + shared + " end", 1)]
    got = {r.doc_id: (r.text, r.n_chars) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: ("\n one\ttwo  three ", 17), 2: ("", 0), 3: ("  left\n as  it was\t", 19), 4: (None, None), 5: ("é x end", 7)}


def test_equal_rows(spark):
    """Many rows of one id, or of none, with one text: worked on once, counted as often as they occur."""
    r = random.Random(9)
    base = " ".join(f"w{r.randrange(40)}" for _ in range(30))
    rows = [(5, base)] * 150 + [(None, base + " tail of it")] * 150 + [(5, "x " + base)] * 2 + [(7, base[10:]), (3, "q r s t u v w"), (9, None), (9, None)]
    docs = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, _copies int")
    got = remove_repeated_bytes(docs, window=12, gram=4, block=4, keep_text=False).collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 12)
    got = remove_repeated_words(docs, window=5, gram=2, keep_text=False).collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows, 5)


def test_very_many_equal_rows(spark):
    text = " ".join(f"w{i * i % 977}" for i in range(900))
    docs = spark.range(20000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(2, text[:2500])], "doc_id long, text string"))
    got = remove_repeated_bytes(docs).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, len(text), len(text), 20000), (2, 2500, 2500, 1)]
    got = remove_repeated_words(docs, keep_text=False).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 0, 20000), (2, len(text[:2500].split()) - 1, 1)]
