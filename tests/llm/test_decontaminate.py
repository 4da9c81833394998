"""Both ways to find test windows, against brute force."""

import hashlib
import random
import re

import pytest

from gleanery.llm.arrays import SEGMENT
from gleanery.llm.decontaminate import clean_documents, clean_spans, scan


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, n):
    tests = {}
    for item, t in items:
        ws = words(t)
        k = min(n, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            tests.setdefault(tuple(ws[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for key, t in rows:
        ws = words(t)
        hit, found = set(), set()
        for g, names in tests.items():
            for i in range(len(ws) - len(g) + 1):
                if tuple(ws[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= names
        out.append((key, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_against_brute_force(spark, limit):
    r = random.Random(5)
    pool = ["Aa", "bb", "é1", "Dd", "e_f", "g-h"]
    items = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 8)))) for i in range(12)] + [(3, None), (None, "zz top"), (10, "aa")]
    rows = [(i, ", ".join(r.choice(pool + ["x", "yy", "zz"]) for _ in range(r.randint(0, 40)))) for i in range(50)]
    rows += [(0, rows[0][1]), (99, None), (98, ""), (None, items[4][1]), (97, "ZZ  top!"), (96, "q " * 5000 + items[5][1])]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_words int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = scan(docs, tests, n=4, max_windows=limit)
    flat = got.select("rest.doc_id", got.n_words, "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute(rows, items, 4)
    assert sorted(map(tuple, flat), key=str) == want
    kept = clean_documents(docs, tests, n=4, max_windows=limit)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    left = clean_spans(docs, tests, n=4, max_windows=limit).collect()
    assert sorted(len(words(x.text)) for x in left) == sorted(w[1] - w[2] for w in want)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_long_mixed_case(spark, limit):
    """Several segments of words in capitals and mixed case, with items behind the cuts."""
    r = random.Random(6)
    pool = ["MIDDLE", "iPhone", "XMLHttpRequest", "Q2FtZWxDYXNl", "PLAIN"]
    items = [(i, " ".join("Zz" + r.choice(pool) + str(i) for _ in range(6))) for i in range(4)]
    text = ""
    for _, item in items:
        text += " ".join(r.choice(pool) for _ in range(300_000 // 8)) + " " + item + " "
    assert len(text) > 3 * SEGMENT
    rows = [(1, text), (2, text.upper()), (3, text.lower())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = scan(docs, spark.createDataFrame(items, "item_id long, text string"), n=4, max_windows=limit)
    flat = got.select("rest.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute(rows, items, 4)
    assert [w[2:4] for w in want] == [(24, 4)] * 3
    assert sorted(map(tuple, flat), key=str) == want


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_empty_tables(spark, limit):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    one = scan(docs, none, max_windows=limit).collect()
    assert [(x.n_words, x.n_hit, x.contaminated) for x in one] == [(3, 0, False)]
    assert scan(docs.where("false"), docs.withColumnRenamed("doc_id", "item_id"), max_windows=limit).collect() == []
