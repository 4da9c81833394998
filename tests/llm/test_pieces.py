"""Ids against the sentencepiece library, merging from scratch, and round trips."""

import random

import pytest
import sentencepiece

from gleanery.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def fst():
    return pieces.Transducer(pieces.Model(pieces.MODEL))


def ids(fst, text):
    import numpy as np

    return np.frombuffer(fst.encode(text), "<i4").tolist()


def test_odd_texts(library, fst):
    for t in ["", " ", "  a", "a  ", "a\n\nb", "\n", "日本語 テキスト", "🙂🙂 ok", "aaaa aaaaa", "x" * 3000, " " * 37, "tab\tand\x00nul", "naïve ÇA ñ", "a▁b", "#include <x>\n    return 0;\n"]:
        assert ids(fst, t) == library.encode(t), t
        if pieces.MARK not in t:
            assert fst.decode(fst.encode(t)) == t


def test_random_texts(library, fst):
    r = random.Random(1)
    for _ in range(1500):
        t = "".join(r.choice("abcdeoinrst  .,'-éß0\n中") for _ in range(r.randint(1, 60)))
        assert ids(fst, t) == library.encode(t), t
        assert fst.decode(fst.encode(t)) == t


def test_given_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in pieces.encode(docs).collect():
        assert r.ids == library.encode(r.text)
        assert r.decoded == r.text


def test_shortest_path_of_a_unigram_model(fst):
    """Against all segmentations of short strings."""
    model = pieces.Model(pieces.MODEL)
    model.merges = False
    r = random.Random(2)
    model.pieces = {p: (i, -r.random() * 5) for i, p in enumerate(["a", "b", "ab", "ba", "aab", "abb", "bb"])}
    uni = pieces.Transducer(model)

    def best(s):
        if not s:
            return 0.0
        return min([-model.pieces[s[:k]][1] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in model.pieces], default=float("inf"))

    for _ in range(200):
        s = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
        assert abs(sum(-uni.score[t] for t in uni._unigram_path(s)) - best(s)) < 1e-9


def test_rows(spark, library):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "hi", 7), (2, "hi", 7)], "doc_id long, text string, n_ids int")
    got = pieces.encode(docs, decode=False).collect()
    assert sorted(((r.doc_id, r.text, r.n_ids, r.ids) for r in got), key=str) == sorted(
        [(1, None, 5, []), (None, "", 6, []), (2, "hi", 7, library.encode("hi")), (2, "hi", 7, library.encode("hi"))], key=str
    )
    assert pieces.encode(docs.where("false")).collect() == []
