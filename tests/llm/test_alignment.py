"""Token alignment against a plain version written from the definition."""

import collections
import hashlib

import pytest
import sentencepiece
from tokenizers import Tokenizer

from gleanery.llm import alignment

TEXTS = [
    "Hello, world!", "Hello, world!", "hello   there\n\n\tyou ", "Straße in Köln — 東京 😀😀é", "", None, "a ▁ mark", "<|endoftext|> </s> <unk> <0x0A>", " ", "x" * 700, "=" * 333 + " " * 77,
    "naïve café 12345678 №", "Hello, world! Hello, world!", "\x00\x01 zero", "ⅷ²ｘ　y\u0085z", "Hello, world!", "don't I'll we've",
]


def brute(rows):
    a_tok = Tokenizer.from_file(alignment.BYTES_MODEL)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
    symbols = alignment.byte_symbols()
    done = []
    for i, text in rows:
        groups = []
        if text:
            want = (" " + text).encode()
            ids_a = a_tok.encode(" " + text, add_special_tokens=False).ids
            ids_b = b_tok.encode(text)
            bytes_a = [bytes(symbols[c] for c in a_tok.id_to_token(x)) for x in ids_a]
            pieces = [b_tok.id_to_piece(x) for x in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(ids_b, pieces)]
            if b"".join(bytes_a) == want == b"".join(bytes_b):
                ends = []
                for parts in (bytes_a, bytes_b):
                    at, own = 0, []
                    for p in parts:
                        at += len(p)
                        own.append(at)
                    ends.append(own)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                low = 0
                for c in cuts:
                    groups.append(([x for x, e in zip(ids_a, ends[0]) if low < e <= c], [x for x, e in zip(ids_b, ends[1]) if low < e <= c]))
                    low = c
        done.append((i, groups))
    held = collections.Counter()
    for _, groups in done:
        held.update({(x, y) for g, h in groups for x in g for y in h})
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups in done:
        links = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def aligned(df, **how):
    got = alignment.align(df, **how).select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("pairs,small", [(alignment.PAIRS, alignment.SMALL), (40, 1), (0, 4)])
def test_edges(spark, monkeypatch, pairs, small):
    monkeypatch.setattr(alignment, "SMALL", small)
    rows = [*enumerate(TEXTS), (None, TEXTS[0]), (3, TEXTS[3]), (3, TEXTS[3])]
    df = spark.createDataFrame([(i, t, "k", 1, [2]) for i, t in rows], "doc_id long, text string, key string, copies int, links array<int>")
    assert aligned(df, pairs=pairs) == brute(rows)


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert aligned(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_empty(spark):
    assert aligned(spark.createDataFrame([], "doc_id long, text string")) == []
    assert aligned(spark.createDataFrame([(1, None)], "doc_id long, text string")) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_both_ways_to_the_same_ids():
    with open(alignment.BYTES_MODEL, "rb") as f, open(alignment.PIECE_MODEL, "rb") as g:
        data = f.read()
        sides = alignment.Sides(data, g.read())
    texts = [t for t in TEXTS if t] + ["ab" * 5000, "\t \n" * 3000, "<|endoftext|>" * 3]
    assert sides._library(data)(texts) == sides.encode_a(texts)
