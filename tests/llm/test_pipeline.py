"""Every stage on planted documents, against what it must keep."""

import random

import pytest
import sentencepiece

import corpus_pipeline as cp
from gleanery.llm import pieces


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    r = random.Random(11)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    text = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows, labels, kinds = [], [], {}
    insults = ["idiot", "loser", "qqxar", "qqxum"]
    for i in range(240):
        t = text(r.randint(20, 150))
        kind = "clean"
        if i % 8 == 0:
            ws = t.split()
            for _ in range(3):
                ws[r.randrange(len(ws))] = r.choice(insults)
            t, kind = " ".join(ws), "toxic"
        rows.append((i, t, "en", "s", len(t)))
        kinds[i] = kind
        labels.append((i, 1, int(kind == "toxic")))
    base = [row for row in rows if kinds[row[0]] == "clean" and len(row[1].split()) > 60]
    passage = text(54)
    items = [(k, text(30)) for k in range(5)]
    for n, row in enumerate(base[:10]):
        rows.append((300 + n, row[1], "en", "s", row[4]))
        kinds[300 + n] = "copy"
        ws = row[1].split()
        ws[len(ws) // 2] = "changed"
        rows.append((320 + n, " ".join(ws), "en", "s", 0))
        kinds[320 + n] = "near"
        rows.append((340 + n, text(40) + " " + passage + " " + text(40), "en", "s", 0))
        kinds[340 + n] = "passage"
        rows.append((360 + n, text(50) + " " + items[n % 5][1].upper() + " " + text(50), "en", "s", 0))
        kinds[360 + n] = "leak"
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (None, text(30), "en", "s", 1)]
    sf = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, rows, kinds, passage, items


def test_stages(spark, corpus, tmp_path):
    sf, rows, kinds, passage, items = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        assert k == len(cp.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[k] = {x.doc_id: x for x in docs.collect()}
    ids = [set(seen[k]) - {None, 400, 401} for k in range(5)]
    by = lambda kind: {i for i, x in kinds.items() if x == kind}
    assert not ids[0] & by("toxic") and by("clean") <= ids[0]
    assert not ids[1] & (by("copy") | by("near")) and by("clean") | by("passage") | by("leak") <= ids[1]
    assert ids[2] == ids[1]
    for i in by("passage"):
        left = seen[2][i].text
        assert passage[30:-30] not in left and len(left) > 100 and seen[2][i].n_chars == len(left)
    for i in by("clean"):
        assert seen[2][i].text == next(t for k, t, *_ in rows if k == i)
    assert not ids[3] & by("leak") and by("clean") | by("passage") <= ids[3]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert set(seen[4]) == set(seen[3])
    for i, x in seen[4].items():
        assert x.ids == library.encode(seen[3][i].text or "") and x.round_trip
    assert {None, 400, 401} & set(seen[4]) >= {None}


def test_run(spark, corpus):
    got = cp.run(spark, corpus[0])
    assert got.count() > 200 and "ids" in got.columns


def test_empty(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, corpus[0])
        assert docs.count() == 0, name
