"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import simhash


def fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=4):
    """(id, fp) -> smallest id reached."""
    fp = np.array([f for _, f in rows], np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        if k is not None:
            groups[r] = min(groups.get(r, k), k)
    return sorted([(k, f, groups.get(find(i))) for i, (k, f) in enumerate(rows)], key=str)


def test_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    got = sorted([(r.id, r.fps[0] % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == brute_components(rows)


def test_edges(spark):
    rows = [(5, None), (2, ""), (9, " \t"), (1, "One"), (7, "one"), (8, "a b c"), (8, "a b c"), (None, "a b c"), (None, "zz"), (4, "x " * 70000), (3, "ÄÖ  x\x1fy")]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, rep int")
    got = sorted([(r.id, r.fps[0] % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == brute_components([(a, fingerprint(b)) for a, b in rows])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_cells_lose_no_link(spark):
    """A tight cluster, chains and random fingerprints, with shards cut into many cells."""
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)}
    centre = r.getrandbits(64)
    for _ in range(400):
        f = centre
        for b in r.sample(range(64), r.randint(0, 5)):
            f ^= 1 << b
        fps.add(f)
    at = r.getrandbits(64)
    for i in range(0, 60, 3):  # a chain of steps of three bits
        at ^= 0b111 << i
        fps.add(at)
    rows = list(enumerate(sorted(fps)))
    prints = spark.createDataFrame([(i, [f - (1 << 64) if f >> 63 else f]) for i, f in rows], "rep long, fps array<long>")
    from gleanery.llm.components import components

    root = {x.node: x.root for x in components(simhash.links(prints, cell=16)).collect()}
    assert [(i, f, root.get(i, i)) for i, f in rows] == sorted(brute_components(rows))


def test_keep_one(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(12)]
    rows, want = [], set()
    for g, text in enumerate(base):
        want.add(10 * g)
        rows.append((10 * g, text))
        for k in range(1, 4):  # one word changed: similar by over 0.9
            ws = text.split()
            ws[r.randrange(120)] = "new"
            rows.append((10 * g + k, " ".join(ws)))
    rows += [(0, base[0]), (200, None), (201, ""), (202, " "), (None, base[1]), (None, base[1]), (203, "short one"), (204, "Short One")]
    docs = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, id int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [x.doc_id for x in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want | {200, 203}) and got.count(None) == 2


def shingles(text, k=5):
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute_keep(rows, bound=0.8):
    """Smallest ids of the groups closed under shingle similarity."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a == b or len(a & b) >= bound * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i, _ in rows})


def test_keep_one_is_exact(spark, monkeypatch):
    """Pairs on both sides of 0.8, of texts of all lengths, some groups larger than a cell."""
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for size in (8, 9, 12, 20, 24, 30, 60, 150, 400):
        for share in (0.02, 0.05, 0.09, 0.1, 0.11, 0.13, 0.18, 0.25):
            base = [word() for _ in range(size)]
            rows.append(base)
            rows.append(base + [word() for _ in range(max(1, round(size * share)))])  # longer
            copy = list(base)
            at = r.randrange(size)
            copy[at : at + max(1, round(size * share))] = [word() for _ in range(max(1, round(size * share)))]
            rows.append(copy)
    base = [word() for _ in range(100)]
    for _ in range(40):  # a group around 0.8
        copy = list(base)
        for _ in range(r.randrange(1, 5)):
            copy[r.randrange(100)] = word()
        rows.append(copy)
    rows = [(i, " ".join(ws)) for i, ws in enumerate(rows)]
    want = brute_keep(rows)
    assert 0.4 * len(rows) < len(want) < 0.95 * len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == want
    monkeypatch.setattr(simhash, "CELL", 7)
    monkeypatch.setattr(simhash, "VOLUME", 500)
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == want


def test_keep_one_goes_through_fingerprints(spark, monkeypatch):
    """Short texts just above the bound are found by fingerprints, and without links of these nothing is folded."""
    r = random.Random(6)
    rows = []
    for size in (8, 12, 16, 20, 24):  # words: one more word makes one shingle more
        for _ in range(30):
            base = [f"w{r.randrange(10**6)}" for _ in range(size)]
            rows += [base, [*base, f"w{r.randrange(10**6)}"]]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda: sorted(x.doc_id for x in simhash.keep_one(docs).collect())
    assert kept() == brute_keep(rows) == list(range(0, len(rows), 2))
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "links", lambda *a, **k: none)
    assert kept() == list(range(len(rows)))


def lost_pairs(wanted):
    """Pairs at 0.8 and more, of which the first eight fingerprints agree in no segment."""
    r, rows = random.Random(9), []
    cuts = [round(64 * i / 5) for i in range(6)]
    while len(rows) < 2 * wanted:
        pairs = []
        for _ in range(500):  # 44 words, the last four other ones: 36 of 44 shingles are shared
            head = [f"w{r.randrange(10**7)}" for _ in range(40)]
            pairs += [" ".join(head + [f"w{r.randrange(10**7)}" for _ in range(4)]) for _ in range(2)]
        fps = simhash._prints(*simhash.A.buffers(pa.array(pairs)), 5, 8).reshape(-1, 2, 8)
        apart = fps[:, 0] ^ fps[:, 1]
        meet = np.zeros(len(apart), bool)
        for lo, hi in zip(cuts, cuts[1:]):
            meet |= ((apart >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1)) == 0).any(1)
        for k in np.flatnonzero(~meet):
            rows += pairs[2 * k : 2 * k + 2]
    return list(enumerate(rows))


def test_keep_one_searches_again(spark):
    """What the first fingerprints miss is found by other ones."""
    rows = lost_pairs(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == brute_keep(rows) == [i for i, _ in rows if i % 2 == 0]


def test_exploded_fingerprints_are_not_sent_to_all_tasks(spark, tmp_path):
    """A small file of fingerprints becomes a hundred times as many rows; the planner judges by the file."""
    spark.range(2000).select(F.col("id").alias("rep"), F.array_repeat(F.col("id"), 24).alias("fps")).write.parquet(str(tmp_path / "prints"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "prints")), simhash.WIDE, sharded=24)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "BuildLeft" not in plan and "Inner" not in plan
