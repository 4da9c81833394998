"""Registers, estimates and components against brute force."""

import random
import re

import numpy as np
import pytest

from gleanery.llm import arrays as A
from gleanery.llm import setsketch


def shingle_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()


def brute(rows):
    """Rows of one id are one document; rows without an id have no component."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not s or not sets[j]:
                continue
            both = len(s & sets[j])
            if rows[i][0] == rows[j][0] or 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), None if k is None else least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, node long, n long")
    return sorted(map(tuple, setsketch.near_duplicates(df).collect()), key=str)


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def edited(r, ws, times):
    out = list(ws)
    for _ in range(times):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def test_registers():
    r = np.random.default_rng(1)
    sets = [r.integers(0, 1 << 63, n, dtype=np.int64).astype(A.U) for n in (1, 2, 7, 60, 3000)]
    sizes = np.array([len(s) for s in sets])
    regs = setsketch.registers(sizes, np.concatenate(sets))
    for s, own in zip(sets, regs):
        # a set's registers do not depend on its neighbours or order, and those of a union are merged ones
        assert (setsketch.registers(np.array([len(s)]), s[::-1].copy())[0] == own).all()
        half = len(s) // 2
        if half:
            a, b = setsketch.registers(np.array([half, len(s) - half]), s)
            assert (setsketch.merged(a, b) == own).all()
    assert (setsketch.registers(np.array([0, 1]), sets[0])[0] == 0).all()


@pytest.mark.parametrize("size", [7, 60, 700])
def test_registers_are_equal_as_often_as_elements(size):
    r = np.random.default_rng(size)
    same, links = [], 0
    for _ in range(300):
        x = r.integers(0, 1 << 63, size * 2, dtype=np.int64).astype(A.U)
        shared = -(-size * 2 * 85 // 185)  # similarity 0.85 with two sets of one size
        a, b = x[:size], np.concatenate([x[:shared], x[size : 2 * size - shared]])
        ra, rb = setsketch.registers(np.array([size, size]), np.concatenate([a, b]))
        same.append((ra == rb).mean() - shared / (2 * size - shared))
        links += bool(setsketch.may_link(np.array([size]), np.array([size]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))[0])
    assert abs(np.mean(same)) < 0.01 and links == 300


def test_estimates_drop_what_is_apart():
    n = np.array([100, 100, 100])
    assert setsketch.may_link(n, n, np.array([30, 8, 0]), np.array([30, 8, 0])).tolist() == [False, True, True]
    assert setsketch.may_link(np.array([100]), np.array([84]), np.array([0]), np.array([0])).tolist() == [False]


def test_fewest_equal_registers():
    """The quick bound never drops what the estimate keeps."""
    least = setsketch.least_equal()
    assert 40 < least[0] < least[-1] < 85
    r = np.random.default_rng(2)
    nb = r.integers(1, 3000, 20000)
    na = np.ceil(nb * r.uniform(0.85, 1, 20000)).astype(int)
    step = np.clip(((na / nb - 0.85) * (setsketch.RATIOS / 0.15)).astype(int), 0, setsketch.RATIOS - 1)
    equal = (r.random(20000) * least[step]).astype(int)
    up = (r.random(20000) * (setsketch.REGISTERS - equal + 1)).astype(int)
    for up in (up, np.zeros_like(up), setsketch.REGISTERS - equal, (setsketch.REGISTERS - equal) // 2):
        down = setsketch.REGISTERS - equal - up
        assert not setsketch.may_link(na, nb, up, down).any() and not setsketch.may_link(nb, na, down, up).any()


def test_shared_elements():
    r = np.random.default_rng(5)
    sets = [r.choice(400, size=int(k), replace=False) if k % 2 else np.arange(int(k)) for k in r.integers(1, 200, 60)]
    n = np.array([len(s) for s in sets])
    left, right = np.arange(0, 40, 2), np.arange(1, 60)
    got = setsketch._shared(np.concatenate(sets), n, left, right)
    assert got.tolist() == [[len(set(sets[i].tolist()) & set(sets[j].tolist())) for j in right] for i in left]


def test_edges(spark):
    long = "x y " * 40000
    rows = [(5, None), (2, ""), (9, " \t"), (1, "One"), (7, "one"), (8, "a b c"), (8, "a b c"), (None, "a b c"), (None, "zz"), (4, long), (6, long + "z"), (3, "ÄÖ  x\x1fy"), (11, "a b c d e f"), (11, "q r s t u v w"), (10, "q r s t u v w")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_given_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("cell,volume", [(1000, 1_000_000), (9, 3000)])
def test_groups_and_chains(spark, monkeypatch, cell, volume):
    """Copies around one text, chains, loose groups, and everything in small cells."""
    monkeypatch.setattr(setsketch, "CELL", cell)
    monkeypatch.setattr(setsketch, "VOLUME", volume)
    r = random.Random(cell)
    rows = []
    hub = words(r, 120)
    rows += [(300 + i, " ".join(edited(r, hub, 1))) for i in range(60)] + [(299, " ".join(hub))]  # the copies differ from each other by more
    worn = words(r, 120)  # as many edits as there are copies of one kind: linked, alike and apart
    rows += [(400 + i, " ".join(edited(r, worn, i // 6))) for i in range(60)]
    loose = words(r, 100)
    rows += [(500 + i, " ".join(edited(r, loose, 2))) for i in range(40)]  # about the bound
    chain = words(r, 150)
    for i in range(40):
        chain = edited(r, chain, 1)
        rows.append((700 - i, " ".join(chain)))
    for size in (5, 6, 7, 8, 9, 20):
        base = words(r, size + 4)
        rows += [(800 + size * 10, " ".join(base)), (801 + size * 10, " ".join(base[1:])), (802 + size * 10, " ".join([*base, "more"]))]
    rows += [(1000 + i, " ".join(words(r, r.randrange(1, 60)))) for i in range(60)]
    assert found(spark, rows) == brute(rows)
