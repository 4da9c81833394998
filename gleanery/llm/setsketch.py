"""Near duplicates by SetSketch registers: banded, estimated by likelihood, verified on full sets.

A document's set holds its distinct word shingles. For each of REGISTERS registers
an element has an exponentially distributed value; a register keeps the least one
of the set, as ``floor(1 - log_b(value))`` cut off to 16 bits. Sketches of a union are the
larger registers of both, and registers of two sets are equal about as often as
their elements are (Ertl, "SetSketch", 2021).

An element's values come from one Poisson process whose points fall on random
registers: the first point on a register is its value. Points come in ascending
order, so an element is done as soon as its next point lies beyond the largest
least value of its set; long texts take few points an element.

1. Equal sets are folded. Registers are cut into BANDS bands of ROWS; sets that
   agree in all registers of a band share a bucket. At similarity 0.85 four equal
   registers have a chance of 0.52, so 28 bands all differ for 1 pair in 10**9.
2. In each bucket all sets are compared with one of them. A pair is estimated
   first: with known set sizes, the registers where one is larger, smaller or equal
   give the likelihood of each similarity. A pair is dropped only if the asked
   similarity is e**DOUBT times less likely than the best one (again about 1 in
   10**9 of true links). The rest is verified on the full sets; links are what is verified.
3. Buckets whose sets are not all linked by now are searched again: sets outside the
   bucket's largest component (left) meet all its sets, in cells of bounded size and
   volume. On registers first: a cell names the sets that may link at all. Then on
   the full sets of those, which are compared inside the cell; it hands on which components
   its links connect.

No bucket is held by one task, no pair is left out, and no pairs are written but
those with one set of a bucket and links of a forest. Work inside cells grows with the
square of a bucket only as far as its sets are alike but not linked.

Defined results: without words or text the set is empty and links with nothing;
texts of fewer words than a shingle are one shingle; rows without an id get no
component and are kept; rows of one id with different texts stand for one document and
share a component if either of them links; repeated rows stay; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import arrays as A
from gleanery.llm.base import query, small_batches, table
from gleanery.llm.components import components
from gleanery.llm.simhash import _roots, _sets, _shingles
from gleanery.session import written

SHINGLE, SIMILAR = 5, (85, 100)
BANDS, ROWS = 28, 4
REGISTERS = BANDS * ROWS
#: Base of the registers, rate of the values, largest register.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Log likelihood ratio from which on a pair is surely apart; most sets, and most shingles, of one part of a bucket.
DOUBT, CELL, VOLUME = 18.0, 1000, 1_000_000


def registers(sizes: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """Registers of sets with ``sizes`` distinct 64-bit ``elements``; zeros for empty sets."""
    n = len(sizes)
    least = np.full((n, REGISTERS), np.inf)
    flat = least.ravel()
    owner = np.repeat(np.arange(n), sizes)
    own, at, level = elements, np.zeros(len(elements)), 0
    while len(own):
        step = int(min(64, max(2, (1 << 17) // len(own))))
        levels = A.mix(np.arange(level + 1, level + step + 1, dtype=A.U))
        x = A.mix(own[:, None] ^ levels[None, :])
        # 44 bits for the gap to the next point, 20 for the register it falls on
        gaps = -np.log(((x >> A.U(20)).astype(np.float64) + 0.5) * 2.0**-44) / (RATE * REGISTERS)
        points = np.cumsum(gaps, axis=1)
        points += at[:, None]
        where = ((x & A.U((1 << 20) - 1)) * A.U(REGISTERS) >> A.U(20)).astype(np.int64) + owner[:, None] * REGISTERS
        np.minimum.at(flat, where.ravel(), points.ravel())
        on = points[:, -1] < least.max(1)[owner]
        own, at, owner, level = own[on], points[on, -1], owner[on], level + step
    out = np.zeros((n, REGISTERS), np.uint16)
    full = sizes > 0
    out[full] = np.clip(np.floor(1 - np.log(least[full]) / math.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _larger(share: np.ndarray) -> np.ndarray:
    """Chance that a register is larger on the side with that share of unshared elements."""
    return -np.log1p(-np.clip(share, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def may_link(na: np.ndarray, nb: np.ndarray, above: np.ndarray, below: np.ndarray, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Pairs that can reach the similarity: by their sizes, and by the likelihood of their registers (``above``: larger on the first side)."""
    out = np.minimum(na, nb) * similar[1] >= np.maximum(na, nb) * similar[0]
    at = np.flatnonzero(out)
    u = na[at] / (na[at] + nb[at])
    up, down = above[at], below[at]

    def likelihood(j: float) -> np.ndarray:
        p, q = _larger(u - (1 - u) * j), _larger((1 - u) - u * j)
        tiny = 1e-9  # a register may differ once in a while where sets hardly differ
        return up * np.log(p + tiny) + down * np.log(q + tiny) + (REGISTERS - up - down) * np.log(np.maximum(1 - p - q, tiny))

    asked = similar[0] / similar[1]
    bar = likelihood(asked)
    for j in np.linspace(0, asked, 18)[:-1]:
        out[at] &= likelihood(float(j)) - bar <= DOUBT
    return out


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``id, node, n, regs`` of ``docs (id, text)``: the node is a digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.buffers(b.column(1))
            node, size = np.zeros(len(b), A.U), np.zeros(len(b), np.int64)
            regs = np.zeros((len(b), REGISTERS), np.uint16)
            for i, j, n, digests in _shingles(data, offsets, shingle):
                size[i:j], h = _sets(n, digests)
                node[i:j] = _names(size[i:j], h)
                regs[i:j] = registers(size[i:j], h)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node.view(np.int64)), pa.array(size), pa.array([r.tobytes() for r in regs.astype("<u2")], pa.binary())], ["id", "node", "n", "regs"])

    return docs.mapInArrow(run, "id long, node long, n long, regs binary")


def _names(sizes: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total = np.concatenate([np.zeros(1, A.U), np.cumsum(A.second(elements), dtype=A.U)])
    return A.mix(total[ends[1:]] - total[ends[:-1]] ^ A.mix(sizes.astype(A.U)))


def _full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, n, set`` of the ``wanted (node, rep)`` sets, read from the texts of the rows with those ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.buffers(b.column(1))
            for i, j, n, digests in _shingles(data, offsets, shingle):
                size, h = _sets(n, digests)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_names(size, h).view(np.int64)), pa.array(size), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["node", "n", "set"])

    texts = docs.join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "text")
    return texts.mapInArrow(run, "node long, n long, set array<long>").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _buckets(nodes: DataFrame) -> DataFrame:
    """``key, node, n`` for each band of ``nodes (node, n, regs)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = A.mix(np.arange(1, BANDS + 1, dtype=A.U))
        for b in batches:
            keys = A.mix(_matrix(b.column(2)).view("<u8") ^ salts[None, :])
            own = [pa.array(np.repeat(b.column(k).to_numpy(), BANDS)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *own], ["key", "node", "n"])

    return nodes.select("node", "n", "regs").mapInArrow(run, "key long, node long, n long")


def _matrix(regs: pa.Array) -> np.ndarray:
    """Registers of each row, one row of 16-bit values each."""
    return np.frombuffer(b"".join(regs.to_pylist()), "<u2").reshape(len(regs), REGISTERS)


def _estimated(pairs: DataFrame, nodes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """``pairs (a, b)`` that may link by their registers."""
    sides = [nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}")) for s in "ab"]
    sizes = F.least("na", "nb") * similar[1] >= F.greatest("na", "nb") * similar[0]
    both = pairs.join(sides[0], "a").join(sides[1], "b").where(sizes).select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                ra, rb = _matrix(b.column(4)), _matrix(b.column(5))
                ok = may_link(b.column(2).to_numpy(), b.column(3).to_numpy(), (ra > rb).sum(1), (ra < rb).sum(1), similar)
                yield b.select([0, 1]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """``pairs (a, b)`` whose full sets are as similar as asked."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_full_sets(docs, nodes.select("node", "rep").join(used, "node", "left_semi"), shingle), "full-sets")
    sides = [sets.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("set").alias(f"s{s}")) for s in "ab"]
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(sides[1], "b").join(sides[0], "a").where(both * similar[1] >= (F.col("na") + F.col("nb") - both) * similar[0]).select("a", "b")


def _by_cell(batches: Iterator[pa.RecordBatch], solve: Callable) -> Iterator[pa.RecordBatch]:
    """Call ``solve(rows, last column)`` for each cell; rows ``key, pair, left, node, root, n, ...`` come sorted by cell, and only the cell at hand is held."""
    held: list[tuple[np.ndarray, pa.Array]] = []

    def one() -> Iterator[pa.RecordBatch]:
        out = solve(np.concatenate([r for r, _ in held], 1), pa.concat_arrays([x for _, x in held]))
        if out is not None:
            yield out

    for batch in batches:
        if not len(batch):
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:6]])
        bounds = np.flatnonzero((np.diff(rows[:2]) != 0).any(0)) + 1
        for s, e in zip([0, *bounds.tolist()], [*bounds.tolist(), len(batch)]):
            if held and (held[0][0][:2, 0] != rows[:2, s]).any():
                yield from one()
                held = []
            held.append((rows[:, s:e], batch.column(6).slice(s, e - s)))
    if held:
        yield from one()


def _hopeful(rows: np.ndarray, regs: pa.Array, similar: tuple[int, int], least: np.ndarray) -> pa.RecordBatch | None:
    """The rows of a cell that may link to a set of another component by their registers."""
    r, left, root, n = _matrix(regs), np.flatnonzero(rows[2]), rows[4], rows[5]
    right = np.flatnonzero(rows[2] == 0)
    some = np.zeros(rows.shape[1], bool)
    of_right = np.ascontiguousarray(r[right])
    low = similar[0] / similar[1]

    def may(i: int, j: np.ndarray) -> np.ndarray:
        return j[may_link(np.full(len(j), n[i]), n[j], (r[i] > r[j]).sum(1), (r[i] < r[j]).sum(1), similar)] if len(j) else j

    for i in left.tolist():
        ratio = np.minimum(n[right], n[i]) / np.maximum(n[right], n[i])
        step = np.clip(((ratio - low) * (RATIOS / (1 - low))).astype(np.int64), 0, RATIOS - 1)
        near = (root[right] != root[i]) & (np.minimum(n[right], n[i]) * similar[1] >= np.maximum(n[right], n[i]) * similar[0])
        near = right[near & (np.count_nonzero(of_right == r[i], axis=1) >= least[step])]
        # what is not named yet is tried in full; of the rest one partner is enough
        found = may(i, near[~some[near]])
        some[found] = True
        named, at = near[some[near]], 0
        while not some[i] and not len(found) and at < len(named):
            found, at = may(i, named[at : at + 64]), at + 64
        some[i] |= len(found) > 0
    if not some.any():
        return None
    return pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:5, some]], ["key", "pair", "left", "node", "root"])


#: Steps of the ratio of two set sizes for which ``least_equal`` is worked out.
RATIOS = 16


def least_equal(similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Fewer equal registers than that never pass ``may_link``, whatever the signs of the others.

    One number for each step of the ratio of the set sizes, from the least that can be similar enough up to 1; two off to be safe.
    """
    low = similar[0] / similar[1]
    above, equal = np.meshgrid(np.arange(REGISTERS + 1), np.arange(REGISTERS + 1))
    fits = above + equal <= REGISTERS
    above, equal = above[fits], equal[fits]
    out = np.zeros(RATIOS, np.int64)
    for step in range(RATIOS):
        best = REGISTERS
        for ratio in low + (1 - low) * (step + np.linspace(0, 1, 5)) / RATIOS:
            few = np.full(len(above), np.ceil(ratio * 1_000_000))
            ok = may_link(few, np.full(len(above), 1_000_000.0), above, REGISTERS - equal - above, similar)
            best = min(best, int(equal[ok].min(initial=REGISTERS)))
        out[step] = max(0, best - 2)
    # neighbouring steps, so that rounding of a ratio cannot matter
    return np.minimum(out, np.minimum(np.append(out[1:], REGISTERS), np.append(REGISTERS, out[:-1])))


def _shared(number: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each left set shares with each right one; ``number`` lists the elements of all sets one after the other."""
    owner = np.repeat(np.arange(len(n)), n)
    place = np.full(len(n), -1)
    sides = []
    width = int(number.max(initial=-1)) + 1
    for own in (left, right):
        place[:] = -1
        place[own] = np.arange(len(own))
        held = place[owner] >= 0
        order = np.argsort(number[held], kind="stable")
        heads = np.concatenate([[0], np.cumsum(np.bincount(number[held], minlength=width))])
        sides.append((place[owner][held][order], heads))
    (a, a_heads), (b, b_heads) = sides
    a_wide, b_wide = np.diff(a_heads), np.diff(b_heads)
    both = np.zeros((len(left), len(right)), np.float32)
    pairs = a_wide * b_wide
    common = pairs * 64 >= len(left) * len(right)
    # elements that many sets hold: columns of a matrix product
    many = np.flatnonzero(common)
    for s in range(0, len(many), 1024):
        own = many[s : s + 1024]
        grids = []
        for rows, heads, wide, size in ((a, a_heads, a_wide, len(left)), (b, b_heads, b_wide, len(right))):
            grid = np.zeros((size, len(own)), np.float32)
            column = np.repeat(np.arange(len(own)), wide[own])
            at = np.arange(len(column)) + np.repeat(heads[own] - (np.cumsum(wide[own]) - wide[own]), wide[own])
            grid[rows[at], column] = 1
            grids.append(grid)
        both += grids[0] @ grids[1].T
    # the others: pair by pair, some millions at a time
    few = np.flatnonzero(~common & (pairs > 0))
    ends = np.cumsum(pairs[few])
    s = 0
    while s < len(few):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + (1 << 22))))
        own = few[s:e]
        column = np.repeat(own, pairs[own])
        nth = np.arange(len(column)) - np.repeat(np.cumsum(pairs[own]) - pairs[own], pairs[own])
        i, j = a[a_heads[column] + nth // b_wide[column]], b[b_heads[column] + nth % b_wide[column]]
        both += np.bincount(i * len(right) + j, minlength=both.size).reshape(both.shape)
        s = e
    return both


def _forest(rows: np.ndarray, sets: pa.Array, similar: tuple[int, int]) -> pa.RecordBatch | None:
    """Links between the components of a cell by its full sets, as many as connect them."""
    left, right, n = np.flatnonzero(rows[2]), np.flatnonzero(rows[2] == 0), rows[5]
    if not len(left) or not len(right):
        return None
    _, number = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    both = _shared(number, n, left, right).astype(np.int64)
    names, component = np.unique(rows[4], return_inverse=True)
    near = both * similar[1] >= similar[0] * (n[left][:, None] + n[right][None, :] - both)
    i, j = np.nonzero(near & (component[left][:, None] != component[right][None, :]))
    if not len(i):
        return None
    root = _roots(len(names), np.stack([component[left[i]], component[right[j]]], 1))
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["a", "b"])


def _rest(buckets: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """Links inside buckets whose sets are not all linked yet. ``roots (node, root)``."""
    rooted = written(buckets.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "rooted")
    per = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("v"))
    stats = per.groupBy("key").agg(F.max(F.struct("c", "root", "v")).alias("main"), F.sum("c").alias("c"), F.sum("v").alias("v"), F.count(F.lit(1)).alias("k"))
    parts = lambda c, v: F.ceil(F.greatest(c / CELL, v / VOLUME)).cast("int")
    # two sets have met already
    stats = stats.where("k > 1 AND c > 2").select(
        "key", F.col("main.root").alias("most"), parts(F.col("c"), F.col("v")).alias("rights"), parts(F.col("c") - F.col("main.c"), F.col("v") - F.col("main.v")).alias("lefts")
    )
    rows = rooted.join(stats, "key")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("long")
    to = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    # left part p meets right part q in cell (p, q); sets of the left stand on both sides
    right = rows.select("key", F.explode(to("lefts", lambda p: p.cast("long") * (1 << 31) + part("rights"))).alias("pair"), F.lit(0).alias("left"), "node", "root")
    left = rows.where("root != most").select("key", F.explode(to("rights", lambda q: part("lefts") * (1 << 31) + q.cast("long"))).alias("pair"), F.lit(1).alias("left"), "node", "root")
    cell = ["key", "pair", "left", "node", "root"]

    def in_cells(df: DataFrame, solve: Callable, kinds: str) -> DataFrame:
        ordered = df.repartition("key", "pair").sortWithinPartitions("key", "pair")
        return ordered.mapInArrow(lambda it: _by_cell(it, lambda r, x: solve(r, x, similar)), kinds)

    sent = left.unionByName(right).join(nodes.select("node", "n", "regs"), "node").select(*cell, "n", "regs")
    least = least_equal(similar)
    some = written(in_cells(sent, lambda r, x, how: _hopeful(r, x, how, least), "key long, pair long, left long, node long, root long"), "hopeful")
    used = some.select("node").distinct()
    sets = written(_full_sets(docs, nodes.select("node", "rep").join(used, "node", "left_semi"), shingle), "full-sets")
    return in_cells(some.join(sets, "node").select(*cell, "n", "set"), _forest, "a long, b long").distinct()


def _pointed(links: DataFrame, rounds: int = 3) -> DataFrame:
    """``node, root``: the smallest node within some links of each. Nodes with one root are linked, but not all linked ones have one root yet."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    for _ in range(rounds):
        now = written(now, "pointed")
        far = now.select(F.col("node").alias("b"), "root")
        now = both.join(far, "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))
    return written(now, "pointed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``id, n, component_id``: size of each row's shingle set, and the smallest id that links reach.

    ``similar`` is the least similarity of a link as a fraction; the bands are made for 0.85 and more.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = written(_sketches(texts, shingle), "sketches")
    nodes = own.where("id IS NOT NULL AND n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = written(nodes, "nodes")
    named = texts.where("id IS NOT NULL")

    keys = _buckets(nodes)
    full = keys.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "first")
    buckets = written(keys.join(full, "key"), "buckets")
    star = buckets.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    likely = written(_estimated(star, nodes, similar), "estimated")
    # rows of one id are one document
    held = own.where("id IS NOT NULL AND n > 0").select("id", "node")
    several = held.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    same = several.join(held, "id").where("a != node").select("a", F.col("node").alias("b")).distinct()
    links = written(_verified(likely, nodes, named, shingle, similar).unionByName(same), "links")
    roots = _pointed(links)
    links = links.unionByName(_rest(buckets.select("key", "node", "n"), roots, nodes, named, shingle, similar))
    roots = components(links).withColumnRenamed("root", "_root")
    rooted = nodes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("_root", "node").alias("root"))
    rooted = written(rooted, "rooted-nodes")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = written(rooted.join(least, "root").select("node", "component_id"), "classes")
    some = own.where("n > 0").join(classes, "node", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    return some.unionByName(own.where("n = 0").select("id", "n", F.col("id").alias("component_id")))


@query(
    "op11_setsketch_components",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
""",
)
def op11_setsketch_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
