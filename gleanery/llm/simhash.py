"""SimHash near duplicates: exact pairs within a Hamming radius by vantage-point search.

Fingerprints have 64 bits. A bit is set if it is set in over half of the XXH64
digests (seed 42) of the text's word shingles.

Pairs: a full-width vantage-point tree cannot shard such fingerprints, since
distances to any vantage point gather around 32 and a ball of radius 4 overlaps
both sides of nearly every boundary. The 64 bits are therefore cut into radius + 1
segments, each with its own Hamming metric: two fingerprints within the radius
agree in at least one segment, so in that segment's metric the ball to query has
radius 0 and lies in the shard around its own vantage value. Each fingerprint is
sent to radius + 1 shards. Inside a shard, pairs are found on all 64 bits by
recursive vantage-point partition: distances to a vantage point give rings, a
pair within the radius lies in rings at most the radius apart, and all else is
pruned by that triangle bound.

A shard of more than ``cell`` fingerprints is dealt over cells, one for each pair
of its parts, so that no task holds a large shard and every pair still meets once.
Equal fingerprints are folded before, whatever number of documents has them.

Cells report a spanning forest of their links: enough for components, and no
group of near copies is expanded into all pairs.

Defined results: null and empty texts have no words and fingerprint zero, linked
like any other; texts shorter than a shingle are one shingle; a null id takes no
part in being the smallest unless all are null; repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.llm import arrays as A
from gleanery.llm.base import query, small_batches, table
from gleanery.llm.components import components
from gleanery.session import written

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Most fingerprints of one part of a shard.
CELL = 1000
#: Where one row of each group is kept: fingerprints searched together, radius in one of them and in all together, and how often other ones are searched.
COUNT, WIDE, TOTAL, BANKS = 8, 20, 120, 2
#: The similarity of near copies there, as a fraction.
SIMILAR = (4, 5)
#: Fewest and most shingles of a text that has MORE fingerprints instead of COUNT as well (with fewer, only equal sets are similar).
FEW, SHORT, MORE = 4, 20, 24
#: Most shingles of one part of a group.
VOLUME = 1_000_000


def _shingles(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first text, last text, shingles of each, their digests)`` by groups of texts; groups without words are left out."""
    wordy, fold = A.unspaced_table(), A.lower_table()
    for i, j in A.groups_of(offsets):
        # the words of each text, lower-cased, with one space between them: a shingle is a range of these bytes
        part = fold[data[offsets[i] : offsets[j]]]
        starts, ends, before = A.word_bounds(part, offsets[i : j + 1] - offsets[i], wordy)
        if not len(starts):
            continue
        sizes = ends - starts
        to = np.zeros(len(starts), np.int64)
        np.cumsum(sizes[:-1] + 1, out=to[1:])
        flat = np.full(int(to[-1] + sizes[-1]), 32, np.uint8)
        taken = wordy[part]
        flat[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(starts)), sizes)] = part[taken]
        counts = np.diff(before)
        lengths = np.minimum(counts, shingle)
        n = counts - lengths + (counts > 0)
        owner = np.repeat(np.arange(len(counts)), n)
        first = before[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        last = first + lengths[owner] - 1
        text, digest = flat.tobytes(), xxhash.xxh64_digest
        s, e = to[first].tolist(), (to[last] + sizes[last]).tolist()
        step = 1 << 16
        parts = [np.frombuffer(b"".join([digest(text[a:b], SEED) for a, b in zip(s[at : at + step], e[at : at + step])]), ">u8") for at in range(0, len(s), step)]
        yield i, j, n, np.concatenate(parts).astype(A.U)


def _prints(data: np.ndarray, offsets: np.ndarray, shingle: int, count: int = 1) -> np.ndarray:
    """Fingerprints of each text; those after the first have the digests mixed with a seed each."""
    out = np.zeros((len(offsets) - 1, count), A.U)
    for i, j, n, digests in _shingles(data, offsets, shingle):
        out[i:j] = _print_bits(n, digests, count)
    return out


def _print_bits(n: np.ndarray, digests: np.ndarray, count: int) -> np.ndarray:
    seeds = [A.U(x) for x in A.mix(np.arange(1, count, dtype=A.U))]
    owner = np.repeat(np.arange(len(n)), n)
    heads = np.concatenate([[0], np.cumsum(n)])
    ones = np.zeros((len(n), count, 64), np.int32)
    step = 1 << 16
    for at in range(0, len(digests), step):
        h = digests[at : at + step]
        lo, hi = owner[at], owner[min(at + step, len(digests)) - 1]
        cut = np.clip(heads[lo : hi + 1] - at, 0, None)
        full = np.flatnonzero(n[lo : hi + 1])
        for c in range(count):
            own = (h if c == 0 else A.mix(h ^ seeds[c - 1])).astype(">u8")
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1)
            ones[lo + full, c] += np.add.reduceat(bits, cut[full], axis=0, dtype=np.int32)
    over = ones * 2 > n[:, None, None]
    return np.packbits(over, axis=2).view(">u8")[:, :, 0]


def _sets(n: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles of each text, and these in ascending order, text by text."""
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((digests, owner))
    owner, h = owner[order], digests[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=len(n)), h[new]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, count: int = 1) -> DataFrame:
    """``id, fps``: ``count`` fingerprints, each with its bits in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _prints(*A.buffers(b.column(1)), shingle, count).view(np.int64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * count), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["id", "fps"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, "id long, fps array<long>")


def _brute(a: np.ndarray, b: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    step = max(1, (1 << 17) // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[b][None, :]) <= radius)
        yield np.stack([part[i], b[j]], 1)


def near(a: np.ndarray, b: np.ndarray, fp: np.ndarray, radius: int, depth: int = 0) -> Iterator[np.ndarray]:
    """Index pairs (x in a, y in b) within the radius, by vantage-point partition of both sides."""
    if len(a) * len(b) <= 1 << 14 or depth > 20:
        yield from _brute(a, b, fp, radius)
        return
    vantage = fp[a[len(a) // 2]]
    da, db = np.bitwise_count(fp[a] ^ vantage), np.bitwise_count(fp[b] ^ vantage)
    for ring in np.unique(da):
        inner = a[da == ring]
        reach = b[(db >= ring.astype(int) - radius) & (db <= ring.astype(int) + radius)]
        if len(inner) and len(reach):
            stuck = len(inner) == len(a) and len(reach) == len(b)
            yield from _brute(inner, reach, fp, radius) if stuck else near(inner, reach, fp, radius, depth + 1)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[pairs[:, 0]], low)
        np.minimum.at(new, label[pairs[:, 1]], low)
        np.minimum.at(new, pairs.ravel(), np.repeat(low, 2))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(cells: Iterator[pa.RecordBatch], radius: int, total: int, segments: int) -> Iterator[pa.RecordBatch]:
    """Links inside each cell; rows come sorted by cell, and only the cell at hand is held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def solve(rows: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        shard, pair, side, rep = rows
        edges = []
        bounds = np.flatnonzero(np.diff(shard).astype(bool) | np.diff(pair).astype(bool)) + 1
        for s, e in zip([0, *bounds.tolist()], [*bounds.tolist(), len(shard)]):
            if e - s < 2:
                continue
            all_bits, kind = fps[s:e], side[s:e]
            own = np.ascontiguousarray(all_bits[:, (int(shard[s]) >> 33) // segments])
            left, right = np.flatnonzero(kind <= 0), np.flatnonzero(kind != 0)
            if not len(right):  # one part against itself
                right = left
            root = np.arange(e - s)
            for p in near(left, right, own, radius):
                # pairs that are linked already add nothing, so a tight group costs little
                p = p[root[p[:, 0]] != root[p[:, 1]]]
                if len(p) and total < 64 * fps.shape[1]:
                    p = p[np.bitwise_count(all_bits[p[:, 0]] ^ all_bits[p[:, 1]]).sum(1, dtype=np.int32) <= total]
                if len(p):
                    root = _roots(e - s, root[p])[root]
            moved = np.flatnonzero(root != np.arange(e - s))
            if len(moved):
                edges.append(np.stack([rep[s:e][moved], rep[s:e][root[moved]]]))
        if edges:
            both = np.concatenate(edges, 1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])
        return None

    for b in cells:
        if not len(b):
            continue
        bits = b.column(4).flatten().to_numpy().view(A.U).reshape(len(b), -1)
        held.append((np.stack([c.to_numpy().astype(np.int64) for c in b.columns[:4]]), bits))
        rows, fps = (np.concatenate([x for x, _ in held], 1), np.concatenate([x for _, x in held])) if len(held) > 1 else held[0]
        # the last cell may go on in the next batch
        differs = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        last = int(differs[-1]) + 1 if len(differs) else 0
        if last:
            out = solve(rows[:, :last], fps[:last])
            if out is not None:
                yield out
        held = [(rows[:, last:], fps[last:])]
    if held:
        out = solve(*held[0])
        if out is not None:
            yield out


def _meets() -> Column:
    """Part p meets every part q in the cell of (p, q); side 0: the lower part, or both if p = q; 1: the higher one."""
    return F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(
            (F.least("part", q).cast("long") * (1 << 31) + F.greatest("part", q)).alias("pair"),
            F.when(F.col("part") <= q, 0).otherwise(1).alias("side"),
        ),
    )


def links(prints: DataFrame, radius: int = RADIUS, cell: int = CELL, segments: int = RADIUS + 1, sharded: int = 1, total: int = 1 << 30) -> DataFrame:
    """Links ``a, b`` between the nodes of ``prints (rep, fps)``: a spanning forest of each shard cell.

    Two nodes link if one of their first ``sharded`` fingerprints is within the
    radius, and all their bits together are within ``total``. With more segments
    than the radius no pair is missed; with fewer, pairs that agree in no segment are.
    """
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    keys = [
        F.struct(F.lit(no * segments + i).cast("long").alias("seg"), F.shiftrightunsigned(F.element_at("fps", no + 1), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("val"))
        for no in range(sharded)
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ]
    sent = prints.select("rep", "fps", F.explode(F.array(*keys)).alias("k")).select("rep", "fps", (F.col("k.seg") * (1 << 33) + F.col("k.val")).alias("shard"))
    # 2 ** (64 / segments) shards for each segment: 40,960 for five segments of one fingerprint; only those of several parts are looked up
    sizes = sent.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select("shard", F.ceil(F.col("n") / cell).cast("int").alias("_parts"))
    if segments >= 5 and sharded <= 8:
        sizes = F.broadcast(sizes)
    # from the left, so that what was exploded is never the side that is sent to all tasks
    dealt = sent.join(sizes, "shard", "left").withColumn("parts", F.coalesce("_parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("fps"), F.col("parts")).cast("int"))
    cells = dealt.select("shard", "rep", "fps", F.explode(_meets()).alias("m")).select("shard", "m.pair", F.col("m.side").cast("long").alias("side"), "rep", "fps")
    ordered = cells.repartition("shard", "pair").sortWithinPartitions("shard", "pair")
    return ordered.mapInArrow(lambda it: _linked(it, radius, total, segments), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, count: int = 1, **how: int) -> DataFrame:
    """``id, fps, component_id``: the smallest id that links reach. ``how`` is for ``links``."""
    own = written(fingerprints(docs, id_col, text_col, shingle, count), "fingerprints")
    prints = written(own.groupBy("fps").agg(F.min("id").alias("rep")), "prints")
    found = components(links(prints.where("rep IS NOT NULL"), **how))
    named = written(prints.join(found, F.col("rep") == F.col("node"), "left").select("fps", F.coalesce("root", "rep").alias("component_id")), "classes")
    return own.join(named, "fps").select("id", "fps", "component_id")


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """``id, fps, d1, d2, n`` of ``docs (id, text)``: fingerprints, a digest of the shingle set and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.buffers(b.column(1))
            fps = np.zeros((len(b), COUNT * BANKS), A.U)
            marks = np.zeros((2, len(b)), A.U)
            size = np.zeros(len(b), np.int64)
            for i, j, n, digests in _shingles(data, offsets, shingle):
                fps[i:j] = _print_bits(n, digests, COUNT * BANKS)
                size[i:j], h = _sets(n, digests)
                ends = np.concatenate([[0], np.cumsum(size[i:j])])
                for k, x in enumerate((A.mix(h), A.second(h))):
                    total = np.concatenate([np.zeros(1, A.U), np.cumsum(x, dtype=A.U)])
                    marks[k, i:j] = total[ends[1:]] - total[ends[:-1]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * COUNT * BANKS), pa.array(fps.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, *[pa.array(m.view(np.int64)) for m in marks], pa.array(size)], ["id", "fps", "d1", "d2", "n"])

    return docs.mapInArrow(run, "id long, fps array<long>, d1 long, d2 long, n long")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``rep, n, set`` of ``docs (rep, text)``: distinct shingle digests in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.buffers(b.column(1))
            for i, j, n, digests in _shingles(data, offsets, shingle):
                size, h = _sets(n, digests)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["rep", "n", "set"])

    return docs.mapInArrow(run, "rep long, n long, set array<long>")


def _alike(rep: np.ndarray, side: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Links of one cell, as root and member rows: a spanning forest of all pairs with a similarity of SIMILAR at least."""
    n = len(rep)
    _, number = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(number, kind="stable")
    holders = owner[order]
    heads = np.concatenate([[0], np.cumsum(np.bincount(number))])
    ends = np.concatenate([[0], np.cumsum(size)])
    root = np.arange(n)
    for i in np.flatnonzero(side == 0):
        apart = root != root[i]
        if not apart.any():
            continue
        own = number[ends[i] : ends[i + 1]]
        lo, wide = heads[own], heads[own + 1] - heads[own]
        at = np.arange(int(wide.sum())) + np.repeat(lo - (np.cumsum(wide) - wide), wide)
        both = np.bincount(holders[at], minlength=n)
        near = apart & (both * SIMILAR[1] >= SIMILAR[0] * (size + size[i] - both))
        if near.any():
            joined = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, joined)] = joined[0]
    moved = np.flatnonzero(root != np.arange(n))
    return np.stack([rep[root[moved]], rep[moved]])


def _confirmed(cells: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` inside each cell; rows ``key, pair, side, rep, n, set`` come sorted by cell."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def solve() -> pa.RecordBatch | None:
        rows = np.concatenate([r for r, _ in held], 1)
        if rows.shape[1] < 2:
            return None
        a, b = _alike(rows[3], rows[2], rows[4], np.concatenate([x for _, x in held]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

    for batch in cells:
        if not len(batch):
            continue
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:5]])
        flat = batch.column(5).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(rows[4])])
        bounds = np.flatnonzero((np.diff(rows[:2]) != 0).any(0)) + 1
        for s, e in zip([0, *bounds.tolist()], [*bounds.tolist(), len(batch)]):
            if held and (held[0][0][:2, 0] != rows[:2, s]).any():
                out = solve()
                if out is not None:
                    yield out
                held = []
            held.append((rows[:, s:e], flat[ends[s] : ends[e]]))
    if held:
        out = solve()
        if out is not None:
            yield out


def similar_links(docs: DataFrame, near: DataFrame, shingle: int) -> DataFrame:
    """Links ``a, b`` with exact shingle similarity SIMILAR at least.

    ``docs (rep, text)``. Compared are the members of each group of ``near (node,
    root)``. A group of more than CELL texts or VOLUME shingles is dealt over cells,
    one for each pair of its parts, so no task holds a large group and every pair
    of it meets.
    """
    wanted = docs.join(near.select(F.col("node").alias("rep")), "rep")
    sets = written(_shingle_sets(wanted.select("rep", "text"), shingle), "shingle-sets")
    sent = sets.join(near.select(F.col("node").alias("rep"), F.col("root").alias("key")), "rep").select("key", "rep", "n", "set")
    most = F.greatest(F.count(F.lit(1)) / CELL, F.sum("n") / VOLUME)
    sizes = sent.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.ceil(most).cast("int").alias("parts")).where("_rows > 1")
    dealt = sent.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("rep", "set"), F.col("parts")).cast("int"))
    cells = dealt.select("key", F.explode(_meets()).alias("m"), "rep", "n", "set").select("key", "m.pair", F.col("m.side").cast("long").alias("side"), "rep", "n", "set")
    ordered = cells.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return ordered.mapInArrow(_confirmed, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id.

    Near copies have word-shingle sets with a similarity (shared over all) of
    SIMILAR at least, and groups are closed under that. SimHash finds candidates:
    texts whose COUNT fingerprints differ in at most TOTAL of all their bits, of
    which pairs at similarity 0.8 differ in about 76; they meet where they agree in
    one of the segments of the fingerprints, as over 99 in 100 such pairs do. What does
    not is searched again: BANKS times with COUNT other fingerprints each time. Texts
    of FEW to SHORT shingles differ in more bits (four of five shingles: 3 in 16), so they
    and those that can be similar to them are searched once more with MORE fingerprints, of which a pair agrees in
    a segment in 9,998 of 10,000 cases. No candidate counts before its shingle sets are compared
    (``similar_links``). Equal sets are folded first. Rows without an id stay.
    """
    longest = SHORT * SIMILAR[1] // SIMILAR[0]
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    own = written(_marked(texts, shingle), "marked")
    nodes = written(own.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.first("fps").alias("fps")), "nodes")
    short = nodes.where(F.col("n").between(FEW, longest)).select(F.col("rep").alias("id"))
    again = written(fingerprints(texts.join(short.distinct(), "id", "left_semi"), "id", "text", shingle, MORE).distinct(), "short-prints")
    found = links(again.select(F.col("id").alias("rep"), "fps"), WIDE, sharded=MORE, total=TOTAL * MORE // COUNT)
    for bank in range(BANKS):
        found = found.unionByName(links(nodes.select("rep", F.slice("fps", bank * COUNT + 1, COUNT).alias("fps")), WIDE, sharded=COUNT, total=TOTAL))
    groups = components(found)
    near = written(groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct(), "candidates")
    reps = texts.withColumnRenamed("id", "rep").join(nodes.select("rep").distinct(), "rep", "left_semi")
    found = components(similar_links(reps, near, shingle))
    first = nodes.join(found, F.col("rep") == F.col("node"), "left").where("root IS NULL OR root = rep").select(F.col("rep").alias("_first")).distinct()
    kept = rows.join(first, F.col("_id") == F.col("_first"), "left_semi")
    kept = kept.withColumn("_no", F.row_number().over(W.partitionBy("_id").orderBy("_id"))).where("_no = 1")
    return kept.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))


@query("op7_simhash_components")
def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.element_at("fps", 1)), 16, "0")).alias("fingerprint"), "component_id")
