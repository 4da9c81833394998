"""Windows that occur more than once, found without a row for each window.

Units are words or UTF-8 bytes, and a window is W units in a row. Shared by the
two substring operators, which read its steps in their own terms.

1. ``runs``: neighbouring windows that hold the same anchor (the least k-gram of
   the window) become one piece ``(core, full)``: ``core`` digests the anchor,
   ``full`` all units that the piece's windows cover. Equal windows have equal
   anchors at equal distances, so windows of pieces with different cores differ.
2. ``decide``: a piece whose core occurs once holds no repeated window and leaves.
   A piece that equals another one as a whole is repeated as a whole. The rest
   stay open, with one copy of each different piece they could partly equal.
3. Open pieces are cut finer (``blocks`` of neighbouring windows, then single
   windows) and decided again. At single windows core and full are the same.

Rows are narrow numbers; texts are shuffled once. Counts fold before each
shuffle. Joins on a core are between written tables, so a core that a large
share of all pieces holds is split over tasks by skew handling. Equality is
decided on 128-bit digests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import arrays as A
from gleanery.llm.base import small_batches
from gleanery.session import written

_LAST = (1 << 63) - 1
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_PIECE = "_key long, _th long, _lo int, _n int, _core long, _f1 long, _f2 long"


@dataclass(frozen=True)
class Plan:
    """``words``: units are words between ASCII white space, else bytes. ``earlier``: a window counts if a smaller key has it, else if any other place has it."""

    words: bool
    window: int
    gram: int
    earlier: bool
    block: int = 0

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            return A.word_values(data, offsets, A.unspaced_table())
        return data, offsets

    def values(self, part: np.ndarray) -> np.ndarray:
        return part if self.words else A.byte_values()[part]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_key`` orders documents (a null id comes last); with ``_th`` it names a row, up to equal rows.

    ``_row`` carries the other columns, whatever their names, and whether the text is null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = F.struct(*[c for c in docs.columns if c != text_col])
    row = F.struct(rest.alias("rest"), F.col(text_col).isNull().alias("empty"))
    return docs.select(row.alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_key"), F.xxhash64(text, F.octet_length(text)).alias("_th"), text.alias("_text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _pieces(keys, ths, lo, n, core, f1, f2) -> pa.RecordBatch:
    cols = [pa.array(keys), pa.array(ths), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), _signed(core), _signed(f1), _signed(f2)]
    return pa.RecordBatch.from_arrays(cols, ["_key", "_th", "_lo", "_n", "_core", "_f1", "_f2"])


def runs(keyed_docs: DataFrame, plan: Plan) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            units, before = plan.units(*A.buffers(b.column(2)))
            for i, j, s, e in A.text_parts(before, plan.window):
                r = A.Runs(plan.values(units[s:e]), np.clip(before[i : j + 1], s, e) - s, plan.window, plan.gram)
                if len(r.start):
                    lo = r.start + s - before[i + r.text]
                    yield _pieces(keys[i + r.text], ths[i + r.text], lo, r.count, r.anchor, r.s1, r.s2)

    return keyed_docs.select("_key", "_th", "_text").mapInArrow(cut, _PIECE)


def _repeated(plan: Plan) -> Column:
    return F.col("_min") < F.col("_max") if plan.earlier else F.col("_count") > 1


def decide(pieces: DataFrame, plan: Plan, name: str) -> DataFrame:
    """Pieces that matter: ``_whole`` (every window of it is repeated), ``_open`` (to be cut finer)."""
    cores = pieces.groupBy("_core").agg(
        F.count(F.lit(1)).alias("_count"), F.min("_key").alias("_min"), F.max("_key").alias("_max"), (F.min("_f1") != F.max("_f1")).alias("_forks")
    )
    cores = written(cores.where(_repeated(plan)).select("_core", "_forks"), f"{name}-cores")
    met = written(pieces.join(cores, "_core"), f"{name}-met")
    fulls = written(met.groupBy("_core", "_f1", "_f2").agg(F.count(F.lit(1)).alias("_count"), F.min("_key").alias("_first")), f"{name}-fulls")
    whole = F.col("_key") > F.col("_first") if plan.earlier else F.col("_count") > 1
    first = F.col("_key") == F.col("_first")
    still = F.col("_forks") & (first if plan.earlier else (F.col("_count") == 1) | first)
    out = met.join(fulls, ["_core", "_f1", "_f2"]).select("_key", "_th", "_lo", "_n", whole.alias("_whole"), still.alias("_open"))
    return written(out.where("_whole OR _open"), f"{name}-decided")


def listed(pieces: DataFrame, name: str) -> DataFrame:
    """Pieces of one document as a list; equal rows are one document here, so its own length bounds the list."""
    return pieces.groupBy("_key", "_th").agg(F.collect_list(F.struct("_lo", "_n")).alias(name))


def _spans(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    s, e = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    own = column.values.slice(s, e - s)
    return own.field(0).to_numpy().astype(np.int64), own.field(1).to_numpy().astype(np.int64)


def _open_texts(batches: Iterator[pa.RecordBatch], plan: Plan, emit: Callable) -> Iterator[pa.RecordBatch]:
    """Call ``emit`` with the open pieces of each text, and about as many windows at a time as a segment has."""
    for b in batches:
        keys, ths, text, pieces = b.column(0), b.column(1), b.column(2), b.column(3)
        for i in range(len(b)):
            units, before = plan.units(*A.buffers(text.slice(i, 1)))
            lo, n = _spans(pieces, i)
            order = np.argsort(lo, kind="stable")
            lo, n = lo[order], n[order]
            at = 0
            while at < len(lo):
                # neighbouring pieces lie close together: digest the stretch of text that holds them
                stop = max(at + 1, int(np.searchsorted(lo, lo[at] + A.SEGMENT)))
                s, e = int(lo[at]), int((lo[at:stop] + n[at:stop]).max()) + plan.window - 1
                got = emit(plan.values(units[s:e]), lo[at:stop] - s, n[at:stop])
                rows = len(got[0])
                if rows:
                    yield _pieces(np.full(rows, keys[i].as_py()), np.full(rows, ths[i].as_py()), got[0] + s, *got[1:])
                at = stop


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of every piece, and the number of its piece."""
    owner = np.repeat(np.arange(len(lo)), n)
    return lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def blocks(texts: DataFrame, plan: Plan) -> DataFrame:
    """Open pieces cut into blocks of neighbouring windows. Blocks are aligned to the distance from the anchor, so equal windows fall into like blocks."""

    def emit(values, lo, n):
        grams = A.Ranges(values).sliding(plan.gram)
        first, other = A.Ranges(values), A.Ranges(A.second(values), 1)
        starts, owner = _expand(lo, n)
        w = plan.window - plan.gram + 1
        bits = max(1, len(grams).bit_length())
        low = A.U((1 << bits) - 1)
        at = A.sliding_min(grams & ~low | np.arange(len(grams), dtype=A.U), w)[lo] & low
        away = at.astype(np.int64)[owner] - starts
        number = away // plan.block
        new = np.ones(len(starts), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(starts)))
        s = starts[head]
        # what all windows of a full block have in common, whether or not this block is cut short
        anchor = s + away[head]
        left, right = anchor - number[head] * plan.block, anchor - (number[head] + 1) * plan.block + 1 + plan.window
        core = A.mix(first.digest(left, right) ^ number[head].astype(A.U))
        extent = (count.astype(A.U) << A.U(32)) | away[head].astype(A.U)
        e = s + count + plan.window - 1
        return s, count, core, A.mix(first.digest(s, e) ^ extent), A.mix(other.digest(s, e) ^ extent)

    return texts.select("_key", "_th", "_text", "_list").mapInArrow(lambda it: _open_texts(it, plan, emit), _PIECE)


def windows(texts: DataFrame, plan: Plan) -> DataFrame:
    """Open pieces cut into single windows."""

    def emit(values, lo, n):
        starts, _ = _expand(lo, n)
        f1 = A.Ranges(values).digest(starts, starts + plan.window)
        f2 = A.Ranges(A.second(values), 1).digest(starts, starts + plan.window)
        return starts, np.ones(len(starts), np.int32), f1, f1, f2

    return texts.select("_key", "_th", "_text", "_list").mapInArrow(lambda it: _open_texts(it, plan, emit), _PIECE)


def decide_windows(single: DataFrame, plan: Plan, name: str) -> DataFrame:
    seen = single.groupBy("_f1", "_f2").agg(F.count(F.lit(1)).alias("_count"), F.min("_key").alias("_min"), F.max("_key").alias("_max"))
    seen = written(seen.where(_repeated(plan)).select("_f1", "_f2", "_min"), f"{name}-windows")
    hit = single.join(seen, ["_f1", "_f2"])
    return (hit.where(F.col("_key") > F.col("_min")) if plan.earlier else hit).select("_key", "_th", "_lo", "_n")


_MARKED = "_key long, _th long, _size long, _gone long, _spans long, _sha string, _kept string"
_MARKED_NAMES = ["_row", "_key", "_th", "_size", "_gone", "_spans", "_sha", "_kept"]


def _mark(text: bytes, intervals: tuple[np.ndarray, np.ndarray], plan: Plan, keep_text: bool) -> tuple:
    """Size, removed units, removed stretches, digest and text of what is left."""
    units: object = text.split() if plan.words else np.frombuffer(text, np.uint8)
    size = len(units)
    lo, n = intervals
    gone = A.covered(np.stack([lo, lo + n + plan.window - 1], 1), size) if len(lo) else np.zeros(size, bool)
    if plan.words:
        left = b" ".join(units if not len(lo) else [units[i] for i in np.flatnonzero(~gone).tolist()])
    else:
        left = units[~gone].tobytes() if len(lo) else text
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(size > 0 and bool(gone[0])) if len(lo) else 0
    kept = None
    if keep_text:
        # white space around kept words stays as it was
        kept = text if not spans else _without_words(text, gone) if plan.words else left
    return size, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None


def _without_words(text: bytes, gone: np.ndarray) -> bytes:
    out, at = [], 0
    for i, m in enumerate(_WORDS.finditer(text)):
        if gone[i] and (i == 0 or not gone[i - 1]):
            out.append(text[at : m.start()])
        elif not gone[i] and i and gone[i - 1]:
            at = m.start()
    return b"".join(out if gone[-1] else [*out, text[at:]])


def marked(docs: DataFrame, plan: Plan, name: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: ``_row, _key, _th, _size, _gone, _spans, _sha, _kept``.

    ``_kept`` is the text that is left, if asked for; bytes of a character that
    lost some of its bytes are dropped from it, while ``_sha`` digests all bytes.
    """
    small_batches(docs.sparkSession)
    named = keyed(docs, id_col, text_col)
    # equal rows (one id, or none, and one text) are worked on once
    several = written(named.groupBy("_key", "_th").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1").select("_key", "_th"), f"{name}-copies")
    copies = None if several.isEmpty() else written(named.join(several, ["_key", "_th"]), f"{name}-equal-rows")
    read = named
    if copies is not None:
        one = copies.groupBy("_key", "_th").agg(F.first("_text").alias("_text"))
        one = written(one.select(F.lit(None).cast(named.schema["_row"].dataType).alias("_row"), "_key", "_th", "_text"), f"{name}-folded")
        named = named.join(several, ["_key", "_th"], "left_anti").select("_row", "_key", "_th", "_text").unionByName(one)
        # where any other place counts, a second copy stands for all others
        read = named if plan.earlier else named.unionByName(one)
    decided = decide(written(runs(read, plan), f"{name}-runs"), plan, f"{name}-run")
    whole = [decided.where("_whole").select("_key", "_th", "_lo", "_n")]
    todo = decided.groupBy("_key", "_th").agg(F.collect_list(F.when(F.col("_open"), F.struct("_lo", "_n"))).alias("_list"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without such pieces are done; the others keep their texts."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            keys, ths, text, lists, row = (b.column(k) for k in range(5))
            free = lists.is_null().to_pylist()
            # a few megabytes of text at a time
            rows, held = [], 0
            for i in range(len(b)):
                t = text[i].as_buffer().to_pybytes()
                if free[i]:
                    rows.append((*_mark(t, none, plan, keep_text), None, None))
                else:
                    rows.append((None, None, None, None, None, t.decode(), lists[i].as_py()))
                held += len(t)
                if held > 8 * A.SEGMENT or i + 1 == len(b):
                    at = i + 1 - len(rows)
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), lists.type))]
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, len(rows)) for c in (row, keys, ths)), *cols], [*_MARKED_NAMES, "_text", "_list"])
                    rows, held = [], 0

    def schema(kinds: str) -> T.StructType:
        return T.StructType([named.schema["_row"], *T._parse_datatype_string(kinds).fields])

    joined = named.join(todo, ["_key", "_th"], "left").select("_key", "_th", "_text", "_list", "_row")
    parted = written(joined.mapInArrow(split, schema(f"{_MARKED}, _text string, _list array<struct<_lo: int, _n: int>>")), f"{name}-texts")
    done = parted.where("_text IS NULL").drop("_text", "_list")
    texts = parted.where("_text IS NOT NULL").select("_key", "_th", "_text", "_list", "_row")
    if plan.block:
        opened = decide(written(blocks(texts, plan), f"{name}-blocks"), plan, f"{name}-block")
        whole.append(opened.where("_whole").select("_key", "_th", "_lo", "_n"))
        finer = texts.drop("_list").join(listed(opened.where("_open"), "_list"), ["_key", "_th"])
    else:
        finer = texts.where(F.size("_list") > 0)
    hits = decide_windows(windows(finer, plan), plan, name)
    for w in whole:
        hits = hits.unionByName(w)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            keys, ths, text, lists, row = (b.column(k) for k in range(5))
            bare = lists.is_null().to_pylist()
            rows, held = [], 0
            for i in range(len(b)):
                t = text[i].as_buffer().to_pybytes()
                rows.append(_mark(t, none if bare[i] else _spans(lists, i), plan, keep_text))
                held += len(t)
                if held > 8 * A.SEGMENT or i + 1 == len(b):
                    at = i + 1 - len(rows)
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, len(rows)) for c in (row, keys, ths)), *cols], _MARKED_NAMES)
                    rows, held = [], 0

    gone = texts.drop("_list").join(listed(hits, "_list"), ["_key", "_th"], "left").select("_key", "_th", "_text", "_list", "_row")
    out = done.unionByName(gone.mapInArrow(finish, schema(_MARKED)))
    if copies is None:
        return out
    out = written(out, f"{name}-marked")
    again = copies.select("_key", "_th", "_row").join(out.where("_row IS NULL").drop("_row"), ["_key", "_th"])
    return out.where("_row IS NOT NULL").unionByName(again.select(*out.columns))
