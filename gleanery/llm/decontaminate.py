"""Benchmark decontamination: a broadcast hash set of test n-grams, checked hits, spans or documents removed.

Texts are lower-cased (A-Z) and cut into words of digits, letters and characters
beyond ASCII. A window is ``n`` item words in a row; an item of fewer words is
one window as a whole. Document windows are looked up by digest and each hit is
verified on the words themselves before it counts.

The set is broadcast only while the test tables have at most MAX_WINDOWS windows,
which is counted first. Beyond that, document windows and item windows meet in a
shuffle join on 128-bit digests, with the same results.

Defined results: null or empty text has no words and no hits; an item without
words has no window; repeated items with one id count once; repeated documents
keep their rows; empty tables give no hits; extra columns are ignored. A null
item id counts as the empty string.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import arrays as A
from gleanery.llm.base import packed, query, small_batches, table, unpacked

N = 10
#: Largest set that is broadcast: about 100 bytes a window in each Python worker.
MAX_WINDOWS = 1_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_SPANS = "array<struct<start: int, n: int>>"


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.translate(_FOLD))


def _window_digests(values: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all n-word windows, and which of them lie inside one text."""
    d = A.Ranges(values).sliding(n)
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    return d, owner[: len(d)] == owner[n - 1 : n - 1 + len(d)] if len(d) else np.zeros(0, bool)


class GramSet:
    """Test windows by digest, with their words and items."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        by_length: dict[int, set[bytes]] = defaultdict(set)
        for item, text in items:
            ws = words_of(text)
            size = min(n, len(ws))
            for i in range(len(ws) - size + 1 if size else 0):
                w = b" ".join(ws[i : i + size])
                self.items[w].add(item)
                by_length[size].add(w)
        self.digests: dict[int, np.ndarray] = {}
        self.sieve: dict[int, np.ndarray] = {}
        for size, grams in by_length.items():
            texts = pa.array(list(grams), pa.binary())
            values, before = A.word_values(*A.buffers(texts), A.alnum_table())
            d, inside = _window_digests(values, before, size)
            self.digests[size] = np.unique(d[inside])
            self.sieve[size] = np.zeros(1 << 22, bool)
            self.sieve[size][d[inside] & A.U((1 << 22) - 1)] = True

    def hits(self, values: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(text, first word, words)`` of each window whose digest is in the set."""
        for size, known in self.digests.items():
            d, inside = _window_digests(values, before, size)
            at = np.flatnonzero(self.sieve[size][d & A.U((1 << 22) - 1)] & inside)
            if len(at):
                pos = np.minimum(np.searchsorted(known, d[at]), len(known) - 1)
                at = at[known[pos] == d[at]]
                for t, i in zip((np.searchsorted(before, at, side="right") - 1).tolist(), at.tolist()):
                    yield t, i - int(before[t]), size


def _summary(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    mask = A.covered([(s, s + n) for s, n in spans], n_words) if spans else ()
    names = ",".join(sorted(items))
    return n_words, int(np.count_nonzero(mask)), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(spans), [{"start": s, "n": n} for s, n in sorted(spans)]


_OUT = f"n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans {_SPANS}"


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Hits of each document: ``rest`` and ``text`` (see ``packed``), ``n_words, n_hit, n_items, items_sha256, contaminated, spans`` (word offsets and lengths)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.select(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long"))).first()[0] or 0
    small_batches(spark)
    named = packed(docs, text_col)
    if total > max_windows:
        return _scan_by_join(named, items, n, id_col)
    rows = [(r.item, r.text.encode()) for r in items.collect()]  # at most max_windows words
    grams = spark.sparkContext.broadcast(rows)
    made: list[GramSet] = []

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(GramSet(grams.value, n))
        known = made[0]
        for b in batches:
            text = b.column(1)
            data, offsets = A.buffers(text)
            for i, j in A.groups_of(offsets):
                own = offsets[i : j + 1] - offsets[i]
                values, before = A.word_values(data[offsets[i] : offsets[j]], own, A.alnum_table(), lower=True)
                spans: dict[int, list] = defaultdict(list)
                items_hit: dict[int, set[str]] = defaultdict(set)
                words: dict[int, list[bytes]] = {}
                for t, s, size in known.hits(values, before):
                    if t not in words:
                        words[t] = words_of(data[offsets[i + t] : offsets[i + t + 1]].tobytes())
                    found = known.items.get(b" ".join(words[t][s : s + size]))
                    if found:  # the words themselves agree
                        spans[t].append((s, size))
                        items_hit[t] |= found
                counts = np.diff(before).tolist()
                out = [_summary(counts[t], spans.get(t, []), items_hit.get(t, set())) for t in range(j - i)]
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), text.slice(i, j - i), *cols], ["rest", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return named.mapInArrow(look, _schema(named))


def _schema(named: DataFrame) -> T.StructType:
    return T.StructType([named.schema["rest"], named.schema["text"], *T._parse_datatype_string(_OUT).fields])


def _all_windows(rows: DataFrame, n: int, sizes: list[int] | None) -> DataFrame:
    """``name, start, n, d1, d2`` of every window; with ``sizes`` of those lengths, else of n words or of the whole text if it is shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name = b.column(0)
            data, offsets = A.buffers(b.column(1))
            for i, j in A.groups_of(offsets):
                own = offsets[i : j + 1] - offsets[i]
                values, before = A.word_values(data[offsets[i] : offsets[j]], own, A.alnum_table(), lower=True)
                counts = np.diff(before)
                for size in sizes or range(1, n + 1):
                    d, inside = _window_digests(values, before, size)
                    d2 = A.Ranges(A.second(values), 1).sliding(size)
                    at = np.flatnonzero(inside)
                    owner = np.searchsorted(before, at, side="right") - 1
                    if not sizes and size < n:
                        whole = counts[owner] == size
                        at, owner = at[whole], owner[whole]
                    cols = [name.take(pa.array(i + owner)), pa.array((at - before[owner]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(d[at].view(np.int64)), pa.array(d2[at].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["name", "start", "n", "d1", "d2"])

    return rows.mapInArrow(cut, f"name {rows.schema[0].dataType.simpleString()}, start int, n int, d1 long, d2 long")


def _scan_by_join(named: DataFrame, items: DataFrame, n: int, id_col: str) -> DataFrame:
    """The way for test tables of any size."""
    tests = _all_windows(items.select("item", "text"), n, None).select(F.col("name").alias("item"), "n", "d1", "d2").distinct()
    sizes = sorted(r.n for r in tests.select("n").distinct().collect())  # at most n numbers
    keyed = named.withColumn("_row", F.struct(F.coalesce(F.col("rest")[id_col].cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("t")).cast("string"))
    seen = _all_windows(keyed.select("_row", "text"), n, sizes).withColumnRenamed("name", "_row") if sizes else None
    if seen is None:
        hits = keyed.select("_row").where("false").select("_row", F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    else:
        met = seen.join(tests, ["n", "d1", "d2"])
        hits = met.groupBy("_row").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set("item").alias("items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans, names in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                out.append(_summary(len(words_of((text or "").encode())), [(s["start"], s["n"]) for s in spans or []], set(names or [])))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))))]
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["rest", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return keyed.join(hits, "_row", "left").select("rest", "text", "spans", "items").mapInArrow(finish, _schema(named))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a test window."""
    return scan(docs, benchmark, id_col, text_col, **how).where("NOT contaminated").select(*unpacked(docs.columns, text_col))


def clean_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the words inside test windows; what is left of a hit text has single spaces."""
    found = scan(docs, benchmark, id_col, text_col, **how)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not spans:
                    out.append(t)
                    continue
                raw = t.encode()
                hit = {i for s in spans for i in range(s["start"], s["start"] + s["n"])}
                keep, at = [], 0
                for i, m in enumerate(_WORD.finditer(raw.translate(_FOLD))):
                    if i in hit:
                        keep.append(raw[at : m.start()])
                        at = m.end()
                out.append(b" ".join(b"".join([*keep, raw[at:]]).split()).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["rest", "text"])

    done = found.select("rest", "text", "spans").mapInArrow(cut, packed(docs, text_col).schema)
    return done.select(*unpacked(docs.columns, text_col))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op2_benchmark_hits",
    f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
tests AS (
  SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT item, w, least(len(w), {N}) AS n, unnest(range(len(w) - least(len(w), {N}) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS rn, doc_id, {_SQL_WORDS} AS w FROM documents),
seen AS (
  SELECT rn, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT rn, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM tests) WHERE len(w) >= n)
),
met AS (SELECT rn, i, seen.n AS n, item FROM seen JOIN tests USING (n, g)),
named AS (SELECT rn, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM met GROUP BY rn),
struck AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS p FROM met) GROUP BY rn)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN named USING (rn) LEFT JOIN struck USING (rn)
""",
)
def op2_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tests = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return scan(docs.select("doc_id", "text"), tests).select("rest.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
