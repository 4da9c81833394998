"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled by their full content and folded to distinct ones with their
number of copies. Each distinct text is tokenised twice and aligned: offsets at
which tokens of both sides end cut the bytes into groups, and all tokens of one
side in a group are linked to all of the other side. A pair of ids counts the
documents that hold it linked, so each distinct text adds its number of copies.
Measures that need those counts are put together text by text and joined to the
documents by the digest of the text.

Pair counts go back to the texts in two ways at once: the commonest pairs, as
many as PAIRS at most, are sent to all tasks and looked up there; what a text
holds besides them is joined by shuffle. So no common pair is a crowded key,
whatever the corpus, and what is broadcast has a fixed bound.

Side A is a byte-level pair-merge vocabulary file, side B a SentencePiece model.
A space goes before each text (B's normaliser puts it). No text of a special
token is special inside a document.

Defined results: null and empty texts, and texts that either side does not give
back byte for byte (a literal space mark), have no tokens: zeros and an empty
digest; rows without an id are documents like others; repeated rows count as
documents of their own; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.base import kept_in_worker, query, small_batches, table
from gleanery.session import written

BYTES_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Most pairs that are sent to all tasks; bytes of texts aligned at once; links of a group that are counted without folding its ids first.
PAIRS, CHUNK, SMALL = 1_000_000, 1 << 21, 64
MARK = "▁"
#: How byte-level vocabularies split texts before merging. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Sides:
    """Both tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        spec = json.loads(a_file)
        vocab = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", [])}}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        symbols = byte_symbols()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(symbols[c] for c in token)
        self.encode_a = self._merging(spec, vocab) or self._library(a_file)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        n = self.model.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # how an id is written: first or later of its side in a group
        self.written = [f"{sep}{i}" for table, seps in ((self.a_bytes, ";,"), (self.b_bytes, "|,")) for sep in seps for i in range(len(table))]

    def _merging(self, spec: dict, vocab: dict[str, int]) -> Callable[[list[str]], list[list[int]]] | None:
        """If ids rank the merges, merging by rank gives the same ids in a quarter of the time."""
        pre = spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        ranked = all(vocab.get(x + y) == 256 + i for i, (x, y) in enumerate(merges))
        if not ranked or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            return None
        import tiktoken

        ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
        own = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts]

    def _library(self, a_file: bytes) -> Callable[[list[str]], list[list[int]]]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_buffer(a_file)
        own.encode_special_tokens = True
        return lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where a side does not give the text back."""
        a, b = self.encode_a([" " + t for t in texts]), self.model.encode(texts, num_threads=1)
        bytes_a, bytes_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            if not t or b"".join(map(bytes_a, a[k])) != whole or b"".join(map(bytes_b, b[k])) != whole:
                a[k], b[k] = [], []
        return a, b


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    before = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=before[1:])
    return np.fromiter((x for r in rows for x in r), np.int64, int(before[-1])), before


def _sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[before[1:]] - total[before[:-1]]


class Aligned:
    """Groups and links of some texts: counts and digest for each, and its linked id pairs with their number of links."""

    def __init__(self, sides: Sides, a_rows: list[list[int]], b_rows: list[list[int]]):
        a, a_before = _flat(a_rows)
        b, b_before = _flat(b_rows)
        a_end, b_end = np.cumsum(sides.a_sizes[a]), np.cumsum(sides.b_sizes[b])
        # texts stand one after the other on both sides, and each is as long on one as on the other
        both = np.zeros((2, int(a_end[-1]) + 1 if len(a_end) else 1), bool)
        both[0, a_end], both[1, b_end] = True, True
        shared = both.all(0)
        upto = np.cumsum(shared)
        a_group, b_group = upto[a_end] - shared[a_end], upto[b_end] - shared[b_end]
        n_groups = int(upto[-1])
        a_count, b_count = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        group_before = np.concatenate([[0], upto[a_end]])[a_before] if len(a_end) else np.zeros(len(a_before), np.int64)
        self.n_a, self.n_b, self.n_groups = np.diff(a_before), np.diff(b_before), np.diff(group_before)
        self.n_links = _sums(a_count * b_count, group_before)
        self.digests = self._digests(sides, a, b, a_group, b_group, a_count, b_count, a_before + b_before)
        self._pairs(a, b, a_group, a_count, b_count, group_before, len(sides.b_bytes), len(sides.a_bytes) * len(sides.b_bytes))

    @staticmethod
    def _digests(sides, a, b, a_group, b_group, a_count, b_count, before) -> list[str]:
        # tokens in writing order: a group's of side A, then its of side B
        a_start, b_start = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_start[a_group]] = a + len(sides.a_bytes) * (np.arange(len(a)) != a_start[a_group])
        order[np.arange(len(b)) + (a_start + a_count)[b_group]] = 2 * len(sides.a_bytes) + b + len(sides.b_bytes) * (np.arange(len(b)) != b_start[b_group])
        out, name = [], sides.written.__getitem__
        for s, e in zip(before[:-1].tolist(), before[1:].tolist()):
            out.append(hashlib.sha256("".join(map(name, order[s:e].tolist()))[1:].encode()).hexdigest() if e > s else "")
        return out

    def _pairs(self, a, b, a_group, a_count, b_count, group_before, n_b, size) -> None:
        owner = np.repeat(np.arange(len(group_before) - 1), np.diff(group_before))
        b_start, a_start = np.cumsum(b_count) - b_count, np.cumsum(a_count) - a_count
        small = a_count * b_count <= SMALL
        times = np.where(small, b_count, 0)[a_group]
        of_a = np.repeat(np.arange(len(a)), times)
        of_b = b_start[a_group][of_a] + np.arange(len(of_a)) - np.repeat(np.cumsum(times) - times, times)
        codes, counts = [owner[a_group[of_a]] * size + a[of_a] * n_b + b[of_b]], [np.ones(len(of_a), np.int64)]
        for g in np.flatnonzero(~small).tolist():  # a long group has far fewer ids than tokens
            ids_a, times_a = np.unique(a[a_start[g] : a_start[g] + a_count[g]], return_counts=True)
            ids_b, times_b = np.unique(b[b_start[g] : b_start[g] + b_count[g]], return_counts=True)
            codes.append((owner[g] * size + ids_a[:, None] * n_b + ids_b[None, :]).ravel())
            counts.append((times_a[:, None] * times_b[None, :]).ravel())
        code, where = np.unique(np.concatenate(codes), return_inverse=True)
        self.links = np.bincount(where, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64) if len(code) else np.zeros(0, np.int64)
        self.before = np.searchsorted(code, np.arange(len(group_before)) * size)
        self.a, self.b = code % size // n_b, code % n_b


def _lists(before: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array((before - before[0]).astype(np.int32)), pa.array(values[before[0] : before[-1]].astype(kind)))


_ALIGNED = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, links array<long>"


def key_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def aligned_texts(docs: DataFrame, text_col: str = "text", a_path: str = BYTES_MODEL, b_path: str = PIECE_MODEL) -> DataFrame:
    """One row for each distinct text: key, copies, counts, digest and linked id pairs."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(a_path, "rb") as f, open(b_path, "rb") as g:  # vocabulary files, read on the driver
        files = (f.read(), g.read())
    name = hashlib.sha256(files[0] + files[1]).hexdigest()
    sent = spark.sparkContext.broadcast(files)
    text = F.col(text_col)
    distinct = docs.where(text.isNotNull() & (text != "")).groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = kept_in_worker(name, lambda: Sides(*sent.value))
        for batch in batches:
            s, held = 0, 0
            sizes = batch.column(2).to_pylist()
            for e in range(1, len(batch) + 1):
                held += sizes[e - 1]
                if held >= CHUNK or e == len(batch):
                    part = batch.slice(s, e - s)
                    got = Aligned(sides, *sides.tokens(part.column(1).to_pylist()))
                    longs = [pa.array(x.astype(np.int64)) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)]
                    lists = [_lists(got.before, x, kind) for x, kind in ((got.a, np.int32), (got.b, np.int32), (got.links, np.int64))]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), *longs, pa.array(got.digests), *lists], [x.split(" ")[0] for x in _ALIGNED.split(", ")])
                    s, held = e, 0

    return distinct.select(key_of(F.col("text")).alias("key"), "text", F.octet_length("text").alias("size"), "copies").mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, documents, best``: in how many documents an id pair is linked, and whether no pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tasks fold their pairs first; what they hold stays below some millions
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def folded() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(code)).astype(np.int64)

        def out(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "documents"])

        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (1, 2))
            held.append((a << 32 | b, np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())))
            if sum(len(c) for c, _ in held) > 1 << 21:
                held = [folded()]
                if len(held[0][0]) > 1 << 20:
                    yield out(*held[0])
                    held = []
        if held:
            yield out(*folded())

    counts = aligned.select("copies", "a", "b").mapInArrow(run, "a int, b int, documents long").groupBy("a", "b").agg(F.sum("documents").alias("documents"))
    counts = written(counts, "pair-counts")
    most = counts.groupBy(F.col("a").alias("own")).agg(F.max("documents").alias("most"))  # one row for each id of the vocabulary
    return counts.join(most, F.col("a") == F.col("own")).select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _common(counts: DataFrame, most: int) -> int:
    """A number of documents that at most ``most`` pairs reach."""
    width = F.length(F.bin("documents"))
    rows = sorted(((r.w, r["n"]) for r in counts.groupBy(width.alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # at most 63 rows
    low, held = 64, 0
    for w, n in rows:
        held += n
        if held > most:
            break
        low = w
    return min(1 << (low - 1), (1 << 63) - 1)


def measures(aligned: DataFrame, counts: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of the pairs."""
    spark = aligned.sparkSession
    low = _common(counts, pairs)
    top = counts.where(F.col("documents") >= low).toArrow()  # at most ``pairs`` rows
    code = top.column("a").to_numpy().astype(np.int64) << 32 | top.column("b").to_numpy().astype(np.int64)
    order = np.argsort(code)
    sent = spark.sparkContext.broadcast((code[order], top.column("documents").to_numpy()[order], top.column("best").to_numpy(zero_copy_only=False)[order]))
    kept = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, documents, best = sent.value
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            a, b, links = (column[c].flatten().to_numpy().astype(np.int64) for c in ("a", "b", "links"))
            before = np.concatenate([[0], np.cumsum(column["a"].value_lengths().to_numpy())])
            own = a << 32 | b
            at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
            here = codes[at] == own if len(codes) else np.zeros(len(own), bool)
            found = links * here
            sums = [_sums(found * v[at], before) if len(codes) else np.zeros(len(batch), np.int64) for v in (best, documents)]
            rest = np.concatenate([[0], np.cumsum(~here)])[before]
            lists = [_lists(rest, x[~here], kind) for x, kind in ((a, np.int32), (b, np.int32), (links, np.int64))]
            yield pa.RecordBatch.from_arrays([*[column[c] for c in kept], *[pa.array(s.astype(np.int64)) for s in sums], *lists], [*kept, "n_best", "count_sum", "a", "b", "links"])

    types = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}
    kinds = ", ".join(f"{c} {types[c]}" for c in kept) + ", n_best long, count_sum long, a array<int>, b array<int>, links array<long>"
    looked = aligned.select(*kept, "a", "b", "links").mapInArrow(run, kinds)
    if low == 1:  # every pair was looked up
        return looked.drop("a", "b", "links")
    looked = written(looked, "looked-up")
    rare = looked.select("key", F.explode(F.arrays_zip("a", "b", "links")).alias("p")).select("key", "p.a", "p.b", "p.links")
    rare = rare.join(counts.where(F.col("documents") < low), ["a", "b"])
    rest = rare.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("_best"), F.sum(F.col("links") * F.col("documents")).alias("_sum"))
    return looked.join(rest, "key", "left").select(*kept, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))


def align(docs: DataFrame, text_col: str = "text", a_path: str = BYTES_MODEL, b_path: str = PIECE_MODEL, pairs: int = PAIRS) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text) with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    aligned = written(aligned_texts(docs, text_col, a_path, b_path), "aligned")
    counts = written(pair_counts(aligned), "counts")
    found = measures(aligned, counts, pairs)
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("row"), key_of(F.col(text_col)).alias("key"))
    joined = rows.join(found, "key", "left")
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return joined.select("row", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in longs], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align(docs).select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
