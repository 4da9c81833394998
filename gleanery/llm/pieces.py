"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

Three machines are compiled from the model file and composed with each text:

* the normaliser turns characters into symbols: spaces become the space mark,
  one mark goes before the text, and, if the model asks, runs of spaces shrink;
* the piece transducer has an arc for each vocabulary entry, spelled out as a
  trie from symbol to symbol, and for a symbol that no entry holds, a chain of
  arcs with the ids of its UTF-8 bytes;
* the weight acceptor gives each arc its cost in the tropical semiring. In a
  unigram model that is minus the piece's score. In a pair-merge model an arc
  depends on the piece before it: it costs nothing if merging the two pieces'
  joined symbols from scratch gives the two pieces again, and infinity if not. A
  sequence in which every neighbouring pair passes is what merging the whole text
  gives, so at most one path of finite cost leads to each state: the search goes
  depth first, long arcs first, and never enters a state twice.

No piece holds a symbol followed by a space mark, so shortest paths are found
word by word (and apart from punctuation, where no piece leads into it) and
remembered, within a fixed number of words.

Decoding runs the same transducer backwards: ids to symbols or bytes, bytes to
characters, marks to spaces, the first mark dropped.

Defined results: null and empty texts have no ids; a literal space mark in a text
decodes as a space; bytes that form no character decode as U+FFFD; control ids
decode to nothing; repeated rows get equal ids; extra columns stay; an empty
table gives an empty result. A model with a precompiled character map is refused.
"""

from __future__ import annotations

import hashlib
import re
import string
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.base import query, small_batches, table

MARK = "▁"
#: Words whose paths a Python worker remembers, and the longest such word.
REMEMBERED, LONGEST = 200_000, 48
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Model:
    """What the transducers are compiled from. Read on the driver, sent to the tasks as plain tables."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap:
            raise ValueError("models with a precompiled character map are not supported")
        if not m.trainer_spec.byte_fallback:
            raise ValueError("the model has no byte pieces")
        kinds = pb.ModelProto.SentencePiece
        self.merges = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.shrink = m.normalizer_spec.remove_extra_whitespaces
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.size = len(m.pieces)


class Transducer:
    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for p, (i, _) in model.pieces.items()}
        self.score = {p: s for p, (_, s) in model.pieces.items()}
        # states of the trie, and whether a piece ends there
        self.states = {p[:k]: p[:k] in self.ids for p in self.ids for k in range(1, len(p) + 1)}
        self.longest = max(map(len, self.ids), default=1)
        # where no piece goes on, paths of the parts are independent
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        self.words = None if inner else re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + ("|\n" if alone else ""))
        # few pieces go on from another character into punctuation: texts without those characters split there too
        marks = string.punctuation
        self.sticky = {a for p in self.ids for a, b in zip(p, p[1:]) if b in marks and a not in marks and a != MARK}
        p, rest = f"[{re.escape(marks)}]", f"[^{re.escape(marks)}{MARK}{alone}]"
        self.parts = None if inner else re.compile(f"{MARK}+{p}*{rest}*|{p}+{rest}*|{rest}+" + ("|\n" if alone else ""))
        self.pairs: dict[str, dict[str, bool]] = {}
        self.codes = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.paths: dict[str, bytes] = {}
        self.out: list[bytes | int] = [b""] * model.size
        for p, i in self.ids.items():
            self.out[i] = p.encode()
        for value, i in model.bytes.items():
            self.out[i] = bytes([value])

    def normalise(self, text: str) -> str:
        if self.model.shrink:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.model.prefix else "") + text.replace(" ", MARK)

    def merged(self, symbols: str) -> list[str]:
        """The pieces that merging gives: the best-scored pair of neighbours first, the leftmost of equal ones."""
        parts = list(symbols)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _open(self, left: str, right: str) -> bool:
        """Whether the arc of ``right`` is open after that of ``left``."""
        if len(self.pairs) > 50_000:
            self.pairs.clear()
        after = self.pairs.setdefault(left, {})
        got = after[right] = self.merged(left + right) == [left, right]
        return got

    def _arcs(self, s: str, i: int) -> list[str]:
        """Input labels of the arcs that leave position i, from short to long."""
        out, get = [], self.states.get
        for j in range(i + 1, min(len(s), i + self.longest) + 1):
            t = s[i:j]
            ends = get(t)
            if ends is None:
                break
            if ends:
                out.append(t)
        return out or [s[i]]

    def _merge_path(self, s: str) -> list[str]:
        n, i, before = len(s), 0, ""
        states, pairs, longest = self.states.get, self.pairs, self.longest
        out: list[str] = []
        dead: set[int] = set()
        shorter = n + 1  # arcs from i must be shorter than this
        while i < n:
            # the piece ends that are reached from i, from short to long
            ends = []
            for j in range(i + 1, min(n, i + longest, i + shorter - 1) + 1):
                ending = states(s[i:j])
                if ending is None:
                    break
                if ending:
                    ends.append(j)
            if not ends and shorter > n:
                ends = [i + 1]  # a symbol that is no piece
            after = pairs.get(before) or {}
            for j in reversed(ends):
                if j in dead:
                    continue
                t = s[i:j]
                if before:
                    is_open = after.get(t)
                    if is_open is None:
                        is_open = self._open(before, t)
                    if not is_open:
                        continue
                out.append(t)
                i, before, shorter = j, t, n + 1
                break
            else:
                # no way on: back over the last arc, and look for a shorter one
                dead.add(i)
                t = out.pop()
                i -= len(t)
                before = out[-1] if out else ""
                shorter = len(t)
        return out

    def _unigram_path(self, s: str) -> list[str]:
        n = len(s)
        cost = [0.0] + [float("inf")] * n
        last: list[str | None] = [None] * (n + 1)
        lowest = min(self.score.values(), default=0.0) - 10.0
        for i in range(n):
            for t in self._arcs(s, i) if s[i] in self.ids else [*self._arcs(s, i), s[i]]:
                c = cost[i] - self.score.get(t, lowest)
                if c < cost[i + len(t)]:
                    cost[i + len(t)], last[i + len(t)] = c, t
        return self._back(s, last)

    @staticmethod
    def _back(s: str, last: list[str | None]) -> list[str]:
        out, i = [], len(s)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def path(self, s: str) -> bytes:
        """Output ids of the shortest path, as little-endian 32-bit numbers."""
        codes = self.codes
        out = []
        for t in self._merge_path(s) if self.model.merges else self._unigram_path(s):
            code = codes.get(t)
            if code is None:
                code = codes[t] = b"".join(self.model.bytes[b].to_bytes(4, "little") for b in t.encode())
            out.append(code)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        symbols = self.normalise(text)
        if not symbols:
            return b""
        if self.words is None:
            return self.path(symbols)
        paths = self.paths
        parts = (self.parts if self.sticky.isdisjoint(symbols) else self.words).findall(symbols)
        got = [paths.get(w) for w in parts]
        if None in got:
            for k, w in enumerate(parts):
                if got[k] is None:
                    p = paths.get(w)
                    if p is None:
                        p = self.path(w)
                        if len(w) <= LONGEST:
                            if len(paths) >= REMEMBERED:
                                paths.clear()
                            paths[w] = p
                    got[k] = p
        return b"".join(got)

    def decode(self, ids: bytes) -> str:
        out = self.out
        text = b"".join([out[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def _kept_in_worker(key: str, make: Callable[[], Transducer]) -> Transducer:
    """A Python worker is used for many tasks: compile once in each."""
    kept = sys.modules.setdefault("_kept_transducers", types.ModuleType("_kept_transducers")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, decode: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and, if asked for, ``decoded``."""
    small_batches(docs.sparkSession)
    model = Model(model_path)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary of one model
    with open(model_path, "rb") as f:
        key = f"{hashlib.sha256(f.read()).hexdigest()}:{REMEMBERED}"
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _kept_in_worker(key, lambda: Transducer(sent.value))
        for b in batches:
            done, rows, held = 0, [], 0
            for i, t in enumerate(b.column(at)):
                text = t.as_py() or ""
                rows.append(fst.encode(text))
                held += len(text)
                if held > 1 << 21 or i + 1 == len(b):
                    yield _with_ids(b.slice(done, len(rows)), rows, [fst.decode(r) for r in rows] if decode else None, names)
                    done, rows, held = i + 1, [], 0

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kind}, ids array<int>" + (", decoded string" if decode else ""))


def _with_ids(b: pa.RecordBatch, rows: list[bytes], decoded: list[str] | None, names: list[str]) -> pa.RecordBatch:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))
    cols = [*b.columns, ids, *([pa.array(decoded, pa.string())] if decoded is not None else [])]
    return pa.RecordBatch.from_arrays(cols, [*names, "ids", *(["decoded"] if decoded is not None else [])])


@query("op8_piece_ids")
def op8_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Model(MODEL)
    low, high = min(model.bytes.values()), max(model.bytes.values())
    coded = encode(docs)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.size(F.filter("ids", lambda i: (i >= low) & (i <= high))).cast("long").alias("n_byte_ids"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
