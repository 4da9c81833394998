"""Array helpers used inside tasks: text buffers, words, rolling digests, sampled anchors.

Digests are polynomials modulo 2**64 over mixed 64-bit values of the units
(words or bytes). With an odd base every power has an inverse, so the digest of
any range comes from two prefix sums, and all ranges of a batch are digested at
once. Two bases give 128 bits where equality of ranges is decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Bytes handled at once; bounds the arrays of a task, whatever the length of a text.
SEGMENT = 1 << 18

_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (SplitMix64's finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        _powers[(which, inverse)] = have
    return have[:n]


class Ranges:
    """Digests of ranges of a value array."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.which = which
        self.prefix = np.zeros(len(values) + 1, U)
        np.cumsum(values * powers(len(values), which), out=self.prefix[1:])

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same for equal contents, wherever they stand; of any lengths."""
        inv = powers(len(self.prefix), self.which, True)
        return mix((self.prefix[end] - self.prefix[start]) * inv[start] + (end - start).astype(U) * U(_SEEDS[self.which]))

    def sliding(self, k: int) -> np.ndarray:
        """Digests of every range of k values."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, U)
        d = self.prefix[k:] - self.prefix[:-k]
        d *= powers(n, self.which, True)
        return mix(d + U(k * _SEEDS[self.which] & (1 << 64) - 1))


def second(values: np.ndarray) -> np.ndarray:
    return mix(values ^ U(_SEEDS[1]))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else offsets


def groups_of(offsets: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def alnum_table() -> np.ndarray:
    """Words of digits, letters and everything beyond ASCII, for lower-cased text."""
    t = np.zeros(256, bool)
    t[48:58] = t[97:123] = True
    t[128:] = True
    return t


def unspaced_table() -> np.ndarray:
    """Words of everything but ASCII white space."""
    t = np.ones(256, bool)
    t[[32, *range(9, 14)]] = False
    return t


_byte_values: np.ndarray | None = None


def byte_values() -> np.ndarray:
    global _byte_values
    if _byte_values is None:
        _byte_values = mix(np.arange(1, 257, dtype=U) * U(_SEEDS[0]))
    return _byte_values


def word_bounds(data: np.ndarray, offsets: np.ndarray, wordy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the number of words before each text."""
    inside = wordy[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | edge[1:n]
        end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def cuts(data: np.ndarray, start: int, end: int, wordy: np.ndarray) -> list[int]:
    """Positions between words, about SEGMENT bytes apart, at which a long text may be handled in parts."""
    at = [start]
    while end - at[-1] > SEGMENT:
        lo, step = at[-1] + SEGMENT, 1 << 16
        cut = end
        while lo < end:
            free = np.flatnonzero(~wordy[data[lo : lo + step]])
            if len(free):
                cut = lo + int(free[0])
                break
            lo += step
        if cut >= end:
            break
        at.append(cut)
    return [*at, end]


def word_values(data: np.ndarray, offsets: np.ndarray, wordy: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each word, and the number of words before each text."""
    values: list[np.ndarray] = []
    before = [0]
    fold = lower_table() if lower else None
    raw = wordy if fold is None else wordy[fold]  # what is a word before folding
    for i, j in groups_of(offsets):
        at = cuts(data, int(offsets[i]), int(offsets[j]), raw) if j == i + 1 else [int(offsets[i]), int(offsets[j])]
        if j > i + 1:
            own = offsets[i : j + 1] - offsets[i]
        total = 0
        for s, e in zip(at, at[1:]):
            part = data[s:e]
            if fold is not None:
                part = fold[part]
            starts, ends, counts = word_bounds(part, own if j > i + 1 else np.array([0, e - s]), wordy)
            values.append(Ranges(byte_values()[part]).digest(starts, ends))
            if j > i + 1:
                before.extend((before[-1] + counts[1:]).tolist())
            else:
                total += int(counts[-1])
        if j == i + 1:
            before.append(before[-1] + total)
    return (np.concatenate(values) if values else np.zeros(0, U)), np.array(before, np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n]) if w > span else x[:n]


class Runs:
    """Windows of W units, gathered by the anchor each one holds.

    The anchor of a window is its k-gram with the least digest (the first of equal
    ones), which depends on the window alone. Neighbouring windows mostly share
    their anchor, so a run ``[lo, lo + count)`` of windows stands for all of them.
    Equal windows have equal anchors at equal distances from their starts.
    """

    def __init__(self, values: np.ndarray, before: np.ndarray, window: int, k: int):
        sizes = np.diff(before)
        n = len(values)
        first = Ranges(values)
        grams = first.sliding(k)
        bits = max(1, int(n).bit_length())
        low = U((1 << bits) - 1)
        at = sliding_min(grams & ~low | np.arange(len(grams), dtype=U), window - k + 1) & low
        full = sizes >= window
        valid = np.zeros(n + 1, np.int8)
        np.add.at(valid, before[:-1][full], 1)
        np.add.at(valid, before[1:][full] - window + 1, -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8)[: len(at)] > 0
        where = np.flatnonzero(valid)
        at = at[where].astype(np.int64)
        owner = np.searchsorted(before, where, side="right") - 1
        if len(where):
            new = np.ones(len(where), bool)
            new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
            heads = np.flatnonzero(new)
        else:
            heads = np.zeros(0, np.int64)
        self.start = where[heads]  # in the whole array
        self.text = owner[heads]
        self.lo = self.start - before[self.text]
        self.count = np.diff(np.append(heads, len(where)))
        self.anchor = grams[at[heads]]
        end = self.start + self.count + window - 1
        extent = (self.count.astype(U) << U(32)) | (at[heads] - self.start).astype(U)
        self.s1 = mix(first.digest(self.start, end) ^ extent)
        self.s2 = mix(Ranges(second(values), 1).digest(self.start, end) ^ extent)


def text_parts(before: np.ndarray, window: int, limit: int = SEGMENT) -> Iterator[tuple[int, int, int, int]]:
    """``(first text, last text, start, end)`` of unit ranges that together hold every window; long texts overlap by ``window - 1``."""
    for i, j in groups_of(before, limit):
        s, e = int(before[i]), int(before[j])
        if j > i + 1 or e - s <= 2 * limit:
            yield i, j, s, e
            continue
        while True:
            stop = min(e, s + limit + window - 1)
            yield i, j, s, stop
            if stop == e:
                break
            s += limit


def covered(intervals: list[tuple[int, int]], n: int) -> np.ndarray:
    """Mask of the units inside any half-open interval."""
    mask = np.zeros(n + 1, np.int32)
    if len(intervals):
        lo, hi = np.array(intervals, np.int64).T
        np.add.at(mask, np.clip(lo, 0, n), 1)
        np.add.at(mask, np.clip(hi, 0, n), -1)
    return np.cumsum(mask[:-1]) > 0
