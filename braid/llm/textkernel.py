"""Words and hashes of many texts at once, with numpy over Arrow buffers.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. A word's hash has two
halves of 64 bits, each folded from its length and its bytes, eight at a time; a run of words is
folded from the hashes of its words. A fold is a product, a sum and a bijection that is not linear, so things
that differ do not collide by construction. A text that is much longer than a slice is worked on in segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
#: Texts are worked on in slices of about so many bytes; working memory is some 100 times that.
SLICE_BYTES = 1 << 18
LONG_WORD = 1024  # bytes from which a word is hashed by itself
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the sequence of two hashed things."""
    return mix(a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(29))))


class Numbers(dict):
    """Numbers of byte strings, in the order in which they are first asked for; :attr:`fresh` holds those not seen before."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []
        self.count = self.bytes = 0

    def __missing__(self, key: bytes) -> int:
        at = self[key] = self.count
        self.count += 1
        self.bytes += len(key)
        self.fresh.append(key)
        return at

    def of(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=len(keys))


@dataclass
class Words:
    """The words of a slice of texts. ``doc`` is the text's place in the slice; ``starts`` and ``ends`` are byte offsets in ``data``."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    def tokens(self) -> list[bytes]:
        """The words' bytes."""
        whole, at = self.data.tobytes(), self.bounds.tolist()
        return b"\n".join([whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]).split()

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of a hash of each word."""
        size = self.ends - self.starts
        low, high = mix(size), mix(size.astype(_U) + _U(0x9E3779B97F4A7C15))
        padded = np.concatenate((self.data, np.zeros(8, dtype=np.uint8)))
        eights = np.lib.stride_tricks.as_strided(padded, (len(self.data) + 1, 8), (1, 1))
        live, at = np.arange(len(size)), self.starts
        long = size >= LONG_WORD
        if long.any():
            for i in np.flatnonzero(long).tolist():
                low[i], high[i] = np.frombuffer(xxhash.xxh3_128_digest(self.data[self.starts[i] : self.ends[i]]), dtype=_U)
            live, at = live[~long], at[~long]
        while len(live):
            left = self.ends[live] - at
            value = eights[at].view("<u8").ravel()
            value &= ~_U(0) >> (8 * np.maximum(8 - left, 0)).astype(_U)
            low[live], high[live] = join_hashes(low[live], value), join_hashes(high[live], value)
            more = left > 8
            live, at = live[more], at[more] + 8
        return low, high


class Ranges:
    """Hashes of runs of words: of 1, 2, 4 and 8 words by doubling, of others by joining these, eight words at a time."""

    def __init__(self, hashes: np.ndarray, most: int = 8):
        self.levels = [hashes]
        while 2 << (len(self.levels) - 1) <= min(most, 8):
            own, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(join_hashes(own[: max(0, len(own) - step)], own[step:]))

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The hashes of the ``size`` words from ``start`` on: equal for equal sequences."""
        left = np.array(np.broadcast_to(np.asarray(size, dtype=np.int64), start.shape))
        out, at = mix(left), start.astype(np.int64, copy=True)
        for k in range(len(self.levels) - 1, -1, -1):
            while len(here := np.flatnonzero(left >> k)):
                out[here] = join_hashes(out[here], self.levels[k][at[here]])
                at[here] += 1 << k
                left[here] -= 1 << k
        return out


def split_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    n = len(data)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(bounds)))
    return Words(data, bounds, starts, ends, doc, first)


def slices(texts: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, bounds) of runs of texts of about ``most_bytes``; a longer text is a slice alone. A null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _edges(data: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of one text start and end, found ``step`` bytes at a time."""
    starts, ends = [], []
    for at in range(0, len(data), step):
        word = np.zeros(min(step, len(data) - at) + 2, dtype=bool)  # with the byte before and the byte after
        word[1:-1] = ~SPACE[data[at : at + step]]
        word[0] = at > 0 and not SPACE[data[at - 1]]
        word[-1] = at + step < len(data) and not SPACE[data[at + step]]
        starts.append(np.flatnonzero(word[1:-1] & ~word[:-2]) + at)
        ends.append(np.flatnonzero(word[1:-1] & ~word[2:]) + at + 1)
    return np.concatenate(starts), np.concatenate(ends)


@dataclass
class Segment:
    """Words of the texts from ``at`` to ``to``, or of a part of one long text.

    A part begins at the text's word ``base``; of its words the first ``own`` are its own,
    the others those that follow. ``last`` is False if further parts of the text come.
    """

    at: int
    to: int
    base: int
    own: int
    words: Words
    last: bool

    @property
    def whole(self) -> bool:
        return self.base == 0 and self.last


def segments(texts: pa.Array, overlap: int = 0, most_bytes: int = SLICE_BYTES) -> Iterator[Segment]:
    """The words of ``texts`` in slices of about ``most_bytes``; a text of more than twice as much comes in parts, each with ``overlap`` words of the next."""
    for at, to, data, bounds in slices(texts, most_bytes):
        if len(data) <= 2 * most_bytes:
            words = split_words(data, bounds)
            yield Segment(at, to, 0, len(words.starts), words, True)
            continue
        starts, ends = _edges(data, most_bytes)
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), most_bytes)), len(starts)))
        if len(cuts) < 2:  # no words
            cuts = np.zeros(2, dtype=np.int64)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            to_word = min(len(starts), j + overlap)
            n = to_word - i
            a, b = (int(starts[i]), int(ends[to_word - 1])) if n else (0, 0)
            words = Words(data[a:b], np.array([0, b - a]), starts[i:to_word] - a, ends[i:to_word] - a, np.zeros(n, dtype=np.int64), np.array([0, n]))
            yield Segment(at, to, i, j - i, words, j == len(starts))


def words_of(texts: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    for at, to, data, bounds in slices(texts, most_bytes):
        yield at, to, split_words(data, bounds)


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow string array over ``data`` cut at ``bounds``."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(data)])


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items repeated ``counts`` times: each copy's item and its place among the item's copies."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
