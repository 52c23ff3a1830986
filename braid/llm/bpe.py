"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary of ranks becomes a ``tokenizers`` BPE model whose alphabet is the usual
byte-to-character table. Texts are cut into pieces by the pattern's rules on whole
Arrow buffers; each different piece is encoded once, and every other place where it
stands takes those ids; pieces are told apart by their bytes. Ids are packed as little-endian
unsigned 32-bit integers, so they pass through the JVM as one binary value for each text.
Decoding takes the characters of the model's tokens back through the byte table and joins
bytes before it reads characters, so a character that is split over tokens comes back whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import fresh_names
from .textkernel import SLICE_BYTES, Numbers, slices, spread

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: The endings that the pattern takes together with an apostrophe before them.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pieces whose ids a worker keeps, and their bytes.
CACHE_PIECES, CACHE_BYTES = 200_000, 1 << 23


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), dtype=x.dtype)))


class Codec:
    """Encoder of one rank file. The pattern's rules are those of :func:`piece_starts`."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        char = byte_characters()
        spell = lambda token: "".join(char[b] for b in token)
        merges = []
        for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
            # every way to make the token: the model merges what makes the lowest rank, whatever the two parts are
            ways = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(spell(a), spell(b)) for a, b in sorted(ways, key=lambda w: (ranks[w[0]], ranks[w[1]]))]
        self.model = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.single = {bytes([b]): ranks[bytes([b])] for b in range(256)}
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.kind = np.zeros(0x110000, dtype=np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
            rest = "".join(piece for piece, _ in pre_tokenizers.Split(Regex(name), "removed").pre_tokenize_str(every))
            own = np.ones(0x110000, dtype=bool)
            own[0xD800:0xE000] = False
            own[np.frombuffer(rest.encode("utf-32-le"), dtype=np.uint32)] = False
            self.kind[own] = kind
        self.forget()

    def forget(self) -> None:
        self.places = Numbers()
        self.flat = np.zeros(1 << 16, dtype=np.uint32)  # the ids of all pieces, one after the other
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0

    def piece_starts(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces start among code points; ``bounds`` are the texts' ends."""
        n = len(code)
        kind = self.kind[code]
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        change = np.ones(n, dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= edge[:n]
        blank = kind == BLANK
        next_solid = np.zeros(n, dtype=bool)  # a character that isn't blank follows in the text
        next_solid[:-1] = ~blank[1:]
        next_solid &= ~edge[1:]
        last = blank & next_solid  # of a run of blanks: a piece of its own, or the next piece's first character
        lead = last & (code == 0x20)
        start = change | last
        start[1:] &= ~lead[:-1]
        quote = np.flatnonzero((code == 0x27) & start)
        if len(quote):
            at = lambda k: np.where(quote + k < n, code[np.minimum(quote + k, n - 1)], 0)
            inside = lambda k: ~edge[np.minimum(quote[:, None] + np.arange(1, k + 1), n)].any(axis=1)
            end = np.zeros(len(quote), dtype=np.int64)
            for ending in ENDINGS:
                hit = np.logical_and.reduce([at(k + 1) == ord(c) for k, c in enumerate(ending)]) & inside(len(ending))
                end[hit] = len(ending)
            for size in (1, 2):
                here = quote[end == size]
                for k in range(1, size + 1):
                    start[here + k] = False
                after = here + size + 1
                start[after[after < n]] = True
        return np.flatnonzero(start)

    def lookup(self, whole: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The place of each piece (a range of bytes) among the known ones, encoding those that are new."""
        if self.places.count > CACHE_PIECES or self.places.bytes > CACHE_BYTES:
            self.forget()
        n, m = self.places.count, self.used
        at = self.places.of([whole[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
        new, self.places.fresh = self.places.fresh, []
        if new:
            texts, odd = [], {}
            for i, piece in enumerate(new):
                try:
                    texts.append(piece.decode())
                except UnicodeDecodeError:
                    texts.append("")
                    odd[i] = [self.single[bytes([b])] for b in piece]
            found = [odd.get(i) or e.ids for i, e in enumerate(self.model.encode_batch_fast(texts, add_special_tokens=False))]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ids = np.fromiter((x for f in found for x in f), dtype=np.uint32, count=int(sizes.sum()))
            self.flat = _room(self.flat, m + len(ids))
            self.begin, self.size = (_room(x, n + len(new)) for x in (self.begin, self.size))
            self.flat[m : m + len(ids)] = ids
            self.begin[n : n + len(new)] = m + np.cumsum(sizes) - sizes
            self.size[n : n + len(new)] = sizes
            self.used = m + len(ids)
        return at

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the texts' bounds among them."""
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(bounds), dtype=np.int64)
        whole = data.tobytes()
        code = np.frombuffer(whole.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        width[(code >= 0xDC80) & (code < 0xDD00)] = 1
        byte_at = np.append(0, np.cumsum(width))
        starts = self.piece_starts(code, np.searchsorted(byte_at, bounds))
        begin = byte_at[starts]
        place = self.lookup(whole, begin, np.append(begin[1:], len(data)))
        sizes = self.size[place]
        item, step = spread(sizes)
        ids = self.flat[self.begin[place][item] + step]
        cuts = np.append(0, np.cumsum(sizes, dtype=np.int64))[np.searchsorted(begin, bounds)]
        return ids, cuts

    def offsets(self, ids: np.ndarray, cuts: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(tokens, 2): each token's first and last character in its text, the last excluded. Tokens that share a character both hold it."""
        ends = np.cumsum(self.length[ids])
        begins = ends - self.length[ids]
        whole = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        text, _ = spread(np.diff(cuts))
        base = whole[bounds][text]
        return np.column_stack((np.maximum(whole[begins + 1] - 1 - base, 0), whole[ends] - base)).astype(np.uint32)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker process's own codec."""
    return Codec(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: its token's characters in the model's vocabulary, taken back through the byte table."""
    byte = {char: b for b, char in enumerate(byte_characters())}
    vocabulary = codec(path).model.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, rank in vocabulary.items():
        out[rank] = bytes(map(byte.__getitem__, token))
    return out


def _parts(data: np.ndarray, most_bytes: int) -> Iterator[np.ndarray]:
    """One long text in parts of about ``most_bytes``, cut before single spaces between other characters, where a piece starts in any case."""
    at = 0
    while at < len(data):
        to, step = at + most_bytes, 1 << 12
        while to < len(data):
            near = data[to - 1 : to + step + 1]  # the candidates, with the bytes beside them
            solid = (near > 0x20) & (near < 0x80) & (near != 0x7F)
            cut = np.flatnonzero((near[1:-1] == 0x20) & solid[:-2] & solid[2:])
            if len(cut):
                to += int(cut[0])
                break
            to += step
        yield data[at:to]
        at = to


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary value for each text: 4 bytes for each number."""
    raw = np.ascontiguousarray(values, dtype="<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * 4, dtype=np.int64)), pa.py_buffer(raw)])


def _encode(path: str, with_offsets: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            last = batch.num_columns - 1
            for at, to, data, bounds in slices(batch.column(last)):
                if len(data) > 2 * SLICE_BYTES:  # one long text
                    parts = [own.encode(part, np.array([0, len(part)]))[0] for part in _parts(data, SLICE_BYTES)]
                    ids = np.concatenate(parts)
                    cuts = np.array([0, len(ids)])
                else:
                    ids, cuts = own.encode(data, bounds)
                columns = [batch.column(i).slice(at, to - at) for i in range(last)]
                more = [pa.array(np.diff(cuts)), _packed(ids, cuts)]
                if with_offsets:
                    more.append(_packed(own.offsets(ids, cuts, data, bounds).ravel(), cuts * 2))
                yield pa.RecordBatch.from_arrays([*columns, *more], [*batch.schema.names[:last], *("n_tokens", "ids", "offsets")[: len(more)]])

    return work


def _decode(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = token_bytes(path).__getitem__
        for batch in batches:
            last = batch.num_columns - 1
            done = [b"".join(map(get, np.frombuffer(x.as_buffer(), dtype="<u4").tolist())) if x.is_valid else None for x in batch.column(last)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(done, pa.large_binary())], [*batch.schema.names[:last], "decoded"])

    return work


def _with(docs: DataFrame, last, work, fields: list[tuple[str, str]]) -> DataFrame:
    """``docs`` through a batch function that takes all its columns and ``last``, and gives its columns and ``fields``."""
    flat = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), last.alias("last"))
    schema = ", ".join([*(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)), *(f"{n} {t}" for n, t in fields)])
    return flat.mapInArrow(work, schema).toDF(*docs.columns, *fresh_names(docs, *(n for n, _ in fields)))


def encode(docs: DataFrame, path: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (packed) and, if asked for, ``offsets`` (packed pairs: first and last character, the last excluded).

    ``path`` is a rank file that every executor can open. Special tokens are ordinary
    text. A null text counts as empty: no ids. Texts of any length are encoded whole;
    bytes that are no UTF-8 are single-byte tokens. Rows and other columns pass
    through; result columns whose names are taken get a leading underscore.
    """
    fields = [("n_tokens", "long"), ("ids", "binary"), ("offsets", "binary")][: 2 + offsets]
    return _with(docs, F.coalesce(F.col(text_col).cast("string"), F.lit("")), _encode(path, offsets), fields)


def decode(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``: the bytes that the packed ids stand for (null for null). Cast to string to read characters."""
    return _with(docs, F.col(ids_col), _decode(path), [("decoded", "binary")])


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``decoded``: :func:`encode`, then :func:`decode` of its ids, in one worker that holds a slice of texts at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _encode(path, False)(batches):
            for own in _decode(path)(iter([batch])):
                yield pa.RecordBatch.from_arrays([*batch.columns, own.column(own.num_columns - 1)], [*batch.schema.names, "decoded"])

    return _with(docs, F.coalesce(F.col(text_col).cast("string"), F.lit("")), work, [("n_tokens", "long"), ("ids", "binary"), ("decoded", "binary")])
