"""Words, hashes and windows of whole texts, computed on Arrow buffers with numpy.

Texts are never turned into Python strings here: a batch's UTF-8 bytes are one
array, words are found with byte classes (every class used by the operators is a
set of ASCII bytes, so UTF-8 continuation bytes need no decoding) and each word is
hashed from its bytes, eight at a time, by rounds that are bijections of the state.

A word, a window and a shingle have two hashes of 64 bits with constants of their
own. One of them finds candidates; what is removed or linked agrees in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once (one document may be longer).
SLICE_BYTES = 1 << 20

_K1, _K2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: (start of the state, factor of a round, start of a join) of the two hashes.
_LANES = ((U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0x2545F4914F6CDD1D)), (U(0xC2B2AE3D27D4EB4F), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)))
#: The bytes of a word beyond these are hashed by themselves, in one call for each such word.
_LONG = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of the two word definitions: not white space; letters, digits and non-ASCII.
NOT_SPACE = ~SPACES
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection on 64-bit words."""
    x = (x ^ (x >> U(30))) * _K1
    x = (x ^ (x >> U(27))) * _K2
    return x ^ (x >> U(31))


class Words:
    """Words of a run of documents: byte spans, hashes, and each document's range of words."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_bytes: np.ndarray, fold: np.ndarray):
        full = ends > starts
        if len(data):
            inside = word_bytes[data]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            first[starts[full]] = inside[starts[full]]
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            last[ends[full] - 1] = inside[ends[full] - 1]
            self.begin = np.flatnonzero(first)
            self.end = np.flatnonzero(last) + 1
        else:
            self.begin = self.end = np.zeros(0, np.int64)
        self.data, self.starts, self.ends, self.fold = data, starts, ends, fold
        self._hashes: dict[int, np.ndarray] = {}
        #: Words of document d are first[d] up to first[d + 1].
        self.first = np.append(np.searchsorted(self.begin, starts), len(self.begin)) if len(starts) else np.zeros(1, np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(starts)), self.count)

    @property
    def hash(self) -> np.ndarray:
        return self.hashes(0)

    def hashes(self, lane: int) -> np.ndarray:
        """One of the two hashes of each word."""
        if lane not in self._hashes:
            self._hashes[lane] = self._hashed(*_LANES[lane][:2])
        return self._hashes[lane]

    def _hashed(self, start: np.uint64, factor: np.uint64) -> np.ndarray:
        size = self.end - self.begin
        state = mix(size.astype(U) * factor + start)
        if not len(size):
            return state
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = self.data if self.fold is SAME else self.fold[self.data]
        at_byte = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))  # eight bytes from each place
        state = mix(state ^ (at_byte[self.begin] & _KEEP[np.minimum(size, 8)]))
        rest = np.flatnonzero(size > 8)
        for k in range(8, _LONG, 8):
            if not len(rest):
                break
            state[rest] = mix(state[rest] * factor ^ (at_byte[self.begin[rest] + k] & _KEEP[np.minimum(size[rest] - k, 8)]))
            rest = rest[size[rest] > k + 8]
        for k in rest.tolist():
            tail = hashlib.blake2b(padded[self.begin[k] + _LONG : self.end[k]], digest_size=8, key=start.tobytes()).digest()
            state[k : k + 1] = mix(state[k : k + 1] * factor ^ np.frombuffer(tail, U))
        return state

    def room(self) -> np.ndarray:
        """Words from each word to its document's end, itself included."""
        return self.first[self.doc + 1] - np.arange(len(self.doc))


def join_hash(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    return mix(a * _K1 + mix(b + _LANES[lane][2]))


def rolling(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of h[i : i + n] at each i, by doubling; garbage in the last n - 1 places."""

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        return np.append(x[k:], np.zeros(min(k, len(x)), U))

    done, out, size, block = 0, None, 1, h
    while n:
        if n & 1:
            out = block if out is None else join_hash(out, ahead(block, done), lane)
            done += size
        n >>= 1
        if n:
            block = join_hash(block, ahead(block, size), lane)
            size *= 2
    return out


def sliding(f: np.ufunc, x: np.ndarray, n: int, pad: int) -> np.ndarray:
    """f over x[i : i + n] at each i, with pad beyond the end."""
    x = np.append(x, np.full(n - 1, pad, x.dtype))
    size = 1
    while size * 2 <= n:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of each text; a null is an empty text."""
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at[:-1] - at[0], at[1:] - at[0]


def slices(starts: np.ndarray, ends: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most `most` bytes, or of one document."""
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + most, side="right")))
        yield lo, min(hi, len(starts))
        lo = min(hi, len(starts))


def words_of(column: pa.Array | pa.ChunkedArray, word_bytes: np.ndarray, fold: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for runs of documents of a text column; a column's chunks aren't joined, so all may have over 2 GiB."""
    at = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        data, starts, ends = text_buffer(chunk)
        for lo, hi in slices(starts, ends):
            a, b = int(starts[lo]), int(ends[hi - 1])
            yield at + lo, at + hi, Words(data[a:b], starts[lo:hi] - a, ends[lo:hi] - a, word_bytes, fold)
        at += len(chunk)
