"""Vectorised scans of Arrow text columns: words, lines and their hashes, a megabyte at a time.

Words are the runs of bytes outside 0x20 and 0x09-0x0D; all separators are ASCII, so UTF-8 may be read by
bytes. Texts of a chunk lie one behind the other in one buffer, and no word or line crosses a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Chunks end after the text that reaches this many bytes, which bounds the memory of a scan.
CHUNK_BYTES = 1 << 20
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 2048

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


class Texts:
    """Some texts in one buffer, with their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    def __len__(self) -> int:
        return self.n

    @property
    def lanes(self) -> np.ndarray:
        """The eight bytes from each byte on, as one number; zeros lie behind the last."""
        if not hasattr(self, "_lanes"):
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        return self._lanes

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span: eight at a time, spread anew after each eight.

        It is no polynomial over the bytes, of which texts of two letters exist that collide at every base. Long
        spans are hashed by BLAKE2.
        """
        size = ends - starts
        out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
        todo = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
        at, left, value = starts[todo], size[todo], out[todo]
        while len(todo):
            lane = self.lanes[at]
            part = left < 8
            lane[part] &= (np.uint64(1) << (left[part].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            value = mix((value ^ lane) * np.uint64(0xC2B2AE3D27D4EB4F) + (value >> np.uint64(29)))
            more = left > 8
            if not more.all():
                out[todo[~more]] = value[~more]
                todo, at, left, value = todo[more], at[more], left[more], value[more]
            at, left = at + 8, left - 8
        for k in np.flatnonzero(size > LONG_SPAN):
            out[k] = np.frombuffer(blake2b(self.data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
        return out

    def joined(self, stay: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts made of their words, or of those that ``stay`` marks, joined by one space."""
        stay = np.arange(len(self.starts)) if stay is None else np.flatnonzero(stay)
        of = self.text[stay]
        last = np.ones(len(stay), bool)
        last[:-1] = of[1:] != of[:-1]
        edge = np.zeros(len(self.data) + 2, np.int8)
        edge[self.starts[stay]] += 1
        np.subtract.at(edge, self.ends[stay] + ~last, 1)  # each but a text's last word brings the separator behind it
        data = self.data.copy()
        data[self.ends[stay][~last]] = 0x20
        mask = np.cumsum(edge[:-2], dtype=np.int8).astype(bool)
        return data[mask], np.concatenate([[0], np.cumsum(self.sums(mask))])

    def sequence_prints(self) -> np.ndarray:
        """[text, 2]: 128 bits of BLAKE2 over each text's words."""
        data, offsets = self.joined()
        out = np.zeros((self.n, 2), np.int64)
        for k in range(self.n):
            out[k] = np.frombuffer(blake2b(data[offsets[k] : offsets[k + 1]].tobytes(), digest_size=16).digest(), np.int64)
        return out

    def find_words(self) -> None:
        """Set starts, ends, counts (words of each text), first (its first word) and text (of each word)."""
        word = ~_SEPARATOR[self.data]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(word))]
        begins[inner] = word[inner]
        stops[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        edges = np.searchsorted(self.starts, self.offsets)
        self.first, self.counts = edges[:-1], np.diff(edges)
        self.text = np.repeat(np.arange(self.n), self.counts)

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of a value for each byte."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def windows(texts: Texts, words: np.ndarray, length: int, base: int = 0xC2B2AE3D27D4EB4F) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words within a text, and the first word of each."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base |= 1
    if length <= 6:
        out = words[: n - length + 1].copy()
        for k in range(1, length):
            out = out * np.uint64(base) + words[k : n - length + 1 + k]
    else:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(base, n), out=total[1:])
        out = (total[length:] - total[:-length]) * powers(pow(base, -1, 1 << 64), n)[: n - length + 1]
    at = np.flatnonzero(texts.text[: n - length + 1] == texts.text[length - 1 :])
    return mix(out[at] + np.uint64(length)), at


def as_texts(column: pa.Array) -> Texts:
    """The values of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, texts) of parts of a column that hold about ``limit`` bytes each."""
    whole = as_texts(column)
    low = 0
    while low < whole.n:
        high = int(np.searchsorted(whole.offsets, whole.offsets[low] + limit))
        high = min(max(high, low + 1), whole.n)
        offsets = whole.offsets[low : high + 1]
        yield low, high, Texts(whole.data[offsets[0] : offsets[-1]], offsets - offsets[0])
        low = high
