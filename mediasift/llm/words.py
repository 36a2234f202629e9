"""Words of a batch of texts as arrays: places, hashes, windows.

Works on the UTF-8 bytes of an Arrow string column; no Python object per word.
A hash takes in eight bytes at a time and mixes them over all bits, so that no pattern
of letters makes two words meet; different words of one length up to eight bytes never do.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
#: Longer stretches of bytes are hashed one by one.
_LONG = 128

#: Texts are taken together up to so many bytes; one longer text is taken alone.
BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Texts:
    """Bytes of some texts, one after the other; text i is ``data[offsets[i]:offsets[i+1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self, marks: np.ndarray) -> np.ndarray:
        """Per text, how many bytes are marked."""
        return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[self.offsets])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64 bits for each stretch of bytes, eight bytes at a time into a mixed state; long ones by BLAKE2."""
        data = _LOWER[self.data] if lower else self.data
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the number in the bytes from each place on
        size = ends - starts
        out = mix(size.astype(U64) * _STEP + U64(1))
        todo, done = np.flatnonzero((size > 0) & (size <= _LONG)), 0
        while len(todo):
            left, part = size[todo] - done, eight[starts[todo] + done]
            short = left < 8
            part[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
            out[todo] = mix((out[todo] ^ part) * _STEP)
            todo, done = todo[left > 8], done + 8
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the first word of each text (and the number of all)."""
        inside = ~BLANK[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = self.offsets[:-1][np.diff(self.offsets) > 0]
        first[edges] |= inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def batches(texts: pa.Array) -> list[tuple[int, Texts]]:
    """The column in slices of about ``BYTES``; null is empty. With the row each begins at."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return []
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out, row = [], 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BYTES, "right")) - 1)
        end = min(end, len(texts))
        out.append((row, Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])))
        row = end
    return out


def windows(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words that stay inside a text, and the text of each.
    ``firsts``: first word of each text and the number of all."""
    counts = np.maximum(np.diff(firsts) - size + 1, 0)
    of = np.repeat(np.arange(len(counts)), counts)
    at = firsts[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    total = np.zeros(len(at), U64)
    for k in range(size):
        total = total * _STEP + hashes[at + k]
    return mix(total), of


def within(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Values that differ where their texts differ."""
    return mix(values + of.astype(U64) * U64(0xD1342543DE82EF95))
