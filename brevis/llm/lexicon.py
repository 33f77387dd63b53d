"""Blocks of texts as word indexes: what the word-based operators share in Python workers.

Words are maximal runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). Text is
handled in blocks of bounded size, and each distinct word of a block is looked at once.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are put together up to so many bytes and rows; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 1 << 14


@dataclass
class Lexicon:
    """``words[ids[bounds[d]:bounds[d + 1]]]`` are the words of text ``d``."""

    words: list[bytes]
    ids: np.ndarray
    bounds: np.ndarray

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices whose texts take about ``BLOCK_BYTES`` at most."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i - start == BLOCK_ROWS or (size and size + n > BLOCK_BYTES):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < len(lengths):
            yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return free blocks to the system: a worker lives on, and would hold the most that any of its
    tasks has taken."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text counts as an empty one."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def lexicon(texts: list[bytes]) -> Lexicon:
    index: dict[bytes, int] = {}
    seen = index.setdefault
    parts = []
    bounds = np.zeros(len(texts) + 1, np.int64)
    for d, raw in enumerate(texts):
        words = raw.split()
        bounds[d + 1] = bounds[d] + len(words)
        if words:
            parts.append(np.fromiter((seen(w, len(index)) for w in words), np.int32, len(words)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return Lexicon(list(index), ids, bounds)


def sum_by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between successive bounds; 0 for an empty text."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(9, 14), 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: An odd base of polynomials modulo 2**64 and its inverse.
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once; the arrays on the way take some 40 bytes for each.
_CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(n, np.uint64)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, ``A-Z`` lower-cased, and their bounds.

    A word's hash is a polynomial in its bytes, the difference of two prefix sums, so that all
    words of a chunk are hashed by a few array operations.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, starts = [], []
    lo = 0
    while lo < len(data):
        hi = min(lo + _CHUNK, len(data))
        while not _IS_SPACE[data[hi - 1]]:
            # a chunk ends with white space; the last byte of all is one
            tail = data[hi : hi + _CHUNK]
            blank = np.flatnonzero(_IS_SPACE[tail])
            hi += int(blank[0]) + 1 if len(blank) else len(tail)
        part = _LOWER[data[lo:hi]]
        space = np.concatenate([[True], _IS_SPACE[part]])
        first = np.flatnonzero(space[:-1] & ~space[1:])
        after = np.flatnonzero(~space[:-1] & space[1:])
        up, down = _powers(max(2 * _CHUNK, 1 << (len(part) - 1).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_OF_BYTE[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[after] - sums[first]) * down[first]))
        starts.append(first + lo)
        lo = hi
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.searchsorted(np.concatenate(starts or [np.zeros(0, np.int64)]), begin)


def lower_case(lex: Lexicon) -> tuple[Lexicon, list[str]]:
    """``lex`` by words in lower case, and these words as strings."""
    index: dict[str, int] = {}
    own = [index.setdefault(w, len(index)) for w in (b" ".join(lex.words).decode("utf-8", "replace").lower().split(" ") if lex.words else ())]
    return Lexicon([w.encode() for w in index], np.array(own, np.int32)[lex.ids], lex.bounds), list(index)


def word_grams(words: list[bytes] | list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word between blanks, of bytes or of the code points of strings, as
    (word index, bucket), by word index."""
    if words and isinstance(words[0], str):
        buf = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    else:
        buf = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    blank = np.cumsum(buf == 32)
    owner, bucket = [], []
    for n in orders:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + buf[k : k + m] + np.uint64(1)
        inner = blank[n - 2 : n - 2 + m] - blank[:m] if n > 2 else np.zeros(m, np.int64)
        ok = inner == 0
        if n <= 2:
            ok &= ~((buf[:m] == 32) & (buf[n - 1 : n - 1 + m] == 32))
        # a gram that starts at a blank belongs to the word after it
        at = np.flatnonzero(ok)
        owner.append((blank[at] - 1).astype(np.int64))
        bucket.append((mix(h[at]) & np.uint64((1 << bits) - 1)).astype(np.int64))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    keep = owner < len(words)
    owner, bucket = owner[keep], bucket[keep]
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]
