"""Packed arrays that are dealt between tasks, and the packages of texts that they come from.

A *package* is the texts that one task gathers before it deals what it counted; a text is known by its
package and its place there. What is found elsewhere goes to the package's *home*, one bucket.
"""

from __future__ import annotations

import numpy as np

from brevis.llm.lexicon import mix


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of numbers, byte by byte."""
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(block: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), "u1")
    out[:, :width] = np.frombuffer(block, "u1", n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


class Writer:
    """Arrays of whole numbers put one after another, each with as many bytes as its greatest needs."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def put(self, x: np.ndarray) -> None:
        width = -(-int(x.max(initial=0)).bit_length() // 8)
        self.parts += [np.array([len(x), width], "<u4").tobytes(), planes(x, width)]

    def raw(self, x: np.ndarray) -> None:
        self.parts += [np.array([len(x), 8], "<u4").tobytes(), x.astype("<f8").tobytes()]

    def block(self) -> bytes:
        return b"".join(self.parts)


class Reader:
    def __init__(self, block: bytes):
        self.data, self.at = block, 0

    def _head(self) -> tuple[int, int]:
        n, width = np.frombuffer(self.data, "<u4", 2, self.at).tolist()
        self.at += 8
        return n, width

    def get(self) -> np.ndarray:
        n, width = self._head()
        self.at += n * width
        return from_planes(self.data, n, width, self.at - n * width)

    def raw(self) -> np.ndarray:
        n, _ = self._head()
        self.at += 8 * n
        return np.frombuffer(self.data, "<f8", n, self.at - 8 * n)


def home(package: int, parts: int) -> int:
    return int(mix(np.array([package], np.uint64))[0] % np.uint64(parts))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def lengths_of(starts: np.ndarray, end: int) -> np.ndarray:
    return np.diff(np.append(starts, end))
