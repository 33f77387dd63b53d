"""Vector quantizers over matrices (rows are vectors); codes are rows of bytes."""

from __future__ import annotations

from functools import lru_cache
from typing import Protocol

import numpy as np


class Quantizer(Protocol):
    name: str

    def bytes_per(self, dim: int) -> int: ...

    def encode(self, x: np.ndarray) -> np.ndarray: ...

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Similarities, one row per query."""


class Int8:
    name = "int8"

    def bytes_per(self, dim: int) -> int:
        return dim

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.floor(np.clip(x, -1, 1) * 127 + 0.5).astype(np.int8).view(np.uint8)

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return queries @ (codes.view(np.int8) / 127.0).T


class Binary:
    name = "binary"

    def bytes_per(self, dim: int) -> int:
        return -(-dim // 8)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x >= 0, axis=1, bitorder="little")

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        width = codes.shape[1] * 8
        bits = np.unpackbits(codes, axis=1, bitorder="little") * 2.0 - 1
        # beyond the query's length a query bit counts as set, a stored one is not
        signs = np.ones((len(queries), width))
        signs[:, : queries.shape[1]] = np.where(queries >= 0, 1, -1)
        return (signs @ bits.T + width) / (2 * width)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of every row; the first of equals."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        distance = np.zeros((len(part), len(centroids)))
        for k in range(x.shape[1]):
            distance += (part[:, k, None] - centroids[None, :, k]) ** 2
        out[at : at + 2048] = distance.argmin(axis=1)
    return out


def lloyd(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids after so many rounds from evenly spaced rows; an empty cluster stays put."""
    centroids = x[(np.arange(k) * len(x) // k) % len(x)].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(x, centroids)
        size = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], minlength=k) for d in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((k, 0))
        full = size > 0
        centroids[full] = sums[full] / size[full, None]
    return centroids


class Product:
    """Product quantization: a codebook for each of ``subvectors`` slices, one byte each."""

    name = "product"

    def __init__(self, subvectors: int = 8, centroids: int = 256, rounds: int = 12):
        if centroids > 256:
            raise ValueError("a code is one byte: at most 256 centroids")
        self.m, self.k, self.rounds, self.books = subvectors, centroids, rounds, None

    def train(self, x: np.ndarray) -> Product:
        if not len(x):
            raise ValueError("no vectors to train on")
        self.books = [lloyd(part, min(self.k, len(x)), self.rounds) for part in np.array_split(np.asarray(x, np.float64), self.m, axis=1)]
        return self

    def _books(self) -> list[np.ndarray]:
        if self.books is None:
            raise ValueError("train first")
        return self.books

    def bytes_per(self, dim: int) -> int:
        return self.m

    def encode(self, x: np.ndarray) -> np.ndarray:
        books = self._books()
        return np.stack([_nearest(part, book) for part, book in zip(np.array_split(x, self.m, axis=1), books, strict=True)], axis=1).astype(np.uint8)

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        books = self._books()
        tables = [part @ book.T for part, book in zip(np.array_split(queries, self.m, axis=1), books, strict=True)]
        return sum(t[:, codes[:, j]] for j, t in enumerate(tables))


@lru_cache(maxsize=32)
def beta_centroids(dim: int, levels: int) -> np.ndarray:
    """Lloyd-Max levels of a coordinate of a random unit vector."""
    reach = min(1.0, 6 / np.sqrt(max(dim, 1)))
    x = -reach + 2 * reach * np.arange(8000) / 7999
    weight = np.where(1 - x * x > 0, np.maximum(1 - x * x, 0) ** ((dim - 3) / 2), 0)
    c = -reach + 2 * reach * (np.arange(levels) + 0.5) / levels
    for _ in range(25):
        own = np.abs(x[:, None] - c).argmin(axis=1)
        mass = np.bincount(own, weight, minlength=levels)
        c = np.where(mass > 0, np.bincount(own, x * weight, minlength=levels) / np.where(mass > 0, mass, 1), c)
    return np.sort(c)


@lru_cache(maxsize=64)
def random_signs(n: int, seed: int) -> np.ndarray:
    """-1 where a 32-bit xorshift generator's low bit is set."""
    s, out = (seed | 1) & 0xFFFFFFFF, np.ones(n, np.float32)
    for i in range(n):
        for shift in (13, -17, 5):
            s ^= (s << shift if shift > 0 else s >> -shift) & 0xFFFFFFFF
        if s & 1:
            out[i] = -1
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row, in single precision."""
    n, width = x.shape[1], 1
    while width < n:
        pairs = x.reshape(len(x), -1, 2, width)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        width *= 2
    return x


_GOLDEN, _OTHER = 0x9E3779B9, 0x85EBCA6B
MAX_DIM = 16384


class Rotation:
    """Rotated scalar quantization: ``bits - 1`` bits per rotated coordinate and one sign bit of
    the rotated residual. ``unbiased`` scales the residual term for an orthonormal rotation."""

    name = "rotation"

    def __init__(self, bits: int = 2, seed: int = _GOLDEN, rounds: int = 3, unbiased: bool = False):
        if bits not in (2, 3, 4):
            raise ValueError("bits: 2, 3 or 4")
        self.bits, self.seed, self.rounds, self.unbiased = bits, seed & 0xFFFFFFFF, rounds, unbiased
        self.sign_seed = self.seed ^ _OTHER

    @staticmethod
    def width(dim: int) -> int:
        return 1 << max(0, dim - 1).bit_length()

    def bytes_per(self, dim: int) -> int:
        d = self.width(dim)
        return 8 + -(-d * (self.bits - 1) // 8) + -(-d // 8)

    def rotate(self, x: np.ndarray, seed: int, rounds: int, back: bool = False) -> np.ndarray:
        d = self.width(x.shape[1])
        if d > MAX_DIM:
            raise ValueError(f"at most {MAX_DIM} dimensions")
        out = np.zeros((len(x), d), np.float32)
        out[:, : x.shape[1]] = x
        scale = np.float32(1 / np.sqrt(d))
        turns = [(seed + r * _GOLDEN) & 0xFFFFFFFF for r in range(rounds)]
        for s in reversed(turns) if back else turns:
            out = hadamard(out) * scale * random_signs(d, s) if back else hadamard(out * random_signs(d, s)) * scale
        return out

    def encode(self, x: np.ndarray) -> np.ndarray:
        d, n = self.width(x.shape[1]), len(x)
        norm = np.sqrt((np.asarray(x, np.float64) ** 2).sum(axis=1))
        norm = np.where(norm == 0, 1, norm)
        levels = beta_centroids(d, 1 << (self.bits - 1))
        y = self.rotate(x, self.seed, self.rounds)
        code = np.abs((y / norm[:, None])[:, :, None] - levels).argmin(axis=2)
        rest = (y - levels[code] * norm[:, None]).astype(np.float32)
        rest_norm = np.sqrt((rest.astype(np.float64) ** 2).sum(axis=1))
        sign = self.rotate(rest, self.sign_seed, 1) >= 0
        planes = (code[:, :, None] >> np.arange(self.bits - 1)) & 1
        head = np.stack([norm, rest_norm], axis=1).astype("<f4").view(np.uint8).reshape(n, 8)
        bits = np.concatenate([planes.reshape(n, -1), sign], axis=1)
        return np.concatenate([head, np.packbits(bits.astype(bool), axis=1, bitorder="little")], axis=1)

    def _parts(self, codes: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        head = np.ascontiguousarray(codes[:, :8]).view("<f4").astype(np.float64)
        bits = np.unpackbits(codes[:, 8:], axis=1, bitorder="little")
        cut = d * (self.bits - 1)
        code = (bits[:, :cut].reshape(len(codes), d, -1).astype(np.int64) << np.arange(self.bits - 1)).sum(axis=2)
        return head[:, 0], head[:, 1], beta_centroids(d, 1 << (self.bits - 1))[code], bits[:, cut : cut + d] * 2.0 - 1

    def _factor(self, d: int) -> float:
        return float(np.sqrt(np.pi / 2) / (np.sqrt(d) if self.unbiased else d))

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        d = self.width(queries.shape[1])
        norm, rest_norm, levels, signs = self._parts(codes, d)
        y = self.rotate(queries, self.seed, self.rounds)
        s = self.rotate(y, self.sign_seed, 1)
        return (y.astype(np.float64) @ levels.T) * norm + self._factor(d) * (s.astype(np.float64) @ signs.T) * rest_norm

    def decode(self, codes: np.ndarray, dim: int) -> np.ndarray:
        d = self.width(dim)
        norm, rest_norm, levels, signs = self._parts(codes, d)
        y = (levels * norm[:, None]).astype(np.float32)
        y += (self._factor(d) * rest_norm[:, None] * self.rotate(signs, self.sign_seed, 1, back=True)).astype(np.float32)
        return self.rotate(y, self.seed, self.rounds, back=True)[:, :dim]
