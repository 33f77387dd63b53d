"""SentencePiece encoding and decoding as a weighted finite-state transduction.

The model file is compiled into four machines over the tropical semiring (weights add along a
path, the smallest sum wins):

* a normaliser: the model's character map, whose arcs read the longest source that it knows and
  write its replacement, all other characters writing themselves; user-defined pieces pass as they
  are; then blanks are squeezed, marked and preceded by the dummy prefix as the model says;
* the piece machine, a trie of all pieces whose final arcs emit piece ids;
* a fallback arc for every character without a piece of its own, which emits its UTF-8 byte pieces,
  or, in a model without these, the unknown piece, once for a run of such characters;
* a pair acceptor over emitted pieces. For BPE models it gives a pair of neighbours weight 0 where
  merging their joined characters by priority restores exactly this pair, else infinity: a
  sequence is the BPE segmentation exactly if all its neighbours are. For unigram models it
  accepts all, and piece arcs weigh the negative score; a user-defined piece is always taken, and
  unused ones never.

An input is composed with the machines lazily: a state is a position with the piece before it, and
the shortest path to the end is the encoding. With weights of 0 and infinity any path of weight 0 is
a shortest one, so BPE's search goes depth first; a unigram model's states are met in the order of
their positions. Where no piece holds a character before a blank mark, runs between such places are
composed on their own, and BPE's paths remembered. BPE pieces that are unused are parted into those
that make them.

Defined results: a null or empty text has no ids; under a model without character map and squeezing,
decoding restores a text exactly unless it holds the blank mark itself (U+2581), which comes back as
a blank. Repeated rows are encoded each on its own; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brevis.llm.lexicon import blocks
from brevis.session import ship_package

BLANK = "▁"
#: Paths that a worker remembers, once as the young and once as the old half.
REMEMBERED = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


def _single(x: float) -> float:
    """``x`` rounded to single precision."""
    return struct.unpack("<f", struct.pack("<f", x))[0]


_NONE: dict[str, tuple] = {}


def _trie(words: dict[str, int]) -> dict[str, tuple]:
    """character -> (value or -1, states after it), from words in any order."""
    after: dict[str, dict] = {}
    for word in words:
        node = after
        for c in word:
            node = node.setdefault(c, {})

    def states(node: dict, prefix: str) -> dict[str, tuple]:
        return {c: (words.get(prefix + c, -1), states(x, prefix + c)) for c, x in node.items()} if node else _NONE

    return states(after, "")


class Normaliser:
    """The compiled character map (a double-array trie over UTF-8 bytes) and the blank rules."""

    def __init__(self, charsmap: bytes, user: list[str], prefix: bool, squeeze: bool, blank: str):
        size = struct.unpack_from("<I", charsmap)[0] if charsmap else 0
        self.units = np.frombuffer(charsmap, "<u4", size // 4, 4 if charsmap else 0).tolist()
        self.pool = charsmap[4 + size :]
        self.user = re.compile("|".join(map(re.escape, sorted(user, key=len, reverse=True)))) if user else None
        self.prefix, self.squeeze, self.blank = prefix, squeeze, blank
        self.known: dict[str, bool] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    def arc(self, raw: bytes) -> tuple[int, str] | None:
        """(bytes read, what is written) by the longest arc at the beginning of ``raw``."""
        units, found = self.units, None
        at = self._offset(units[0])
        for k, byte in enumerate(raw):
            at ^= byte
            unit = units[at]
            if unit & 0x800000FF != byte:
                break
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[at] & 0x7FFFFFFF
                found = k + 1, self.pool[start : self.pool.index(b"\0", start)].decode()
        return found

    def begins(self, c: str) -> bool:
        """Whether an arc may begin with a character, so that it cannot simply be copied."""
        if c not in self.known:
            units, at, whole = self.units, self._offset(self.units[0]), True
            for byte in c.encode():
                at ^= byte
                unit = units[at]
                if unit & 0x800000FF != byte:
                    whole = False
                    break
                at ^= self._offset(unit)
            self.known[c] = whole
        return self.known[c]

    def mapped(self, text: str) -> str:
        if not self.units:
            return text
        special = "".join(c for c in set(text) if self.begins(c))
        if not special:
            return text
        out, at = [], 0
        for m in re.finditer(f"[{re.escape(special)}]", text):
            if m.start() < at:
                continue
            # no source of the map is longer than a few dozen bytes
            arc = self.arc(text[m.start() : m.start() + 64].encode())
            if arc:
                read = len(text[m.start() : m.start() + 64].encode()[: arc[0]].decode())
                out += [text[at : m.start()], arc[1]]
                at = m.start() + read
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        if self.user:
            parts, at = [], 0
            for m in self.user.finditer(text):
                parts += [self.mapped(text[at : m.start()]), m.group()]
                at = m.end()
            text = "".join([*parts, self.mapped(text[at:])])
        else:
            text = self.mapped(text)
        if self.squeeze:
            text = re.sub("  +", " ", text.strip(" "))
        if not text:
            return ""
        return (self.blank if self.prefix else "") + text.replace(" ", self.blank)


class Transducer:
    """The compiled model; :meth:`encode` and :meth:`decode` work on whole texts."""

    def __init__(self, model: bytes):
        self.surface: list[str] = []
        self.kind: list[int] = []
        self.score: list[float] = []
        algorithm, dummy_prefix, squeeze, escape, charsmap, as_suffix, mark = UNIGRAM, True, True, True, b"", False, " ⁇ "
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.surface.append(piece[1].decode())
                self.score.append(struct.unpack("<f", piece[2])[0])
                self.kind.append(piece[3])
            elif number == 2:
                spec = dict(_fields(value))
                algorithm, as_suffix, mark = spec.get(3, UNIGRAM), spec.get(24, 0), spec.get(44, mark.encode()).decode()
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, dummy_prefix, squeeze, escape = spec.get(2, b""), spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)
        if algorithm not in (UNIGRAM, BPE) or as_suffix:
            raise ValueError("only unigram and BPE models with blanks before words are compiled")
        self.bpe = algorithm == BPE
        self.blank, self.prefix, self.squeeze = BLANK if escape else " ", bool(dummy_prefix), bool(squeeze)
        user = [s for s, k in zip(self.surface, self.kind, strict=True) if k == USER]
        self.normalise = Normaliser(charsmap, user, self.prefix, self.squeeze, self.blank)
        self.piece = {s: i for i, s in enumerate(self.surface) if self.kind[i] in (NORMAL, USER, UNUSED)}
        self.unknown = self.kind.index(UNKNOWN)
        normal = [x for x, k in zip(self.score, self.kind, strict=True) if k == NORMAL] or [0.0]
        # the library's starting value for the greatest score is the least positive one
        self.worst, self.greatest = _single(min(normal) - 10.0), max(*normal, 1.1754943508222875e-38)
        self.byte_id = {int(s[3:5], 16): i for i, s in enumerate(self.surface) if self.kind[i] == BYTE}
        # the bytes that each piece stands for
        self.written = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else (mark if k == UNKNOWN else p.replace(BLANK, " ")).encode() for p, k in zip(self.surface, self.kind, strict=True)]
        # the piece machine: by character, (the piece that ends there or -1, the states after it)
        arcs = {s: i for s, i in self.piece.items() if self.kind[i] == NORMAL or self.kind[i] == (UNUSED if self.bpe else USER)}
        self.trie, self.longest = _trie(arcs), max(map(len, arcs), default=1)
        self.some_unused = UNUSED in self.kind
        self.frozen = re.compile("(" + "|".join(map(re.escape, sorted(user, key=len, reverse=True))) + ")") if user and self.bpe else None
        if any(self.blank in s.lstrip(self.blank) for s in self.piece):
            # a piece crosses from a word into a blank
            self.runs = re.compile("(?s).+")
        else:
            # characters without a piece part the input as well, if they are bytes: nothing joins across them
            apart = "".join(c for c in "\n\t\r" if not any(c in s for s in self.piece)) if self.byte_id else ""
            self.runs = re.compile(f"[{apart}]|{self.blank}*[^{self.blank}{apart}]+|{self.blank}+" if apart else f"{self.blank}*[^{self.blank}]+|{self.blank}+")
        self.pairs: dict[tuple[int, int], float] = {}
        self.paths: dict[str, bytes] = {}
        self.old_paths: dict[str, bytes] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}

    def parts(self, p: int) -> tuple[int, int] | None:
        """The two pieces whose joining made ``p``, or None if ``p`` is one character.

        Characters are joined by priority, the leftmost of equals first. A piece that this never
        arrives at is parted into (-1, -1).
        """
        if p not in self.made_of:
            parts = list(self.surface[p])
            while len(parts) > 2:
                best, at = -np.inf, -1
                for k in range(len(parts) - 1):
                    joined = self.piece.get(parts[k] + parts[k + 1])
                    if joined is not None and self.score[joined] > best:
                        best, at = self.score[joined], k
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            sides = [self.piece.get(x, -1) for x in parts]
            self.made_of[p] = None if len(sides) == 1 else tuple(sides) if len(sides) == 2 and min(sides) >= 0 else (-1, -1)
        return self.made_of[p]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether joining by priority never joins across the border of two pieces.

        The joinings that made the two pieces are undone from the last one back. At each point the
        pieces at the border must not have had a joining of their own that came before the one
        just undone; of equal priorities the one further left comes first.
        """
        until, equal_counts = np.inf, False
        while True:
            across = self.piece.get(self.surface[left] + self.surface[right])
            if across is not None:
                rank = -self.score[across]
                if rank < until or (equal_counts and rank == until):
                    return False
            of_left, of_right = self.parts(left), self.parts(right)
            if of_left is None and of_right is None:
                return True
            if (-1, -1) in (of_left, of_right):
                return False
            if of_right is None or (of_left is not None and self.score[left] < self.score[right]):
                until, equal_counts, left = -self.score[left], False, of_left[1]
            else:
                until, equal_counts, right = -self.score[right], True, of_right[0]

    def pair(self, left: int, right: int) -> float:
        """Weight of ``right`` after ``left`` (-1: the start or an unknown character)."""
        key = (left, right)
        weight = self.pairs.get(key)
        if weight is None:
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            good = self.parts(right) != (-1, -1) and (left < 0 or self.stays_apart(left, right))
            weight = self.pairs[key] = 0.0 if good else np.inf
        return weight

    def arcs(self, run: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs that leave a position, shortest first; -1: bytes."""
        children, out, end = self.trie, [], at
        for c in run[at : at + self.longest]:
            state = children.get(c)
            if state is None:
                break
            end += 1
            p, children = state
            if p >= 0:
                out.append((end, p))
        if not out or out[0][0] > at + 1:
            out.insert(0, (at + 1, -1))
        return out

    def accepted(self, run: str) -> list[tuple[int, int]]:
        """The path of weight 0 under a pair acceptor, as (end, piece), found depth first.

        Arcs weigh 0 or infinity, so the first complete path is a shortest one. At most one
        accepted path leads to a position, so a position that led nowhere is not entered again.
        """
        known, pair, n = self.pairs.get, self.pair, len(run)
        path: list[tuple[int, int]] = []
        open_arcs = [self.arcs(run, 0)]
        dead = set()
        while len(open_arcs[-1]) or path:
            before = path[-1][1] if path else -1
            arcs = open_arcs[-1]
            while arcs:
                end, p = arcs.pop()
                if dead and end in dead:
                    continue
                if p >= 0:
                    weight = known((before, p))
                    if weight is None:
                        weight = pair(before, p)
                    if weight:
                        continue
                path.append((end, p))
                if end == n:
                    return path
                open_arcs.append(self.arcs(run, end))
                break
            else:
                open_arcs.pop()
                dead.add(path.pop()[0])
        raise ValueError("no path")

    def ids_on(self, run: str, path: list[tuple[int, int]]) -> bytes:
        """Ids that a path through a normalised run emits, little-endian unsigned 32-bit."""
        ids: list[int] = [p for _, p in path]
        if not self.some_unused and min(ids) >= 0:
            return struct.pack(f"<{len(ids)}I", *ids)
        ids, at = [], 0
        for end, p in path:
            if p >= 0:
                self.used(p, ids)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in run[at:end].encode())
            else:
                ids.append(self.unknown)
            at = end
        return np.array(ids, "<u4").tobytes()

    def used(self, p: int, ids: list[int]) -> None:
        """Append ``p``, or, if it is unused, the pieces that make it."""
        parts = self.parts(p) if self.kind[p] == UNUSED else None
        if not parts or -1 in parts:
            ids.append(p)
        else:
            self.used(parts[0], ids)
            self.used(parts[1], ids)

    def cheapest(self, run: str, start: float) -> tuple[list[tuple[int, int]], float]:
        """The path of least weight under a model whose arcs weigh, as (end, piece), and the sum up to
        its end. Sums are scores, the negative weights, rounded to single precision at every position
        as in the library; of equal paths to a position the one met first, from the leftmost start by
        the shortest arc, the fallback arc last."""
        n = len(run)
        total: list[float] = [start] + [-np.inf] * n
        last, origin = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            arcs = self.arcs(run, i)
            for j, p in arcs[1:] + arcs[:1] if arcs[0][1] < 0 else arcs:
                if p < 0:
                    score = self.worst
                elif self.kind[p] == USER:
                    score = _single(len(run[i:j].encode()) * self.greatest - 0.1)
                else:
                    score = self.score[p]
                new = _single(total[i] + score)
                if new > total[j]:
                    total[j], last[j], origin[j] = new, p, i
        path, at = [], n
        while at:
            path.append((at, last[at]))
            at = origin[at]
        return path[::-1], total[n]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        text = self.normalise(text)
        if not text:
            return b""
        out = []
        for part in self.frozen.split(text) if self.frozen else (text,):
            if self.frozen and part and self.frozen.fullmatch(part):
                out.append(struct.pack("<I", self.piece[part]))
            elif part:
                out += self.encoded_runs(part)
        ids = b"".join(out)
        if self.byte_id:
            return ids
        # neighbouring unknown characters are one
        x = np.frombuffer(ids, "<u4")
        again = np.zeros(len(x), bool)
        again[1:] = (x[1:] == self.unknown) & (x[:-1] == self.unknown)
        return x[~again].tobytes()

    def encoded_runs(self, text: str) -> list[bytes]:
        if not self.bpe:
            out, total = [], 0.0
            for run in self.runs.findall(text):
                path, total = self.cheapest(run, total)
                out.append(self.ids_on(run, path))
            return out
        if len(self.paths) > REMEMBERED:
            # paths used since the last turn are found again among the old ones
            self.paths, self.old_paths = {}, self.paths
        runs = self.runs.findall(text)
        found = list(map(self.paths.get, runs))
        if None in found:
            for k, run in enumerate(runs):
                if found[k] is None:
                    # it may have come before in this text
                    path = self.paths.get(run) or self.old_paths.get(run) or self.ids_on(run, self.accepted(run))
                    if len(run) <= 64:
                        self.paths[run] = path
                    found[k] = path
        return found

    def decode(self, ids: list[int]) -> str:
        out, at = [], 0
        while (self.prefix or self.squeeze) and at < len(ids):
            i = ids[at]
            if self.kind[i] == NORMAL or self.kind[i] == USER or self.kind[i] == UNUSED:
                piece = self.surface[i]
                if not piece.startswith(BLANK):
                    break
                # the dummy prefix; if blanks are squeezed, all blanks before the first word
                out.append(piece[1:].replace(BLANK, " ").encode())
            elif self.kind[i] != CONTROL:
                break
            at += 1
            if self.kind[i] != CONTROL and not (self.squeeze and out[-1] == b""):
                break
        return b"".join([*out, *map(self.written.__getitem__, ids[at:] if at else ids)]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, n_byte_pieces, restored``: the encoding of every whole text (binary,
    little-endian unsigned 32-bit) and whether decoding it gives the text again."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        is_byte = np.array([k == BYTE for k in machine.kind])
        for b in blocks(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = [machine.encode(t) for t in texts]
            numbers = [np.frombuffer(x, "<u4") for x in ids]
            restored = [machine.decode(x.tolist()) == t for x, t in zip(numbers, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([int(is_byte[x].sum()) for x in numbers], pa.int64()), pa.array(restored)],
                ["doc_id", "ids", "n_byte_pieces", "restored"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n_byte_pieces bigint, restored boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of encoded rows (``doc_id, ids``); null ids give a null text."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for b in batches:
            texts = [None if x is None else machine.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
