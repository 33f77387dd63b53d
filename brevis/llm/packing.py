"""Best-fit packing of tokenised documents by exact-complement hashing.

How pieces fill sequences depends on their lengths alone, so the plan is made on the histogram of
lengths (``capacity`` entries at most, whatever the number of documents): from the longest piece
down, the gap that a piece leaves is looked up in an index of single, pair and triple length
sums, and a combination that fills it exactly is consumed as often as the counts allow. Each step
uses up at least one length, which then leaves the index. What has no exact complement is packed
best-fit, longest first, again length by length; if best fit alone needs fewer sequences for all
lengths, its plan stands. The plan, a list of (pattern, times), is then dealt to the pieces: pieces of a
length are numbered, and a number tells pattern, sequence and offset.

Numbering pieces of a length never gathers them: each piece belongs to one of many slices by its
document's hash, slices are counted by length, and a piece's number is its rank within (slice,
length) plus the counts of earlier slices.

Defined results: a null text is packed as an empty one, which still has its end token; repeated
rows are packed each on its own (a document identifier should be unique: pieces of repeated
identifiers are dealt in any order among themselves, so such rows keep whole results). Columns
other than identifier and text are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevis.llm.lexicon import blocks
from brevis.session import ship_package, staged

CAPACITY = 1024
END_ID = 2


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """A byte-level BPE tokenizer from its ``tokenizers`` file, run by the faster of two libraries.

    The file's vocabulary, merge order and added tokens are used as they are; ids equal those of
    ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path}: a byte-level BPE tokenizer without normaliser or prefix space is needed")
    # the printable stand-ins of bytes: printable Latin-1 for itself, the others from U+0100 on
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    # Fixed value: the split pattern of byte-level BPE
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


#: A run of white space that the split pattern's look-ahead would try from every place; its engine
#: gives up on longer ones. The characters are those of the pattern's class.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def encode(text: str, path: str) -> np.ndarray:
    tokenizer = load_tokenizer(path)
    plain = lambda t: tokenizer.encode_to_numpy(t, allowed_special="all", disallowed_special=())
    parts, at = [], 0
    for m in _LONG_BLANK.finditer(text):
        # as the pattern parts it: a run is one piece, but for its last character before a word
        last = m.end() == len(text) or any(text.startswith(t, m.end()) for t in tokenizer.special_tokens_set)
        end = m.end() if last else m.end() - 1
        parts += [plain(text[at : m.start()]), np.array(tokenizer._encode_single_piece(text[m.start() : end]), np.uint32)]  # noqa: SLF001
        at = end
    return np.concatenate([*parts, plain(text[at:])]) if parts else plain(text)


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's ids and ``end_id``, cut where longer
    than ``capacity``. Only the first piece of a document may be shorter than ``capacity``.
    ``ids`` is binary, little-endian unsigned 32-bit."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            rows, piece, start, ids = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                tokens = np.append(encode(text or "", tokenizer), end_id).astype("<u4")
                first = (len(tokens) - 1) % capacity + 1
                cuts = [0, *range(first, len(tokens), capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(tokens)], strict=True)):
                    rows.append(i)
                    piece.append(k)
                    start.append(lo)
                    ids.append(tokens[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


class Sums:
    """Index of the sums of one, two and three available lengths, up to ``capacity``.

    ``two[s]`` marks the lengths that another one completes to ``s``, ``three[s]`` those that a sum
    of two completes. A length that is used up leaves all sums that it was part of.
    """

    def __init__(self, lengths: list[int], capacity: int):
        size = capacity + 1
        self.one = np.zeros(size, bool)
        self.one[lengths] = True
        self.two, self.three = np.zeros((size, size), bool), np.zeros((size, size), bool)
        for n in lengths:
            self.two[n:, n] = self.one[: size - n]
        self.pairs = self.two.any(axis=1)
        for n in lengths:
            self.three[n:, n] = self.pairs[: size - n]

    def remove(self, n: int) -> None:
        size = len(self.one)
        self.one[n] = False
        self.two[:, n] = False
        self.two[np.arange(n, size), np.arange(size - n)] = False
        self.three[:, n] = False
        pairs = self.two.any(axis=1)
        for s in np.flatnonzero(self.pairs & ~pairs):
            self.three[np.arange(s, size), np.arange(size - s)] = False
        self.pairs = pairs

    def fills(self, gap: int) -> Iterator[tuple[int, ...]]:
        """Combinations of the sum ``gap``: fewest lengths first, then the longest first."""
        if self.one[gap]:
            yield (gap,)
        down = lambda row: np.flatnonzero(row)[::-1].tolist()
        for x in down(self.two[gap]):
            if 2 * x < gap:
                break
            yield x, gap - x
        for x in down(self.three[gap]):
            if 3 * x < gap:
                break
            for y in down(self.two[gap - x, : x + 1]):
                if 2 * y < gap - x:
                    break
                yield x, y, gap - x - y


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the tightest gap; open sequences are grouped by what they hold."""
    out: list[tuple[tuple[int, ...], int]] = []
    gaps: list[int] = []
    open_: dict[int, list[list]] = {}

    def add(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap <= 0:
            out.append((pattern, times))
            return
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append([pattern, times])

    for n in sorted(counts, reverse=True):
        count = counts[n]
        while count:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                per = capacity // n
                if count // per:
                    add((n,) * per, count // per)
                count -= count // per * per
                if count:
                    add((n,) * count, 1)
                    count = 0
                break
            gap = gaps[at]
            pattern, times = open_[gap][-1]
            m = min(count, times)
            if m == times:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            else:
                open_[gap][-1][1] -= m
            add((*pattern, n), m)
            count -= m
    return out + [(tuple(p), t) for groups in open_.values() for p, t in groups]


def _complements(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements from the longest length down, then best fit of what has none."""
    left, residual = counts.copy(), Counter()
    index = Sums(list(left), capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    for n in sorted(left, reverse=True):
        while left[n]:
            used = None
            if n < capacity:
                fits = (Counter((n, *fill)) for fill in index.fills(capacity - n))
                used = next((u for u in fits if all(left[m] >= k for m, k in u.items())), None)
            else:
                used = Counter((n,))
            if used is None:
                residual[n] = left[n]
                left[n] = 0
                index.remove(n)
                break
            times = min(left[m] // k for m, k in used.items())
            rest = used - Counter((n,))
            out.append(((n, *sorted(rest.elements(), reverse=True)), times))
            for m, k in used.items():
                left[m] -= k * times
                if not left[m]:
                    index.remove(m)
    return out + _best_fit(residual, capacity)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), using every counted piece once. Where best
    fit alone needs fewer sequences than with complements taken first, its plan is taken."""
    whole = Counter({int(n): int(c) for n, c in counts.items() if c > 0})
    plans = _complements(whole, capacity), _best_fit(whole, capacity)
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first number, times, first sequence, offset) of the plan."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for n in pattern:
            rows.setdefault(n, []).append((used[n], times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``. ``pieces`` should be a stored table, as it is read
    twice: for the counts and for the placement."""
    spark = pieces.sparkSession
    n_slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_slices)).cast("int"))
    by_slice = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_count"))
    # at most capacity x slices rows; only the capacity totals reach the driver
    totals = by_slice.groupBy("length").agg(F.sum("_count").alias("n")).collect()
    table = slots(plan_packing({r["length"]: r["n"] for r in totals}, capacity))
    shared = spark.sparkContext.broadcast(table)
    earlier = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = by_slice.withColumn("_first", F.coalesce(F.sum("_count").over(earlier), F.lit(0))).select("_slice", "length", "_first")
    rank = F.row_number().over(Window.partitionBy("_slice", "length").orderBy("doc_id", "piece", "start"))
    # one exchange by (slice, length) serves both the window and the join
    numbered = sliced.withColumn("_rank", rank - 1).join(first, ["_slice", "length"]).withColumn("_number", F.col("_rank") + F.col("_first"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length, number):  # noqa: ANN001, ANN202
        import pandas as pd

        length, number = length.to_numpy(), number.to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            rows = shared.value[int(n)]
            k = np.searchsorted(rows[:, 0], number[at], side="right") - 1
            sequence[at] = rows[k, 2] + number[at] - rows[k, 0]
            offset[at] = rows[k, 3]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = numbered.withColumn("_place", place("length", "_number"))
    return placed.select(*(F.col(c) for c in pieces.columns), "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack: ``doc_id, piece, start, length, ids, sequence_id, offset``."""
    return pack(staged(tokenize_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
