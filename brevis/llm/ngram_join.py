"""N-gram Jaccard self-join of documents: rare-first prefix filtering.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents of equal sets are
one *text*, known by a 64-bit hash of the set.

1. Texts are read once. A task gathers some 2 million shingles, a *package*, and deals them by
   shingle: sorted, as differences, each with the text's place in the package. The package's list of
   texts goes to one place, its home. Where shingles meet their texts are counted, and those shared by
   two or more go to the packages' homes with a rank key whose order is rare first (a rounded
   logarithm of the count, then the hash).
2. At home a text's shared shingles meet. Shingles of its own come first in rare-first order; if
   they fill the prefix (``n - ceil(t n) + 1`` shingles), no other text can be similar and the text
   is done. The others are stored as records, one for each text.
3. Texts that share a prefix shingle are candidates. Length and positional filters apply at once,
   the suffix filter before the exact overlap is counted. No pair is verified twice, and pairs of
   texts known to be connected are not verified at all: each list of texts is first compared with
   its most central member, components are updated, and only pairs across components remain, until
   such a round finds none. The last round takes every remaining pair, so no link between components
   is lost.

The list of a shingle that very many texts share is dealt in *cells*. In the first round a cell of
``STAR_CELLS * CELL`` texts or so has a central member of its own. From the second on a component is
present with its most central text alone, so that the cells' centres meet. In the last round each pair
of cells of about ``CELL`` texts meets. A pair is dealt by its less central text, so that the pairs of a
central one spread over all tasks.

Set sizes count 64-bit hashes. Overlaps are counted on 56 of the bits: within a pair of 1000-shingle
texts a false common shingle has a chance of 1e-11. 3e9 texts hold one equal pair of set hashes with
a chance of 0.25.

A package's places depend on the order of rows, which a lost task must meet again: documents that do
not come straight from a stored table are stored first.

Defined results: a text without words (or null) has an empty set and is linked with nothing; a
text of fewer words than a shingle has its whole sequence as one; repeated rows are linked as
copies. Columns other than identifier and text are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevis.llm.lexicon import blocks, give_back, mix, raw_texts, word_hashes
from brevis.llm.packages import from_planes, home, planes
from brevis.session import drop_staged, is_scan, plan_bytes, ship_package, staged

SIZE = 5
#: The Jaccard similarity as a fraction.
NUM, DEN = 75, 100
#: Rounds of comparing with central texts at most; they end when one finds no candidates.
STAR_ROUNDS = 6
#: Shingles of a package, and texts, whose places take two bytes.
PACKAGE, PACKAGE_TEXTS = 2 << 20, 1 << 16
#: Shingles that a task decodes at once where they meet.
RANGE = 8 << 20
#: Texts of a cell of a list; and cells of the last round to one of the first rounds, whose work is
#: linear in a list's texts.
CELL, STAR_CELLS = 4096, 64
#: Bytes of stored documents to a partition, where there are not more partitions anyhow.
PART_BYTES = 256 << 20
KEY_BITS = np.uint64(56)
_MASK = np.uint64((1 << 56) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HEAD = struct.Struct("<QQII")
#: Kinds of rows that are dealt: documents, shingles, lists of texts, shared shingles.
DOCUMENT, SHINGLES, TEXTS, SHARED = range(4)


def shingle_sets(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, with their bounds."""
    word, starts = word_hashes(texts)
    lengths = np.diff(starts)
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], np.uint64)
    long = np.repeat(lengths >= size, counts)
    m = len(word) - size + 1
    if m > 0 and long.any():
        h = np.zeros(m, np.uint64)
        for k in range(size):
            h = h * _ODD + word[k : k + m]
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        out[long] = mix(h[doc[:m] == doc[size - 1 :]] * _ODD + np.uint64(size))
    for n in range(1, size):
        short = np.flatnonzero(lengths == n)
        h = np.zeros(len(short), np.uint64)
        for k in range(n):
            h = h * _ODD + word[starts[short] + k]
        out[bounds[short]] = mix(h * _ODD + np.uint64(n))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo > 1:
            out[lo:hi].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][counts > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def set_hashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, as a signed number."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + _ODD), dtype=np.uint64)])
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    return mix(total + np.diff(bounds).astype(np.uint64)).view(np.int64)


# ---- what is dealt: rows (bucket, kind, block, doc_id, n, sig) ----


def _schema(id_type: str) -> str:
    return f"bucket int, kind tinyint, block binary, doc_id {id_type}, n bigint, sig bigint"


def _pack(package: int, base: int, keys: np.ndarray, place: np.ndarray) -> bytes:
    """Sorted keys, ``base`` at least, as differences, with places in the package."""
    steps = np.diff(keys, prepend=np.uint64(base))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return _HEAD.pack(package, base, len(keys), width) + planes(steps, width) + place.astype("<u2").tobytes()


def _unpack(block: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    package, base, n, width = _HEAD.unpack_from(block)
    keys = np.cumsum(from_planes(block, n, width, _HEAD.size), dtype=np.uint64) + np.uint64(base)
    return package, keys, np.frombuffer(block, "<u2", n, _HEAD.size + n * width)


def _dealt(rows: Iterator[tuple[int, int, bytes]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, block) as record batches of about 8 MB."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        n = len(held)
        bucket, kind, block = zip(*held, strict=True)
        columns = [pa.array(bucket, pa.int32()), pa.array(kind, pa.int8()), pa.array(block, pa.binary()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "block", "doc_id", "n", "sig"])

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 8 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _cuts(parts: int) -> np.ndarray:
    """The least key of every bucket, and the bound of the last one."""
    return np.array([-(-(b << 56) // parts) for b in range(parts + 1)], np.uint64)


def _postings(parts: int, size: int, package_size: int, package_texts: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, cuts = TaskContext.get().partitionId(), 0, _cuts(parts)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def package() -> Iterator[tuple[int, int, bytes]]:
            nonlocal made
            number = task << 32 | made
            made += 1
            sig, n, hashes = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            # of equal texts met here one is sent
            once = np.zeros(len(sig), bool)
            once[np.unique(sig, return_index=True)[1]] = True
            once &= n > 0
            keys = hashes[np.repeat(once, n)] >> np.uint64(8)
            sig, n = sig[once], n[once]
            yield home(number, parts), TEXTS, struct.pack("<QI", number, len(sig)) + sig.astype("<i8").tobytes() + n.astype("<u4").tobytes()
            order = np.argsort(keys)
            place = np.repeat(np.arange(len(sig), dtype=np.uint16), n)[order]
            keys = keys[order]
            at = np.searchsorted(keys, cuts[:-1]).tolist() + [len(keys)]
            for b in range(parts):
                if at[b] < at[b + 1]:
                    yield b, SHINGLES, _pack(number, int(cuts[b]), keys[at[b] : at[b + 1]], place[at[b] : at[b + 1]])

        n_held, n_texts, rows, id_type = 0, 0, task, None
        for b in blocks(batches):
            ids, id_type = b.column("doc_id"), b.column("doc_id").type
            hashes, bounds = shingle_sets(raw_texts(b.column("text")), size)
            sig, n = set_hashes(hashes, bounds), np.diff(bounds)
            if n_texts and (n_held + len(hashes) > package_size or n_texts + len(n) > package_texts):
                yield from _dealt(package(), id_type)
                n_held = n_texts = 0
            bucket = (np.arange(rows, rows + len(n)) % parts).astype(np.int32)
            rows += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(np.zeros(len(n), np.int8)), pa.nulls(len(n), pa.binary()), ids, pa.array(n), pa.array(sig, mask=n == 0)],
                ["bucket", "kind", "block", "doc_id", "n", "sig"],
            )
            held.append((sig, n, hashes))
            n_held, n_texts = n_held + len(hashes), n_texts + len(n)
        if n_texts:
            yield from _dealt(package(), id_type)
        give_back()

    return run


def _meet(parts: int, at_once: int):  # noqa: ANN202
    """Shingles by bucket to shared shingles by home; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[bytes] = []
        bucket, id_type = -1, pa.int64()
        for b in batches:
            id_type = b.column("doc_id").type
            own = np.flatnonzero(b.column("kind").to_numpy() == SHINGLES)
            if len(own):
                bucket = b.column("bucket")[int(own[0])].as_py()
                found += b.column("block").take(pa.array(own)).to_pylist()
            if len(own) < len(b):
                yield b.filter(pa.array(b.column("kind").to_numpy() != SHINGLES))
        if found:
            yield from _dealt(_shared(found, bucket, parts, at_once), id_type)
            del found
        give_back()

    return run


def _shared(found: list[bytes], bucket: int, parts: int, at_once: int) -> Iterator[tuple[int, int, bytes]]:
    cuts = _cuts(parts)
    low, high = int(cuts[bucket]), int(cuts[bucket + 1])
    n_ranges = -(-sum(_HEAD.unpack_from(x)[2] for x in found) // at_once)
    for r in range(n_ranges):
        lo, hi = (np.uint64(low + (high - low) * k // n_ranges) for k in (r, r + 1))
        packages, keys, places = [], [], []
        for x in found:
            package, key, place = _unpack(x)
            first, last = np.searchsorted(key, [lo, hi]) if n_ranges > 1 else (0, len(key))
            packages.append(package)
            keys.append(key[first:last])
            places.append(place[first:last])
        source = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key, place = np.concatenate(keys), np.concatenate(places)
        del keys, places
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        count = np.repeat(count, count)
        kept = np.flatnonzero(count >= 2)
        rank = np.minimum(255, np.floor(8 * np.log2(count[kept]))).astype(np.uint64)
        key, order = (rank << KEY_BITS) | key[kept], order[kept]
        where = source[order] << 16 | place[order]
        order = np.argsort(where, kind="stable")
        key, where = key[order], where[order]
        at = np.searchsorted(where, np.arange(len(packages) + 1) << 16)
        for k, package in enumerate(packages):
            if at[k] < at[k + 1]:
                own = slice(at[k], at[k + 1])
                yield home(package, parts), SHARED, struct.pack("<QI", package, at[k + 1] - at[k]) + (where[own] & 0xFFFF).astype("<u2").tobytes() + key[own].astype("<u8").tobytes()


def _prefix(n, num: int, den: int):  # noqa: ANN001, ANN202
    return n - (num * n + den - 1) // den + 1


def _gather(num: int, den: int):  # noqa: ANN202
    """At home: records of the texts whose prefix reaches a shared shingle; documents pass."""
    names = ["is_text", "doc_id", "n", "sig", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, bytes] = {}
        shared: dict[int, list[bytes]] = {}
        id_type = pa.int64()
        for b in batches:
            id_type = b.column("doc_id").type
            kind = b.column("kind").to_numpy()
            rows = b.filter(pa.array(kind == DOCUMENT))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), bool)), rows.column("doc_id"), rows.column("n"), rows.column("sig"), pa.nulls(len(rows), pa.binary())], names)
            for k, block in zip(kind.tolist(), b.column("block").to_pylist(), strict=True):
                if k == TEXTS:
                    texts[struct.unpack_from("<Q", block)[0]] = block
                elif k == SHARED:
                    shared.setdefault(struct.unpack_from("<Q", block)[0], []).append(block)
        for package in sorted(shared):
            sig, n = _texts_of(texts.pop(package))
            place, key = (np.concatenate(x) for x in zip(*map(_shared_of, shared.pop(package)), strict=True))
            order = np.lexsort((key, place))
            place, key = place[order], key[order]
            once = np.ones(len(key), bool)
            once[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1])
            place, key = place[once], key[once]
            first = np.searchsorted(place, np.arange(len(sig) + 1))
            count = np.diff(first)
            live = np.flatnonzero((count > 0) & (n - count < _prefix(n, num, den)))
            for at in range(0, len(live), 1024):
                own = live[at : at + 1024]
                records = [key[first[i] : first[i + 1]].astype("<u8").tobytes() for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(own), bool)), pa.nulls(len(own), id_type), pa.array(n[own]), pa.array(sig[own]), pa.array(records, pa.binary())], names)

    return run


def _texts_of(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<QI", block)[1]
    return np.frombuffer(block, "<i8", n, 12), np.frombuffer(block, "<u4", n, 12 + 8 * n).astype(np.int64)


def _shared_of(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<QI", block)[1]
    return np.frombuffer(block, "<u2", n, 12), np.frombuffer(block, "<u8", n, 12 + 2 * n)


def text_records(docs: DataFrame, parts: int, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """A stored table of two kinds of rows. Without ``is_text``: ``doc_id, n, sig`` of every row of
    ``docs``, ``sig`` null for an empty set. With it: ``n, sig, shared`` of texts that may have a
    similar one, once or more each; ``shared`` holds the rank keys of their shared shingles in
    rare-first order (little-endian, 8 bytes each)."""
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    by_shingle = docs.mapInArrow(_postings(parts, size, PACKAGE, PACKAGE_TEXTS), _schema(id_type)).repartitionById(parts, F.col("bucket"))
    by_home = by_shingle.mapInArrow(_meet(parts, RANGE), _schema(id_type)).repartitionById(parts, F.col("bucket"))
    return staged(by_home.mapInArrow(_gather(num, den), f"is_text boolean, doc_id {id_type}, n bigint, sig bigint, shared binary"), "join-texts", "is_text")


# ---- candidates ----


def _prefix_entries(num: int, den: int, cell: int):  # noqa: ANN202
    """``key, cells, sig, n, place, own, label`` of the shared shingles in each text's prefix;
    ``cells`` is the number of cells of the shingle's list, from the count in its rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                sig, n, label = (part.column(c).to_numpy() for c in ("sig", "n", "label"))
                keys = [np.frombuffer(x, "<u8") for x in part.column("shared").to_pylist()]
                own = n - np.array([len(k) for k in keys])
                reach = _prefix(n, num, den) - own
                keys = [k[:r] for k, r in zip(keys, reach, strict=True)]
                sizes = np.array([len(k) for k in keys])
                row = np.repeat(np.arange(len(keys)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + own[row]
                key = np.concatenate(keys)
                cells = np.ceil(2.0 ** (((key >> KEY_BITS).astype(np.float64) + 1) / 8) / cell).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(cells), pa.array(sig[row]), pa.array(n[row]), pa.array(place), pa.array(own[row]), pa.array(label[row])],
                    ["key", "cells", "sig", "n", "place", "own", "label"],
                )

    return run


_ENTRY = "key bigint, cells int, sig bigint, n bigint, place bigint, own bigint, label bigint"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by (key, cell), cut between its values: each list whole, several at once."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        if not len(b):
            continue
        new = {c: b.column(c).to_numpy() for c in b.schema.names}
        held = {c: np.concatenate([held[c], x]) for c, x in new.items()} if held else new
        if len(held["key"]) < 1 << 16 and len(b) < 1 << 16:
            continue
        key, cell = held["key"], held["cell"]
        last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield {c: x[:cut] for c, x in held.items()}
            held = {c: x[cut:] for c, x in held.items()}
    if held:
        yield held


def _candidates(every: bool, num: int, den: int):  # noqa: ANN202
    """Pairs (a, b) of texts of different components that share a prefix shingle, the more central
    one (with the smaller share of shingles of its own) first.

    Texts are compared with the most central one of a list, or, if ``every``, all with all, but for
    pairs whose smaller text holds the shingle beyond its *lead*: two similar texts have their first
    common shingle among the first ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller one, of size ``n``.
    """

    def pairs_of(c: dict[str, np.ndarray]) -> np.ndarray:
        order = np.lexsort((c["sig"], c["n"] if every else c["own"] / c["n"], c["cell"], c["key"]))
        c = {k: v[order] for k, v in c.items()}
        alone = c["own"] / c["n"]
        starts = np.flatnonzero(np.concatenate([[True], (c["key"][1:] != c["key"][:-1]) | (c["cell"][1:] != c["cell"][:-1])]))
        ends = np.append(starts[1:], len(order))
        mixed = (np.minimum.reduceat(c["label"], starts) != np.maximum.reduceat(c["label"], starts)) & (ends - starts > 1)
        starts, ends = starts[mixed], ends[mixed]

        def fit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            n, m = c["n"][i], c["n"][j]
            least = -(-num * (n + m) // (num + den))
            most = np.minimum(n - c["place"][i], m - c["place"][j])
            ok = (c["label"][i] != c["label"][j]) & (c["sig"][i] != c["sig"][j]) & (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (most >= least)
            i, j = i[ok], j[ok]
            turn = (alone[i] > alone[j]) | ((alone[i] == alone[j]) & (c["sig"][i] > c["sig"][j]))
            return np.stack([c["sig"][np.where(turn, j, i)], c["sig"][np.where(turn, i, j)]], axis=1)

        if not every:
            sizes = ends - starts
            pivot = np.repeat(starts, sizes - 1)
            return fit(pivot, np.arange(len(pivot)) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1) + pivot + 1)
        found, size = [np.zeros((0, 2), np.int64)], 0
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            # by size: none beyond 1 / t times a text's size is similar to it
            reach = lo + np.searchsorted(c["n"][lo:hi], c["n"][lo:hi] * den // num, side="right")
            for i in (lo + np.flatnonzero(c["lead"][lo:hi])).tolist():
                j = np.arange(i + 1, reach[i - lo])
                # in a cell that is a pair of parts only texts of different parts meet
                j = j[(c["half"][i] < 0) | (c["half"][j] != c["half"][i])]
                if len(j):
                    found.append(fit(np.full(len(j), i), j))
                    size += len(found[-1])
                if size > 1 << 20:
                    found, size = [np.unique(np.concatenate(found), axis=0)], 0
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _runs(batches):
            pairs = np.unique(pairs_of(c), axis=0)
            for at in range(0, len(pairs), 1 << 16):
                part = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], ["a", "b"])
        give_back()

    return run


def candidates(entries: DataFrame, parts: int, step: int, every: bool, num: int = NUM, den: int = DEN) -> DataFrame:
    """Distinct pairs (a, b) of candidates from prefix entries."""
    if every:
        # only lists of several components and with a leading text are dealt; each pair of parts is a cell
        entries = entries.withColumn("lead", F.expr(f"place <= n - (2 * {num} * n + {num + den - 1}) DIV {num + den}").cast("tinyint"))
        mixed = entries.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.max("lead").alias("_lead")).filter("_low <> _high AND _lead = 1").select("key")
        part = F.pmod(F.xxhash64("sig"), F.col("cells")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
        entries = entries.join(mixed, "key").withColumn("_part", part).withColumn("_other", other)
        low, high = F.least("_part", "_other"), F.greatest("_part", "_other")
        entries = entries.withColumns({"cell": low * F.col("cells") + high, "half": F.when(low == high, -1).otherwise(F.col("_part"))}).drop("_part", "_other")
    else:
        if step:
            # of each component in a list the most central text
            best = F.min(F.struct((F.col("own") / F.col("n")).alias("_alone"), "sig", "n", "place", "own", "cells")).alias("_best")
            entries = entries.groupBy("key", "label").agg(best).select("key", "label", "_best.sig", "_best.n", "_best.place", "_best.own", "_best.cells")
        cells = F.ceil(F.col("cells") / STAR_CELLS ** (step + 1))
        entries = entries.withColumns({"cell": F.pmod(F.xxhash64("sig"), cells).cast("int"), "half": F.lit(-1), "lead": F.lit(1).cast("tinyint")})
    lists = entries.select("key", "cell", "sig", "n", "place", "own", "label", "half", "lead").repartition(parts, "key", "cell").sortWithinPartitions("key", "cell")
    return lists.mapInArrow(_candidates(every, num, den), "a bigint, b bigint").distinct()


# ---- verification ----


def _halves_apart(x: np.ndarray, y: np.ndarray, allowed: int) -> bool:
    """Suffix filter: whether a split at the middle key shows a difference beyond ``allowed``."""
    if not len(x) or not len(y):
        return abs(len(x) - len(y)) > allowed
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    return abs(i - j) + abs((len(x) - i) - (len(y) - j)) > allowed


def similar(x: np.ndarray, nx: int, y: np.ndarray, ny: int, num: int = NUM, den: int = DEN) -> bool:
    """Whether two sets are similar, from their shared keys (sorted) and sizes."""
    least = -(-num * (nx + ny) // (num + den))
    if min(len(x), len(y)) < least or _halves_apart(x, y, len(x) + len(y) - 2 * least):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return den * common >= num * (nx + ny - common)


def _verify(num: int, den: int):  # noqa: ANN202
    """Rows come sorted by group, and in a group all records before all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, records = None, {}
        for b in batches:
            links = []
            for g, a, other, n, shared in zip(*(b.column(k).to_pylist() for k in ("group", "a", "b", "n", "shared")), strict=True):
                if g != group:
                    group, records = g, {}
                if shared is not None:
                    records[a] = (np.frombuffer(shared, "<u8"), n)
                elif similar(*records[a], *records[other], num, den):
                    links.append((a, other))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def verify(pairs: DataFrame, records: DataFrame, parts: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs that are similar. Pairs are dealt by their second text and an eighth of the first
    ones, in groups of which a task holds one at a time; a record goes once to each group."""
    group = F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.lit(8))), F.lit(64 * parts)).cast("int").alias("group")
    dealt = pairs.select(group, "a", "b")
    none = [F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("shared")]
    needed = dealt.select("group", F.explode(F.array("a", "b")).alias("sig")).distinct()
    given = needed.join(records, "sig").select("group", F.col("sig").alias("a"), F.lit(None).cast("bigint").alias("b"), "n", "shared")
    both = given.union(dealt.select("group", "a", "b", *none)).repartition(parts, "group").sortWithinPartitions("group", F.col("b").asc_nulls_first())
    return both.mapInArrow(_verify(num, den), "a bigint, b bigint")


# ---- components ----


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``links`` (a, b): the labels of connected nodes are equal.

    Every node points to its smallest neighbour or itself, pointers are followed twice, and links
    are drawn anew between what they point to, until none is left.
    """
    edges = staged(links, "join-links")
    labels = None
    done = [edges]
    step = 0
    while edges.count():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        down = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("node"), "to")
        down = staged(down, f"join-down{step}")
        done.append(down)
        for _ in range(2):
            nxt = down.select(F.col("node").alias("to"), F.col("to").alias("next"))
            down = down.join(nxt, "to").select("node", F.col("next").alias("to"))
        down = staged(down, f"join-jump{step}")
        done.append(down)
        if labels is None:
            labels = down.withColumnRenamed("to", "label")
        else:
            moved = down.select(F.col("node").alias("label"), "to")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        a, b = (down.select(F.col("node").alias(k), F.col("to").alias(f"to_{k}")) for k in ("a", "b"))
        edges = staged(edges.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct(), f"join-edges{step}")
        done.append(edges)
        step += 1
    out = staged(labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label")), "join-labels")
    for table in done:
        drop_staged(table)
    return out


def similar_links(records: DataFrame, parts: int, num: int = NUM, den: int = DEN) -> tuple[DataFrame | None, DataFrame | None]:
    """Verified links (a, b) that connect every pair of similar texts, and ``node, label``."""
    links = labels = tried = None
    done: list[DataFrame] = []
    rounds = [(step, False) for step in range(STAR_ROUNDS)] + [(0, True)]
    idle = False
    for step, last in rounds:
        if idle and not last:
            continue
        if labels is None:
            members = records.withColumn("label", F.col("sig"))
        else:
            members = records.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        entries = members.mapInArrow(_prefix_entries(num, den, CELL), _ENTRY)
        pairs = candidates(entries, parts, step, last, num, den)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = staged(pairs, f"join-pairs{'-last' if last else step}")
        done.append(pairs)
        idle = not pairs.count()
        if idle:
            continue
        found = verify(pairs, records, parts, num, den)
        done += [x for x in (links, labels) if x is not None]
        links = staged(found if links is None else links.union(found), f"join-found{step}")
        labels = components(links)
        tried = pairs if tried is None else tried.union(pairs)
    for table in done:
        drop_staged(table)
    return links, labels


def similarity_components(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    stored = docs if is_scan(docs) else staged(docs, "join-documents")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(stored) // PART_BYTES))
    whole = text_records(stored, parts, size, num, den)
    drop_staged(stored)
    records = staged(whole.filter("is_text").select("sig", "n", "shared").dropDuplicates(["sig"]), "join-records")
    links, labels = similar_links(records, parts, num, den)
    drop_staged(records)
    texts = whole.filter("NOT is_text").select("doc_id", "n", "sig")
    return _with_components(texts, links, labels).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_components(texts: DataFrame, links: DataFrame | None, labels: DataFrame | None) -> DataFrame:
    """``texts`` with ``component_id``, null where it is the row's own identifier."""
    least = texts.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    if labels is None:
        least = staged(least.filter("rows > 1").select("sig", F.col("least").alias("component_id")), "join-components")
    else:
        joined = staged(least.join(labels.withColumnRenamed("node", "sig"), "sig", "left").filter("rows > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "sig")), "join-least")
        of_label = joined.groupBy("label").agg(F.min("least").alias("component_id"))
        least = staged(joined.join(of_label, "label").select("sig", "component_id"), "join-components")
        for table in (joined, links, labels):
            drop_staged(table)
    return texts.join(least, "sig", "left")
