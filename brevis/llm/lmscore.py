"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary, order and smoothing: the background model counts all
documents, the target model the documents marked as target. A document's score is the mean over
its tokens of the background loss minus the target loss (nats): above 0, the text is closer to the
target. Probabilities are ``p(w | h) = (c(h, w) + MU p(w)) / (c(h) + MU)`` with add-a-half unigrams.

Nothing that is counted is bounded: the vocabulary is all words (one class more holds what was never
seen), and words are known by 64-bit hashes, bigrams by their second word and 56 bits of the first.
A task gathers documents into packages (:mod:`brevis.llm.packages`) and deals their bigrams by second
word: every word with the bigrams that it ends, and for each of these the places of the documents
that hold it. Where they meet, all of a word's occurrences are there (a mark stands before the first
word of a document), so words and bigrams are counted on the spot. The loss differences are summed
per document, a number for each document and bucket, and meet at the package's home.

Words and bigrams found in ``HOT_SHARE`` of the documents of any package are set apart first, so that
none gathers more than a small share of all documents in one task: the counts of hot words are
broadcast and their bigrams dealt by bigram, and the counts of hot bigrams are broadcast and summed
where the documents are. At most ``HOT`` of each are set apart; the others take the common way, with
the same result. What is hot is decided once, by the hash that is counted.

A package's places depend on the order of rows, which a lost task must meet again: documents that do
not come straight from a stored table are stored first.

Defined results: words are runs of bytes other than ASCII white space, ``A-Z`` lower-cased; a null
or empty text has no tokens and score 0; every row is a text of its own, also where identifiers repeat
or are null, which are no target then. Identifiers may be of any type that the two tables share.
Without target documents all scores are those of a target model of no counts. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevis.llm.lexicon import blocks, mix, raw_texts, word_hashes
from brevis.llm.packages import Reader, Writer, home, lengths_of, runs
from brevis.session import drop_staged, is_scan, plan_bytes, ship_package, staged

MU = 100.0
#: Share of a package's documents (and their least number) that make a word or a bigram hot.
HOT_SHARE, HOT_DOCS = 0.02, 32
HOT = 1 << 16
#: Words of a package, and documents: 15 bits of a place, whose highest bit marks a target.
PACKAGE, PACKAGE_TEXTS = 2 << 20, 1 << 15
#: Occurrences that a task decodes at once where they meet.
RANGE = 8 << 20
#: Bytes of stored documents to a partition, where there are not more partitions anyhow.
PART_BYTES = 256 << 20
#: Marked identifiers that are broadcast at most; beyond, documents are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: In place of a first word: the mark before a document's first word, and the one that says that
#: nothing follows a last word. The latter is no occurrence of the word.
_START, _END = np.uint64((1 << 56) - 1), np.uint64((1 << 56) - 2)
DOCUMENT, BIGRAMS, SUMS = range(3)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a bigram from 56 bits of its first word's hash and its second word's."""
    return mix(first * np.uint64(3) + mix(second))


def _short(word: np.ndarray) -> np.ndarray:
    return np.minimum(word >> np.uint64(8), _END - np.uint64(1))


def _find(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` in the sorted ``among``, and whether they are there."""
    if not len(among):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return at, among[at] == values


def marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, text, target`` where ``target`` marks the identifiers in the table ``target``; rows
    come in an order that they keep when they are read again."""
    own = docs.select("doc_id", "text")
    own = own if is_scan(own) else staged(own, "lm-documents")
    ids = target.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    flag = F.coalesce("target", F.lit(False)).alias("target")
    if ids.count() <= BROADCAST_IDS:
        return own.join(F.broadcast(ids), "doc_id", "left").select("doc_id", "text", flag)
    # rows without identifier would all be sent to one task
    joined = own.filter("doc_id IS NOT NULL").join(ids, "doc_id", "left").unionByName(own.filter("doc_id IS NULL").withColumn("target", F.lit(False)))
    return staged(joined.select("doc_id", "text", flag), "lm-marked")


class Package:
    """The words of some documents, one after another."""

    def __init__(self, number: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]):
        self.number = number
        self.word = np.concatenate([h[0] for h in held])
        self.lengths = np.concatenate([h[1] for h in held])
        self.target = np.concatenate([h[2] for h in held])
        self.ids = [h[3] for h in held]
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        ends = np.cumsum(self.lengths)
        full = self.lengths > 0
        self.heads, self.tails = (ends - self.lengths)[full], ends[full] - 1
        inner = np.ones(len(self.word), bool)
        inner[self.heads] = False
        #: places of all second words of bigrams; the first ones stand before them
        self.seconds = np.flatnonzero(inner)

    def pairs(self) -> np.ndarray:
        return _pair(_short(self.word[self.seconds - 1]), self.word[self.seconds])


def _gathered(batches: Iterator[pa.RecordBatch], size: int, texts: int) -> Iterator[Package]:
    task, made = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
    n_words = n_texts = 0
    for whole in blocks(batches):
        for at in range(0, len(whole), texts):
            b = whole.slice(at, texts)
            word, bounds = word_hashes(raw_texts(b.column("text")))
            if n_texts and (n_words + len(word) > size or n_texts + len(b) > texts):
                yield Package(task << 32 | made, held)
                made, held, n_words, n_texts = made + 1, [], 0, 0
            held.append((word, np.diff(bounds), b.column("target").to_numpy(zero_copy_only=False).astype(bool), b.column("doc_id")))
            n_words, n_texts = n_words + len(word), n_texts + len(b)
    if n_texts:
        yield Package(task << 32 | made, held)


def _often(keys: np.ndarray, doc: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys that ``least`` documents or more hold, and how many do."""
    key, where, n = np.unique(keys, return_inverse=True, return_counts=True)
    may = np.flatnonzero(n[where] >= least)
    held = np.unique(where[may] * (int(doc[-1]) + 1 if len(doc) else 1) + doc[may])
    n = np.bincount(held // (int(doc[-1]) + 1 if len(doc) else 1), minlength=len(key))
    hot = np.flatnonzero(n >= least)
    return key[hot], n[hot]


def _cuts(parts: int) -> np.ndarray:
    """The least hash of every bucket but the first."""
    return np.array([-(-(b << 64) // parts) for b in range(1, parts)], np.uint64)


def _survey(parts: int, size: int, texts: int, share: float, least: int):  # noqa: ANN202
    """Rows (kind, bucket, key, n, n_target, block): 0, the words of a package and how many are of the
    target; 1 and 2, words and bigrams that many of its documents hold, and how many; 3, its distinct
    words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(parts)
        for p in _gathered(batches, size, texts):
            bound = max(least, share * len(p.lengths))
            words, n_words = _often(p.word, p.doc, bound)
            pairs, n_pairs = _often(p.pairs(), p.doc[p.seconds], bound)
            distinct = np.unique(p.word)
            at = [0, *np.searchsorted(distinct, cuts).tolist(), len(distinct)]
            filled = [b for b in range(parts) if at[b] < at[b + 1]]
            data = []
            for b in filled:
                w = Writer()
                w.put(np.diff(distinct[at[b] : at[b + 1]], prepend=np.uint64(0)))
                data.append(w.block())
            kinds = [0] + [1] * len(words) + [2] * len(pairs) + [3] * len(filled)
            none = np.zeros(len(kinds), np.int64)
            key, n, n_target, bucket = none.copy(), none.copy(), none.copy(), none.copy()
            n[0], n_target[0] = len(p.word), p.lengths[p.target].sum()
            found = slice(1, 1 + len(words) + len(pairs))
            key[found], n[found] = np.concatenate([words, pairs]).view(np.int64), np.concatenate([n_words, n_pairs])
            bucket[found.stop :] = filled
            block = pa.array([None] * found.stop + data, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int8()), pa.array(bucket, pa.int32()), pa.array(key), pa.array(n), pa.array(n_target), block], ["kind", "bucket", "key", "n", "n_target", "block"])

    return run


def _count_distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of distinct words of a bucket; the words of a few packages are joined at a time."""
    known, new, size = np.zeros(0, np.uint64), [], 0
    for b in batches:
        for block in b.column("block").to_pylist():
            new.append(np.cumsum(Reader(block).get(), dtype=np.uint64))
            size += len(new[-1])
            if size > max(RANGE // 4, len(known)):
                known, new, size = np.unique(np.concatenate([known, *new])), [], 0
    yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(np.concatenate([known, *new])))])], ["n"])


class Model:
    """Counts of hot words, gains of hot bigrams, and what a loss needs of the whole corpus."""

    def __init__(self, totals: tuple[int, int], size: int, words: np.ndarray, pairs: np.ndarray):
        self.totals, self.size = np.array(totals, np.float64), size
        self.words, self.counts = np.sort(words), np.zeros((len(words), 2))
        self.pairs, self.pair_gain = np.sort(pairs), np.zeros(len(pairs))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.totals + 0.5 * self.size)

    def first_gain(self, counts: np.ndarray) -> np.ndarray:
        """log p_target - log p_background of words of given counts."""
        p = np.log(self.unigram(counts))
        return p[:, 1] - p[:, 0]

    def pair_part(self, counts: np.ndarray, n: np.ndarray, n_target: np.ndarray) -> np.ndarray:
        """What bigrams of given counts add to a gain; ``counts`` are those of their second words."""
        p = np.log(np.stack([n, n_target], axis=1) + MU * self.unigram(counts))
        return p[:, 1] - p[:, 0]

    def history_part(self, counts: np.ndarray) -> np.ndarray:
        """What a word of given counts adds to the gain of the word after it."""
        p = np.log(counts + MU)
        return p[:, 0] - p[:, 1]


def _count_hot(shared, size: int, texts: int):  # noqa: ANN001, ANN202
    """(kind, key, word, n, n_target) of hot words and of hot bigrams whose second word is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for p in _gathered(batches, size, texts):
            at, hot = _find(p.word, model.words)
            aim = p.target[p.doc]
            n = [np.bincount(at[m], minlength=len(model.words)) for m in (hot, hot & aim)]
            own = p.seconds[hot[p.seconds]]
            key = _pair(_short(p.word[own - 1]), p.word[own])
            place, known = _find(key, model.pairs)
            place, own = place[known], own[known]
            m = [np.bincount(place[x], minlength=len(model.pairs)) for x in (slice(None), aim[own])]
            second = np.zeros(len(model.pairs), np.uint64)
            second[place] = p.word[own]
            some, pairs = np.flatnonzero(n[0]), np.flatnonzero(m[0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [len(some), len(pairs)]), pa.int8()),
                    pa.array(np.concatenate([model.words[some], model.pairs[pairs]]).view(np.int64)),
                    pa.array(np.concatenate([model.words[some], second[pairs]]).view(np.int64)),
                    *(pa.array(np.concatenate([a[some], b[pairs]])) for a, b in zip(n, m, strict=True)),
                ],
                ["kind", "key", "word", "n", "n_target"],
            )

    return run


def train(rows: DataFrame, parts: int, hot: int | None = None) -> Model:
    """Totals, hot words and hot bigrams of the rows of :func:`marked`; ``hot`` bounds what is set
    apart, not what is counted."""
    hot = HOT if hot is None else hot
    survey = rows.mapInArrow(_survey(parts, PACKAGE, PACKAGE_TEXTS, HOT_SHARE, HOT_DOCS), "kind tinyint, bucket int, key bigint, n bigint, n_target bigint, block binary")
    survey = staged(survey, "lm-survey", "kind")
    n, n_target = survey.filter("kind = 0").agg(F.sum("n"), F.sum("n_target")).first()
    words = survey.filter("kind = 3").select("bucket", "block").repartitionById(parts, F.col("bucket")).mapInArrow(_count_distinct, "n bigint").agg(F.sum("n")).first()[0]
    column = lambda t, c: t.column(c).to_numpy()
    top = [survey.filter(F.col("kind") == k).groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(hot).select("key").toArrow() for k in (1, 2)]
    model = Model((n or 0, n_target or 0), (words or 0) + 1, *(column(t, "key").view(np.uint64) for t in top))
    drop_staged(survey)
    if len(model.words):
        shared = rows.sparkSession.sparkContext.broadcast(model)
        found = rows.mapInArrow(_count_hot(shared, PACKAGE, PACKAGE_TEXTS), "kind tinyint, key bigint, word bigint, n bigint, n_target bigint")
        # one row for each hot word and bigram
        found = found.groupBy("kind", "key").agg(F.max("word").alias("word"), F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).toArrow()
        kind, key, word = column(found, "kind"), column(found, "key").view(np.uint64), column(found, "word").view(np.uint64)
        counts = np.stack([column(found, "n"), column(found, "n_target")], axis=1)
        model.counts[np.searchsorted(model.words, key[kind == 0])] = counts[kind == 0]
        order = np.argsort(key[kind == 1])
        key, word, counts = key[kind == 1][order], word[kind == 1][order], counts[kind == 1][order]
        model.pairs, model.pair_gain = key, model.pair_part(model.counts[np.searchsorted(model.words, word)], counts[:, 0], counts[:, 1])
    else:
        model.pairs, model.pair_gain = model.pairs[:0], model.pair_gain[:0]
    return model


def _schema(id_type: str) -> str:
    return f"bucket int, kind tinyint, block binary, doc_id {id_type}, package bigint, place int, n bigint, known double"


_NAMES = ["bucket", "kind", "block", "doc_id", "package", "place", "n", "known"]


def _dealt(rows: Iterator[tuple[int, int, bytes]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, block) as record batches of about 8 MB."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        bucket, kind, block = zip(*held, strict=True)
        none = [pa.nulls(len(held), t) for t in (id_type, pa.int64(), pa.int32(), pa.int64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int8()), pa.array(block, pa.binary()), *none], _NAMES)

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 8 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _known(p: Package, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What hot words and bigrams add to each document, and for every word whether it is hot and
    where, and for every bigram whether it is hot."""
    place, common = _find(p.word, model.words)
    history = np.zeros(len(p.word))
    history[common] = model.history_part(model.counts)[place[common]]
    # a last word is no history
    history[p.tails] = 0
    n = len(p.lengths)
    known = np.bincount(p.doc, history, minlength=n).astype(np.float64)
    heads = p.heads[common[p.heads]]
    known[p.doc[heads]] += model.first_gain(model.counts)[place[heads]]
    hot = np.zeros(len(p.seconds), bool)
    may = np.flatnonzero(common[p.seconds])
    at, found = _find(_pair(_short(p.word[p.seconds[may] - 1]), p.word[p.seconds[may]]), model.pairs)
    hot[may[found]] = True
    known += np.bincount(p.doc[p.seconds[may[found]]], model.pair_gain[at[found]], minlength=n)
    return known, common, place, hot


def _postings(shared, parts: int, size: int, texts: int):  # noqa: ANN001, ANN202
    def deal(p: Package, model: Model, common: np.ndarray, place: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        mark = (p.doc | p.target[p.doc].astype(np.int64) << 15).astype(np.uint16)
        plain = p.seconds[~common[p.seconds]]
        heads, tails = p.heads[~common[p.heads]], p.tails[~common[p.tails]]
        where = np.concatenate([plain, heads, tails])
        first = np.concatenate([_short(p.word[plain - 1]), np.full(len(heads), _START), np.full(len(tails), _END)])
        second, mark_of = p.word[where], mark[where]
        order = np.lexsort((first, second))
        first, second, mark_of = first[order], second[order], mark_of[order]
        # bigrams whose second word is hot are dealt one by one
        own = p.seconds[common[p.seconds] & ~hot]
        pair = _pair(_short(p.word[own - 1]), p.word[own])
        order = np.argsort(pair)
        pair, index, hot_mark = pair[order], place[own][order], mark[own][order]
        cuts = _cuts(parts)
        at = [0, *np.searchsorted(second, cuts).tolist(), len(second)]
        hot_at = [0, *np.searchsorted(pair, cuts).tolist(), len(pair)]
        for b in range(parts):
            s, h = slice(at[b], at[b + 1]), slice(hot_at[b], hot_at[b + 1])
            if s.start == s.stop and h.start == h.stop:
                continue
            w = Writer()
            w.put(np.array([p.number], np.uint64))
            pairs, words = runs(second[s], first[s]), runs(second[s])
            w.put(second[s][words])
            w.put(lengths_of(np.searchsorted(pairs, words), len(pairs)))
            w.put(first[s][pairs])
            w.put(lengths_of(pairs, s.stop - s.start))
            w.put(mark_of[s])
            pairs = runs(pair[h])
            w.put(pair[h][pairs])
            w.put(index[h][pairs])
            w.put(lengths_of(pairs, h.stop - h.start))
            w.put(hot_mark[h])
            yield b, BIGRAMS, w.block()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for p in _gathered(batches, size, texts):
            known, common, place, hot = _known(p, model)
            n = len(p.lengths)
            ids = pa.concat_arrays(p.ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, home(p.number, parts)), pa.int32()), pa.array(np.zeros(n), pa.int8()), pa.nulls(n, pa.binary()), ids,
                    pa.array(np.full(n, p.number)), pa.array(np.arange(n), pa.int32()), pa.array(p.lengths.astype(np.int64)), pa.array(known),
                ],
                _NAMES,
            )
            yield from _dealt(deal(p, model, common, place, hot), ids.type)

    return run


class Met:
    """A block of bigrams as arrays; ``part`` gives those of a range of hashes."""

    def __init__(self, block: bytes):
        r = Reader(block)
        self.package = int(r.get()[0])
        self.words, pairs, self.first, n, self.mark = (r.get() for _ in range(5))
        self.pair_cuts = np.concatenate([[0], np.cumsum(pairs)]).astype(np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.hot, self.index, n, self.hot_mark = (r.get() for _ in range(4))
        self.hot_cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

    def part(self, low: int, high: int) -> tuple[np.ndarray, ...]:
        """(second, first, n, mark; pair, index, n, mark); ``n`` is of entries of ``mark``."""
        side = lambda x, v: len(x) if v >= 1 << 64 else int(np.searchsorted(x, np.uint64(v)))
        lo, hi = side(self.words, low), side(self.words, high)
        a, b = self.pair_cuts[lo], self.pair_cuts[hi]
        c, d = side(self.hot, low), side(self.hot, high)
        return (
            np.repeat(self.words[lo:hi], np.diff(self.pair_cuts[lo : hi + 1])), self.first[a:b], np.diff(self.cuts[a : b + 1]), self.mark[self.cuts[a] : self.cuts[b]],
            self.hot[c:d], self.index[c:d], np.diff(self.hot_cuts[c : d + 1]), self.hot_mark[self.hot_cuts[c] : self.hot_cuts[d]],
        )


def _of_target(n: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """How many of each pair's ``n`` marks are of target documents."""
    return np.diff(np.concatenate([[0], np.cumsum(mark >> np.uint64(15)).astype(np.int64)])[np.concatenate([[0], np.cumsum(n)])])


def _gains(model: Model, second: np.ndarray, first: np.ndarray, n: np.ndarray, n_target: np.ndarray) -> np.ndarray:
    """Loss differences of each entry of bigrams whose second word is not hot."""
    start, end = first == _START, first == _END
    _, at = np.unique(_pair(first, second), return_inverse=True)
    pair, pair_target = (np.bincount(at, x)[at] for x in (n, n_target))
    _, word = np.unique(second, return_inverse=True)
    counts = np.stack([np.bincount(word, np.where(end, 0, x)) for x in (n, n_target)], axis=1)[word]
    history = model.history_part(counts)
    return np.where(end, -history, history + np.where(start, model.first_gain(counts), model.pair_part(counts, pair, pair_target)))


def _meet(shared, parts: int, at_once: int):  # noqa: ANN001, ANN202
    """Bigrams by bucket to sums of loss differences by home; documents pass."""

    def sums(found: list[bytes], bucket: int) -> Iterator[tuple[int, int, bytes]]:
        model: Model = shared.value
        bounds = [0, *_cuts(parts).tolist(), 1 << 64]
        low, high = bounds[bucket], bounds[bucket + 1]
        met = [Met(x) for x in found]
        ranges = max(1, -(-sum(len(m.mark) + len(m.hot_mark) for m in met) // at_once))
        for r in range(ranges):
            lo, hi = (low + (high - low) * k // ranges for k in (r, r + 1))
            parted = [m.part(lo, hi) for m in met]
            second, first, n, mark, pair, index, hot_n, hot_mark = (np.concatenate(x) for x in zip(*parted, strict=True))
            n, hot_n = n.astype(np.int64), hot_n.astype(np.int64)
            gain = _gains(model, second, first, n, _of_target(n, mark)) if len(n) else np.zeros(0)
            _, at = np.unique(pair, return_inverse=True)
            counted = [np.bincount(at, x, minlength=1)[at] for x in (hot_n, _of_target(hot_n, hot_mark))]
            hot_gain = model.pair_part(model.counts[index.astype(np.int64)], *counted) if len(pair) else np.zeros(0)
            # the sum of each document of each package
            source = np.concatenate([np.repeat(np.arange(len(met)), [len(x[k]) for x in parted]) for k in (3, 7)])
            key = source << 15 | (np.concatenate([mark, hot_mark]) & np.uint64(0x7FFF)).astype(np.int64)
            value = np.concatenate([np.repeat(gain, n), np.repeat(hot_gain, hot_n)])
            unique, at = np.unique(key, return_inverse=True)
            total = np.bincount(at, value, minlength=len(unique))
            cut = np.searchsorted(unique, np.arange(len(met) + 1) << 15)
            for k, m in enumerate(met):
                if cut[k] < cut[k + 1]:
                    w = Writer()
                    w.put(np.array([m.package], np.uint64))
                    w.put(unique[cut[k] : cut[k + 1]] & 0x7FFF)
                    w.raw(total[cut[k] : cut[k + 1]])
                    yield home(m.package, parts), SUMS, w.block()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[bytes] = []
        bucket, id_type = -1, pa.int64()
        for b in batches:
            id_type = b.column("doc_id").type
            kind = b.column("kind").to_numpy()
            own = np.flatnonzero(kind == BIGRAMS)
            if len(own):
                bucket = b.column("bucket")[int(own[0])].as_py()
                found += b.column("block").take(pa.array(own)).to_pylist()
            if len(own) < len(b):
                yield b.filter(pa.array(kind != BIGRAMS))
        if found:
            yield from _dealt(sums(found, bucket), id_type)

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At home: a document's sum over what is known and what met elsewhere, by its tokens."""
    documents: dict[int, list[pa.RecordBatch]] = {}
    sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in batches:
        kind = b.column("kind").to_numpy()
        for block in b.filter(pa.array(kind == SUMS)).column("block").to_pylist():
            r = Reader(block)
            sums.setdefault(int(r.get()[0]), []).append((r.get().astype(np.int64), r.raw()))
        rows = b.filter(pa.array(kind == DOCUMENT))
        package = rows.column("package").to_numpy(zero_copy_only=False)
        for k in np.unique(package).tolist():
            documents.setdefault(k, []).append(rows.filter(pa.array(package == k)))
    for k in sorted(documents):
        rows = pa.Table.from_batches(documents.pop(k)).sort_by("place").combine_chunks()
        total = rows.column("known").to_numpy().copy()
        # in one order, whatever the order in which they came
        for place, value in sorted(sums.pop(k, ()), key=lambda x: (x[0][0], len(x[0]), x[1][0])):
            total[place] += value
        n = rows.column("n").to_numpy()
        ids = rows.column("doc_id").combine_chunks()
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(total / np.maximum(n, 1))], ["doc_id", "n_tokens", "score"])


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, score`` of every row; ``target`` holds the target's identifiers."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = marked(docs, target)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(docs.select("doc_id", "text")) // PART_BYTES) if is_scan(docs) else 1)
    shared = spark.sparkContext.broadcast(train(rows, parts))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    by_word = rows.mapInArrow(_postings(shared, parts, PACKAGE, PACKAGE_TEXTS), _schema(id_type)).repartitionById(parts, F.col("bucket"))
    by_home = by_word.mapInArrow(_meet(shared, parts, RANGE), _schema(id_type)).repartitionById(parts, F.col("bucket"))
    return by_home.mapInArrow(_score, f"doc_id {id_type}, n_tokens bigint, score double")
