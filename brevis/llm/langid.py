"""Language identification by hierarchical discrimination.

A text's language family is predicted first; one-versus-one linear support vector machines then
separate the languages of that family. Both levels read the same features, hashed byte n-grams
of whole words, averaged over all words of the whole text and scaled to unit length.

Families of common languages are given. Other languages get learnt ones, as many as the square root
of their number: the mean features of languages far from each other start a family, the others join
the nearest. So the number of machines stays near that of languages to the power of 1.5.

Defined results: a text that is null or without a letter is ``und`` with score 0; without any
training row every text is ``und``. Of equal probabilities the language that sorts first is taken.
Repeated rows are scored each on its own; columns other than the identifier, text and language are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevis.llm.lexicon import Lexicon, blocks, lexicon, raw_texts, sum_by_doc, word_grams
from brevis.llm.linear import couple, one_versus_one, smallest_keys
from brevis.session import ship_package

#: Families of some languages (ISO 639-1).
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}
ORDERS = (1, 2, 3, 4)
BITS = 13
#: Bound of the training sample: rows in all, but one for each language at least.
MAX_ROWS = 2048
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Level:
    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    biases: np.ndarray

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return couple(margins, self.pairs, len(self.classes))


@dataclass
class LanguageModel:
    families: Level
    languages: dict[str, Level]


def _features(texts: list[bytes]) -> np.ndarray:
    """A dense unit-length row of n-gram means for each text."""
    lex = lexicon([t.lower() for t in texts])
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    if not lex.words:
        return out
    owner, bucket = word_grams(lex.words, ORDERS, BITS)
    first = np.searchsorted(owner, np.arange(len(lex.words) + 1))
    for d in range(len(texts)):
        words, times = np.unique(lex.ids[lex.bounds[d] : lex.bounds[d + 1]], return_counts=True)
        for w, n in zip(words, times, strict=True):
            np.add.at(out[d], bucket[first[w] : first[w + 1]], n)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def training_rows(docs: DataFrame, fit_on: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """A bounded sample of the rows to learn from: for each language those of smallest hash.

    The identifiers are chosen from (id, lang) alone; texts are read for the chosen rows only.
    """
    known = docs.filter(fit_on & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    n = known.agg(F.countDistinct("lang")).first()[0]
    chosen = smallest_keys(known, "lang", "doc_id", max(1, max_rows // max(1, n)))
    return known.filter(F.col("doc_id").isin(sorted(chosen))).dropDuplicates(["doc_id"]) if chosen else known.limit(0)


def learnt_families(x: np.ndarray, lang: list[str], families: dict[str, str]) -> dict[str, str]:
    """``families`` with those of other languages: each is named after the language it began with."""
    others = sorted(set(lang) - set(families))
    code = np.array(lang)
    means = {k: x[code == k].mean(axis=0) for k in others}
    heads: list[str] = []
    far = dict.fromkeys(others, np.inf)
    while len(heads) ** 2 < len(others):
        heads.append(max(others, key=lambda k: far[k]))
        for k in others:
            far[k] = min(far[k], float(np.linalg.norm(means[k] - means[heads[-1]])))
    near = {k: min(heads, key=lambda h: float(np.linalg.norm(means[k] - means[h]))) for k in others}
    return families | {k: f"like {h}" for k, h in near.items()}


def fit(docs: DataFrame, fit_on: Column, families: dict[str, str] = FAMILIES, max_rows: int = MAX_ROWS) -> LanguageModel | None:
    """Train both levels on at most ``max_rows`` of the rows where ``fit_on`` holds."""
    ship_package(docs.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                x = _features(raw_texts(part.column("text")))
                rows = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([x[i][r] for i, r in enumerate(rows)], pa.list_(pa.float32()))],
                    ["doc_id", "lang", "at", "value"],
                )

    sample = training_rows(docs, fit_on, max_rows).mapInArrow(featurise, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, at array<int>, value array<float>")
    rows = sorted(((r["doc_id"], r["lang"], r["at"], r["value"]) for r in sample.toLocalIterator()), key=lambda r: r[0])
    if not rows:
        return None
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, (_, _, at, value) in enumerate(rows):
        x[i, at] = value
    lang = [r[1] for r in rows]
    families = learnt_families(x, lang, families)
    family = [families[k] for k in lang]
    languages = {}
    for f in sorted(set(family)):
        own = [i for i, k in enumerate(family) if k == f]
        languages[f] = Level(*one_versus_one(x[own], [lang[i] for i in own]))
    return LanguageModel(Level(*one_versus_one(x, family)), languages)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, family_pred, score`` for the whole text of every row."""
    ship_package(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    levels = [model.families, *model.languages.values()] if model else []
    names = list(model.languages) if model else []
    stacked = np.hstack([v.weights for v in levels]).astype(np.float32) if model else np.zeros((1 << BITS, 0), np.float32)
    slices = np.cumsum([0, *(len(v.pairs) for v in levels)])
    shared = docs.sparkSession.sparkContext.broadcast(stacked)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in blocks(batches):
            texts = raw_texts(b.column("text"))
            n = len(texts)
            lang, fam, score = ["und"] * n, ["und"] * n, np.zeros(n)
            letters = np.array([bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts], bool)
            if model and letters.any():
                lex = lexicon([t.lower() for t in texts])
                margins = _margins(lex, weights)
                at = np.flatnonzero(letters)
                top = model.families.probabilities(margins[at, : slices[1]] + model.families.biases)
                best = top.argmax(axis=1)
                for j, f in enumerate(names):
                    k = model.families.classes.index(f)
                    rows = at[best == k]
                    level = model.languages[f]
                    p = level.probabilities(margins[rows, slices[j + 1] : slices[j + 2]] + level.biases)
                    choice = p.argmax(axis=1)
                    for r, c, q, t in zip(rows, choice, p.max(axis=1), top[best == k, k], strict=True):
                        lang[r], fam[r], score[r] = level.classes[c], f, q * t
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(fam, pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "family_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {id_type}, lang_pred string, family_pred string, score double")


def _margins(lex: Lexicon, weights: np.ndarray) -> np.ndarray:
    """Inner products of the texts' unit-length features with the columns of ``weights``.

    They are additive over words: each distinct word of a block meets each column once, and each
    distinct word of a text is added with its count, one column at a time.
    """
    owner, bucket = word_grams(lex.words, ORDERS, BITS)
    width = max(1, len(lex.words))
    keys, times = np.unique(lex.doc_of * width + lex.ids, return_counts=True)
    word, bounds = keys % width, np.searchsorted(keys, np.arange(len(lex.bounds)) * width)
    first = np.searchsorted(owner, np.arange(width + 1))
    size = np.diff(first)
    norm = np.zeros(len(lex.bounds) - 1)
    for d in np.flatnonzero(np.diff(bounds)):
        own = word[bounds[d] : bounds[d + 1]]
        n = size[own]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(first[own] - (ends - n), n)
        counts = np.bincount(bucket[at], np.repeat(times[bounds[d] : bounds[d + 1]], n), minlength=1 << BITS)
        norm[d] = np.sqrt(counts @ counts)
    out = np.empty((len(norm), weights.shape[1]))
    for k in range(weights.shape[1]):
        per_word = np.bincount(owner, weights[bucket, k], minlength=width)
        out[:, k] = sum_by_doc(per_word[word] * times, bounds) / np.maximum(norm, 1e-12)
    return out
