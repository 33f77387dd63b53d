"""Toxicity: a character n-gram linear classifier with naive Bayes log-count ratio features.

A text's features are the hashed n-grams of code points of its distinct words in lower case, each
counted once for every distinct word that holds it. Feature values are scaled by the log-count ratio of toxic and other
labelled texts, and a logistic regression is fitted on the scaled values. As scores are additive
over distinct words, each distinct word of a block of texts is scored once.

Defined results: a null text counts as empty; an empty text gets the score of the bias alone.
Without labels of both kinds the score is the share of toxic labels (0 without any). Repeated
rows are scored each on its own; labels that are null or neither 0 nor 1 are not learnt from; of
several labels of one document the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevis.llm.lexicon import Lexicon, blocks, lexicon, lower_case, raw_texts, sum_by_doc, word_grams
from brevis.llm.linear import SparseRows, logistic, sigmoid, smallest_keys
from brevis.session import ship_package, trim

ORDERS = (3, 4, 5)
BITS = 17
#: Bound of the training sample: labelled rows of each class, those of smallest hash.
MAX_PER_CLASS = 1500
ALPHA = 1.0
L2 = 1e-3


@dataclass
class ToxicityModel:
    weights: np.ndarray | None
    bias: float


def _distinct(lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes of each text without repeats, and their bounds."""
    width = max(1, len(lex.words))
    keys = np.unique(lex.doc_of * width + lex.ids)
    return keys % width, np.searchsorted(keys, np.arange(len(lex.bounds)) * width)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        lex, words = lower_case(lexicon([t.lower() for t in raw_texts(b.column("text"))]))
        at, value = [], []
        if lex.words:
            ids, bounds = _distinct(lex)
            owner, bucket = word_grams(words, ORDERS, BITS)
            first = np.searchsorted(owner, np.arange(len(lex.words) + 1))
            for d in range(len(b)):
                own = [bucket[first[w] : first[w + 1]] for w in ids[bounds[d] : bounds[d + 1]]]
                g, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0), np.zeros(0))
                at.append(g.astype(np.int32))
                value.append(n.astype(np.int32))
        else:
            at, value = [[]] * len(b), [[]] * len(b)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("toxic"), pa.array([len(x) for x in at], pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.int32()))],
            ["doc_id", "toxic", "n", "at", "value"],
        )


def training_rows(docs: DataFrame, labels: DataFrame, fit_on: Column, max_per_class: int) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``max_per_class`` labelled texts of either class."""
    known = labels.filter(fit_on & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    toxic_of = smallest_keys(known, "toxic", "doc_id", max_per_class)
    spark = docs.sparkSession
    chosen = spark.createDataFrame(sorted(toxic_of.items()), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")
    # the sample has 2 * max_per_class rows at most, so its side may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, fit_on: Column, max_per_class: int = MAX_PER_CLASS) -> ToxicityModel:
    """Train on labelled rows for which ``fit_on`` (over the columns of ``labels``) holds."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = training_rows(docs, labels, fit_on, max_per_class).mapInArrow(_featurise, f"doc_id {kind}, toxic int, n bigint, at array<int>, value array<int>").toArrow()
    y = rows.column("toxic").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(None, float(np.log(max(y.mean(), 1e-9) / max(1 - y.mean(), 1e-9))) if len(y) else -30.0)
    # in one order, whatever the order in which they came
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    y = y[order]
    sizes = rows.column("n").to_numpy()
    starts = np.cumsum(sizes) - sizes
    at = np.concatenate([starts[i] + np.arange(sizes[i], dtype=np.int32) for i in order]).astype(np.int32)
    columns = rows.column("at").combine_chunks().flatten().to_numpy()[at]
    counts = rows.column("value").combine_chunks().flatten().to_numpy()[at].astype(np.float32)
    del rows, at
    trim(docs.sparkSession)
    x = SparseRows(np.concatenate([[0], np.cumsum(sizes[order])]), columns, counts, 1 << BITS)
    p, q = ALPHA + x.t_dot(y), ALPHA + x.t_dot(1 - y)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    x.scale = ratio
    w, bias = logistic(x, y, L2)
    return ToxicityModel((w * ratio).astype(np.float32), bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` for the whole text of every row; the score is a probability."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            out = pa.array(probabilities(raw_texts(b.column("text")), shared.value))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), out], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield b.filter(pa.array(probabilities(raw_texts(b.column("text")), shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)


def probabilities(texts: list[bytes], model: ToxicityModel) -> np.ndarray:
    lex, words = lower_case(lexicon([t.lower() for t in texts]))
    margin = np.full(len(texts), model.bias)
    if lex.words and model.weights is not None:
        owner, bucket = word_grams(words, ORDERS, BITS)
        per_word = np.bincount(owner, model.weights[bucket], minlength=len(lex.words))
        ids, bounds = _distinct(lex)
        margin += sum_by_doc(per_word[ids], bounds)
    return sigmoid(margin)
