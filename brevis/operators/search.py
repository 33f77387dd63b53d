"""Quantized vector search: encode a table, scan its codes for a shortlist, rerank exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevis.functions.quantizers import Product, Quantizer
from brevis.functions.vectors import cosine, doubles, relative_error
from brevis.session import ship_package, staged

#: Queries that are sent to every task in a round.
MAX_QUERIES = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def train_product(vectors: DataFrame, quantizer: Product, rows: int = 10_000) -> Product:
    """Train on the ``rows`` vectors of smallest hash of the identifier (a bounded random sample)."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select(doubles("embedding").alias("v")).toArrow().column("v").combine_chunks()
    return quantizer.train(_matrix(sample))


def encode_vectors(vectors: DataFrame, quantizer: Quantizer) -> DataFrame:
    """``vec_id, code`` (binary)."""
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = quantizer.encode(_matrix(b.column("v"))) if len(b) else []
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "code"])

    return vectors.select("vec_id", doubles("embedding").alias("v")).mapInArrow(run, "vec_id bigint, code binary")


#: Codes that are scored at once, and queries.
SCORED, ASKED = 8192, 64


def _stored(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(c, np.uint8) for c in column.to_pylist()])


class Best:
    """The ``size`` best codes so far of every query; ties go to the smaller identifier."""

    def __init__(self, n_queries: int, size: int):
        self.size = size
        self.ids = [np.zeros(0, np.int64)] * n_queries
        self.scores = [np.zeros(0)] * n_queries

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.ids[q]) == self.size and self.size:
            # the last one kept is the least
            worth = np.flatnonzero(scores >= self.scores[q][-1])
            if not len(worth):
                return
            ids, scores = ids[worth], scores[worth]
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        best = np.lexsort((ids, -scores))[: self.size]
        self.ids[q], self.scores[q] = ids[best], scores[best]

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        n = [len(x) for x in self.ids]
        columns = np.repeat(names, n), np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.concatenate([*self.scores, np.zeros(0)])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "approx"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to ``SCORED`` rows or more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= SCORED:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def query_blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(identifiers, matrix) of all queries in blocks of about ``size``, by the identifier's hash."""
    queries = queries.select("query_id", doubles("query").alias("q"))
    n = queries.count()
    blocks = -(-n // size)
    if blocks > 1:
        queries = staged(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "search-queries")
    for b in range(blocks):
        asked = (queries.filter(F.col("_block") == b) if blocks > 1 else queries).toArrow()
        if asked.num_rows:
            yield asked.column("query_id").to_numpy(), _matrix(asked.column("q").combine_chunks())


def shortlist(codes: DataFrame, queries: DataFrame, quantizer: Quantizer, size: int) -> DataFrame:
    """``query_id, vec_id, approx, approx_rank``: the best codes of every query.

    Queries are sent to the codes, ``MAX_QUERIES`` in a round. A task keeps the best ``size`` of each
    over all its codes, so at most that many rows per query and partition are shuffled.
    """
    spark = codes.sparkSession
    ship_package(spark)
    found = []
    n = queries.count()
    if n > MAX_QUERIES:
        # every round reads the codes again
        codes = staged(codes.select("vec_id", "code"), "search-codes")
    for names, q in query_blocks(queries, MAX_QUERIES):
        shared = spark.sparkContext.broadcast((names, q, quantizer))
        local = codes.select("vec_id", "code").mapInArrow(_scan(shared, size), "query_id bigint, vec_id bigint, approx double")
        found.append(staged(local, "search-round") if n > MAX_QUERIES else local)
    if not found:
        found = [codes.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("approx")).limit(0)]
    order = Window.partitionBy("query_id").orderBy(F.desc("approx"), "vec_id")
    return reduce(DataFrame.union, found).withColumn("approx_rank", F.row_number().over(order)).filter(F.col("approx_rank") <= size)


def _scan(shared, size: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, quantizer = shared.value
        best = Best(len(names), size)
        for t in _gathered(batches):
            ids, stored = t.column("vec_id").to_numpy(), _stored(t.column("code"))
            for at in range(0, len(names), ASKED):
                for k, row in enumerate(quantizer.scores(q[at : at + ASKED], stored)):
                    best.add(at + k, ids, row)
        yield best.batch(names)

    return run


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: candidates by exact cosine; ties keep their order."""
    scored = candidates.join(vectors.select("vec_id", doubles("embedding").alias("_v")), "vec_id").join(queries.select("query_id", doubles("query").alias("_q")), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "approx_rank")
    return scored.withColumn("score", cosine(F.col("_q"), F.col("_v"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_with_rerank(vectors: DataFrame, queries: DataFrame, quantizer: Quantizer, k: int = 10, size: int | None = None) -> DataFrame:
    size = max(size or 6 * k, k)
    return rerank(shortlist(encode_vectors(vectors, quantizer), queries, quantizer, size), queries, vectors, k)


def round_trip(vectors: DataFrame, quantizer) -> DataFrame:  # noqa: ANN001
    """One row: mean cosine and mean relative error of decoded vectors against their originals."""
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            if len(x):
                back = quantizer.decode(quantizer.encode(x), x.shape[1]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array(back.tolist())], ["v", "back"])

    decoded = vectors.select(doubles("embedding").alias("v")).mapInArrow(run, "v array<double>, back array<double>")
    return decoded.agg(F.avg(cosine(F.col("v"), F.col("back"))).alias("cosine"), F.avg(relative_error(F.col("v"), F.col("back"))).alias("error"))


class Plain:
    """Vectors as they are, in double precision; scores are exact cosines."""

    name = "plain"

    def bytes_per(self, dim: int) -> int:
        return 8 * dim

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        x = codes.view(np.float64)
        norm = np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1))[None]
        return (q @ x.T) / np.where(norm == 0, 1, norm)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x).view(np.uint8)


def exact_top(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` by exact cosine over all vectors, ties by identifier."""
    found = shortlist(encode_vectors(vectors, Plain()), queries, Plain(), k)
    return found.select("query_id", F.col("approx_rank").alias("rank"), "vec_id", F.col("approx").alias("score"))


def recall(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, recall``: the share of the true ``k`` that was found."""
    hit = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / k).alias("recall"))


def estimator_bias(estimated: DataFrame) -> DataFrame:
    """Mean signed error, correlation and slope of ``estimate`` on ``actual``."""
    return estimated.agg(F.avg(F.col("estimate") - F.col("actual")).alias("mean_error"), F.corr("estimate", "actual").alias("correlation"), F.regr_slope("estimate", "actual").alias("slope"))


def estimator_moments(vectors: DataFrame, queries: DataFrame, quantizer: Quantizer) -> DataFrame:
    """As :func:`estimator_bias`, of every query's estimated and actual inner products with every
    vector. A pair is never a row: each task adds up its pairs' moments."""
    spark = vectors.sparkSession
    ship_package(spark)
    names = ["n", "e", "a", "ee", "aa", "ea"]
    parts = []
    for _, q in query_blocks(queries, MAX_QUERIES):
        shared = spark.sparkContext.broadcast((q, quantizer))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            q, quantizer = shared.value
            total = np.zeros(6)
            for t in _gathered(batches):
                x = _matrix(t.column("v").combine_chunks())
                codes = quantizer.encode(x)
                for at in range(0, len(q), ASKED):
                    e, a = quantizer.scores(q[at : at + ASKED], codes).ravel(), (q[at : at + ASKED] @ x.T).ravel()
                    total += [len(e), e.sum(), a.sum(), e @ e, a @ a, e @ a]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names)

        parts.append(vectors.select(doubles("embedding").alias("v")).mapInArrow(run, ", ".join(f"{c} double" for c in names)))
    none = spark.range(0).select(*(F.lit(0.0).alias(c) for c in names))
    total = reduce(DataFrame.union, parts, none).agg(*(F.sum(c).alias(c) for c in names))
    n, e, a, ee, aa, ea = map(F.col, names)
    covariance, of_e, of_a = ea - e * a / n, ee - e * e / n, aa - a * a / n
    return total.select(((e - a) / n).alias("mean_error"), (covariance / F.sqrt(of_e * of_a)).alias("correlation"), (covariance / of_a).alias("slope"))
