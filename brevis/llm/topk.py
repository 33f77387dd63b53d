"""Exact top-k search by columnar branch and bound.

Vectors become whole numbers. Queries are sent to the candidates, ``QUERY_BLOCK`` in a round, and
candidates stay where they are: a task puts its own into blocks in vertical layout, one row per
dimension. Scores are accumulated a few dimensions at a time, those of most energy first. After each
step the rest of a score lies within the product of the remaining lengths of query and candidate
(Cauchy-Schwarz); candidates whose upper bound is below the k-th best lower bound, or below the k-th
best score that the task has seen in earlier blocks, are dropped and the others compacted. A task
gives the k best of every query over all its blocks, and these are merged per query.

Defined results: vectors that are null or hold null or non-finite components take no part; a
shorter vector is continued with zeros; with fewer candidates than k all are returned. Several
rows of one query identifier are one query (any of them); candidates of the query's own identifier
are left out, other repeated candidate rows count each. Scores are exact: a component beyond 2**62
units or a score beyond 63 bits, which no result column could hold, is refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevis.session import drop_staged, ship_package, staged

UNITS = 256
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 16384
STEP = 8
_LIMIT = 1 << 62


def whole_numbers(vector: str) -> Column:
    """``floor(256 * x)`` of every component."""
    refused = F.raise_error(F.lit(f"a vector component is beyond {_LIMIT} / {UNITS}")).cast("bigint")
    return F.transform(vector, lambda x: F.when(F.abs(UNITS * x.cast("double")) < float(_LIMIT), F.floor(UNITS * x.cast("double")).cast("bigint")).otherwise(refused))


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def vertical(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Vectors as columns, one row per dimension; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return np.ascontiguousarray(flat.reshape(len(sizes), width).T)
    out = np.zeros((width, len(sizes)), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
    return out


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(query's place, candidates, scores) of the ``k`` best candidates of every query; vertical
    layouts. Candidates whose score is below the query's ``floors`` may be left out."""
    width = max(len(q), len(x))
    q, x = (np.pad(m, ((0, width - len(m)), (0, 0))) for m in (q, x))
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    fq, fx = q[order].astype(np.float64), np.ascontiguousarray(x[order].astype(np.float64))
    cuts = [*range(0, width, STEP), width]
    rest = lambda m: np.sqrt(np.stack([(m[c:] ** 2).sum(axis=0) for c in cuts]))
    q_rest, x_rest = rest(fq), rest(fx)
    big = float(np.abs(fq).max(initial=0)) * float(np.abs(fx).max(initial=0)) * width
    # a little slack covers rounding where sums leave the exact range of doubles
    loose = big * 1e-12 if big >= 2**52 else 1e-6
    for i, name in enumerate(q_ids):
        alive = np.flatnonzero(x_ids != name)
        score = np.zeros(len(alive))
        floor = -np.inf if floors is None else floors[i] - loose
        for step, lo in enumerate(cuts[:-1]):
            hi = cuts[step + 1]
            score += fq[lo:hi, i] @ (fx[lo:hi] if len(alive) == len(x_ids) else fx[lo:hi, alive])
            slack = q_rest[step + 1, i] * x_rest[step + 1, alive] * (1 + 1e-9) + loose
            if len(alive) > k:
                least = score - slack
                floor = max(floor, np.partition(least, len(least) - k)[len(least) - k])
            keep = score + slack >= floor
            if not keep.all():
                alive, score = alive[keep], score[keep]
        if big < 2**53:
            exact = score.astype(np.int64)
        else:
            exact = np.array([sum(int(a) * int(b) for a, b in zip(q[:, i], x[:, j], strict=True)) for j in alive], object)
            if len(exact) and max(abs(e) for e in exact) >= 1 << 63:
                raise OverflowError("a score is beyond 63 bits")
            exact = exact.astype(np.int64)
        top = np.lexsort((x_ids[alive], -exact))[:k]
        yield i, x_ids[alive[top]], exact[top]


def _scan(shared, k: int):  # noqa: ANN001, ANN202
    """The ``k`` best of every query over all candidates of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        ids = [np.zeros(0, np.int64)] * len(q_ids)
        scores = [np.zeros(0, np.int64)] * len(q_ids)
        floors = np.full(len(q_ids), -np.inf)
        for t in _candidate_blocks(batches):
            for i, found, exact in best(q, q_ids, vertical(t.column("v")), t.column("vec_id").to_numpy(), k, floors):
                if len(found):
                    found, exact = np.concatenate([ids[i], found]), np.concatenate([scores[i], exact])
                    top = np.lexsort((found, -exact))[:k]
                    ids[i], scores[i] = found[top], exact[top]
                    if len(top) == k:
                        floors[i] = exact[top[-1]]
        n = [len(x) for x in ids]
        columns = np.repeat(q_ids, n), np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([*scores, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def _candidate_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= CANDIDATE_BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows where ``queries`` holds, the ``k`` rows of
    greatest inner product, ties to the smaller identifier."""
    spark = vectors.sparkSession
    ship_package(spark)
    ready = vectors.filter(usable(vector) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole_numbers(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    asked = staged(ready.filter("asked").select("vec_id", "v").dropDuplicates(["vec_id"]), "topk-queries")
    rounds = -(-asked.count() // QUERY_BLOCK)
    if rounds > 1:
        # every round reads all candidates
        ready = staged(ready, "topk-vectors")
    found = []
    for r in range(rounds):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).toArrow()
        if not part.num_rows:
            continue
        shared = spark.sparkContext.broadcast((part.column("vec_id").to_numpy(), vertical(part.column("v"))))
        local = ready.select("vec_id", "v").mapInArrow(_scan(shared, k), "query_id bigint, vec_id bigint, score bigint")
        found.append(staged(local, "topk-round") if rounds > 1 else local)
    drop_staged(asked)
    if not found:
        found = [spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(every: int, k: int = 5) -> str:
    """The same rows for vectors of equal length in DuckDB's SQL."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({UNITS} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
