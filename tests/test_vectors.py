import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis.functions import vectors as V
from brevis.functions.quantizers import Binary, Int8, Product, Rotation, beta_centroids
from brevis.operators import search


def clustered(n=2000, d=128, clusters=25):
    """Unit vectors around random centres, from a linear congruential generator."""
    s = 42

    def uniform():
        nonlocal s
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        return s / 4294967296

    centres = [np.array([uniform() * 2 - 1 for _ in range(d)]) for _ in range(clusters)]
    x = np.array([centres[i % clusters] + np.array([uniform() - 0.5 for _ in range(d)]) * 0.6 for i in range(n)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = centres[3] + np.array([uniform() - 0.5 for _ in range(d)]) * 0.6
    return x, (q / np.linalg.norm(q))[None]


@pytest.fixture(scope="module")
def data():
    return clustered()


def recall(scores, truth, k=10, pool=10, x=None, q=None):
    best = np.argsort(-scores[0], kind="stable")[:pool]
    if x is not None:
        best = best[np.argsort(-(x[best] @ q[0]), kind="stable")]
    return len(set(best[:k]) & set(np.argsort(-truth[0], kind="stable")[:k])) / k


def test_codes_are_as_long_as_said(data):
    x, _ = data
    for q in (Int8(), Binary(), Product(16, 32, 2).train(x[:500]), Rotation(2), Rotation(3), Rotation(4)):
        assert q.encode(x[:5]).shape == (5, q.bytes_per(128))
    assert [Rotation(b).bytes_per(128) for b in (2, 3, 4)] == [40, 56, 72]


def test_recall_of_shortlists(data):
    x, q = data
    truth = q @ x.T
    assert recall(Int8().scores(q, Int8().encode(x)), truth) >= 0.9
    for quantizer in (Product(16, 256, 4).train(x), Rotation(3)):
        assert recall(quantizer.scores(q, quantizer.encode(x)), truth, pool=64, x=x, q=q) >= 0.8


def test_rotation_round_trip(data):
    x, _ = data
    r = Rotation(3)
    y = r.rotate(x[:8], r.seed, 3)
    assert np.allclose(r.rotate(y, r.seed, 3, back=True), x[:8], atol=1e-5)
    back = r.decode(r.encode(x[:50]), 128)
    assert np.mean(np.sum(back * x[:50], axis=1) / np.linalg.norm(back, axis=1)) > 0.9
    zero = np.zeros((1, 100))
    assert np.frombuffer(r.encode(zero)[0, :4].tobytes(), "<f4")[0] == 1.0
    with pytest.raises(ValueError):
        r.encode(np.zeros((1, 20000)))
    assert np.allclose(beta_centroids(128, 4), -beta_centroids(128, 4)[::-1])


def test_unbiased_estimates_have_slope_one(data):
    x, _ = data
    y = np.random.default_rng(0).normal(size=(50, 128))
    y = x[:50] + 0.3 * y / np.linalg.norm(y, axis=1, keepdims=True)
    actual = (y @ x[:50].T).ravel()
    slopes = [np.polyfit(actual, Rotation(2, unbiased=u).scores(y, Rotation(2).encode(x[:50])).ravel(), 1)[0] for u in (False, True)]
    assert slopes[0] < 0.8 < 0.95 < slopes[1] < 1.05


def test_edge_values():
    assert Int8().encode(np.array([[-0.5, 2, -2]])).view(np.int8).tolist() == [[-63, 127, -127]]
    assert Binary().encode(np.array([[-0.0, -1, 1]])).tolist() == [[5]]
    assert Binary().scores(np.array([[1.0, -1, 1]]), np.array([[5]], np.uint8))[0, 0] == 3 / 8
    with pytest.raises(ValueError):
        Product().train(np.zeros((0, 8)))
    with pytest.raises(ValueError):
        Product().encode(np.zeros((1, 8)))
    assert len(Product(2, 256, 2).train(np.eye(4)).books[0]) == 4


def test_column_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    codes = spark.createDataFrame([([-0.5, 2.0],)], "v array<double>").select(V.int8_codes(F.col("v"))).first()[0]
    assert codes == [-63, 127]
    assert df.select(V.l2_normalized(F.col("a"))).collect()[1][0] == [0.6, 0.8]


def test_search_in_spark(spark, data):
    x, q = data
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:300])], "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(0, q[0].tolist())], "query_id bigint, query array<double>")
    truth = search.exact_top(vectors, queries, 10)
    want = np.argsort(-(x[:300] @ q[0]), kind="stable")[:10].tolist()
    assert [r["vec_id"] for r in truth.orderBy("rank").collect()] == want
    found = search.search_with_rerank(vectors, queries, Rotation(3), 10, 64)
    assert search.recall(found, truth).first()["recall"] >= 0.9


def test_equal_scores_keep_shortlist_order(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2)], "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, query array<double>")
    candidates = spark.createDataFrame([(0, 2, 0.9, 1), (0, 1, 0.8, 2)], "query_id bigint, vec_id bigint, approx double, approx_rank int")
    assert [r["vec_id"] for r in search.rerank(candidates, queries, vectors).orderBy("rank").collect()] == [2, 1]


def test_any_number_of_queries(spark, data, monkeypatch):
    x, _ = data
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:300])], "vec_id bigint, embedding array<double>").repartition(3)
    queries = vectors.filter("vec_id % 5 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    rows = lambda df: {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in df.collect()}
    want = [rows(search.exact_top(vectors, queries, 10)), rows(search.search_with_rerank(vectors, queries, Rotation(3), 10, 64))]
    monkeypatch.setattr(search, "MAX_QUERIES", 7)
    got = [rows(search.exact_top(vectors, queries, 10)), rows(search.search_with_rerank(vectors, queries, Rotation(3), 10, 64))]
    assert len(got[0]) == 600 and got == want
    best = np.argsort(-(x[:300:5] @ x[:300].T), axis=1, kind="stable")[:, :10]
    assert all(got[0][5 * i, k + 1][0] == best[i, k] for i in range(60) for k in range(10))
    assert search.exact_top(vectors.limit(0), queries, 10).count() == 0


def test_moments_are_those_of_all_pairs(spark, data, monkeypatch):
    x, _ = data
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:120])], "vec_id bigint, embedding array<double>").repartition(3)
    queries = vectors.filter("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    q = x[:120:10]
    e, a = Rotation(3).scores(q, Rotation(3).encode(x[:120])).ravel(), (q @ x[:120].T).ravel()
    pairs = spark.createDataFrame([(float(u), float(v)) for u, v in zip(e, a, strict=True)], "estimate double, actual double")
    want = search.estimator_bias(pairs).first()
    for most in (4096, 5):
        monkeypatch.setattr(search, "MAX_QUERIES", most)
        got = search.estimator_moments(vectors, queries, Rotation(3)).first()
        assert np.allclose(tuple(got), tuple(want), atol=1e-9)


def test_product_is_trained_on_all_of_the_table(spark):
    vectors = spark.createDataFrame([(i, [float(i >= 300), 1.0]) for i in range(600)], "vec_id bigint, embedding array<double>")
    book = search.train_product(vectors, Product(1, 2, 4), 100).books[0]
    assert sorted(book[:, 0].round()) == [0, 1]


def test_recall_of_every_quantizer(spark):
    from brevis.plans import queries

    found = {r["quantizer"]: r["recall"] for r in queries.recall_at_10(spark, "/root/testdata/sf0.001").collect()}
    assert found.keys() == {"int8", "binary", "product", "rotation"}
    assert all(0 < x <= 1 for x in found.values())


# ---- published figures: fixed values of seeds, sizes and results ----


def published_vectors():
    """2000 unit vectors around 25 centres, and a query near the fourth; seed 42."""
    u = V.uniforms(42)
    noise = lambda: np.array([next(u) * 2 - 1 for _ in range(128)])
    unit = lambda v: v / np.linalg.norm(v)
    centres = [unit(noise()) for _ in range(25)]
    x = np.array([unit(centres[i % 25] + noise() * 0.35) for i in range(2000)])
    return x, unit(centres[3] + noise() * 0.2)[None]


def test_published_recall():
    x, q = published_vectors()
    truth = q @ x.T
    for quantizer, plain, reranked in (
        (Int8(), 1.0, None), (Binary(), 0.2, 0.6), (Product(16, 256, 12).train(x), 0.5, 1.0), (Rotation(2), 0.6, None), (Rotation(3), 0.7, 1.0), (Rotation(4), 0.8, None),
    ):
        scores = quantizer.scores(q, quantizer.encode(x))
        assert recall(scores, truth) == plain, quantizer.name
        if reranked is not None:
            assert recall(scores, truth, pool=64, x=x, q=q) == reranked, quantizer.name
    estimate = Rotation(3).scores(q, Rotation(3).encode(x))[0]
    assert abs((estimate - truth[0]).mean() + 0.0013) < 1e-4 and abs(np.corrcoef(estimate, truth[0])[0, 1] - 0.965) < 1e-3


def test_published_attention():
    """Attention over 512 coded keys and values of 128 normal components; seed 7."""
    g = V.gaussians(7)
    keys, values = (np.array([[next(g) for _ in range(128)] for _ in range(512)]) for _ in range(2))
    q = np.array([next(g) for _ in range(128)])

    def softmax(s):
        e = np.exp(s - s.max())
        return e / e.sum()

    weights = softmax(keys @ q / np.sqrt(128))
    exact = weights @ values
    for bits, cosine, error, divergence, of_values in ((2, 0.775, 0.658, 1.30e-1, 0.837), (3, 0.916, 0.404, 4.05e-2, 0.951), (4, 0.975, 0.233, 1.21e-2, 0.986)):
        r = Rotation(bits)
        w = softmax(r.scores(q[None], r.encode(keys))[0] / np.sqrt(128))
        back = r.decode(r.encode(values), 128).astype(np.float64)
        out = w @ back
        assert abs(out @ exact / np.linalg.norm(out) / np.linalg.norm(exact) - cosine) < 1e-3
        assert abs(np.linalg.norm(out - exact) / np.linalg.norm(exact) - error) < 1e-3
        assert abs((weights * np.log(weights / np.maximum(w, 1e-12))).sum() / divergence - 1) < 5e-3
        assert abs(np.mean((back * values).sum(axis=1) / np.linalg.norm(back, axis=1) / np.linalg.norm(values, axis=1)) - of_values) < 1e-3


def test_sums_and_errors_of_vectors(spark):
    df = spark.createDataFrame([("a", 0.25, [4.0, 8.0]), ("a", 0.75, [4.0, None]), ("b", 1.0, [1.0])], "g string, w double, v array<double>")
    assert sorted(tuple(r) for r in V.weighted_sum(df, "w", "v", "g").collect()) == [("a", 0, 4.0), ("a", 1, 2.0), ("b", 0, 1.0)]
    pair = spark.createDataFrame([([3.0, 4.0], [3.0, 1.0])], "x array<double>, y array<double>")
    assert pair.select(V.relative_error(F.col("x"), F.col("y"))).first()[0] == 0.6
    row = search.round_trip(spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.5, 0.5, 0.5, 0.5])], "vec_id bigint, embedding array<double>"), Rotation(4)).first()
    assert row["cosine"] > 0.9 and row["error"] < 0.5
