"""The facade, and memory that goes on from an earlier state."""

import pytest
from pyspark.sql import functions as F

from brevis.operators import memory
from brevis.operators.engine import Engine


def messages(spark, convs, n):
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", f"We must use part {i % 7} of {c} for the goal. Filler {i} here.") for c in convs for i in range(n)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def facts(state):
    return {r["conv_id"]: ([m["id"] for m in r["memories"]], [m["text"] for m in r["memories"]], [(m["source"]["from"], m["source"]["to"]) for m in r["memories"]], [m["turn"] for m in r["recent"]], r["raw_tokens"], r["ingested"]) for r in state.collect()}


@pytest.mark.parametrize("cuts", [[5], [3, 16, 17]])
def test_ingestion_in_parts_equals_one(spark, cuts):
    every = messages(spark, [1, 2], 30).union(messages(spark, [3], 4))
    want = facts(memory.memory_state(every))
    engine = Engine(spark)
    for low, high in zip([0, *cuts], [*cuts, 99], strict=True):
        engine.ingest(every.filter((F.col("turn") >= low) & (F.col("turn") < high)))
    assert facts(engine.state) == want
    assert tuple(engine.total().first()) == (3, 64, sum(len(v[0]) for v in want.values()), sum(v[4] for v in want.values()))


def test_context_compression_and_retrieval(spark):
    engine = Engine(spark, budget=60, keep_recent=2, distill_every=2)
    engine.ingest(messages(spark, [1], 9))
    row = engine.build_context(query="which part?", system="Be brief.").first()
    assert row["packed_tokens"] <= 60 + 5 and row["messages"][0]["content"].startswith("Relevant memory:") and row["messages"][1]["content"] == "Be brief."
    assert engine.build_context(budget=0).first()["packed_messages"] == 0
    texts = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None)], "k bigint, text string")
    out = {r["k"]: r for r in engine.compress(texts, "k").collect()}
    assert out[1]["handle"] == "ccr_1" and engine.size() == 2
    engine.compress(texts.limit(1).withColumn("text", F.lit("newer text of one")), "k")
    found = {r["handle"]: r for r in engine.retrieve(spark.createDataFrame([("ccr_1",), ("ccr_7",)], "handle string")).collect()}
    assert found["ccr_1"]["original"] == "newer text of one" and found["ccr_7"]["error"] == "unknown handle"
    stats = engine.stats().first()
    assert (stats["calls"], stats["stored"]) == (3, 2)
    named = spark.createDataFrame([(1, out[1]["compressed"])], "id int, c string")
    assert [r["original"] for r in engine.retrieve_all(named, "c", "id").collect()] == ["newer text of one"]
    engine.clear()
    assert engine.size() == 0 and engine.stats().first()["stored"] == 0


def test_snapshot_and_restore(spark, tmp_path):
    every = messages(spark, [1], 20)
    first = Engine(spark)
    first.ingest(every.filter("turn < 16"))
    first.snapshot(str(tmp_path / "s"))
    second = Engine(spark)
    second.restore(str(tmp_path / "s"))
    assert facts(second.state) == facts(first.state) and second.inspect().columns == ["conv_id", "memories", "recent"]
    second.ingest(every.filter("turn >= 16"))
    assert facts(second.state) == facts(memory.memory_state(every))


def test_a_failing_provider_loses_nothing(spark):
    class Broken:
        def complete(self, prompt, max_tokens=1024):
            raise RuntimeError("down")

    engine = Engine(spark)
    engine.ingest(messages(spark, [1], 5))
    before = facts(engine.state)
    engine.provider = Broken()
    with pytest.raises(Exception, match="down"):
        engine.ingest(messages(spark, [1], 40).filter("turn >= 5"))
    assert facts(engine.state) == before


def test_own_token_counter(spark):
    words = lambda c: F.size(F.split(F.trim(c), " +")).cast("bigint")
    engine = Engine(spark, count=words)
    engine.ingest(spark.createDataFrame([(1, 0, "user", "one two three")], "conv_id bigint, turn bigint, role string, text string"))
    assert engine.state.first()["raw_tokens"] == 3
    assert engine.build_context(budget=2).first()["packed_messages"] == 0 and engine.build_context(budget=3).first()["packed_messages"] == 1


def test_facts_without_their_like(spark):
    a, b, c = "a b c d e f g h i j", "b c d e f g h i j k", "c d e f g h i j k l"
    rows = [(1, 0, a), (1, 1, b), (1, 2, c), (2, 0, b), (2, 1, None), (2, 2, None), (2, 3, b.upper())]
    df = spark.createDataFrame(rows, "g int, n int, text string")
    assert sorted((r["g"], r["n"]) for r in memory.dedupe_facts(df, "g", "n").collect()) == [(1, 0), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert memory.dedupe_facts(df.limit(0), "g", "n").count() == 0
