import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis.functions.providers import OfflineProvider, distill, keep_unlike
from brevis.functions.text import estimate_tokens, to_fixed
from brevis.operators import memory


def conversation(spark, n=24):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"We should use part {i} for the goal. Filler number {i} follows here.") for i in range(n)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_tokens(spark):
    df = spark.createDataFrame([("",), ("   ",), ("abcd",), ("abcde",), (None,), ("\u00a0ab\ufeff",), ("😀a",)], "t string")
    assert [r[0] for r in df.select(estimate_tokens("t")).collect()] == [0, 0, 1, 2, 0, 1, 1]


def test_to_fixed(spark):
    df = spark.createDataFrame([(1.005,), (-0.0005,), (2.5,)], "x double")
    assert [r[0] for r in df.select(to_fixed(F.col("x"), 2)).collect()] == [1.0, 0.0, 2.5]


def test_flushes_do_not_depend_on_batches(spark):
    d = memory.flush_schedule(conversation(spark)).groupBy("block").count().collect()
    assert {r["block"]: r["count"] for r in d} == {0: 9, 1: 9, None: 6}
    early = memory.flush_schedule(conversation(spark, 14)).filter("block IS NOT NULL").count()
    assert early == 0 and memory.flush_schedule(conversation(spark, 15)).filter("block IS NOT NULL").count() == 9


def test_greedy_deduplication_is_not_transitive():
    a, b, c = "a b c d e f g h i j", "b c d e f g h i j k", "c d e f g h i j k l"
    assert keep_unlike([a, b, c], 0.8) == [0, 2]
    assert keep_unlike(["!!", "??"]) == [0, 1]


def test_offline_provider():
    p = OfflineProvider()
    v = p.embed(["the quick brown fox"])[0]
    assert {i: round(float(x), 6) for i, x in enumerate(v) if x} == {4: 0.5, 36: 0.5, 47: 0.5, 50: 0.5}
    assert p.complete("lost --- user: We must go. ok.") == "- We must go."
    assert distill("user: I prefer tea. Nice.", p) == ["I prefer tea."]


def packed(spark, costs, budget, **how):
    recent = [{"turn": i, "role": "user", "content": "x" * (4 * c)} for i, c in enumerate(costs)]
    state = spark.createDataFrame([(1, recent, [{"id": "m", "text": "abcd", "kind": "fact", "source": None}], 0, len(costs))], memory.STATE)
    return memory.pack_context(state, budget, **how).first()


def test_packing_skips_and_goes_on(spark):
    row = packed(spark, [3, 50, 5], 10)
    assert [len(m["content"]) // 4 for m in row["messages"]] == [3, 5]
    assert row["memories_used"] == 0


def test_preamble_and_memory_order(spark):
    row = packed(spark, [2], 20, system="s" * 8)
    assert [m["role"] for m in row["messages"]] == ["system", "system", "user"]
    assert row["messages"][0]["content"] == "Relevant memory:\n- abcd"
    assert [m["role"] for m in packed(spark, [2], 3, system="s" * 80)["messages"]] == ["user"]


def test_ranked_packing(spark):
    memories = [{"id": str(i), "text": t, "kind": "fact", "source": None} for i, t in enumerate(["about cats", "about the export pipeline"])]
    state = spark.createDataFrame([(1, [], memories, 10, 0)], memory.STATE)
    row = memory.pack_context(state, 9, query="export pipeline", provider=OfflineProvider()).first()
    assert row["messages"][0]["content"] == "Relevant memory:\n- about the export pipeline"


def test_equally_like_memories_keep_their_order(spark):
    """Both share sums of 3 with the query and of 9 with themselves; scaled vectors differ in the last bit."""
    texts, query = ["we use cats we use", "to cats to"], "What must the next release use?"
    asked, *own = OfflineProvider().counts([query, *texts])
    assert [(v @ asked, v @ v) for v in own] == [(3, 9), (3, 9)]
    for order in (texts, texts[::-1]):
        memories = [{"id": str(i), "text": t, "kind": "fact", "source": None} for i, t in enumerate(order)]
        state = spark.createDataFrame([(1, [], memories, 10, 0)], memory.STATE)
        row = memory.pack_context(state, 90, query=query, provider=OfflineProvider()).first()
        assert row["messages"][0]["content"] == "\n- ".join(["Relevant memory:", *order])


def test_ranking_takes_a_provider_s_own_vectors(spark):
    class ByLength(OfflineProvider):
        """The shorter a text, the more alike to a query of one letter."""

        def embed(self, texts):
            return np.array([[1.0, len(t) - 1.0] for t in texts])

    memories = [{"id": str(i), "text": t, "kind": "fact", "source": None} for i, t in enumerate(["a long one", "short"])]
    state = spark.createDataFrame([(1, [], memories, 10, 0)], memory.STATE)
    row = memory.pack_context(state, 90, query="a", provider=ByLength()).first()
    assert row["messages"][0]["content"] == "Relevant memory:\n- short\n- a long one"


@pytest.mark.parametrize("size", [1, 5, 24])
def test_stream_equals_batch(spark, tmp_path, size):
    from brevis.streaming.ingest import drain, ingest_stream

    messages = conversation(spark)
    folder = tmp_path / "in"
    for at in range(0, 24, size):
        messages.filter((F.col("turn") >= at) & (F.col("turn") < at + size)).coalesce(1).write.mode("append").parquet(str(folder))
        if size > 1:
            continue
        if at >= 17:
            break
    n = spark.read.parquet(str(folder)).count()
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = drain(ingest_stream(stream), "conv_id", "ingested", "t").first()
    want = memory.memory_state(conversation(spark, n)).first()
    state = json.loads(got["state"])
    assert [m["text"] for m in state["memories"]] == [m["text"] for m in want["memories"]]
    assert [m["turn"] for m in state["recent"]] == [m["turn"] for m in want["recent"]]
    assert got["ingested"] == n and state["raw_tokens"] == want["raw_tokens"]
