"""Conversation memory and session counters over streams.

State is kept per conversation. Messages are taken one at a time in the order of ``turn`` within a
micro-batch, so results do not depend on how messages fall into batches, provided that a
conversation's turns arrive in order. A batch is atomic: if the provider fails, the batch is run
again from the state before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brevis.functions.providers import OfflineProvider, Provider, distill, keep_unlike
from brevis.functions.text import estimate_tokens
from brevis.operators.memory import DISTILL_EVERY, KEEP_RECENT
from brevis.session import ship_package, staged

OUTPUT = "conv_id bigint, state string, ingested bigint, n_memories int, n_recent int"


def ingest_stream(messages: DataFrame, keep_recent: int = KEEP_RECENT, distill_every: int = DISTILL_EVERY, provider: Provider | None = None, threshold: float = 0.8) -> DataFrame:
    """The state of every conversation that a micro-batch touches, after it (update mode)."""
    ship_package(messages.sparkSession)
    provider = provider or OfflineProvider()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"recent": [], "memories": [], "ingested": 0, "raw_tokens": 0}
        new = pd.concat(list(parts)).sort_values("turn")
        for turn, role, text, tokens in zip(new["turn"], new["role"], new["text"], new["tokens"], strict=True):
            held["recent"].append({"turn": int(turn), "role": role, "content": text})
            held["ingested"] += 1
            held["raw_tokens"] += int(tokens)
            if len(held["recent"]) <= keep_recent + distill_every:
                continue
            cut = len(held["recent"]) - keep_recent
            old, held["recent"] = held["recent"][:cut], held["recent"][cut:]
            stop = held["ingested"] - keep_recent
            facts = distill("\n".join(f"{m['role']}: {m['content']}" for m in old), provider)
            every = held["memories"] + [{"text": f, "from": stop - cut, "to": stop} for f in facts]
            held["memories"] = [every[i] for i in keep_unlike([m["text"] for m in every], threshold)]
        state.update((json.dumps(held),))
        yield pd.DataFrame({"conv_id": [key[0]], "state": [json.dumps(held, sort_keys=True, ensure_ascii=False)], "ingested": [held["ingested"]], "n_memories": [len(held["memories"])], "n_recent": [len(held["recent"])]})

    ready = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), estimate_tokens("text").alias("tokens"))
    return ready.groupBy("conv_id").applyInPandasWithState(step, OUTPUT, "held string", "update", GroupStateTimeout.NoTimeout)


def session_counters(calls: DataFrame) -> DataFrame:
    """Running totals of a stream of compression results (complete mode)."""
    return calls.agg(F.count("*").alias("calls"), F.sum("original_tokens").alias("tokens_in"), F.sum("compressed_tokens").alias("tokens_out"))


def append_store(originals: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Append a stream of ``handle, original`` rows to the reversible store at ``path``."""
    return originals.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def _drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All rows that a stream writes while it runs over what is there."""
    spark = stream.sparkSession
    path = staged(spark.createDataFrame([], stream.schema), name)._brevis_path  # noqa: SLF001
    write = lambda batch, _: batch.write.mode("append").parquet(path)
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain(stream: DataFrame, key: str, newest: str, name: str) -> DataFrame:
    """Run an update-mode stream over what is there and return the newest row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(newest))
    return _drained(stream, name, "update").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def drain_counters(calls: DataFrame, name: str = "counters") -> DataFrame:
    """The last running totals of a stream of compression results; zeros if there was none."""
    found = _drained(session_counters(calls), name, "complete")
    return found.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in found.columns))
