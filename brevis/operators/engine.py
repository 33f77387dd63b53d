"""One object for the whole of it: conversations, contexts and reversible compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevis.functions.providers import OfflineProvider, Provider
from brevis.functions.text import estimate_tokens
from brevis.operators import content, memory
from brevis.session import drop_staged, staged
from brevis.sources.text import load_snapshot, save_snapshot


class Engine:
    """Memory of conversations, contexts within a budget, and a store of what was compressed.

    State and store are tables in the shared scratch folder, made anew by each call that changes
    them, so a call that fails leaves them as they were.
    """

    def __init__(
        self, spark: SparkSession, provider: Provider | None = None, budget: int = memory.BUDGET, keep_recent: int = memory.KEEP_RECENT, distill_every: int = memory.DISTILL_EVERY,
        count: content.Counter = estimate_tokens,
    ):
        self.spark, self.provider, self.budget, self.count = spark, provider or OfflineProvider(), budget, count
        self.keep_recent, self.distill_every = keep_recent, distill_every
        self.state = spark.createDataFrame([], memory.STATE)
        self.store: DataFrame | None = None
        self.calls: DataFrame | None = None

    def _replace(self, name: str, new: DataFrame) -> None:
        old, table = getattr(self, name), staged(new, f"engine-{name}")
        setattr(self, name, table)
        if old is not None:
            drop_staged(old)

    def ingest(self, messages: DataFrame) -> None:
        """Add messages (``conv_id, turn, role, text``) that come after those added before."""
        touched = memory.memory_state(messages, self.keep_recent, self.distill_every, self.provider, count=self.count, before=self.state.join(messages.select("conv_id").distinct(), "conv_id", "left_semi"))
        self._replace("state", touched.unionByName(self.state.join(messages.select("conv_id").distinct(), "conv_id", "left_anti")))

    def build_context(self, query: str | None = None, budget: int | Column | None = None, system: str | None = None) -> DataFrame:
        """Messages and counters of every conversation, ranked by ``query`` if the provider embeds."""
        return memory.pack_context(self.state, self.budget if budget is None else budget, system, query, self.provider, self.count)

    def compress(self, df: DataFrame, key: str, text: str = "text", level: str = "safe", kind: str | None = None, keep: float | None = None) -> DataFrame:
        """``df`` compressed; the originals are stored under handles made from ``key``. A handle that
        is there already gets the newer original."""
        new = content.store(df, key, text)
        out = staged(content.compress_content(df, text, level, kind, keep, key, self.count), "engine-compressed")
        self._replace("store", new if self.store is None else self.store.join(new, "handle", "left_anti").unionByName(new))
        tokens = out.select("original_tokens", "compressed_tokens")
        self._replace("calls", tokens if self.calls is None else self.calls.unionByName(tokens))
        return out

    def _originals(self) -> DataFrame:
        return self.spark.createDataFrame([], "handle string, original string") if self.store is None else self.store

    def retrieve(self, handles: DataFrame, limit: int = content.RETRIEVE_LIMIT) -> DataFrame:
        return content.retrieve_tool(handles, self._originals(), limit)

    def retrieve_all(self, df: DataFrame, compressed: str, *keys: str) -> DataFrame:
        return content.retrieve_all(df, compressed, self._originals(), *keys)

    def stats(self) -> DataFrame:
        calls = self.spark.createDataFrame([], "original_tokens bigint, compressed_tokens bigint") if self.calls is None else self.calls
        return content.session_stats(calls, self._originals())

    def size(self) -> int:
        return self._originals().count()

    def clear(self) -> None:
        """Drop all stored originals; handles given out before are unknown from then on."""
        if self.store is not None:
            drop_staged(self.store)
        self.store = None

    def inspect(self) -> DataFrame:
        return memory.inspect(self.state)

    def snapshot(self, path: str) -> None:
        save_snapshot(self.state, path)

    def restore(self, path: str) -> None:
        """Take the state of a snapshot in place of the present one."""
        self._replace("state", load_snapshot(self.spark, path).select(*self.state.columns))

    def total(self) -> DataFrame:
        """One row: conversations, messages ingested, facts and raw tokens."""
        return self.state.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("ingested"), F.lit(0)).alias("messages"), F.coalesce(F.sum(F.size("memories")), F.lit(0)).alias("facts"), F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw_tokens"))
