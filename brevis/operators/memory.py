"""Conversation memory and context packing over a table of messages.

Messages are taken one at a time in the order of ``turn``: as soon as more than ``keep_recent +
distill_every`` are held, all but the last ``keep_recent`` are distilled. Seen from the start of a
conversation this happens at fixed message numbers, so the schedule is a plain window expression;
blocks are distilled in parallel and only the facts of a conversation meet for de-duplication.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevis.functions.providers import OfflineProvider, Provider, directions, distill, keep_unlike
from brevis.functions.text import estimate_tokens, to_fixed
from brevis.functions.vectors import cosine
from brevis.session import ship_package

KEEP_RECENT, DISTILL_EVERY, BUDGET = 6, 8, 8000
STATE = "conv_id bigint, recent array<struct<turn:bigint,role:string,content:string>>, memories array<struct<id:string,text:string,kind:string,source:struct<`from`:bigint,`to`:bigint>>>, raw_tokens bigint, ingested bigint"


Counter = Callable[[Column], Column]


def _flushed(position: Column, total: Column, keep_recent: int, distill_every: int) -> Column:
    """The flush that takes the message at ``position`` of ``total``, or null for a recent one.
    Flushes hold ``distill_every + 1`` messages each."""
    size = distill_every + 1
    flushes = F.greatest(F.lit(0), F.floor((total - keep_recent) / size))
    block = F.floor(position / size)
    return F.when(block < flushes, block)


def flush_schedule(messages: DataFrame, keep_recent: int = KEEP_RECENT, distill_every: int = DISTILL_EVERY) -> DataFrame:
    """``messages`` with ``position`` (from 0) and ``block``: the flush that takes a message, or
    null for the recent ones. Blocks hold ``distill_every + 1`` messages each."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    d = messages.withColumns({"position": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy("conv_id"))})
    return d.withColumn("block", _flushed(F.col("position"), F.col("_n"), keep_recent, distill_every)).drop("_n")


def distill_blocks(scheduled: DataFrame, provider: Provider | None = None) -> DataFrame:
    """``conv_id, block, start, stop, facts``: what the provider finds in each block."""
    ship_package(scheduled.sparkSession)
    provider = provider or OfflineProvider()
    ordered = F.sort_array(F.collect_list(F.struct("position", F.concat("role", F.lit(": "), "text").alias("line"))))
    found = scheduled.filter("block IS NOT NULL").groupBy("conv_id", "block").agg(F.array_join(ordered["line"], "\n").alias("transcript"), F.min("position").alias("start"), (F.max("position") + 1).alias("stop"))

    @F.pandas_udf("array<string>")
    def facts(transcripts: pd.Series) -> pd.Series:
        return transcripts.map(lambda t: distill(t, provider))

    return found.select("conv_id", "block", "start", "stop", facts("transcript").alias("facts"))


MEMORIES = "array<struct<id:string,text:string,kind:string,source:struct<`from`:bigint,`to`:bigint>>>"


def memory_state(
    messages: DataFrame, keep_recent: int = KEEP_RECENT, distill_every: int = DISTILL_EVERY, provider: Provider | None = None, threshold: float = 0.8,
    count: Counter = estimate_tokens, before: DataFrame | None = None,
) -> DataFrame:
    """One row per conversation: recent messages, de-duplicated facts and counters.

    With ``before``, an earlier result, ``messages`` are those that came after it. Blocks are laid
    from a conversation's first message on, so the result is that of all messages at once.
    """
    new = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", count(F.col("text")).alias("tokens"))
    counters = new.groupBy("conv_id").agg(F.sum("tokens").cast("bigint").alias("raw_tokens"), F.count("*").alias("ingested"))
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    if before is None:
        lines = new.withColumn("position", position)
        known = None
    else:
        old = before.select("conv_id", "ingested", F.posexplode("recent").alias("_at", "m"), F.size("recent").alias("_held"))
        old = old.select("conv_id", "m.turn", "m.role", F.col("m.content").alias("text"), (F.col("ingested") - F.col("_held") + F.col("_at")).cast("int").alias("position"))
        # one row per conversation on the right
        lines = new.withColumn("position", position).join(before.select("conv_id", F.col("ingested").alias("_before")), "conv_id", "left")
        lines = lines.withColumn("position", (F.col("position") + F.coalesce("_before", F.lit(0))).cast("int")).select("conv_id", "turn", "role", "text", "position").unionByName(old)
        counters = counters.unionByName(before.select("conv_id", "raw_tokens", "ingested")).groupBy("conv_id").agg(F.sum("raw_tokens").alias("raw_tokens"), F.sum("ingested").alias("ingested"))
        known = before.select("conv_id", F.posexplode("memories").alias("place", "m")).select("conv_id", F.lit(-1).cast("bigint").alias("block"), "place", "m.text", F.col("m.source.from").alias("start"), F.col("m.source.to").alias("stop"), F.col("m.id").alias("id"))
    scheduled = lines.join(counters.select("conv_id", F.col("ingested").alias("_n")), "conv_id").withColumn("block", _flushed(F.col("position"), F.col("_n"), keep_recent, distill_every))
    recent = F.sort_array(F.collect_list(F.when(F.col("block").isNull(), F.struct("position", F.col("turn").cast("bigint").alias("turn"), "role", F.col("text").alias("content")))))
    base = scheduled.groupBy("conv_id").agg(F.transform(recent, lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["content"].alias("content"))).alias("recent"))

    @F.pandas_udf("array<int>")
    def unlike(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: keep_unlike(list(t), threshold))

    facts = distill_blocks(scheduled, provider).select("conv_id", "block", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), F.posexplode("facts").alias("place", "text"))
    facts = facts.withColumn("id", F.concat(F.lit("m"), F.col("block").cast("string"), F.lit("_"), F.col("place").cast("string")))
    if known is not None:
        facts = facts.unionByName(known)
    listed = facts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "place", "text", "start", "stop", "id"))).alias("all"))
    memory = lambda m: F.struct(m["id"].alias("id"), m["text"].alias("text"), F.lit("fact").alias("kind"), F.struct(m["start"].alias("from"), m["stop"].alias("to")).alias("source"))
    kept = listed.withColumn("keep", unlike(F.col("all.text"))).select("conv_id", F.transform("keep", lambda i: memory(F.get(F.col("all"), i))).alias("memories"))
    none = F.array().cast(MEMORIES)
    # a conversation without any held message still has counters
    out = counters.join(base, "conv_id", "left").join(kept, "conv_id", "left")
    return out.select("conv_id", F.coalesce("recent", F.array().cast("array<struct<turn:bigint,role:string,content:string>>")).alias("recent"), F.coalesce("memories", none).alias("memories"), "raw_tokens", "ingested")


def dedupe_facts(facts: DataFrame, key: str, order: str, text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``facts`` that are kept: in each group, in order, a text goes if its words are too
    like those of one kept before. Null texts have no words and are kept."""
    ship_package(facts.sparkSession)

    @F.pandas_udf("array<int>")
    def unlike(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: keep_unlike([x or "" for x in t], threshold))

    listed = facts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.struct(*(F.col(f"`{c}`") for c in facts.columns)).alias("row")))).alias("_all"))
    kept = listed.select(F.explode(unlike(F.transform("_all", lambda r: r["row"][text]))).alias("_i"), "_all")
    return kept.select(F.get("_all", F.col("_i"))["row"].alias("r")).select("r.*")


def _greedy(items: Column, budget: Column) -> Column:
    """Items taken in order while they fit: struct(left, taken). What does not fit is skipped."""
    start = F.struct(budget.cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("taken"))

    def step(state: Column, item: Column) -> Column:
        fits = item["cost"] <= state["left"]
        return F.struct(
            F.when(fits, state["left"] - item["cost"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.concat(state["taken"], F.array(item["at"].cast("bigint")))).otherwise(state["taken"]).alias("taken"),
        )

    return F.aggregate(items, start, step)


def pack_context(state: DataFrame, budget: int | Column = BUDGET, system: str | None = None, query: str | None = None, provider: Provider | None = None, count: Counter = estimate_tokens) -> DataFrame:
    """``conv_id, messages`` and counters: memories, preamble and recent turns within a budget.

    The preamble is charged first, then recent turns from the newest back, then memories, in the
    order of their likeness to ``query`` if the provider can embed; of equal ones the earlier first.
    """
    ship_package(state.sparkSession)
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    cost = F.lit(0).cast("bigint") if not system else count(F.lit(system))
    use_system = F.lit(bool(system)) & (cost <= limit)
    d = state.withColumn("_left", limit - F.when(use_system, cost).otherwise(0))
    turns = F.transform("recent", lambda m, i: F.struct(i.alias("at"), count(m["content"]).alias("cost")))
    d = d.withColumn("_recent", _greedy(F.reverse(turns), F.col("_left")))
    if query and provider is not None and hasattr(provider, "embed"):

        @F.pandas_udf("array<array<double>>")
        def embed(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: directions(provider, list(t)).tolist())

        target = F.array(*(F.lit(float(x)) for x in directions(provider, [query])[0]))
        d = d.withColumn("_vectors", embed(F.col("memories.text")))
        ranked = F.array_sort(F.transform("memories", lambda m, i: F.struct((-cosine(target, F.get(F.col("_vectors"), i))).alias("rank"), i.alias("at"), (count(m["text"]) + 2).alias("cost"))))
    else:
        ranked = F.transform("memories", lambda m, i: F.struct(F.lit(0.0).alias("rank"), i.alias("at"), (count(m["text"]) + 2).alias("cost")))
    d = d.withColumn("_memory", _greedy(ranked, F.col("_recent.left")))
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    remembered = F.concat(F.lit("Relevant memory:\n"), F.array_join(F.transform("_memory.taken", lambda i: F.concat(F.lit("- "), F.get(F.col("memories"), i.cast("int"))["text"])), "\n"))
    chosen = F.transform(F.sort_array("_recent.taken"), lambda i: message(F.get(F.col("recent"), i.cast("int"))["role"], F.get(F.col("recent"), i.cast("int"))["content"]))
    d = d.withColumn("messages", F.concat(
        F.when(F.size("_memory.taken") > 0, F.array(message(F.lit("system"), remembered))).otherwise(none),
        F.when(use_system, F.array(message(F.lit("system"), F.lit(system or "")))).otherwise(none), chosen))
    d = d.withColumn("packed_tokens", F.aggregate(F.transform("messages", lambda m: count(m["content"])), F.lit(0).cast("bigint"), lambda a, x: a + x))
    ratio = F.when(F.col("packed_tokens") > 0, to_fixed(F.col("raw_tokens") / F.col("packed_tokens"), 2)).otherwise(1.0)
    return d.select("conv_id", "messages", "raw_tokens", "packed_tokens", ratio.alias("ratio"), F.size("recent").alias("raw_messages"), F.size("messages").alias("packed_messages"), F.size("_memory.taken").alias("memories_used"))


def inspect(state: DataFrame) -> DataFrame:
    return state.select("conv_id", "memories", "recent")
