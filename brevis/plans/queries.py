"""The registered queries over the source rules' operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevis.functions import line_rules
from brevis.functions import vectors as V
from brevis.functions.providers import OfflineProvider
from brevis.functions.quantizers import Binary, Int8, Product, Rotation
from brevis.functions.text import estimate_tokens, saving
from brevis.operators import content, memory, search
from brevis.session import ship_package, spread, staged

Query = Callable[[SparkSession, str], DataFrame]
#: Small memories, as the conversations have eight turns at most.
KEEP, EVERY = 2, 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, over all cores where it is small."""
    return spread(_table(spark, sf_dir, name))


def _joined(df: DataFrame, key: str, order: str, line: Column, head: str | None = None) -> DataFrame:
    """``key, text``: the lines of every key in order, one text each."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    text = F.array_join(ordered["l"], "\n")
    return df.groupBy(key).agg((F.concat(F.lit(head + "\n"), text) if head else text).alias("text"))


def _rounded(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5).cast("bigint")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log per user."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat_ws(" ", F.concat(stamp, F.lit("Z")), level, F.concat("event_type", F.lit(":")), F.lit("user"), F.col("user_id").cast("string"), F.lit("took"), F.floor("value").cast("string"))
    return _joined(_table(spark, sf_dir, "events"), "user_id", "event_id", line)


EVENT_LOGS = """SELECT user_id, string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' ' || event_type || ': user '
 || user_id || ' took ' || CAST(floor(value) AS BIGINT), chr(10) ORDER BY event_id) AS text FROM events GROUP BY user_id"""


def customer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_acctbal") < 0, "error").otherwise("ok"), "c_mktsegment")
    return _joined(_table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", line, "custkey,name,status,segment")


CUSTOMER_TABLES = """SELECT c_nationkey, 'custkey,name,status,segment' || chr(10) || string_agg(c_custkey || ',' || c_name || ',' || CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'ok' END || ',' || c_mktsegment,
 chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY c_nationkey"""


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as test output per user."""
    n = F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("FAIL suite "), n))
        .when(F.col("event_type") == "click", F.concat(F.lit("    at lib (node_modules/x/"), n, F.lit(".js:1:2)")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("    at own (src/"), n, F.lit(".js:1:2)")))
        .otherwise(F.concat(F.lit("PASS suite "), n))
    )
    return _joined(_table(spark, sf_dir, "events"), "user_id", "event_id", line)


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("event_id", F.to_json(F.struct("event_id", "event_type", "value")).alias("j"))))
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(ordered["j"], ","), F.lit("]")).alias("text"))


def _compressed(df: DataFrame, key: str, **how: str | float) -> DataFrame:
    return content.compress_content(df, **how).select(key, "type", "compressed", "original_tokens", "compressed_tokens")


# ---- tokens, detection and compression ----


def tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(estimate_tokens("text")).alias("tokens"))


def detect_type_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "documents").select("doc_id", content.detect_type("text").alias("type"))


def detect_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_texts(spark, sf_dir, t).select(F.lit(t).alias("table_name"), content.detect_type(c).alias("type")) for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("table_name", "type").agg(F.count("*").alias("n"))


def prose_prune_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(_texts(spark, sf_dir, "documents"), "doc_id", kind="prose")


def prose_prune_aggr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(_texts(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn")), "id", kind="prose", level="aggressive")


def log_compress_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(event_logs(spark, sf_dir), "user_id", kind="log")


def log_compress_aggr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(event_logs(spark, sf_dir), "user_id", kind="log", level="aggressive")


def table_compress_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(customer_tables(spark, sf_dir), "c_nationkey", kind="table")


def table_compress_aggr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(customer_tables(spark, sf_dir), "c_nationkey", kind="table", level="aggressive")


def trace_compress_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(event_traces(spark, sf_dir), "user_id", kind="trace")


def code_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(_texts(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id", kind="code")


def trace_compress_aggr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(event_traces(spark, sf_dir), "user_id", kind="trace", level="aggressive")


def code_compress_aggr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(_texts(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id", kind="code", level="aggressive")


def log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each template of a user's log lines occurs."""
    lines = event_logs(spark, sf_dir).select("user_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("user_id", line_rules.log_template("line").alias("template")).agg(F.count("*").alias("n"))


def pick_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _texts(spark, sf_dir, "documents").select("doc_id", line_rules.pick_delimiter("text").alias("d"))
    return found.select("doc_id", F.coalesce("d.delimiter", F.lit("none")).alias("delimiter"), F.coalesce("d.columns", F.lit(0)).alias("n_columns"))


def signal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the error lines of each user's log, those that the compressed log still holds."""
    logs = event_logs(spark, sf_dir).withColumn("markers", F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" ERROR "))))
    return content.signal_recall(content.compress_content(logs, kind="log", level="aggressive"), "compressed", "markers").select("user_id", "n_markers", "n_surviving")


def json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a compressed array shows and those that its note counts."""
    d = content.compress_content(event_json(spark, sf_dir), kind="json")
    shown = F.regexp_count("compressed", F.lit('"event_id":')).cast("bigint")
    hidden = F.coalesce(F.regexp_extract("compressed", "…\\(([0-9]+) more similar items\\)", 1).try_cast("bigint"), F.lit(0))
    return d.select("user_id", shown.alias("n_shown"), hidden.alias("n_hidden"))


def json_compress_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(event_json(spark, sf_dir), "user_id", kind="json")


def json_compress_aggr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(event_json(spark, sf_dir), "user_id", kind="json", level="aggressive")


def route_and_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = content.compress_content(_texts(spark, sf_dir, "documents"))
    total = d.groupBy("type").agg(F.count("*").alias("n"), F.sum("original_tokens").alias("tokens_in"), F.sum("compressed_tokens").alias("tokens_out"))
    return total.withColumn("saved", saving("tokens_in", "tokens_out")[1])


# ---- reversible store and tool surface ----


def ccr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = content.retrieve(docs.select("doc_id", content.handle_of("doc_id").alias("handle")), content.store(docs, "doc_id"))
    return found.select("doc_id", "handle", F.md5("original").alias("digest"), "length")


def ccr_retrieve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name their own handle twice, a neighbour's and one that is unknown."""
    docs = _table(spark, sf_dir, "documents")
    mark = lambda k: content.marker(content.handle_of(k))
    text = F.concat(mark("doc_id"), mark("doc_id"), mark(F.col("doc_id") + 1), content.marker(F.lit("ccr_zzzzzzzz")))
    return content.retrieve_all(docs.select("doc_id", text.alias("c")), "c", content.store(docs, "doc_id"), "doc_id").select("doc_id", "handle", F.md5("original").alias("digest"))


def retrieve_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = content.retrieve(docs.select("doc_id", content.handle_of(F.col("doc_id") + 1).alias("handle")), content.store(docs, "doc_id"), limit=2000)
    return found.select("doc_id", "handle", F.coalesce("length", F.lit(-1)).alias("length"), "truncated", F.coalesce(F.length("original"), F.lit(-1)).alias("returned"))


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir, "documents")
    calls = content.compress_content(docs, kind="code")
    return content.session_stats(calls, content.store(docs, "doc_id"))


# ---- memory and packing ----


def memory_flush_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.flush_schedule(_table(spark, sf_dir, "conversations"), KEEP, EVERY).select("conv_id", "turn", "position", F.coalesce("block", F.lit(-1)).alias("block"))


def memory_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = memory.memory_state(_table(spark, sf_dir, "conversations"), KEEP, EVERY)
    return state.select("conv_id", F.size("recent").alias("n_recent"), F.array_join("memories.text", "|").alias("facts"), "raw_tokens", "ingested")


def distill_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = memory.distill_blocks(memory.flush_schedule(_table(spark, sf_dir, "conversations"), KEEP, EVERY))
    return blocks.select("conv_id", "block", "start", "stop", F.array_join("facts", "\n").alias("facts"))


def offline_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)

    @F.pandas_udf("string")
    def complete(prompts: pd.Series) -> pd.Series:
        return prompts.fillna("").map(OfflineProvider().complete)

    return _texts(spark, sf_dir, "conversations").select("conv_id", "turn", complete("text").alias("completion"))


def dedupe_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation that are unlike those kept before them."""
    return memory.dedupe_facts(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn")


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(OfflineProvider().embed(list(texts.fillna("")))))

    d = _texts(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(embed("text")).alias("dim", "x"))
    return d.filter("x <> 0").select("conv_id", "turn", "dim", _rounded(F.col("x")).alias("x"))


def _packed(spark: SparkSession, sf_dir: str, **how) -> DataFrame:  # noqa: ANN003
    state = memory.memory_state(_table(spark, sf_dir, "conversations"), KEEP, EVERY)
    d = memory.pack_context(state, 120, **how)
    return d.withColumn("messages", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"))


def pack_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent turns alone: the memory keeps all turns, and the newest that fit are packed."""
    state = memory.memory_state(_table(spark, sf_dir, "conversations"), 1_000, 1_000)
    d = memory.pack_context(state, 100)
    return d.select("conv_id", "raw_tokens", "packed_tokens", "ratio", "raw_messages", "packed_messages")


def pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, system="Answer briefly.")


def pack_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, query="What must the next release use?", provider=OfflineProvider())


# ---- vectors ----


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.exact_top(_table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5)
    return found.select("query_id", "rank", "vec_id", _rounded(F.col("score")).alias("score"))


def int8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = V.int8_codes(V.doubles("embedding"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(codes.cast("array<string>"), ",").alias("codes"))


def binary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(V.sign_bits(V.doubles("embedding")).cast("array<string>"), "").alias("bits"))


def _short(spark: SparkSession, sf_dir: str, quantizer, size: int = 10) -> DataFrame:  # noqa: ANN001
    vectors = _table(spark, sf_dir, "embeddings")
    if isinstance(quantizer, Product):
        search.train_product(vectors, quantizer)
    found = search.shortlist(search.encode_vectors(vectors, quantizer), _queries(spark, sf_dir), quantizer, size)
    return found.select("query_id", F.col("approx_rank").alias("rank"), "vec_id", _rounded(F.col("approx")).alias("score"))


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return search.encode_vectors(vectors, search.train_product(vectors, Product(16, 64))).select("vec_id", F.hex("code").alias("code"))


def tq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.encode_vectors(_table(spark, sf_dir, "embeddings"), Rotation(3)).select("vec_id", F.hex("code").alias("code"))


def value_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine and relative error of vectors that were coded by rotation and decoded again."""
    return search.round_trip(_table(spark, sf_dir, "embeddings"), Rotation(3))


def int8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir, Int8())


def binary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir, Binary())


def pq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir, Product(16, 64))


def tq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir, Rotation(3))


def _reranked(spark: SparkSession, sf_dir: str, quantizer) -> DataFrame:  # noqa: ANN001
    vectors = _table(spark, sf_dir, "embeddings")
    if isinstance(quantizer, Product):
        search.train_product(vectors, quantizer)
    found = search.search_with_rerank(vectors, _queries(spark, sf_dir), quantizer, 10, 64)
    return found.select("query_id", "rank", "vec_id", _rounded(F.col("score")).alias("score"))


def rerank_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, Binary())


def pq_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, Product(16, 64))


def tq_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, Rotation(3))


def recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = search.exact_top(_table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10)
    out = None
    for name, q in (("int8", Int8()), ("binary", Binary()), ("product", Product(16, 64)), ("rotation", Rotation(3))):
        part = search.recall(_short(spark, sf_dir, q), truth).agg(F.avg("recall").alias("recall")).select(F.lit(name).alias("quantizer"), "recall")
        out = part if out is None else out.union(part)
    return out


def recall_int8_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = search.exact_top(_table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10)
    parts = [search.recall(_short(spark, sf_dir, q), truth).agg(_rounded(F.avg("recall")).alias("recall")).select(F.lit(q.name).alias("quantizer"), "recall") for q in (Int8(), Binary())]
    return parts[0].union(parts[1])


def _labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of the first vector of every label with the vectors of that label."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("v"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("q"))
    return e.join(first, "label").select("label", "vec_id", "v", V.dot(F.col("q"), F.col("v")).alias("score"))


def attention_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.softmax(F.col("score"), Window.partitionBy("label"))
    d = _labelled_scores(spark, sf_dir).withColumn("p", p)
    return d.select("label", "vec_id", _rounded(F.col("p")).alias("p"))


def kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of attention over rounded scores from that over exact ones."""
    w = Window.partitionBy("label")
    d = _labelled_scores(spark, sf_dir).select("label", V.softmax(F.col("score"), w).alias("p"), V.softmax(F.floor(F.col("score") * 10 + 0.5) / 10, w).alias("q"))
    return d.groupBy("label").agg(_rounded(F.sum(V.kl_term(F.col("p"), F.col("q")))).alias("kl"))


def attention_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors weighed by the softmax of their scores, by dimension."""
    d = _labelled_scores(spark, sf_dir).withColumn("p", V.softmax(F.col("score"), Window.partitionBy("label")))
    return V.weighted_sum(d, "p", "v", "label").select("label", "dim", _rounded(F.col("x")).alias("x"))


def attention_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative error and cosine of attention over 8-bit keys and values against exact ones."""
    w = Window.partitionBy("label")
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("v"))
    d = e.join(e.groupBy("label").agg(F.min_by("v", "vec_id").alias("q")), "label")
    coded = F.transform(V.int8_codes(F.col("v")), lambda c: c / F.lit(127.0))
    d = d.withColumn("u", coded).withColumns({"p": V.softmax(V.dot(F.col("q"), F.col("v")), w), "r": V.softmax(V.dot(F.col("q"), F.col("u")), w)})
    exact, approx = V.weighted_sum(d, "p", "v", "label"), V.weighted_sum(d, "r", "u", "label").withColumnRenamed("x", "y")
    both = exact.join(approx, ["label", "dim"]).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "x", "y"))).alias("o"))
    x, y = F.col("o.x"), F.col("o.y")
    return both.select("label", _rounded(V.relative_error(x, y)).alias("error"), _rounded(V.cosine(x, y)).alias("cosine"))


def tq_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.estimator_moments(_table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), Rotation(3))


# ---- streams ----


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brevis.streaming import ingest

    schema = _table(spark, sf_dir, "conversations").schema
    messages = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations.parquet*")
    state = ingest.drain(ingest.ingest_stream(messages, KEEP, EVERY), "conv_id", "ingested", "ingest")
    facts = F.from_json("state", "memories array<struct<text:string>>, raw_tokens bigint")
    return state.withColumn("s", facts).select("conv_id", "n_recent", F.array_join("s.memories.text", "|").alias("facts"), "s.raw_tokens", "ingested")


def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of a stream of compressed messages, after the last batch."""
    from brevis.streaming import ingest

    schema = _table(spark, sf_dir, "conversations").schema
    messages = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations.parquet*")
    return ingest.drain_counters(content.compress_content(messages, kind="code"))


def memory_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of all conversations where their first three turns were taken in before the rest."""
    turns = _table(spark, sf_dir, "conversations")
    first = staged(memory.memory_state(turns.filter("turn < 3"), KEEP, EVERY), "memory-first")
    state = memory.memory_state(turns.filter("turn >= 3"), KEEP, EVERY, before=first)
    return state.select("conv_id", F.size("recent").alias("n_recent"), F.array_join("memories.text", "|").alias("facts"), "raw_tokens", "ingested")


def queries() -> dict[str, Query]:
    own = (
        tokens_by_lang, detect_type_docs, detect_type_counts, prose_prune_safe, prose_prune_aggr, log_compress_safe, log_compress_aggr,
        table_compress_safe, table_compress_aggr, trace_compress_safe, code_compress, json_compress_safe, json_compress_aggr, route_and_report,
        ccr_roundtrip, ccr_retrieve_all, retrieve_truncated, session_stats, memory_flush_schedule, memory_state, distill_facts, hash_embed,
        pack_recent, pack_context, pack_ranked, cosine_topk, int8_encode, binary_encode, int8_topk, binary_topk, pq_topk, tq_topk,
        rerank_binary, pq_rerank, tq_rerank, recall_at_10, attention_softmax, kl_divergence, tq_bias, stream_ingest,
        trace_compress_aggr, code_compress_aggr, log_templates, pick_delimiter, signal_recall, json_counts, offline_complete, dedupe_facts, pq_encode, tq_encode,
        value_round_trip, recall_int8_binary, attention_output, attention_error, stream_stats, memory_in_parts,
    )
    return {f.__name__: f for f in own}
