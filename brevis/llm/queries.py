"""The registered queries of this package and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevis.llm import langid, lmscore, ngram_join, ngram_sql, packing, pii, quality, topk, toxicity, urlgraph, wfst
from brevis.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, over all cores where the table is small."""
    return spread(table(spark, sf_dir, "documents"))


def remainder(doc_id: str | Column, m: int) -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % m


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, remainder("doc_id", 4) != 2)
    out = langid.identify(docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "family_pred")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    pieces = packing.tokenize_pieces(docs, tokenizer_path("byte_bpe_50k.json"))
    digest = packing.staged(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(digest)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.filter_urls(table(spark, sf_dir, "pages"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return out.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wfst.encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "n_byte_pieces", "restored")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return lmscore.cross_entropy_difference(documents(spark, sf_dir), good)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [v for k, v in sorted(globals().items()) if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": ngram_sql.SQL, "op6_url_filters": urlgraph.sql(), "op7_exact_top_k": topk.sql(50)}
