"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. :func:`run` writes every stage's
result as Parquet to the shared scratch folder and reads it back for the next one; what a stage
stored on the way is deleted then.

Defined results, for every stage: a null text counts as an empty one; the first stage rejects both,
as they have fewer words than its base rule asks for, and the other stages keep them (packed, they
are an end token each). Rows that repeat are judged each on its own, but of rows with equal texts,
or with one identifier and one text, near copies leave one. An empty table gives an empty result
with the same columns. Further columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevis.llm import ngram_join, packing, pii, quality, toxicity
from brevis.llm.queries import remainder, table, tokenizer_path
from brevis.session import drop_staged, scratch, staged, trim

#: Identifiers to drop that are broadcast at most; beyond, documents are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trim(spark)
    return quality.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; the model learns from labelled ones here."""
    trim(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of smallest identifier, null ones last. Rows are
    told apart by identifier and text; of rows that share both, one is kept."""
    trim(spark)
    kind = docs.schema["doc_id"].dataType
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"), F.xxhash64("text").alias("hash"))
    found = staged(ngram_join.similarity_components(docs.select(key.alias("doc_id"), "text")), "pipeline-components")
    others = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_key")).distinct()
    repeated = staged(found.filter("n_shingles > 0 AND component_id = doc_id").groupBy(F.col("doc_id").alias("_key")).count().filter("count > 1").select("_key"), "pipeline-repeated")
    n_repeated = repeated.count()
    side = lambda keys, n: F.broadcast(keys) if n <= BROADCAST_IDS else keys
    kept = docs.withColumn("_key", key).join(side(others, others.count()), "_key", "left_anti")
    if n_repeated:
        repeated = side(repeated, n_repeated)
        kept = kept.join(repeated, "_key", "left_anti").unionByName(kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by placeholders."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, their token ids (``ids``, little-endian unsigned 32-bit) and
    their places in training sequences. Null and empty texts are an end token each."""
    pieces = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("best-fit packing", pack),
]

#: Training, iterated estimates and tokenisation have no SQL form; tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as used:
            out = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
            used.keep(out)
        drop_staged(docs)
        docs = out
    return docs
