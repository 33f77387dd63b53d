import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brevis.llm import ngram_join, pii, toxicity
from brevis.llm.queries import oracle_sql, queries, remainder, tokenizer_path
from brevis.session import scratch_dir, staged

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(staged(stage(spark, seen[-1], SF), "test-stage"))
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == docs.columns for d in seen[:5])
    assert ids[0] > ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    model = toxicity.fit(seen[1], spark.read.parquet(f"{SF}/labels.parquet"), remainder("doc_id", 5) != 0)
    assert ids[2] == {r["doc_id"] for r in toxicity.score(seen[1], model).collect() if r["score"] < 0.5}
    assert ids[3] == {r["component_id"] for r in ngram_join.similarity_components(seen[2]).collect()}
    before = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert {r["doc_id"]: r["text"] for r in seen[4].collect()} == {i: pii.redact(t, pii.find_spans(t)) for i, t in before.items()}


def test_packed_sequences_hold_the_tokens(spark):
    from tokenizers import Tokenizer

    texts = ["one two", None, "", "words " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("sequence_id", F.lit("clash"))
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    reference = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = b"".join(r["ids"] for r in own)
        assert np.frombuffer(ids, "<u4").tolist() == [*reference.encode(t or "", add_special_tokens=False).ids, 2]
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in own)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edge_cases(spark, name, stage):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"word{k % 997} of{k % 89}" for k in range(150_000))
    odd = [(None,) * 5, (10**6, None, None, None, None), (10**6, "", "en", None, 0), (None, long, "en", "web", len(long)), (None, long, "en", "web", len(long)), (10**6 + 1, " " * 10**6 + "x", None, "web", None)]
    df = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(5))
    clash = {"toxic": F.lit(1), "sig": F.lit("s"), "score": F.lit(0.5), "_row": F.lit("r"), "ids": F.lit("i"), "label": F.lit(None).cast("string"), "kept": F.lit(True)}
    df = staged(df.withColumns(clash), "edge")
    out = stage(spark, df, SF)
    rows = out.collect()
    empty = stage(spark, df.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns
    if name == "best-fit packing":
        assert sum(r["doc_id"] is None and r["piece"] == 0 for r in rows) == 3
        return
    assert out.columns == df.columns
    blank = sum(not (r["text"] or "").strip() for r in rows)
    if name == "quality rules":
        assert blank == 0 and all(r["_row"] == "r" for r in rows)
    elif name == "toxicity":
        assert blank >= 3 and len(rows) > 150
    elif name == "n-gram Jaccard join":
        assert blank == 3 and sum(r["text"] == long for r in rows) == 1
    else:
        assert len(rows) == df.count()


def test_run_deletes_what_it_stored(spark):
    import os

    folder = scratch_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(folder)) - before
    assert [x.rsplit("-", 1)[0] for x in left if x.startswith(("pipeline-", "quality-", "join-", "pieces"))] == ["pipeline-best-fit-packing"]
    rows = out.collect()
    assert rows and max(sum(r["length"] for r in g) for g in _by(rows, "sequence_id").values()) <= 1024


def _by(rows, name):
    out = {}
    for r in rows:
        out.setdefault(r[name], []).append(r)
    return out


def test_one_query_for_each_operator():
    names = list(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(oracle_sql()) <= set(names)


def test_near_copies_of_repeated_and_null_identifiers(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d + " end"), (None, a), (4, ""), (4, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    ends = [x for x in got if x[1] and x[1].startswith("d0")]
    assert len(ends) == 1 and ends[0][0] is None
    assert sorted((x for x in got if x not in ends), key=str) == sorted([(1, a), (2, b), (3, c), (4, ""), (4, ""), (None, None)], key=str)
