"""The pipeline's stages, each against what it is given."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from kervan.llm.common import stage
from tests.llm.test_operators import crc, ids_by_library, lowered, near_brute


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(step(spark, kept[-1], sf), f"test_{name}"))
        assert kept[-1].columns == columns
    counts = [k.count() for k in kept]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    texts = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    last = {}
    for i in sorted(texts):
        last[lowered(texts[i])] = i
    assert {r["doc_id"] for r in kept[2].collect()} == set(last.values())
    classes = near_brute([tuple(r) for r in kept[2].select("doc_id", "text").collect()])
    assert {r["doc_id"] for r in kept[3].collect()} == set(classes.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf)
    encode, want = ids_by_library("word_bpe_49k.json", 1), Counter()
    for r in kept[-1].select("doc_id", "text").collect():
        ids = encode(r["text"])
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])] += 1
    assert Counter(tuple(r) for r in packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == want
    per = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r["sum(length)"] <= 4096 for r in per)
    assert packed.select("doc_id").distinct().count() == kept[-1].select("doc_id").distinct().count()


def test_stages_on_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf), f"test_empty_{name}")
        assert docs.isEmpty()
