"""Null ids, clashing names and odd characters, operator by operator."""

import random
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import pyarrow as pa
from pyspark.sql import functions as F

from kervan.llm.exact_dedup import exact_groups
from kervan.llm.mixing import mix
from kervan.llm.near_dedup import near_duplicates
from kervan.llm.packing import pack_documents
from kervan.llm.repeated_spans import repeated_spans
from kervan.llm.token_counts import token_counts
from kervan.llm.token_output import token_id_roundtrip
from kervan.llm.tokenizing import Pieces
from kervan.llm.topk_search import top_k
from tests.llm.test_operators import crc, ids_by_library, near_brute, topk_brute

LETTERS = [*"ab ı.'é\n\t", *[" "] * 6, "▁", "▁", "¨", "ͺ", "​", "⁠", "\xad", "　", "﻿", "ͅ", "ﬁ", "Ａ", "\xa0", "\x01", "İ", "\U0001f600", "한", "<s>", "<unk>", "<0x41>", "<|endoftext|>"]


def odd_texts(n, rng):
    return ["".join(rng.choices(LETTERS, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_of_odd_texts(name):
    """Characters on which a tokenizer's own cuts depend, its mark for a space among them."""
    texts = [*odd_texts(8_000, random.Random(name)), "▁ ı", "▁ ▁", "▁", " ▁", "a▁ b"]
    path = public_tokenizers.path(name)
    ids, ends = Pieces(path).ids(pa.array(texts))
    if name.endswith(".model"):
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    else:
        from tokenizers import Tokenizer

        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))] == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    return [(i if i % 3 else None, base[i % 12] if i % 11 else None) for i in range(48)] + [(7, base[7]), (None, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    names = ["_id", "_text", "_digest", "_run", "_row", "chunk", "length", "score", "size", "source", "class_id"]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for n in names:
        frame = frame.withColumn(n, F.lit("x"))
    return frame.cache()


def test_token_operators_with_null_ids(docs, rows):
    encode = ids_by_library("word_bpe_49k.json", 1)
    got = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64).collect()
    want = Counter((i, k, s, len(ids[s : s + 64]), crc(ids[s : s + 64])) for i, t in rows for ids in [encode(t)] for k, s in enumerate(range(0, len(ids), 64)))
    assert Counter(tuple(r)[:5] for r in got) == want and min(r["gap"] for r in got) >= 0
    encode = ids_by_library("byte_bpe_50k.json", 2)
    found = token_id_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((i, len(ids), crc(ids)) for i, t in rows for ids in [encode(t)])
    first = [r["doc_id"] for r in found]
    assert first[: first.count(None)] == [None] * first.count(None)
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counted = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, path).collect())
    assert counted == Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)


def test_dedup_with_null_ids(docs, rows):
    got = near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    named = [r for r in rows if r[0] is not None]
    want = near_brute(named)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["class_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    spans = {(r["doc_id"], r["n_removed"]) for r in repeated_spans(docs).collect() if r["doc_id"] is None}
    assert spans == {(None, 0)}
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").lower(), []).append(i)
    for r in exact_groups(docs).collect():
        same = next(g for g in groups.values() if r["doc_id"] in g and len(g) == r["group_size"])
        assert r["keep_id"] == max((i for i in same if i is not None), default=None) or r["keep_id"] in [i for g in groups.values() for i in g]


def test_mixing_with_null_ids(docs, rows):
    got = mix(docs.drop("source").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a"))).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_top_k_with_clashing_names(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.uniform(-2, 2) for _ in range(3)]) for i in range(50)] + [(5, None)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for n in ("query_id", "rank", "score", "_id", "block"):
        frame = frame.withColumn(n, F.lit(1))
    assert sorted(tuple(r) for r in top_k(frame, k=4, query_modulus=10).collect()) == topk_brute(vectors, 4, 10)


def test_large_families_shrink_to_their_pairs(spark):
    """A template family whose members are not alike enough gives no one to compare, near copies in it do, and of them all
    links are kept."""
    from kervan.llm import near_dedup
    from tests.llm.test_operators import words

    rng = random.Random(6)
    template = words(rng, 100).split()
    texts = []
    for i in range(300):
        w = template[:]
        for at in (10, 40, 70):
            w[at] = f"only{i}x{at}"
        texts.append(" ".join(w))
        if i % 60 == 0:
            texts.append(" ".join([*w[:-1], "other"]))
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = near_dedup.shingle_sets(frame, frame.select(F.col("id").alias("want")))
    members = frame.select("id", F.col("id").alias("label"))
    pairs = {i for i, t in enumerate(texts) if t.endswith("other")}
    assert {r["id"] for r in near_dedup.contested(members, sets, 0.8).collect()} == pairs | {i - 1 for i in pairs}
    joined = members.withColumn("label", F.when(F.col("id").isin(*pairs), F.col("id") - 1).otherwise(F.col("id")))
    assert near_dedup.contested(joined, sets, 0.8).isEmpty()


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_contested_members_hold_every_link(spark, threshold):
    from kervan.llm import near_dedup

    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(80):
        w = base[: rng.randint(20, 60)]
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(30)}"
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = near_dedup.shingle_sets(frame, frame.select(F.col("id").alias("want")))
    import numpy as np

    units = {r["id"]: set(np.frombuffer(r["units"], np.uint64).tolist()) for r in sets.collect()}
    linked = {i for i in units for j in units if i != j and len(units[i] & units[j]) >= threshold * len(units[i] | units[j])}
    kept = {r["id"] for r in near_dedup.contested(frame.select("id", F.col("id").alias("label")), sets, threshold).collect()}
    assert linked and linked <= kept
