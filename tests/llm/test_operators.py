"""Each operator against brute force, on small tables that hold nulls, empty, long, equal and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from kervan.llm.common import stage
from kervan.llm.exact_dedup import drop_copies, exact_groups
from kervan.llm.mixing import mix, mixed_documents
from kervan.llm.near_dedup import drop_near_duplicates, near_duplicates
from kervan.llm.packing import best_fit_decreasing, lower_bound, pack_documents
from kervan.llm.quality import BUCKET_BITS, margins, quality_scores
from kervan.llm.repeated_spans import repeated_spans
from kervan.llm.token_counts import token_counts
from kervan.llm.token_output import decode_ranks, encode_ranks, token_id_roundtrip
from kervan.llm.topk_search import top_k
from kervan.llm.toxicity import maximal_segments, toxicity_scores

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [words(rng, 60) for _ in range(12)]
    passage = words(rng, 25)
    texts = [None, "", "  ", "a", "Ab cd", "aB CD", "x y z"]
    for b in base:
        w = b.split()
        near = w[:]
        near[30] = "changed"
        texts += [b, b, b.upper(), " ".join(near), words(rng, 10) + " " + passage + " " + words(rng, 9)]
    texts += ["é ü ö " * 40, "ha " * 5000, words(rng, 8000), "tab\tand\r\nlines  and   spaces ", "<|endoftext|> it's 5% don't", "naïve ﬁ ① Å"]
    sources = ["b", "a", None, "c", "z"]
    out = [(i * 3 + 1, t, "en", sources[rng.randrange(5)], 0, 9) for i, t in enumerate(texts)]
    return out + [out[8], out[8]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return stage(spark.createDataFrame(rows, DOCS).repartition(5), "test_docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups(docs, rows, empty):
    got = Counter(tuple(r) for r in exact_groups(docs).collect())
    want = Counter()
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r[1]), []).append(r[0])
    for r in rows:
        ids = groups[lowered(r[1])]
        want[(r[0], max(ids), len(ids), r[0] == max(ids), hashlib.sha256(lowered(r[1]).encode()).hexdigest())] += 1
    assert got == want
    assert exact_groups(empty).count() == 0
    assert {r["doc_id"] for r in drop_copies(docs).collect()} == {max(v) for v in groups.values()}


def test_exact_groups_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "A"), (None, "b")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_groups(df).collect()}
    assert got == {(None, 1, False), (1, 1, True), (None, None, True)}


def shingles(t):
    w = [x for x in lowered(t).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near_brute(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    texts = {r[0]: r[1] or "" for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, either = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if texts[a] == texts[b] or (either and both >= 0.8 * either):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, rows, empty):
    want = near_brute(rows)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    assert near_duplicates(empty).count() == 0
    assert {r["doc_id"] for r in drop_near_duplicates(docs).collect()} == set(want.values())


def one_bucket(monkeypatch):
    """Every text meets every other in one bucket, whatever the signatures are."""
    from pyspark.sql import functions as F

    from kervan.llm import near_dedup

    monkeypatch.setattr(near_dedup, "band_hashes", lambda texts, bands, rows: texts.select("id", F.lit(0).cast("long").alias("bucket")))
    return near_dedup


def family(rng, n_pairs):
    """Pairs of near copies that share most of one template; members of different pairs stay below 0.8."""
    template, rows = words(rng, 100).split(), []
    for i in range(n_pairs):
        w = template[:]
        for at in (10, 40, 70):
            w[at] = f"pair{i}x{at}"
        rows += [" ".join(w), " ".join(w[:-1] + ["other"])]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_many_groups_in_a_bucket(spark, monkeypatch):
    one_bucket(monkeypatch)
    rows = family(random.Random(11), 30)
    want = near_brute(rows)
    assert len(set(want.values())) == 30
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_near_duplicates_head_without_a_link(spark, monkeypatch):
    near_dedup = one_bucket(monkeypatch)
    rng = random.Random(3)
    rows = [(0, words(rng, 80))] + [(i + 1, t) for i, t in family(rng, 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {0: 0, 1: 1, 2: 1}
    # A bucket above the bound is compared block against block.
    monkeypatch.setattr(near_dedup, "BLOCK_UNITS", 400)
    rows = family(rng, 20)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == near_brute(rows)


def test_repeated_rows_go_once(spark):
    rng = random.Random(5)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    near = " ".join(a.split()[:-1] + ["other"])
    rows = [(1, a), (1, a), (3, a), (3, b), (3, b), (None, c), (None, c), (None, b), (4, near), (3, near), (5, d)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "test_repeated")
    assert Counter(map(tuple, drop_copies(docs).collect())) == Counter([(3, a), (3, b), (None, c), (4, near), (5, d)])
    assert Counter(map(tuple, drop_near_duplicates(docs).collect())) == Counter([(1, a), (3, b), (None, c), (5, d)])


def test_components_are_complete(spark):
    from kervan.llm.components import connected_components

    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    assert {tuple(r) for r in connected_components(pairs).collect()} == {(i, 1) for i in range(1, 41)}
    with pytest.raises(RuntimeError):
        connected_components(pairs, max_rounds=1)


def spans_brute(rows, span=50):
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append((r[1] or "").encode())
    seen, out = set(), {}
    for i in sorted(by_id):
        fresh = set()
        for b in by_id[i]:
            gone = bytearray(len(b))
            for j in range(len(b) - span + 1):
                x = b[j : j + span]
                fresh.add(x)
                if x in seen:
                    gone[j : j + span] = b"\1" * span
            runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
            out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
        seen |= fresh
    return out


def test_repeated_spans(docs, rows, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in repeated_spans(docs).collect()}
    assert got == spans_brute(rows)
    assert sum(v[1] for v in got.values()) > 0
    assert repeated_spans(empty).count() == 0


def test_repeated_spans_null_and_shared_ids(spark, monkeypatch):
    """Null ids lose nothing and are no source; rows that share an id keep what they share. Many hash ranges."""
    monkeypatch.setattr("kervan.llm.repeated_spans.RANGE_BYTES", 50)
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(300))
    rows = [(None, text[:200]), (4, text), (4, text[:150]), (9, text[100:]), (None, text[:90])]
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 90, 0), (0, 200, 0), (4, 150, 0), (4, 300, 0), (9, 200, 200)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("kervan_spans")]


def test_repeated_spans_random(spark):
    rng = random.Random(1)
    pool = "".join(rng.choice("ab é") for _ in range(400))
    rows = [(i, "".join(pool[s : s + rng.randint(20, 120)] for s in (rng.randrange(300) for _ in range(3)))) for i in range(60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == spans_brute(rows)


def test_token_counts_and_cache(spark, docs, rows, empty, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or "")), len(model.encode(r[1] or "")) > 100) for r in rows)
    cache = f"{tmp_path}/cache"
    for _ in range(2):
        assert Counter(tuple(r) for r in token_counts(docs, path, cache, limit=100).collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in rows})  # the second run added nothing
    assert token_counts(empty, path).count() == 0


def test_variable_length_code():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = encode_ranks(ranks)
        assert (decode_ranks(control, data, n) == ranks).all()
        assert len(control) == -(-n // 4)


def ids_by_library(name, end):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: [*model.encode(t or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_ids(docs, rows, empty):
    encode = ids_by_library("byte_bpe_50k.json", 2)
    got = [tuple(r) for r in token_id_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()]
    start, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())):
        ids = encode(r[1])
        want.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert token_id_roundtrip(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = ids_by_library("word_bpe_49k.json", 1)
    got = pack_documents(docs, path, capacity=256).collect()
    want = Counter()
    for r in rows:
        ids = encode(r[1])
        for k, s in enumerate(range(0, len(ids), 256)):
            want[(r[0], k, s, len(ids[s : s + 256]), crc(ids[s : s + 256]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    import numpy as np

    # Long pieces cannot share a sequence, so the total alone is no fair bound.
    assert len(bins) <= lower_bound(np.array([r["length"] for r in got]), 256) + 1
    assert pack_documents(empty, path).count() == 0


def test_bounds():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        lengths = np.sort(rng.integers(1, 101, rng.integers(1, 200)))[::-1]
        bins, offsets, free = best_fit_decreasing(lengths, 100)
        assert lower_bound(lengths, 100) <= len(free)
        assert (np.bincount(bins, lengths).astype(int) + free == 100).all()
    assert lower_bound(np.array([60, 60, 60]), 100) == 3


def fill_brute(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left = budget - sum(target.values())
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
    return target


def test_mixing(docs, rows, empty):
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    target = fill_brute(sizes)
    got = mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    taken, source = Counter(), {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 3
    assert sorted(tuple(r) for r in mix(docs).collect()) == sorted(tuple(r) for r in got)
    assert mix(empty).count() == 0
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words_out = Counter()
    for r in mixed.collect():
        words_out[r["source"]] += size(r["text"])
    for s, t in taken.items():
        assert abs(words_out[s] - t) <= 2 * max(size(r[1]) for r in rows[-2:])  # repeated rows share a plan


def topk_brute(vectors, k, modulus):
    import math

    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {i: v for i, v in good if i % modulus == 0}.items():
        scored = sorted(((sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q), key=lambda s: (-s[0], s[1]))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4, 1000])
def test_top_k(spark, block):
    rng = random.Random(2)
    same = [0.5, -0.25, 1.0]
    vectors = [(i, [rng.uniform(-2, 2) for _ in range(3)]) for i in range(60)] + [(100 + i, same) for i in range(25)]
    vectors += [(200, None), (205, [1.0, None, 2.0]), (210, [float("nan"), 0.0, 1.0]), (215, [float("inf"), 0.0, 1.0]), (3, same)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    import numpy as np

    stored = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    got = sorted(tuple(r) for r in top_k(df, k=7, query_modulus=5, query_block=block, candidate_block=block).collect())
    assert got == topk_brute(stored, 7, 5)
    assert top_k(df.filter("vec_id < 0"), k=7, query_modulus=5).count() == 0
    few = top_k(df.filter("vec_id IN (0, 1, 2)"), k=7, query_modulus=5).collect()
    assert len(few) == 2


def test_segments_against_all_pairs():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        s = [rng.choice([-2, -1, -0.5, 1, 2, 3]) for _ in range(rng.randint(0, 25))]
        found = maximal_segments(np.array(s, float))
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)], default=0)
        assert max([f[2] for f in found], default=0) == pytest.approx(max(best, 0))
        for a, b, score in found:
            assert score == pytest.approx(sum(s[a:b])) and score > 0
        for (_, b, _), (a, _, _) in zip(found, found[1:]):
            assert b <= a


def test_all_maximal_segments():
    import numpy as np

    def segments(s, at=0):
        """The best segment, then those of what lies before and behind it."""
        sums = [(sum(s[i:j]), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        score, i, j = max(sums, default=(0, 0, 0))
        return [] if score <= 0 else [*segments(s[:i], at), (at + i, at + j, pytest.approx(score)), *segments(s[j:], at + j)]

    rng = random.Random(6)
    for _ in range(300):
        s = [rng.uniform(-2, 1.5) for _ in range(rng.randint(0, 30))]
        assert [tuple(f) for f in maximal_segments(np.array(s, float))] == segments(s)


def labelled(spark, bad, n=400):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        y = rng.random() < 0.4
        rows.append((i, bad(rng, words(rng, rng.randint(15, 60)), y)))
        if rng.random() < 0.8:
            labels.append((i, int(y), int(not y)))
    truth = {i: y for i, y, _ in labels}
    rows += [(10_001, None), (10_002, ""), (10_003, "word"), (5, rows[5][1])]
    labels.append((None, 1, 1)), labels.append((7_777_777, 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), truth


def check_scores(got, truth, expected_rows):
    assert len(got) == expected_rows
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)
    assert right >= 0.9, right


def test_toxicity(spark, empty):
    insults = ["loserly", "idiotic", "scumbag", "moronic"]

    def make(rng, text, y):
        w = text.split()
        for _ in range(3 * y):
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        return " ".join(w)

    docs, labels, truth = labelled(spark, make)
    check_scores(toxicity_scores(docs, labels).collect(), truth, 404)
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    lone = toxicity_scores(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in lone}) == 1


def test_quality(spark):
    docs, labels, truth = labelled(spark, lambda rng, t, y: t.upper().replace(" ", "!! ") if y else t)
    check_scores(quality_scores(docs, labels).collect(), {i: 1 - y for i, y in truth.items()}, 404)
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert len({r["score"] for r in quality_scores(docs, labels.limit(0)).collect()}) == 1


def quality_features(text):
    """The feature ids of a text, one by one."""
    mask = (1 << 64) - 1
    base = 0x9E3779B97F4A7C15

    def mix(h):
        for _ in range(2):
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask
        return h ^ h >> 32

    def hashed(b):
        return mix(sum((x + 1) * pow(base, i, 1 << 64) for i, x in enumerate(b)) + len(b) & mask)

    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    found = [hashed(w.encode()) for w in words]
    for a, b in zip(words, words[1:]):
        found.append(0x5EED << 48 if a == b else mix(hashed(a.encode()) * 3 + hashed(b.encode()) & mask))
    for w in words:
        for n in (3, 5):
            for i in range(len(w) - n + 1):
                place = (i == 0) + 2 * (i + n == len(w)) + 4 * n
                found.append(mix(hashed(w[i : i + n].encode()) + place * base & mask))
    return [h >> 64 - BUCKET_BITS for h in found]


def test_quality_features_one_by_one(rows):
    import numpy as np

    texts = ["", *(t for _, t, *_ in rows if t and len(t) < 3000), "", "şçğ ışığı x", " ", "\u2003wide\u00a0space 日本語日本語 ab", ""]
    table = np.random.default_rng(3).normal(size=1 << BUCKET_BITS).astype(np.float32)
    raw = [t.encode() for t in texts]
    got = margins(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), table)
    for text, value in zip(texts, got):
        ids = quality_features(text)
        assert value == pytest.approx(float(np.mean(table[ids].astype(float))) if ids else 0.0, abs=1e-9)


def test_scores_of_any_rows(spark, docs, rows):
    """Null ids, empty and long texts, repeated rows and further columns, one of them named like an internal one."""
    given = docs.unionByName(spark.createDataFrame([(None, "lone", "en", "a", 0, 9)], DOCS)).withColumnRenamed("n_chars", "_text")
    labels = spark.createDataFrame([(r[0], i % 2, i % 2) for i, r in enumerate(rows)], "doc_id long, toxic int, quality int")
    for scores in (toxicity_scores(given, labels), quality_scores(given, labels)):
        got = scores.collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted([(False, r[0]) for r in rows] + [(True, 0)])
        assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert not next(r for r in got if r["doc_id"] is None)["held_out"]


def test_stages_judge_rows_and_keep_any_columns(spark):
    """Repeated rows, one id with several texts, null ids and columns named like internal ones."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "A b c", "x"), (1, "a b c", "x"), (1, "a b c", "x"), (2, "other words here", "x"), (2, long, "y"), (3, long + " end", "y"), (None, "A B C", None), (None, "alone", None), (5, None, "x"), (6, "", "x")]
    docs = spark.createDataFrame([(*r, i, 7, 8, 9, 10) for i, r in enumerate(rows)], "doc_id long, text string, source string, _words int, _whole int, _few_key int, _digest int, _id int")
    exact = drop_copies(docs)
    assert exact.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, lowered(r["text"] or "")) for r in exact.collect())
    assert got == sorted([(False, 1, "a b c"), (False, 2, "other words here"), (False, 2, long), (False, 3, long + " end"), (True, 0, "alone"), (False, 6, "")])
    near = drop_near_duplicates(docs)
    assert near.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").lower()) for r in near.collect())
    assert got == sorted([(False, 1, "a b c"), (False, 2, "other words here"), (False, 2, long), (True, 0, "alone"), (False, 5, "")])
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    plan = {}
    for r in mix(docs).collect():
        plan.setdefault((r["doc_id"], r["size"]), []).append(r["taken"])
    words = lambda t: len((t or "").split())
    given = {}
    for r in mixed.collect():
        given[r["_words"]] = given.get(r["_words"], 0) + words(r["text"])
    for i, (key, text, _) in enumerate(rows):
        assert given.get(i, 0) in plan[key, words(text)], i
    assert sum(given.values()) == sum(sum(v) for v in plan.values())
