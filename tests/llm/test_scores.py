"""The two classifiers recomputed one text at a time, from the labelled sample to the score."""

import math
import random
import re
import zlib

import pytest

pytest.importorskip("public_tokenizers")

from kervan.llm import quality as Q
from kervan.llm import toxicity as T
from tests.llm.test_operators import quality_features, words

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mix(h):
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & MASK
    return h ^ h >> 32


def hashed(b):
    return mix(sum((x + 1) * pow(BASE, i, 1 << 64) for i, x in enumerate(b)) + len(b) & MASK)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(17)
    rows, labels = [], {}
    for i in range(260):
        bad = rng.random() < 0.35
        w = words(rng, rng.randint(5, 40)).split()
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["Idiotic", "scumbags", "moronic!", "IDIOTS"]))
        rows.append((i, " ".join(w)))
        if rng.random() < 0.85:
            labels[i] = int(bad)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame([(i, y, 1 - y) for i, y in labels.items()], "doc_id long, toxic int, quality int")


def tokens_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def segments(s):
    """All maximal segments by comparing all pairs of places."""
    if not s:
        return []
    sums = [0.0]
    for x in s:
        sums.append(sums[-1] + x)
    score, i, j = max((sums[j] - sums[i], -i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    return [] if score <= 0 else [*segments(s[: -i if i else 0]), score, *segments(s[j:])]


def test_toxicity_from_sample_to_score(spark, corpus):
    import numpy as np

    docs, rows, labels = corpus
    model = T.fit(docs, label_frame(spark, labels))
    sample = [(t, labels[i]) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    ones = sum(y for _, y in sample)
    zeros = len(sample) - ones
    counts = {}
    for text, y in sample:
        for unit in {w[:p] for w in tokens_of(text) for p in T.PREFIXES}:
            counts.setdefault(unit, [0, 0])[1 - y] += 1
    odds = {}
    for unit, (a, b) in counts.items():
        if a + b < T.UNIT_COUNT:
            continue
        pooled = T.PRIOR_WEIGHT * (a + b) / (ones + zeros)
        inside, outside = a + pooled, b + pooled
        delta = math.log(inside / (ones + T.PRIOR_WEIGHT - inside)) - math.log(outside / (zeros + T.PRIOR_WEIGHT - outside))
        shrunk = abs(delta) - T.SHRINK * math.sqrt(1 / inside + 1 / outside)
        if shrunk > 0:
            odds[unit] = math.copysign(shrunk, delta)
    got = dict(zip(model["units"].tolist(), model["odds"].tolist()))
    assert got == pytest.approx({hashed(u): x for u, x in odds.items()}) and any(u.startswith(b"idio") for u in odds)

    def scores(text):
        out = []
        for w in tokens_of(text):
            best = 0.0
            for p in T.PREFIXES:
                x = odds.get(w[:p], 0.0)
                if x > best or (best <= 0 and x < best):
                    best = x
            out.append(best - T.DRIFT)
        return out

    clean = [round(v * 100) / 100 for t, y in sample if not y for v in scores(t)]
    assert sum(math.exp(model["lambda"] * v) for v in clean) / len(clean) == pytest.approx(1, abs=1e-3)

    def statistics(text, lnk):
        s = scores(text)
        x = [model["lambda"] * v - lnk - math.log(max(len(s), 1)) for v in segments(s)]
        return (max(x), sum(v for v in x if v > 0)) if x else (T.NO_SEGMENT, 0.0)

    firsts = [statistics(t, 0.0)[0] for t, y in sample if not y]
    firsts = [x for x in firsts if x > T.NO_SEGMENT]
    assert model["lnk"] == pytest.approx(float(np.median(firsts)) + math.log(math.log(2)) if len(firsts) >= 20 else 0.0)
    w = model["curve"]

    def z(text):
        best, total = statistics(text, model["lnk"])
        return min(max(best, T.NO_SEGMENT), 40.0) / 10, math.log1p(total), 1.0

    def probability(x):
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))

    # The curve is the ridge optimum over the sample.
    points = [(z(t), y) for t, y in sample]
    for k in range(3):
        assert sum(x[k] * (probability(x) - y) for x, y in points) + 1e-2 * w[k] == pytest.approx(0, abs=1e-6)
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    assert got == pytest.approx({i: probability(z(t)) for i, t in rows}, abs=1e-9)


def test_quality_from_model_to_score(spark, corpus):
    docs, rows, labels = corpus
    table, bias = Q.fit(docs, label_frame(spark, labels))
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, (table, bias)).collect()}
    for i, text in rows:
        ids = quality_features(text)
        margin = sum(float(table[k]) for k in ids) / max(len(ids), 1) + bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)


def test_held_out_labels_are_never_learned(spark, corpus):
    """Turning all held-out labels round changes no score."""
    docs, _, labels = corpus
    for scores, modulus, held in ((T.toxicity_scores, 3, 1), (Q.quality_scores, 4, 2)):
        turned = {i: 1 - y if zlib.crc32(str(i).encode()) % modulus == held else y for i, y in labels.items()}
        assert turned != labels
        a = {r["doc_id"]: r["score"] for r in scores(docs, label_frame(spark, labels)).collect()}
        b = {r["doc_id"]: r["score"] for r in scores(docs, label_frame(spark, turned)).collect()}
        assert a == pytest.approx(b, abs=1e-9)
