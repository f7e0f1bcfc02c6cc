"""Quality classifier: supervised subword embeddings.

Features of a text are hashed words, word pairs (pairs of the same word share one id) and the character n-grams inside
its words, told apart by whether they begin or end the word. A document's vector is the average of its features' learned
vectors, a softmax layer gives the class; both are trained together by stochastic gradient descent in numpy, in one task
over a sample of labelled documents that is bounded in documents and in features. The number of steps is the same at
every size. As the output layer is linear in the average, scoring needs one number per feature id: the document's
log-odds are the average of its features' log-odds, taken over the whole text.

Defined results: null, empty and blank texts score the model's bias; without labelled documents, or with one class
only, the score is the smoothed share of class 1; repeated rows score alike; rows with a null id are scored, are not
held out and never learned from; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import NOT_SPACE, Words, mix64
from .common import flat_bytes, stage
from .labelled import held_out, labelled_sample
from .tokenizing import sub_batches

BUCKET_BITS = 18
GRAMS = (3, 5)
SAMPLE_DOCS = 8_000
#: Distinct features of all documents that are learned from, 8 bytes each; the sample ends before it would hold more.
SAMPLE_FEATURES = 1 << 25
#: Steps of one document, at every size of the sample: it is gone through in ever new orders until they are done.
STEPS = 32_000
SUB_BATCH = 256 << 10


def feature_sets(raw: np.ndarray, offsets: np.ndarray):
    """Yields (bucket ids, place of each text's first id and one more) for words, word pairs and character n-grams."""
    words = Words(raw, offsets, NOT_SPACE)
    h = words.hashes()
    shift = np.uint64(64 - BUCKET_BITS)
    yield (h >> shift).astype(np.int64), words.bounds
    if len(h) > 1:
        pair = mix64(h[:-1] * np.uint64(3) + h[1:])
        pair[h[:-1] == h[1:]] = np.uint64(0x5EED << 48)
        inside = np.ones(len(pair), bool)
        inside[words.bounds[1:-1][(words.bounds[1:-1] > 0) & (words.bounds[1:-1] < len(h))] - 1] = False
        at = np.concatenate([[0], np.cumsum(inside)])
        yield (pair[inside] >> shift).astype(np.int64), at[np.minimum(words.bounds, len(pair))]
    # The first byte of each character, and its word.
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    behind = np.append(first[1:], len(raw))
    starts = np.zeros(len(raw), np.int64)
    starts[words.start] = 1
    word = np.where(NOT_SPACE[raw[first]], np.cumsum(starts)[first] - 1, -1)
    for n in GRAMS:
        last = word[n - 1 :]
        at = np.flatnonzero((word[: len(last)] == last) & (last >= 0))
        start, end, own = first[at], behind[at + n - 1], word[at]
        place = (start == words.start[own]) + 2 * (end == words.end[own]) + 4 * n
        yield (mix64(words.of(start, end) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), np.searchsorted(start, offsets)


def margins(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The average of `table` over each text's features; 0 without features."""
    total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for ids, bounds in feature_sets(raw, offsets):
        sums = np.zeros(len(ids) + 1)
        np.cumsum(table[ids], out=sums[1:])
        total += np.diff(sums[bounds])
        n += np.diff(bounds)
    return total / np.maximum(n, 1)


def sparse_features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct feature ids and their shares."""
    sets = list(feature_sets(raw, offsets))
    out = []
    for d in range(len(offsets) - 1):
        ids = np.concatenate([ids[at[d] : at[d + 1]] for ids, at in sets])
        unique, n = np.unique(ids, return_counts=True)
        out.append((unique.astype(np.int32), (n / max(len(ids), 1)).astype(np.float32)))
    return out


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, steps: int = STEPS, rate: float = 1.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """Log-odds of class 1 per feature id, and the bias."""
    labels = np.array([s[2] for s in samples], int)
    if len(labels) == 0 or labels.min() == labels.max():
        ones = labels.sum() if len(labels) else 0
        return np.zeros(1 << BUCKET_BITS, np.float32), float(np.log((ones + 1) / (len(labels) - ones + 1)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    step = 0
    while step < steps:
        for i in rng.permutation(len(samples))[: steps - step]:
            lr = rate * (1 - step / steps)
            step += 1
            ids, share, label = samples[i]
            own = vectors[ids]
            hidden = share @ own
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1.0
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            # Shares are small: features are stepped by share relative to the largest one, as a per-text unit step.
            own -= (lr * len(ids) ** 0.5) * share[:, None] * back[None, :]
            vectors[ids] = own
    out = vectors @ (layer[:, 1] - layer[:, 0])
    return out.astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 4, held: int = 2, bound: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """Trains in one Spark task over at most `bound` documents and SAMPLE_FEATURES features, in the order of a hash of
    their ids; only the table of feature log-odds comes back."""

    def featurise(batches):
        for batch in batches:
            for at, n in sub_batches(batch.column(0), SUB_BATCH):
                raw, offsets = flat_bytes(batch.column(0).slice(at, n))
                found = sparse_features(raw, offsets)
                yield pa.record_batch(
                    [batch.column(2).slice(at, n), batch.column(1).slice(at, n), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())],
                    ["id", "label", "ids", "shares"],
                )

    def learn(batches):
        rows = []
        for batch in batches:
            for label, ids, share in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((np.frombuffer(ids, np.int32), np.frombuffer(share, np.float32), label))
        if not rows:
            return
        table, bias = train(rows)
        yield pa.record_batch([pa.array([table.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["table", "bias"])

    sample = labelled_sample(docs, labels, label_col, modulus, held, bound)
    sample = stage(sample.mapInArrow(featurise, "id long, label int, ids binary, shares binary"), "quality_sample")
    # One task learns, so one task takes the sample; its rows are bounded, and the rest of a large sample stays in the JVM.
    upto = Window.orderBy(F.xxhash64(F.lit("order"), "id"), "id", "ids").rowsBetween(Window.unboundedPreceding, 0)
    sample = sample.withColumn("upto", F.sum(F.octet_length("ids") / 4).over(upto)).filter(F.col("upto") <= SAMPLE_FEATURES)
    model = sample.select("label", "ids", "shares").mapInArrow(learn, "table binary, bias double").first()
    if model is None:
        return train([])
    return np.frombuffer(model["table"], "<f4"), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): probability of class 1 from the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table, bias = sent.value
        for batch in batches:
            for at, n in sub_batches(batch.column(1), SUB_BATCH):
                raw, offsets = flat_bytes(batch.column(1).slice(at, n))
                odds = margins(raw, offsets, table) + bias
                yield pa.record_batch([batch.column(0).slice(at, n), pa.array(1 / (1 + np.exp(-np.clip(odds, -50, 50))))], [id_col, "score"])

    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return slim.mapInArrow(run, f"{id_col} long, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose whole text scores at least the threshold, with all their columns and without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches):
        table, bias = sent.value
        for batch in batches:
            keep = []
            text = batch.column(at_text).cast(pa.string())
            for at, n in sub_batches(text, SUB_BATCH):
                raw, offsets = flat_bytes(text.slice(at, n))
                odds = margins(raw, offsets, table) + bias
                keep.append(1 / (1 + np.exp(-np.clip(odds, -50, 50))) >= threshold)
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 4, held: int = 2, threshold: float = 0.7, bound: int = SAMPLE_DOCS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, label_col, modulus, held, bound))
    return scored.select("doc_id", held_out("doc_id", modulus, held).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
