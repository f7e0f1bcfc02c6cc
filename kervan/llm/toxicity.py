"""Toxicity: maximum-scoring segments over token log-odds.

Training, on a bounded sample of labelled documents: for each unit (a lower-cased word or a prefix of one, so that
inflected words share evidence) the log-odds of occurring in toxic against other documents under an informative
Dirichlet prior (the pooled frequencies), shrunk towards 0 by two standard deviations. A token scores its best unit,
minus a drift that makes the expected score negative.

Scanning, over the whole text: a linear-time pass finds all maximal scoring segments (each token's positive runs and
the negative gaps between them are summed first, so the loop is over runs only). Segment scores are calibrated as
extreme values: with the Karlin-Altschul parameters of the scores in clean documents, a segment of normalised score
x = lambda * S - ln(K * n) has P(a clean text of n tokens reaches it) = 1 - exp(-exp(-x)). The document's best and
summed significant segments give its score through a logistic curve fitted on the sample.

Defined results: null, empty and wordless texts have no segment and score the curve's value without one; without
labelled documents of both classes every score is the smoothed share of class 1; repeated rows score alike; rows with a
null id are scored, are not held out and never learned from; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import ALNUM, LOWER, Words
from .common import flat_bytes, stage
from .labelled import held_out, labelled_sample
from .tokenizing import sub_batches

SAMPLE_DOCS = 20_000
#: The model holds the strongest units, so many at most, and none that the sample holds more rarely.
MODEL_UNITS = 1 << 16
UNIT_COUNT = 5
FILTER_BITS = 22
PREFIXES = (None, 4, 5, 6, 8)
PRIOR_WEIGHT = 20.0
SHRINK = 2.0
DRIFT = 0.35
SUB_BATCH = 512 << 10


class Scorer:
    """Token scores from the selected units: a bit filter, then a sorted table."""

    def __init__(self, units: np.ndarray, odds: np.ndarray):
        order = np.argsort(units)
        self.units, self.odds = units[order], odds[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(units >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def tokens(self, words: Words) -> np.ndarray:
        best = np.zeros(len(words.start))
        if not len(self.units):
            return best - DRIFT
        for prefix in PREFIXES:
            h = words.hashes(prefix)
            may = np.flatnonzero(self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.units, h[may]), len(self.units) - 1)
            odds = np.where(self.units[at] == h[may], self.odds[at], 0.0)
            # The strongest evidence decides, positive before negative.
            best[may] = np.where((odds > best[may]) | ((best[may] <= 0) & (odds < best[may])), odds, best[may])
        return best - DRIFT


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a score sequence, in linear time."""
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]]).astype(np.int8)))
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []  # start, end, total before it, total up to its end
    previous: list[int] = []  # for each kept segment, the last one before it with a smaller total before
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        left, right = float(sums[start]), float(sums[end])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = previous[j]
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:], previous[j:]
            j = len(found) - 1
        found.append((start, end, left, right))
        previous.append(j)
    return [(s, e, r - l) for s, e, l, r in found]


def karlin_altschul(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * value)) = 1."""
    if not (values > 0).any() or (values * share).sum() >= 0:
        return 0.2
    low, high = 1e-6, 1.0
    excess = lambda x: float((share * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _blocks(batches, column=0):
    for batch in batches:
        for at, n in sub_batches(batch.column(column), SUB_BATCH):
            raw, offsets = flat_bytes(batch.column(column).slice(at, n))
            yield batch.slice(at, n), Words(LOWER[raw], offsets, ALNUM)


def unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, toxic, other): documents of each class that hold a unit, summed in each task first."""

    def count(batches):
        for batch, words in _blocks(batches):
            label = np.array(batch.column(1).to_pylist(), np.int64)
            doc = words.document()
            units, docs = [], []
            for prefix in PREFIXES:
                units.append(words.hashes(prefix)), docs.append(doc)
            unit, doc = np.concatenate(units), np.concatenate(docs)
            order = np.lexsort((doc, unit))
            unit, doc = unit[order], doc[order]
            first = np.ones(len(unit), bool)
            first[1:] = (unit[1:] != unit[:-1]) | (doc[1:] != doc[:-1])
            unit, toxic = unit[first], label[doc[first]]
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.zeros(0, np.int64)
            ones = np.add.reduceat(toxic, starts) if len(starts) else toxic
            n = np.diff(np.append(starts, len(unit)))
            yield pa.record_batch([pa.array(unit[starts].view(np.int64)), pa.array(ones), pa.array(n - ones)], ["unit", "toxic", "other"])

    return sample.mapInArrow(count, "unit long, toxic long, other long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 3, held: int = 1, bound: int = SAMPLE_DOCS) -> dict:
    """The units' shrunk log-odds (MODEL_UNITS at most), lambda, ln K and the calibration curve."""
    spark = docs.sparkSession
    sample = stage(labelled_sample(docs, labels, label_col, modulus, held, bound), "toxic_sample")
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = size.get(1, 0), size.get(0, 0)
    empty = {"units": np.zeros(0, np.uint64), "odds": np.zeros(0), "lambda": 0.2, "lnk": 0.0, "curve": (0.0, 0.0, float(np.log((ones + 1) / (zeros + 1))))}
    if not ones or not zeros:
        return empty
    a, b = F.col("toxic"), F.col("other")
    pooled = PRIOR_WEIGHT * (a + b) / F.lit(float(ones + zeros))
    inside, outside = a + pooled, b + pooled
    delta = F.log(inside / (ones + PRIOR_WEIGHT - inside)) - F.log(outside / (zeros + PRIOR_WEIGHT - outside))
    spread = F.sqrt(1 / inside + 1 / outside)
    odds = F.signum(delta) * F.greatest(F.abs(delta) - SHRINK * spread, F.lit(0.0))
    counted = unit_counts(sample.select("text", "label")).filter(a + b >= UNIT_COUNT)
    chosen = counted.select("unit", odds.alias("odds")).filter("odds <> 0").orderBy(F.desc(F.abs("odds")), "unit").limit(MODEL_UNITS).collect()
    units = np.array([r["unit"] for r in chosen], np.int64).view(np.uint64)
    scorer = Scorer(units, np.array([r["odds"] for r in chosen], np.float64))
    sent = spark.sparkContext.broadcast(scorer)

    def histogram(batches):
        total: dict[int, int] = {}
        for batch, words in _blocks(batches):
            clean = np.array(batch.column(1).to_pylist()) == 0
            values = np.round(sent.value.tokens(words)[clean[words.document()]] * 100).astype(np.int64)
            for v, n in zip(*(x.tolist() for x in np.unique(values, return_counts=True))):
                total[v] = total.get(v, 0) + n
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["value", "n"])

    seen = sample.select("text", "label").mapInArrow(histogram, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).orderBy("value").collect()
    n = np.array([r["n"] for r in seen], np.float64)
    lam = karlin_altschul(np.array([r["value"] for r in seen]) / 100.0, n / max(n.sum(), 1))
    model = {"units": scorer.units, "odds": scorer.odds, "lambda": lam, "lnk": 0.0, "curve": (0.0, 0.0, 0.0)}
    found = sample.mapInArrow(_segments(spark.sparkContext.broadcast((scorer, lam, 0.0)), 1, "label"), SEGMENT_SCHEMA.replace("doc_id long", "label int"))
    rows = np.array([(r["label"], r["best"], r["total"]) for r in found.select("label", "best", "total").collect()], np.float64).reshape(-1, 3)
    # ln K from the Gumbel median of clean documents that have a segment: x has median -ln(ln 2).
    clean = rows[(rows[:, 0] == 0) & (rows[:, 1] > NO_SEGMENT)]
    model["lnk"] = float(np.median(clean[:, 1]) + np.log(np.log(2))) if len(clean) >= 20 else 0.0
    again = sample.mapInArrow(_segments(spark.sparkContext.broadcast((scorer, lam, model["lnk"])), 1, "label"), SEGMENT_SCHEMA.replace("doc_id long", "label int"))
    rows = np.array([(r["label"], r["best"], r["total"]) for r in again.select("label", "best", "total").collect()], np.float64).reshape(-1, 3)
    model["curve"] = _logistic(rows[:, 1:], rows[:, 0])
    return model


NO_SEGMENT = -20.0
SEGMENT_SCHEMA = "doc_id long, best double, total double, n_segments int, first_token int, last_token int"


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Newton's method with a small ridge, on bounded and slowly growing transforms of the two statistics."""
    z = np.column_stack([_squash(x[:, 0]), np.log1p(x[:, 1]), np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 1e-2 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
    return tuple(float(v) for v in w)


def _squash(x: np.ndarray) -> np.ndarray:
    return np.clip(x, NO_SEGMENT, 40.0) / 10.0


def _segments(sent, key: int = 0, name: str = "doc_id"):
    """Per text: best and summed significant segment scores, and the place of the best one."""

    def scan(batches):
        scorer, lam, lnk = sent.value
        for batch, words in _blocks(batches, 0):
            scores = scorer.tokens(words)
            out = []
            for d in range(batch.num_rows):
                own = scores[words.bounds[d] : words.bounds[d + 1]]
                base = lnk + np.log(max(len(own), 1))
                found = [(lam * s - base, s, a, b) for a, b, s in maximal_segments(own)]
                if not found:
                    out.append((NO_SEGMENT, 0.0, 0, -1, -1))
                    continue
                best = max(found, key=lambda f: (f[0], -f[2]))
                good = [f[0] for f in found if f[0] > 0]
                out.append((best[0], float(sum(good)), len(good), best[2], best[3]))
            cols = list(zip(*out))
            kinds = (pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.record_batch([batch.column(key), *(pa.array(c, t) for c, t in zip(cols, kinds))], [name, "best", "total", "n_segments", "first_token", "last_token"])

    return scan


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_segments, first_token, last_token): the passage of the best segment in word numbers."""
    sent = docs.sparkSession.sparkContext.broadcast((Scorer(model["units"], model["odds"]), model["lambda"], model["lnk"]))
    slim = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.col(id_col).cast("long").alias("doc_id"))
    w = model["curve"]
    squashed = F.least(F.greatest(F.col("best"), F.lit(NO_SEGMENT)), F.lit(40.0)) / 10.0
    odds = F.lit(w[0]) * squashed + F.lit(w[1]) * F.log1p("total") + F.lit(w[2])
    return slim.mapInArrow(_segments(sent, 1), SEGMENT_SCHEMA).select("doc_id", (1 / (1 + F.exp(-odds))).alias("score"), "n_segments", "first_token", "last_token")


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 3, held: int = 1, threshold: float = 0.7, bound: int = SAMPLE_DOCS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted and the best passage."""
    scored = score(docs, fit(docs, labels, label_col, modulus, held, bound))
    return scored.select(
        "doc_id", held_out("doc_id", modulus, held).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"), "n_segments", "first_token", "last_token"
    )
