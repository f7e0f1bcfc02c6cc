"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are packed into blocks and every query block meets every candidate block. A first pass scores
everything and keeps, per query, a histogram of scores; each further pass scores again and refines the one bin that
holds the k-th value, until a bin is one score wide. Then a last pass keeps the scores above the k-th value and, among
equals, the smallest ids. A block reports only the bins down to its own k-th score: bins below cannot hold the global
k-th value. No task ever holds all scores of a query.

Scores are integer inner products of floor(scale * x); they are computed in float64 where the exact bound of the
products allows and in int64 otherwise.

Defined results: vectors that are null, or that hold a null or non-finite component, take no part; a query has no more
rows than there are candidates; candidates with the same score rank by id, repeated ids (other than the query's own)
each count, a query id that repeats is searched once; components are compared up to the longer vector, missing ones
count as 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage

NOTHING = np.iinfo(np.int64).min
PACK_SCHEMA = "block long, ids binary, vectors binary, dim int, top double, states binary"


def _packer(width: int, scale: float):
    """Rows (id, vector[, prefix, need]) to blocks of at most `width` floored vectors."""

    def pack(batches):
        ids, rows, states = [], [], []
        for batch in batches:
            extra = list(zip(*(batch.column(i).to_pylist() for i in range(2, batch.num_columns)))) or [()] * batch.num_rows
            for key, vec, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), extra):
                if key is None or vec is None or any(x is None for x in vec):
                    continue
                values = np.floor(np.asarray(vec, np.float64) * scale)
                if not np.isfinite(values).all():
                    continue
                ids.append(key), rows.append(values), states.append(state)
                if len(ids) == width:
                    yield _block(ids, rows, states)
                    ids, rows, states = [], [], []
        if ids:
            yield _block(ids, rows, states)

    return pack


def _block(ids, rows, states):
    matrix = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for i, row in enumerate(rows):
        matrix[i, : len(row)] = row
    top = float(np.abs(matrix).max()) if matrix.size else 0.0
    cells = (ids[0], np.array(ids, np.int64).tobytes(), matrix.tobytes(), matrix.shape[1], top, np.array(states, np.int64).tobytes())
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.binary())
    return pa.record_batch([pa.array([x], t) for x, t in zip(cells, kinds)], ["block", "ids", "vectors", "dim", "top", "states"])


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, their (prefix, need), candidate ids and the exact integer scores of a pair of blocks."""
    qi, ci = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    states = np.frombuffer(row["q_states"], np.int64).reshape(len(qi), -1)
    q = np.frombuffer(row["q_vectors"], np.int64).reshape(len(qi), row["q_dim"])
    c = np.frombuffer(row["vectors"], np.int64).reshape(len(ci), row["dim"])
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    if row["q_top"] * row["top"] * max(dim, 1) < 2.0**52:
        s = (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        s = q @ c.T
    s[qi[:, None] == ci[None, :]] = NOTHING
    return qi, states, ci, s


def top_k(
    vectors: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_modulus: int = 100,
    scale: float = 1024.0,
    query_block: int = 256,
    candidate_block: int = 2048,
    bin_bits: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query (id divisible by query_modulus) against every other row."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    queries = stage(slim.filter(usable & (F.col("id") % query_modulus == 0)).groupBy("id").agg(F.max("v").alias("v")), "topk_queries")
    candidates = stage(slim.mapInArrow(_packer(candidate_block, scale), PACK_SCHEMA), "topk_candidates")
    most = candidates.agg(F.max("top").alias("top"), F.max("dim").alias("dim")).first()
    if most["top"] is None or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = int(most["top"]) ** 2 * max(most["dim"], 1) + 1  # scores lie strictly between -reach and reach

    # Candidate blocks are dealt to groups and each query block goes to every group, so no side is broadcast.
    groups = 2 * shuffle_partitions(spark)
    dealt = candidates.withColumn("_g", F.pmod(F.xxhash64("block", "ids"), F.lit(groups)).cast("int"))

    def pairs(state: DataFrame) -> DataFrame:
        asked = queries.join(state.hint("merge"), "id").select("id", "v", "prefix", "need")
        blocks = asked.mapInArrow(_packer(query_block, scale), PACK_SCHEMA)
        blocks = blocks.select(*[F.col(c).alias(f"q_{c}") for c in blocks.columns if c != "block"])
        spread = blocks.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return spread.join(dealt.hint("merge"), "_g").drop("_g", "block", "states")

    shift = (2 * reach).bit_length()
    state = queries.select("id", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
    while shift > 0:
        step = min(bin_bits, shift)
        shift -= step
        counts = pairs(state).mapInArrow(_histogram(k, reach, shift, step), "id long, bin long, n long, need long")
        counts = counts.groupBy("id", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        above = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("bin"))) - F.col("n")
        # The lowest bin with fewer than `need` scores above it: it holds the k-th score, or the last one there is.
        found = counts.withColumn("above", above).filter(F.col("above") < F.col("need")).groupBy("id")
        found = found.agg(F.min(F.struct("bin", "above", "need")).alias("b"))
        state = stage(found.select("id", F.col("b.bin").alias("prefix"), (F.col("b.need") - F.col("b.above")).alias("need")), "topk_state")

    hits = pairs(state).mapInArrow(_above(reach), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _histogram(k: int, reach: int, shift: int, step: int):
    """Counts per query and bin; a block's scores below its own k-th cannot matter."""

    def count(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                qi, states, ci, s = _scores(batch.slice(at, 1).to_pylist()[0])
                top = s if len(ci) <= k else np.partition(s, len(ci) - k, axis=1)[:, len(ci) - k :]
                bins = (top + reach) >> shift
                live = (top != NOTHING) & ((bins >> step) == states[:, :1])
                row, col = np.nonzero(live)
                if not len(row):
                    continue
                both = np.stack([row, bins[row, col]])
                cells, n = np.unique(both, axis=1, return_counts=True)
                out = (qi[cells[0]], cells[1], n.astype(np.int64), states[cells[0], 1])
                yield pa.record_batch([pa.array(x, pa.int64()) for x in out], ["id", "bin", "n", "need"])

    return count


def _above(reach: int):
    """Scores above the k-th value and, of those equal to it, as many of the smallest ids as the query still needs."""

    def select(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                qi, states, ci, s = _scores(batch.slice(at, 1).to_pylist()[0])
                edge = states[:, :1] - reach
                row, col = np.nonzero((s >= edge) & (s != NOTHING))
                if not len(row):
                    continue
                score, tied = s[row, col], s[row, col] == edge[row, 0]
                order = np.lexsort((ci[col], tied, row))
                row, col, score, tied = row[order], col[order], score[order], tied[order]
                tie_at = np.cumsum(tied)
                first = np.searchsorted(row, row, "left")
                before = np.where(first > 0, tie_at[first - 1], 0)
                kept = ~tied | (tie_at - before <= states[row, 1])
                out = (qi[row[kept]], ci[col[kept]], score[kept])
                yield pa.record_batch([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return select
