"""Best-fit packing with certified bounds.

Texts become token pieces of at most `capacity`. Each partition (a bounded number of pieces) is packed by best-fit
decreasing; dual-feasible functions over its lengths give a lower bound on its bins, and a partition that meets the
bound is certified. Open bins (of partitions with a gap, and the emptiest of the others) give their documents to the
next round, where they are dealt anew over fewer partitions and packed again, until the bins of all partitions meet
the bound of the whole table or a round gains nothing. Every round but the last saves a bin at least, so they end; there is
no other limit. The gap of a sequence says how many bins its partition has above its bound: 0 is a certificate.

Defined results: null text counts as empty and holds only the end id; repeated rows and ids are packed one by one; an
empty table gives an empty result. Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty
from .tokenizing import sub_batches, worker_pieces

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, free long, bound long"
PARTITION_PIECES = 1 << 16


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: place, length and crc32 of the ids."""

    def cut(batches):
        pieces = worker_pieces(tokenizer_path)
        for batch in batches:
            for at, n in sub_batches(batch.column(1), 8 << 20):
                ids, offsets = pieces.ids(batch.column(1).slice(at, n))
                raw = memoryview(np.insert(ids.astype("<u4"), offsets[1:], end_id)).cast("B")
                begins = offsets[:-1] + np.arange(n)
                rows = []
                for key, begin, size in zip(batch.column(0).slice(at, n).to_pylist(), begins.tolist(), (np.diff(offsets) + 1).tolist()):
                    for k, start in enumerate(range(0, size, capacity)):
                        length = min(capacity, size - start)
                        rows.append((key, k, start, length, zlib.crc32(raw[4 * (begin + start) : 4 * (begin + start + length)])))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(cut, PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs, by two families of dual-feasible functions over the length histogram."""
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * size).sum()) // capacity)
    # Lengths above capacity - a fill a bin, lengths below a count nothing.
    count_from = np.concatenate([np.cumsum(n[::-1])[::-1], [0]])
    sum_from = np.concatenate([np.cumsum((n * size)[::-1])[::-1], [0]])
    a = np.arange(1, capacity // 2 + 1)
    middle = sum_from[a] - sum_from[capacity - a + 1]
    best = max(best, int((count_from[capacity - a + 1] + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 101):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (given in decreasing order), and the free space of each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    spaces: list[int] = []  # the distinct free spaces, ascending
    holders: dict[int, list[int]] = {}
    free: list[int] = []
    for i, length in enumerate(lengths.tolist()):
        at = bisect_left(spaces, length)
        if at == len(spaces):
            b, space = len(free), capacity
            free.append(capacity)
        else:
            space = spaces[at]
            b = holders[space].pop()
            if not holders[space]:
                del holders[space], spaces[at]
        bins[i], offsets[i] = b, capacity - space
        left = space - length
        free[b] = left
        if left:
            if left in holders:
                holders[left].append(b)
            else:
                holders[left] = [b]
                insort(spaces, left)
    return bins, offsets, np.array(free, np.int64)


def _pack(capacity: int, round_no: int):
    def pack(batches):
        from pyspark import TaskContext

        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.Table.from_batches(tables).select(["doc_id", "piece", "start", "length", "ids_crc32"])
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        base = (round_no << 52) | (TaskContext.get().partitionId() << 28)
        bound = np.full(len(bins), len(free) - lower_bound(lengths, capacity))
        extra = {"sequence_id": base + bins, "offset": offsets, "free": free[bins], "bound": bound}
        for name, values in extra.items():
            rows = rows.append_column(name, pa.array(values.astype(np.int64)))
        yield from rows.combine_chunks().to_batches(max_chunksize=1 << 16)

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id, offset and gap to staged pieces."""
    total = pieces.agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.count_if(F.col("length") > capacity // 2).alias("large")).first()
    target = max(-(-(total["tokens"] or 0) // capacity), total["large"] or 0)
    sealed, pool, n, used = [], pieces, total["n"], None
    for round_no in itertools.count():
        parts = max(1, -(-n // PARTITION_PIECES))
        packed = stage(pool.repartition(parts).mapInArrow(_pack(capacity, round_no), PACKED_SCHEMA), f"packed{round_no}")
        # A bin is open if it could take a typical short document, or if its partition is not certified and it has any space.
        open_bin = (F.col("free") >= capacity // 64) | ((F.col("bound") > 0) & (F.col("free") > 0))
        sums = packed.agg(
            F.sum(F.when(F.col("offset") == 0, 1).otherwise(0)).alias("bins"),
            F.sum(F.when(open_bin & (F.col("offset") == 0), 1).otherwise(0)).alias("open_bins"),
            F.count_if(open_bin).alias("open"),
        ).first()
        before = used
        sealed_bins = (before or {}).get("sealed", 0)
        used = {"all": sealed_bins + (sums["bins"] or 0), "sealed": sealed_bins + (sums["bins"] or 0) - (sums["open_bins"] or 0)}
        done = used["all"] <= target or parts == 1 or not sums["open"] or (before is not None and used["all"] >= before["all"])
        if done:
            # A round that gained nothing still is a whole packing of its pool.
            sealed.append(packed)
            break
        sealed.append(packed.filter(~open_bin))
        pool, n = packed.filter(open_bin), sums["open"]
    out = sealed[0]
    for more in sealed[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.col("bound").alias("gap"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap."""
    pieces = stage(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity)
