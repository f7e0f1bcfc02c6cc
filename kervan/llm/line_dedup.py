"""Line dedup: lines that many documents share stay only in the document with the largest id.

A first pass notes the hash of each document's distinct long lines in two Bloom filters, once-seen and twice-seen. Tasks
emit the bit positions that they met once and more than once; the positions are merged by section (twice = twice in a
task, or once in two). A second pass tests every line against the twice-seen filter: only suspected repeats, as
128-bit digests, shuffle to be counted exactly and to choose the document that keeps them. Documents without a suspect
are done in that pass. Filters only spare work: any filter size gives the same result.

Sizes: FILTER_LINE_BITS bits a line, at most FILTER_BITS in all, which bounds the broadcast. Below the bound about 5 % of
the lines that are not repeated are suspected; beyond it (some 67 million lines) the share grows towards all of them.

Defined results: a null text is one empty line; each row is a document of its own; null ids lose against any other id, and
lines that only rows without an id hold stay in all of them; rows that repeat the largest id all keep the line; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_join, stage, text_or_empty

FILTER_LINE_BITS = 8
FILTER_BITS = 1 << 29
SECTIONS = 1 << 10
FOLD_POSITIONS = 4_000_000
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONTINUED = bytes(range(0x80, 0xC0))


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line: stripped, A-Z lowered; None for keys of fewer than min_chars code points."""
    keys = [line.strip(_SPACE) for line in text.lower().split(b"\n")]  # bytes.lower() lowers A-Z alone
    return [k if len(k) >= min_chars and len(k.translate(None, _CONTINUED)) >= min_chars else None for k in keys]


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _positions(digests: list[bytes]) -> np.ndarray:
    """Two 32-bit places per digest, one row each."""
    return np.frombuffer(b"".join(digests), np.uint32).reshape(-1, 4)[:, :2]


def _fold(once: np.ndarray, twice: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions seen once and more often, after more were met."""
    places, n = np.unique(np.concatenate([once, twice, twice, more]), return_counts=True)
    return places[n == 1], places[n > 1]


def _sightings(min_chars: int):
    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = np.zeros(0, np.uint32)
        held: list[np.ndarray] = []
        n_held = n_lines = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                digests = [_digest(k) for k in {k for k in line_keys(text, min_chars) if k is not None}]
                if digests:
                    held.append(_positions(digests).ravel())
                    n_held += len(held[-1])
                    n_lines += len(digests)
                if n_held > FOLD_POSITIONS:
                    once, twice = _fold(once, twice, np.concatenate(held))
                    held, n_held = [], 0
        if held:
            once, twice = _fold(once, twice, np.concatenate(held))
        if not n_lines:
            return
        edges = (np.arange(SECTIONS + 1, dtype=np.uint64) * np.uint64((1 << 32) // SECTIONS)).astype(np.uint64)
        at, at2 = np.searchsorted(once, edges), np.searchsorted(twice, edges)
        used = np.flatnonzero((np.diff(at) > 0) | (np.diff(at2) > 0)).tolist()
        yield pa.record_batch(
            [
                pa.array(used, pa.int32()),
                pa.array([once[at[i] : at[i + 1]].tobytes() for i in used], pa.binary()),
                pa.array([twice[at2[i] : at2[i + 1]].tobytes() for i in used], pa.binary()),
                pa.array([n_lines if k == 0 else 0 for k in range(len(used))], pa.int64()),
            ],
            ["section", "once", "twice", "n_lines"],
        )

    return note


def _merged(shift: int):
    """Twice-seen bits of each section from its tasks' positions, one section in memory at a time."""
    width = ((1 << 32) >> shift) // SECTIONS

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None

        def result():
            return pa.record_batch([pa.array([current], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["section", "bits"])

        for batch in batches:
            for section, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if section != current:
                    if current is not None:
                        yield result()
                    current, once, twice = section, np.zeros(width, bool), np.zeros(width, bool)
                for raw, often in ((a, False), (b, True)):
                    places = (np.frombuffer(raw, np.uint32) >> np.uint32(shift)).astype(np.int64) - section * width
                    if often:
                        twice[places] = True
                    else:
                        # Two positions of one task may fall on one bit at this filter size.
                        places, n = np.unique(places, return_counts=True)
                        twice[places[once[places] | (n > 1)]] = True
                    once[places] = True
        if current is not None:
            yield result()

    return merge


def _twice_seen(docs: DataFrame, min_chars: int, filter_bits: int) -> tuple[np.ndarray, int]:
    """The twice-seen filter, as bytes of at most filter_bits bits, and how far positions are shifted to bits."""
    seen = stage(docs.select("_text").mapInArrow(_sightings(min_chars), "section int, once binary, twice binary, n_lines bigint"), "line_sightings")
    n_lines = seen.agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n")).first()["n"]
    bits = 8 * SECTIONS
    while bits < min(n_lines * FILTER_LINE_BITS, filter_bits):
        bits *= 2
    shift = 32 - (bits.bit_length() - 1)
    sections = seen.select("section", "once", "twice").repartition("section").sortWithinPartitions("section").mapInArrow(_merged(shift), "section int, bits binary")
    found = np.zeros(bits // 8, np.uint8)
    width = bits // 8 // SECTIONS
    for row in sections.toLocalIterator():  # the filter alone, at most filter_bits
        found[row["section"] * width : (row["section"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return found, shift


def _suspects(filter_, shift: int, min_chars: int):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            per, sizes, lines = [], [], []
            for text in texts:
                keys = line_keys(text, min_chars)
                lines.append(len(keys))
                digests = [_digest(k) for k in {k for k in keys if k is not None}]
                per += digests
                sizes.append(len(digests))
            hit = np.zeros(0, bool)
            if per:
                places = _positions(per) >> np.uint32(shift)
                hit = ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)
            ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
            kept = np.concatenate([[0], np.cumsum(hit)])[ends]
            values = pa.array([per[i] for i in np.flatnonzero(hit).tolist()], pa.binary())
            suspects = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), values)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lines, pa.int64()), suspects], ["_id", "_text", "n_lines", "suspects"])

    return test


def _without(min_chars: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, drops in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if drops:
                    gone = set(drops)
                    stay = [k is None or _digest(k) not in gone for k in line_keys(text, min_chars)]
                    counts.append(len(stay) - sum(stay))
                    text = b"\n".join([line for line, ok in zip(text.split(b"\n"), stay) if ok])
                else:
                    counts.append(0)
                texts.append(text)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary()), batch.column(2), pa.array(counts, pa.int64())], ["_id", "_text", "n_lines", "n_dropped"])

    return drop


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: id, n_lines (before), n_dropped, kept_text. Lines whose key (stripped, A-Z lowered) has at
    least min_chars code points and stands in at least min_docs documents go, except from those of the largest id.
    filter_bits is a power of two of at least 8192."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).cast("binary").alias("_text"))
    bits, shift = _twice_seen(docs, min_chars, filter_bits)
    tested = docs.mapInArrow(_suspects(spark.sparkContext.broadcast(bits), shift, min_chars), f"_id {id_type}, _text binary, n_lines bigint, suspects array<binary>")
    # Written once with a number for each row, so neither null ids nor repeated rows meet in one group.
    tested = stage(tested.withColumn("_row", F.monotonically_increasing_id()), "line_suspects")
    suspects = tested.filter(F.size("suspects") > 0)

    sighted = suspects.select("_row", "_id", F.explode("suspects").alias("_key"))
    repeated = sighted.groupBy("_key").agg(F.count("*").alias("_docs"), F.max("_id").alias("_keeper")).filter(F.col("_docs") >= min_docs)
    repeated = stage(repeated.select("_key", "_keeper"), "repeated_lines")
    drops = small_join(sighted, repeated, "_key").filter(~F.col("_id").eqNullSafe(F.col("_keeper")))
    drops = drops.groupBy("_row").agg(F.collect_list("_key").alias("_drops"))  # as many as the document has lines

    clean = tested.filter(F.size("suspects") == 0).select("_id", "_text", "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    cut = suspects.select("_row", "_id", "_text", "n_lines").join(drops.hint("merge"), "_row", "left").select("_id", "_text", "n_lines", "_drops")
    cut = cut.mapInArrow(_without(min_chars), f"_id {id_type}, _text binary, n_lines bigint, n_dropped bigint")
    return clean.unionByName(cut).select(F.col("_id").alias(id_col), "n_lines", "n_dropped", F.col("_text").cast("string").alias("kept_text"))
