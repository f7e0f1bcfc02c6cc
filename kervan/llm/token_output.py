"""Token-id output: frequency-ranked ids in byte-aligned variable-length code.

File format (Parquet as the container, one row per block of consecutive documents, rows in document order):
  run, seq            place of the block in the order
  doc_ids, lengths    little-endian int64 per document
  control             2 bits per token, 4 tokens a byte, low bits first: length of the code in bytes minus 1
  data                the code bytes of all tokens: the frequency rank, little-endian
and beside it a table (rank, token_id). Frequent tokens have ranks below 256 and take one byte. The reader expands the
control bytes with a 256-row lookup table and gathers the data bytes with numpy.

Defined results: null text counts as empty and holds only the end id; null ids come first in the order; rows that
repeat an id are ordered by a hash of their token ids, then by these; an empty table gives empty files; further columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_bytes, new_path, stage, text_or_empty, unstage, with_run_start
from .tokenizing import release_pieces, sub_batches, worker_pieces

BLOCK_SCHEMA = "run int, seq long, doc_ids binary, doc_nulls binary, lengths binary, control binary, data binary"
BLOCK_COLUMNS = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
#: Text that is tokenised at once.
TEXT_BYTES = 8 << 20
#: For each control byte: the lengths of its four codes.
CODE_LENGTHS = np.stack([(np.arange(256) >> (2 * i) & 3) + 1 for i in range(4)], axis=1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks (uint32)."""
    ranks = np.ascontiguousarray(ranks, np.uint32)
    size = (ranks >= 1 << 8).astype(np.uint8)
    for bits in (16, 24):
        if len(ranks) and ranks.max() >> bits:
            size += ranks >= np.uint32(1 << bits)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    start = np.cumsum(size, dtype=np.int64) - size + np.arange(len(ranks))
    data = np.empty(len(ranks) + int(size.sum(dtype=np.int64)), np.uint8)
    data[start] = ranks.astype(np.uint8)
    for b in range(1, int(size.max(initial=0)) + 1):
        more = np.flatnonzero(size >= b)
        data[start[more] + b] = (ranks[more] >> np.uint32(8 * b)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block, by table lookup."""
    lengths = CODE_LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32)
    for b in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > b)
        out[more] |= raw[start[more] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


def write_token_ids(
    docs: DataFrame,
    tokenizer_path: str,
    out_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4 << 20,
) -> None:
    """Tokenise every text once, count ids over all documents, and write blocks in ascending id order.

    Only the ids (2 bytes each for vocabularies up to 65 536) are shuffled by range, not the texts; ties of the id are
    dealt and ordered by a hash of the ids, so rows that share an id, or have none, do not meet in one task.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    def tokenise(batches):
        """A row per document, and last in each task a row with the task's count of each id."""
        pieces = worker_pieces(tokenizer_path)
        dtype = np.dtype(pieces.dtype if end_id < 1 << 8 * pieces.width else np.uint32)
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at, n in sub_batches(batch.column(1), TEXT_BYTES):
                ids, offsets = pieces.ids(batch.column(1).slice(at, n))
                ids = np.insert(ids.astype(dtype), offsets[1:], end_id)
                total, got = np.bincount(ids, minlength=len(total)), total
                total[: len(got)] += got
                ends = pa.py_buffer(((offsets + np.arange(n + 1)) * dtype.itemsize).astype(np.int32))
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(ids)])
                yield pa.record_batch([batch.column(0).slice(at, n), blobs, pa.array(np.full(n, dtype.itemsize, np.int32)), pa.nulls(n, pa.binary())], columns)
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], columns)

    columns = ["id", "ids", "width", "counts"]
    staged = stage(slim.mapInArrow(tokenise, "id long, ids binary, width int, counts binary"), "token_ids")
    raw = staged.filter("counts IS NULL").drop("counts")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                got = np.frombuffer(blob.as_buffer(), "<i8")
                total = np.concatenate([total, np.zeros(max(len(got) - len(total), 0), np.int64)])
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["token_id", "n"])

    # One row per distinct id: bounded by the vocabulary, whatever the corpus.
    counts = staged.filter("counts IS NOT NULL").select("counts").mapInArrow(count, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    ranked = sorted(((-r["n"], r["token_id"]) for r in counts.collect()))
    by_rank = np.array([x[1] for x in ranked], np.uint32)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)

    def encode(batches):
        from pyspark import TaskContext

        release_pieces()
        run, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, n in sub_batches(batch.column(1), block_bytes):
                keys, blobs, widths = (batch.column(c).slice(at, n) for c in range(3))
                lengths = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype("<i8") // widths.to_numpy()
                cells = (
                    keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                    np.packbits(keys.is_null().to_numpy(zero_copy_only=False)).tobytes(),
                    lengths.astype("<i8").tobytes(),
                    *encode_ranks(sent.value[_flat_ids(blobs, widths)]),
                )
                yield pa.record_batch([pa.array([run], pa.int32()), pa.array([seq], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], BLOCK_COLUMNS)
                seq += 1

    table = spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, token_id long")
    table.write.parquet(f"{out_path}/ranks")
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    ordered = raw.withColumn("tie", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order, "ids").select("id", "ids", "width")
    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{out_path}/blocks")
    unstage(staged)


def _flat_ids(blobs: pa.Array, widths: pa.Array) -> np.ndarray:
    """The ids of all rows end to end; one call of the writer gives all rows the same width."""
    raw, _ = flat_bytes(blobs)
    return np.frombuffer(raw, np.uint16 if widths[0].as_py() == 2 else np.uint32)


def read_token_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Decodes the files: one row per document with start, n_tokens and the crc32 of its ids."""
    ranks = spark.read.schema("rank int, token_id long").parquet(f"{path}/ranks").orderBy("rank").collect()
    sent = spark.sparkContext.broadcast(np.array([r["token_id"] for r in ranks], "<u4"))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                run, seq = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                doc_ids, nulls, lengths, control, data = (batch.column(j)[i].as_buffer() for j in range(2, 7))
                keys, lengths = np.frombuffer(doc_ids, "<i8"), np.frombuffer(lengths, "<i8")
                void = np.unpackbits(np.frombuffer(nulls, np.uint8))[: len(keys)].astype(bool)
                ids = memoryview(sent.value[decode_ranks(control, data, int(lengths.sum()))]).cast("B")
                ends = np.cumsum(lengths) * 4
                crcs = [zlib.crc32(ids[e - 4 * n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                place = np.arange(len(keys), dtype=np.int64)
                yield pa.record_batch(
                    [pa.array(keys, pa.int64(), mask=void), pa.array(np.full(len(keys), run), pa.int32()), pa.array(np.full(len(keys), seq), pa.int64()), pa.array(place), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    [id_col, "run", "seq", "place", "n_tokens", "ids_crc32"],
                )

    docs = stage(blocks.mapInArrow(decode, f"{id_col} long, run int, seq long, place long, n_tokens long, ids_crc32 long"), "token_docs")
    return with_run_start(docs, "run", ["seq", "place"], "n_tokens", "start").select(id_col, "start", "n_tokens", "ids_crc32")


def token_id_roundtrip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, out_path: str | None = None, **options) -> DataFrame:
    """Write the files and read them back."""
    path = out_path or new_path(docs.sparkSession, "token_files")
    write_token_ids(docs, tokenizer_path, path, end_id, **options)
    return read_token_ids(docs.sparkSession, path, options.get("id_col", "doc_id"))
