"""Suffix dedup: removes bytes covered by a long string that also starts in a document with a smaller id.

Positions are ranked by prefixes of growing length and drop out as soon as their rank is unique, in the manner of
prefix doubling, but on a sample of positions that cannot miss a match: every window of `span` bytes elects the
smallest hash among its `seed`-byte strings, so two equal windows elect the same seed at the same place.

 1. seed bytes: elected seeds, ranked over all documents; seeds of one document only are unique and drop out.
 2. context: a surviving seed with all windows that elected it is one string (up to 2 * span - seed bytes); equal
    strings get equal ranks and the smallest document id of the rank. Documents above it lose these windows at once.
 3. span bytes: where a seed has several contexts (the edges of copied passages), the windows of each rank's smallest
    document are ranked one by one, and windows with a smaller document in their rank are removed.

Each ranking is a shuffle by hash range: tasks send sorted runs of fingerprints packed as binary, a range's task sorts
and merges them with numpy and answers to the chunks that asked. Documents are dealt to chunks of bounded size by a
hash of their id and written once as a table bucketed by chunk, so the texts are shuffled once. A chunk sends each
rank once, with its smallest id, so copies of a passage never meet in one task beyond one row per chunk. Ranks of steps 2
and 3, on which bytes are removed, are compared by 128 bits (two hashes with different symbol values); those of step 1
only choose candidates and have 64. There is a hash range for every RANGE_BYTES of text at the most.

Defined results: null and empty texts, and texts shorter than the span, lose nothing; rows with a null id neither lose
bytes nor count as a source; rows that share an id are judged against smaller ids only, so they keep what they share
with each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import _power, mix64
from ..session import remove_folder
from .common import flat_bytes, new_path, shuffle_partitions, stage, text_or_empty

SEED = 24
CHUNK_BYTES = 2 << 20
RANGE_BYTES = 64 << 20
FLUSH = 2_000_000
ASK_SCHEMA = "bucket int, chunk int, data binary"
ANSWER_SCHEMA = "chunk int, kind int, data binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESOLVED, BY_WINDOW, SMALLER = 0, 1, 2
#: Symbol values of the second hash.
CHECK = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Prefixes:
    """Hashes of all strings of one text, from prefix sums."""

    def __init__(self, raw: np.ndarray, symbols: np.ndarray | None = None):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1) if symbols is None else symbols[raw]) * _power("up", n), out=self.sums[1:])
        self.down = _power("down", n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all_of(self, size: int) -> np.ndarray:
        return mix64((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size] + np.uint64(size))


def _window_minimum(h: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while n * 2 <= w:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (w - n)], h[w - n :]) if n < w else h


def elected(prefixes: Prefixes, span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, first and last window start of each run of windows that elect the same seed."""
    least = _window_minimum(prefixes.all_of(seed), span - seed + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[start], start, np.append(start[1:], len(least)) - 1


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _runs(*values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in sorted arrays, of which all must be equal."""
    if not len(values[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([v[1:] != v[:-1] for v in values], axis=0)]))


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _least(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the smallest doc of each."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    at = _runs(key)
    return key[at], doc[at]


def _asks(chunk: int, sort_key: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.Table:
    """One row per bucket that has entries: the columns' values end to end."""
    b = _bucket(sort_key, buckets)
    order = np.argsort(b, kind="stable")
    b, columns = b[order], [c[order] for c in columns]
    at = _runs(b)
    ends = np.append(at[1:], len(b))
    data = [b"".join(c[s:e].tobytes() for c in columns) for s, e in zip(at.tolist(), ends.tolist())]
    return pa.table([pa.array(b[at], pa.int32()), pa.array(np.full(len(at), chunk), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "chunk", "data"])


def _answers(chunks: np.ndarray, kinds: np.ndarray, values: np.ndarray) -> pa.Table:
    """One row per (chunk, kind): its values."""
    order = np.lexsort((kinds, chunks))
    chunks, kinds, values = chunks[order], kinds[order], values[order]
    at = _runs(chunks.astype(np.int64) * 4 + kinds)
    ends = np.append(at[1:], len(values))
    data = [values[s:e].tobytes() for s, e in zip(at.tolist(), ends.tolist())]
    return pa.table([pa.array(chunks[at], pa.int32()), pa.array(kinds[at], pa.int32()), pa.array(data, pa.binary())], names=["chunk", "kind", "data"])


def _gather(table: pa.Table, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Chunk of every entry and the `width` columns of all asks of a bucket."""
    parts, chunks = [[] for _ in range(width)], []
    for chunk, blob in zip(table.column("chunk").to_pylist(), table.column("data").to_pylist()):
        block = np.frombuffer(blob, np.uint64).reshape(width, -1)
        chunks.append(np.full(block.shape[1], chunk, np.int64))
        for i in range(width):
            parts[i].append(block[i])
    return np.concatenate(chunks), [np.concatenate(p) for p in parts]


class _Chunk:
    """The documents of a chunk: elected seeds and contexts of all of them."""

    def __init__(self, table: pa.Table, span: int, seed: int, check: bool = False):
        table = table.combine_chunks()
        self.ids = table.column("doc_id").to_pylist()
        column = table.column("text")
        self.raw, offsets = flat_bytes(column) if table.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.offsets = offsets.tolist()
        hs, xs, ys, los, his, docs, rows = [], [], [], [], [], [], []
        for i, key in enumerate(self.ids):
            if key is None or self.offsets[i + 1] - self.offsets[i] < span:
                continue
            p = Prefixes(self.text(i))
            h, lo, hi = elected(p, span, seed)
            hs.append(h), los.append(lo), his.append(hi), xs.append(p.of(lo, hi + span))
            if check:
                ys.append(Prefixes(self.text(i), CHECK).of(lo, hi + span))
            docs.append(np.full(len(h), key, np.int64)), rows.append(np.full(len(h), i, np.int64))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.h, self.x, self.lo, self.hi, self.doc, self.row = join(hs, np.uint64), join(xs, np.uint64), join(los, np.int64), join(his, np.int64), join(docs, np.int64), join(rows, np.int64)
        self.y = join(ys, np.uint64)
        # The context's rank is compared together with the seed's.
        self.x = mix64(self.x ^ (self.h << np.uint64(1)))

    def text(self, i: int) -> np.ndarray:
        return self.raw[self.offsets[i] : self.offsets[i + 1]]

    def smallest(self) -> np.ndarray:
        """For each elected seed: the smallest document of its context in this chunk."""
        keys, docs = _least(self.x, self.doc)
        return docs[np.searchsorted(keys, self.x)] if len(keys) else self.doc

    def windows(self, by_window: np.ndarray, smallest: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document, row and start of the windows of contexts that are ranked window by window."""
        at = np.flatnonzero(_member(self.x, by_window) & (self.doc == smallest))
        n = self.hi[at] - self.lo[at] + 1
        which = np.repeat(at, n)
        start = self.lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        row = self.row[which]
        return self.window_hashes(row, start, span), self.doc[which], row, start

    def window_hashes(self, row: np.ndarray, start: np.ndarray, span: int, symbols: np.ndarray | None = None) -> np.ndarray:
        found = np.zeros(len(row), np.uint64)
        for s, e in zip(_runs(row).tolist(), np.append(_runs(row)[1:], len(row)).tolist()):
            found[s:e] = Prefixes(self.text(int(row[s])), symbols).of(start[s:e], start[s:e] + span)
        return found


def _sets(table: pa.Table) -> dict[int, np.ndarray]:
    found: dict[int, list] = {RESOLVED: [], BY_WINDOW: [], SMALLER: []}
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
        found[kind].append(np.frombuffer(blob, np.uint64))
    return {k: np.sort(np.concatenate(v)) if v else np.zeros(0, np.uint64) for k, v in found.items()}


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    content = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    parts = shuffle_partitions(spark)
    total = content.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks = max(parts, -(-total // CHUNK_BYTES))
    buckets = max(2 * parts, -(-total // RANGE_BYTES))
    # Rows without an id, of which none loses a byte, are dealt by their texts.
    content = content.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(chunks)).cast("int"))

    name = f"kervan_spans_{uuid.uuid4().hex}"
    path = new_path(spark, name)
    content.repartition(parts, "chunk").write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, "chunk").saveAsTable(name)
    texts = spark.table(name)

    def ask_seeds(batches):
        seeds, owner, n = [], [], 0
        number = 0
        for batch in batches:
            raw, offsets = flat_bytes(batch.column(1))
            ids, place = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, key in enumerate(ids):
                if key is None or offsets[i + 1] - offsets[i] < span:
                    continue
                h = np.unique(elected(Prefixes(raw[offsets[i] : offsets[i + 1]]), span, seed)[0])
                seeds.append(h), owner.append(np.full(len(h), place[i], np.int64))
                n, number = n + len(h), number + 1
                if n >= FLUSH:
                    yield from _seed_asks(seeds, owner, buckets)
                    seeds, owner, n = [], [], 0
        if seeds:
            yield from _seed_asks(seeds, owner, buckets)

    def rank_seeds(table: pa.Table) -> pa.Table:
        hashes, owners, flags = [], [], []
        for blob in table.column("data").to_pylist():
            n_chunks, n = np.frombuffer(blob[:8], np.uint32).tolist()
            ids = np.frombuffer(blob, np.int32, n_chunks, 8)
            counts = np.frombuffer(blob, np.int32, n_chunks, 8 + 4 * n_chunks)
            hashes.append(np.frombuffer(blob[8 + 8 * n_chunks : 8 + 8 * n_chunks + 8 * n], np.uint64))
            flags.append(np.unpackbits(np.frombuffer(blob, np.uint8, -1, 8 + 8 * n_chunks + 8 * n))[:n])
            owners.append(np.repeat(ids.astype(np.int64), counts))
        h, owner, flag = np.concatenate(hashes), np.concatenate(owners), np.concatenate(flags)
        order = np.lexsort((owner, h))
        h, owner, flag = h[order], owner[order], flag[order]
        at = _runs(h)
        size = np.diff(np.append(at, len(h)))
        shared = np.repeat((size > 1) | (np.maximum.reduceat(flag, at) > 0), size)
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        keep = shared & once
        return _answers(owner[keep], np.zeros(int(keep.sum()), np.int64), h[keep])

    def ask_contexts(key, left: pa.Table, right: pa.Table) -> pa.Table:
        c = _Chunk(left, span, seed, check=True)
        keep = _member(c.h, _sets(right)[0])
        h, x, y, doc = c.h[keep], c.x[keep], c.y[keep], c.doc[keep]
        order = np.lexsort((doc, x))
        order = order[_runs(x[order])]
        return _asks(key[0].as_py(), h[order], [h[order], x[order], y[order], doc[order].view(np.uint64)], buckets)

    def rank_contexts(table: pa.Table) -> pa.Table:
        chunk, (h, x, y, doc) = _gather(table, 4)
        doc = doc.view(np.int64)
        order = np.lexsort((doc, y, x, h))
        chunk, h, x, y, doc = chunk[order], h[order], x[order], y[order], doc[order]
        at = _runs(x, y)
        size = np.diff(np.append(at, len(x)))
        least = np.repeat(doc[at], size)
        # How many contexts a seed has.
        seed_at = _runs(h[at])
        several = np.repeat(np.repeat(np.diff(np.append(seed_at, len(at))) > 1, np.diff(np.append(seed_at, len(at)))), size)
        resolved, single = doc > least, (doc == least) & several
        keep = resolved | single
        return _answers(chunk[keep], np.where(resolved, RESOLVED, BY_WINDOW)[keep], x[keep])

    def ask_windows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        c, sets = _Chunk(left, span, seed), _sets(right)
        fp, doc, row, start = c.windows(sets[BY_WINDOW], c.smallest(), span)
        y = c.window_hashes(row, start, span, CHECK)
        order = np.lexsort((doc, fp))
        order = order[_runs(fp[order])]
        return _asks(key[0].as_py(), fp[order], [fp[order], y[order], doc[order].view(np.uint64)], buckets)

    def rank_windows(table: pa.Table) -> pa.Table:
        chunk, (fp, y, doc) = _gather(table, 3)
        doc = doc.view(np.int64)
        order = np.lexsort((doc, y, fp))
        chunk, fp, y, doc = chunk[order], fp[order], y[order], doc[order]
        at = _runs(fp, y)
        least = np.repeat(doc[at], np.diff(np.append(at, len(fp))))
        keep = doc > least
        return _answers(chunk[keep], np.full(int(keep.sum()), SMALLER), fp[keep])

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        c, sets = _Chunk(left, span, seed), _sets(right)
        smallest = c.smallest()
        gone = _member(c.x, sets[RESOLVED]) | (c.doc > smallest)
        fp, doc, row, start = c.windows(sets[BY_WINDOW], smallest, span)
        keys, docs_ = _least(fp, doc)
        hit = _member(fp, sets[SMALLER]) | (docs_[np.searchsorted(keys, fp)] < doc if len(keys) else np.zeros(0, bool))
        first, last = np.concatenate([c.lo[gone], start[hit]]), np.concatenate([c.hi[gone], start[hit]]) + span
        owner = np.concatenate([c.row[gone], row[hit]])
        order = np.argsort(owner, kind="stable")
        first, last, owner = first[order], last[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(len(c.ids) + 1))
        out = []
        for i, doc_id in enumerate(c.ids):
            text = c.text(i)
            s, e = bounds[i], bounds[i + 1]
            if s == e:
                out.append((doc_id, len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
                continue
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, first[s:e], 1)
            np.add.at(change, last[s:e], -1)
            removed = np.cumsum(change[:-1]) > 0
            spans = int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum())
            out.append((doc_id, len(text), int(removed.sum()), spans, hashlib.sha256(text[~removed].tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        cols = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(v, t) for v, t in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def with_texts(answers: DataFrame):
        return texts.groupBy("chunk").cogroup(answers.groupBy("chunk"))

    try:
        seeds = content.select("doc_id", "text", "chunk").mapInArrow(ask_seeds, "bucket int, data binary")
        shared = stage(seeds.groupBy("bucket").applyInArrow(rank_seeds, ANSWER_SCHEMA), "span_seeds")
        contexts = with_texts(shared).applyInArrow(ask_contexts, ASK_SCHEMA)
        ranked = stage(contexts.groupBy("bucket").applyInArrow(rank_contexts, ANSWER_SCHEMA), "span_contexts")
        windows = with_texts(ranked).applyInArrow(ask_windows, ASK_SCHEMA)
        smaller = stage(windows.groupBy("bucket").applyInArrow(rank_windows, ANSWER_SCHEMA), "span_windows")
        return stage(with_texts(ranked.unionByName(smaller)).applyInArrow(remove, RESULT_SCHEMA), "span_results")
    finally:
        spark.sql(f"DROP TABLE {name}")
        remove_folder(spark, path)


def _seed_asks(seeds: list[np.ndarray], owners: list[np.ndarray], buckets: int):
    """Rows (bucket, data): header, chunk ids, counts, hashes by chunk, and a bit for hashes of several documents."""
    h, owner = np.concatenate(seeds), np.concatenate(owners)
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    at = _runs(h)
    several = np.repeat(np.diff(np.append(at, len(h))) > 1, np.diff(np.append(at, len(h))))
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner, several = h[once], owner[once], several[once]
    b = _bucket(h, buckets)
    order = np.lexsort((owner, b))
    h, owner, several, b = h[order], owner[order], several[order], b[order]
    starts = _runs(b)
    numbers, data = [], []
    for s, e in zip(starts.tolist(), np.append(starts[1:], len(b)).tolist()):
        own = owner[s:e]
        c = _runs(own)
        head = np.array([len(c), e - s], np.uint32).tobytes()
        counts = np.diff(np.append(c, len(own))).astype(np.int32)
        data.append(head + own[c].astype(np.int32).tobytes() + counts.tobytes() + h[s:e].tobytes() + np.packbits(several[s:e]).tobytes())
        numbers.append(int(b[s]))
    for i in range(0, len(data), 64):
        yield pa.record_batch([pa.array(numbers[i : i + 64], pa.int32()), pa.array(data[i : i + 64], pa.binary())], ["bucket", "data"])
