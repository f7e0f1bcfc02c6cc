"""Spelling variants: words that differ by exactly one inserted, deleted or replaced character.

Words are counted, then compared in blocks of adjacent lengths (m, m + 1). An edit leaves one half of the shorter word
unchanged, so a block holds only the words of the two lengths that share a first or a last half; blocks of more than
BLOCK_WORDS words are split again by a half of what is left. In a block, NumPy multiplies the words' letter counts: the
Gram matrix gives the squared distances, pairs of at most two are kept, and common prefixes and suffixes verify that it
is one edit. A pair that shares both halves is counted in the prefix block alone.

Defined results: a null text has no words; a null id is written as nothing; rows that repeat count again; an empty table
gives an empty result; further columns are ignored; words of any length take part.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, small_join, stage, text_or_empty

LETTERS = r"A-Za-zÀ-ÿ"
MIN_CHARS = 7
BLOCK_WORDS = 4096
TILE_ROWS = 1024
_NO_CUT = 1 << 30


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_n: int = 2, typo_every: int | None = 31) -> DataFrame:
    """word, n of the maximal letter runs of all texts, A-Z lowered. With typo_every, runs whose hash with the document's id
    it divides lose one letter. A run of fewer than min_chars letters cannot give a word, so the pattern skips it."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("_run"),
    )
    lowered = F.when(F.octet_length("_run") == F.char_length("_run"), F.lower("_run")).otherwise(F.translate("_run", string.ascii_uppercase, string.ascii_lowercase))
    runs = runs.withColumn("word", lowered)
    if typo_every:
        h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        at = h % F.char_length("word")
        shorter = F.concat(F.substring("word", F.lit(1), at.cast("int")), F.substring("word", (at + 2).cast("int"), F.char_length("word")))
        runs = runs.select(F.when(h % typo_every == 0, shorter).otherwise(F.col("word")).alias("word")).filter(F.char_length("word") >= min_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_n)


def _key() -> Column:
    return F.concat_ws("|", "m", "p", "s", "cut", F.substring("word", F.lit(1), F.col("p")), F.expr("right(word, s)"))


def _blocks(words: DataFrame, block_words: int) -> DataFrame:
    """word, n once for each block: the shorter length m, the shared prefix p and suffix s, and the prefix length `cut` from
    which a pair belongs to another block."""
    length = F.char_length("word")
    kinds = []
    for m in (length, length - 1):
        half = F.floor(m / 2).cast("int")
        for p, s, cut in ((half, F.lit(0), F.lit(_NO_CUT)), (F.lit(0), half, half)):
            kinds.append(F.struct(m.alias("m"), p.alias("p"), s.alias("s"), cut.alias("cut")))
    least = words.agg(F.min(length)).first()[0] or 0
    rows = words.select("word", "n", F.explode(F.array(*kinds)).alias("_b")).select("word", "n", "_b.*").filter(F.col("m") >= least)
    rows, done = rows.withColumn("key", _key()), None
    while True:
        large = rows.filter(F.col("m") - F.col("p") - F.col("s") >= 2).groupBy("key").count().filter(F.col("count") > block_words)
        large = stage(large.select("key", F.lit(True).alias("_large")), "large_blocks")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = small_join(rows, large, "key", "left")
        small = marked.filter("_large IS NULL").drop("_large")
        done = small if done is None else done.unionByName(small)
        half = F.floor((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
        parts = F.array(
            F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"), F.col("cut").alias("cut")),
            F.struct(F.col("p").alias("p"), (F.col("s") + half).alias("s"), F.least("cut", F.col("p") + half).alias("cut")),
        )
        rows = marked.filter("_large").select("word", "n", "m", F.explode(parts).alias("_b")).select("word", "n", "m", "_b.*").withColumn("key", _key())
        rows = stage(rows, "split_blocks")


def _near_pairs(flat: np.ndarray, start: np.ndarray, size: np.ndarray, m: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs of a block that are one edit apart; words have m or m + 1 letters."""
    rows = np.arange(len(size))
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    used, letter = np.unique(flat[at], return_inverse=True)
    counts = np.bincount(np.repeat(rows, size) * len(used) + letter, minlength=len(rows) * len(used)).reshape(len(rows), len(used)).astype(np.float32)
    squares = (counts * counts).sum(axis=1)
    short, long = rows[size == m], rows[size == m + 1]
    columns = np.arange(m)
    head = flat[start[:, None] + columns]
    tail = flat[(start + size)[:, None] - 1 - columns]
    first, second = [], []
    for low in range(0, len(short), TILE_ROWS):
        tile = short[low : low + TILE_ROWS]
        for others, edits in ((short[low:], m - 1), (long, m)):
            if not len(others):
                continue
            gram = counts[tile] @ counts[others].T
            a, b = np.nonzero(squares[tile][:, None] + squares[others][None, :] - 2 * gram <= 2.5)
            a, b = tile[a], others[b]
            if edits < m:  # each pair of one length once
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 1 << 18):
                i, j = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
                same = head[i] == head[j]
                prefix = np.where(same.all(axis=1), m, same.argmin(axis=1))
                same = tail[i] == tail[j]
                suffix = np.where(same.all(axis=1), m, same.argmin(axis=1))
                ok = (prefix + suffix >= edits) & (prefix < cut)
                first.append(i[ok])
                second.append(j[ok])
    return (np.concatenate(first), np.concatenate(second)) if first else (rows[:0], rows[:0])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, m, cut, word as Latin-1 bytes, n), sorted by key and falling n; out come, for each word of a block,
    the number of words near it and the best of them."""
    names = ["word", "n_near", "best_n", "best"]
    held: pa.Table | None = None

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column(0).combine_chunks()
        change = np.flatnonzero(~np.asarray(pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False), bool)) + 1
        edges = np.concatenate([[0], change, [len(key)]])
        many = np.flatnonzero(np.diff(edges) > 1)
        flat, offsets = flat_bytes(table.column(3))
        size, n = np.diff(offsets), table.column(4).to_numpy()
        lengths, cuts = table.column(1).to_numpy(), table.column(2).to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in many.tolist():
            a, b = edges[k], edges[k + 1]
            i, j = _near_pairs(flat, offsets[a:b], size[a:b], int(lengths[a]), int(cuts[a]))
            if len(i):
                one, other = np.concatenate([i, j]), np.concatenate([j, i])
                near = np.bincount(one, minlength=b - a)
                best = np.full(b - a, b - a)
                np.minimum.at(best, one, other)  # rows stand in order of preference
                found = np.flatnonzero(near)
                out.append((found + a, near[found], best[found] + a))
        if out:
            rows, near, best = (np.concatenate(x) for x in zip(*out))
            words = table.column(3).combine_chunks()
            yield pa.record_batch([words.take(pa.array(rows)), pa.array(near, pa.int64()), pa.array(n[best], pa.int64()), words.take(pa.array(best))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        # The last block of a batch may go on in the next one.
        last = table.column(0)[-1].as_py()
        open_from = int(np.argmax(np.asarray(pc.equal(table.column(0), last).combine_chunks().to_numpy(zero_copy_only=False), bool)))
        if open_from:
            yield from blocks(table.slice(0, open_from).combine_chunks())
        held = table.slice(open_from).combine_chunks()
    if held is not None:
        yield from blocks(held)


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, best_n, best: of words (word, n; one row a word) with a near word, how many and the most frequent one
    (ties: the smallest)."""
    blocks = _blocks(words, block_words).select("key", "m", "cut", F.encode("word", "ISO-8859-1").alias("word"), "n")
    found = blocks.repartition("key").sortWithinPartitions("key", F.desc("n"), "word").mapInArrow(_compare, "word binary, n_near bigint, best_n bigint, best binary")
    best = F.min(F.struct((-F.col("best_n")).alias("_n"), F.col("best")))
    per = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    text = lambda c: F.decode(c, "ISO-8859-1")
    return per.select(text("word").alias("word"), "n_near", (-F.col("_best._n")).alias("best_n"), text("_best.best").alias("best"))


def variant_groups(words: DataFrame, ratio: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n). The form is the best near word if it occurs `ratio` times as
    often; forms grow that much with each step, so following them to the root ends after a few rounds of doubling."""
    words = stage(words.select("word", "n"), "words")
    near = near_words(words, block_words)
    formed = words.join(near.hint("merge"), "word", "left")
    taken = F.col("best_n") >= ratio * F.col("n")
    formed = stage(
        formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")),
        "forms",
    )
    links = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stage(small_join(links, further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        links = step.select("word", "root")
        if step.filter("_moved").isEmpty():
            break
    return formed.join(links.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
