"""MinHash near-dedup with DartMinHash signatures.

A document is the weighted set of its five-word shingles (words between ASCII white space, ASCII lower case), the
weight being the number of occurrences; a text of one to four words is one shingle. Similarity is the weighted
Jaccard index (sum of smaller over sum of larger weights); 0.8 or more is a link, groups are the connected components
of links, and of each group the smallest id stays.

Signature: each unit of weight of each element is a region in which darts fall as a Poisson process over rank,
generated from the hash of element and unit alone, so equal regions get equal darts in every document. A document
takes the darts below rank t / weight (about t darts whatever its size), spreads them over k coordinates by hash, and
keeps the earliest dart of each coordinate; documents that leave a coordinate empty look further up.

Banding: `bands` groups of `rows` coordinates are hashed and documents with an equal band hash meet in a bucket. Each
document is first compared with one candidate, the smallest head (smallest member) over all its buckets, which settles
most of them whatever the number of bands. Documents that are not in the component of all their heads are then compared
with those other heads. In buckets that still span several components, each member outside the head's component is
compared with every member of another component, so that no link inside a bucket is missed; of large buckets only members
that share a unit of their prefix with another component stay (see contested), and what is left is cut into blocks. Every compared pair is verified exactly on its shingles. Equal texts are reduced to one representative
before, and joined back at the end.

Defined results: texts without a word (null, empty, blank) form no group unless their normalised texts are equal;
repeated rows and equal texts share a class; rows with a null id are reported with class null and stay; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import LOWER, NOT_SPACE, Words, mix64
from .common import flat_bytes, one_row_each, shuffle_partitions, small_join, stage, text_or_empty, unstage
from .components import connected_components
from .tokenizing import sub_batches

SHINGLE = 5
SUB_BATCH = 512 << 10
#: Counts and postings that one step of a comparison holds.
TILE = 4 << 20
#: A bucket with more units of weight than this is compared in blocks of about this size.
BLOCK_UNITS = 1 << 20
#: Units are ordered by their counts on 2^ORDER_BITS places.
ORDER_BITS = 20
#: Members that one copy of their head is sent along with.
SECTION_MEMBERS = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def cells(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of weight of each text: hash of (shingle, occurrence number), and the bounds per text."""
    words = Words(LOWER[raw], offsets, NOT_SPACE)
    h = words.hashes()
    n_words = np.diff(words.bounds)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    first = words.bounds[:-1][doc] + np.arange(bounds[-1]) - bounds[:-1][doc]
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    shingle = np.zeros(len(first), np.uint64)
    short = n_words[doc] < SHINGLE
    for i in range(SHINGLE):
        part = padded[first + i]
        if short.any():
            part = np.where(short & (i >= n_words[doc]), np.uint64(0), part)
        shingle = mix64(shingle * _GOLDEN + part + np.uint64(i + 1))
    # Occurrence numbers: equal shingles of a text, counted in order.
    order = np.lexsort((shingle, doc))
    s, d = shingle[order], doc[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0)) if len(s) else np.zeros(0, np.int64)
    return mix64(s ^ ((np.arange(len(s)) - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))), bounds


def dart_signatures(units: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """A row of k values (rank bits, dart hash) per text; rows of texts without units stay all ones."""
    n_docs = len(bounds) - 1
    best = np.full((n_docs, k), np.iinfo(np.uint64).max, np.uint64)
    weight = np.diff(bounds)
    throw = k * (math.log(k) + 4.0)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        theta = throw / weight[todo]
        n = weight[todo]
        doc = np.repeat(todo, n)
        at = np.repeat(bounds[todo] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        limit = np.repeat(theta, n)
        cell, rank, number = units[at], np.zeros(len(at)), 0
        flat = best.reshape(-1)
        while len(cell):
            number += 1
            cell = mix64(cell + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64)))
            # The gap to the next dart of the cell is exponential.
            rank = rank - np.log(((cell >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = rank < limit
            cell, rank, limit, doc = cell[live], rank[live], limit[live], doc[live]
            dart = mix64(cell ^ np.uint64(0xA0761D6478BD642F))
            place = doc * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            value = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | dart & np.uint64(0xFFFFFFFF)
            np.minimum.at(flat, place, value)
        todo = todo[(best[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        best[todo] = np.iinfo(np.uint64).max
        throw *= 2
    return best


def _each(batches, column: int):
    for batch in batches:
        for at, n in sub_batches(batch.column(column), SUB_BATCH):
            raw, offsets = flat_bytes(batch.column(column).slice(at, n))
            yield batch.slice(at, n), *cells(raw, offsets)


def band_hashes(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, band hash) rows of the texts that have words."""

    def run(batches):
        for batch, units, bounds in _each(batches, 1):
            some = np.flatnonzero(np.diff(bounds) > 0)
            sig = dart_signatures(units, bounds, bands * rows)[some].reshape(len(some), bands, rows)
            h = np.zeros((len(some), bands), np.uint64)
            for r in range(rows):
                h = mix64(h * _GOLDEN + sig[:, :, r])
            h = mix64(h + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))[some]
            yield pa.record_batch([pa.array(np.repeat(ids, bands)), pa.array(h.reshape(-1).view(np.int64))], ["id", "bucket"])

    return texts.mapInArrow(run, "id long, bucket long")


def shingle_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, units): the sorted units of weight of the texts whose id is in ids (want)."""

    def run(batches):
        for batch, units, bounds in _each(batches, 1):
            blobs = [np.sort(units[s:e]).tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(blobs, pa.binary())], ["id", "units"])

    ids = stage(ids.distinct(), "wanted").withColumnRenamed("want", "id")
    sets = small_join(texts, ids, "id", "left_semi").mapInArrow(run, "id long, units binary")
    return stage(sets, "shingle_sets")


def wanted_sets(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of sets whose id is in ids (want)."""
    return small_join(sets, stage(ids.distinct(), "wanted").withColumnRenamed("want", "id"), "id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The staged pairs (head a, member b) whose weighted Jaccard similarity on shingles is at least the threshold. sets: id,
    units of all that are in a pair, and no more than a few others.

    A head's members are dealt to sections of about SECTION_MEMBERS, each of which gets one copy of the head; a section's
    rows lie behind each other in a task, the head first, so a task holds one head and one Arrow batch.
    """

    def compare(batches):
        head, head_id = None, None
        for batch in batches:
            keep = []
            for i, (a, leads) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                units = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                if leads:
                    head, head_id = units.copy(), a
                    continue
                assert a == head_id
                small, large = (head, units) if len(head) <= len(units) else (units, head)
                if len(small) < threshold * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                if common >= threshold * (len(head) + len(units) - common):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    heads = stage(pairs.groupBy("a").agg(F.ceil(F.count("*") / SECTION_MEMBERS).alias("sections")), "near_heads")
    dealt = small_join(pairs, heads, "a").select("a", "b", F.pmod(F.xxhash64("b"), "sections").alias("section"))
    members = dealt.join(sets.select(F.col("id").alias("b"), "units").hint("merge"), "b").select("a", "b", "section", F.lit(False).alias("leads"), "units")
    leading = heads.join(sets.select(F.col("id").alias("a"), "units").hint("merge"), "a")
    leading = leading.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sections") - 1)).alias("section"), F.lit(True).alias("leads"), "units")
    rows = members.unionByName(leading).repartition(shuffle_partitions(pairs.sparkSession), "a", "section").sortWithinPartitions("a", "section", F.desc("leads"))
    return stage(rows.select("a", "b", "leads", "units").mapInArrow(compare, "a long, b long"), "links")


def _spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (lengths[i] of them), end to end."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def joining_links(sets: list[np.ndarray], labels: np.ndarray, n_rows: int, inner: bool, threshold: float) -> list[tuple[int, int]]:
    """Compares each of the first n_rows sets with all later sets (inner: those among the first n_rows too) of another
    label. Of the links, those that join two labels, each of which takes over the other then: a spanning forest."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    doc = np.repeat(np.arange(n), sizes)
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Units that many sets hold are counted by a matrix product (at most 8 cells a unit of input), others by postings.
    common_code = seen > max(n // 8, 8)
    dense_at = common_code[code]
    matrix = np.zeros((n, int(common_code.sum())), np.float32)
    matrix[doc[dense_at], (np.cumsum(common_code) - 1)[code[dense_at]]] = 1
    rare = ~dense_at & (seen[code] > 1)
    doc, code = doc[rare], code[rare]
    order = np.argsort(code, kind="stable")
    posting, first = doc[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(seen)))])
    at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    work = np.concatenate([[0], np.cumsum((first[code + 1] - first[code]))])[at] + np.arange(n + 1) * n
    _, labels = np.unique(labels, return_inverse=True)
    out, start = [], 0
    while start < n_rows:
        end = min(max(int(np.searchsorted(work, work[start] + TILE, "right")) - 1, start + 1), n_rows)
        left = start if inner else n_rows
        common = np.rint(matrix[start:end] @ matrix[left:].T).astype(np.int64)
        mine = code[at[start] : at[end]]
        many = first[mine + 1] - first[mine]
        other = posting[_spread(many, first[mine])] - left
        row = np.repeat(doc[at[start] : at[end]] - start, many)[other >= 0]
        common += np.bincount(row * (n - left) + other[other >= 0], minlength=common.size).reshape(common.shape)
        link = common >= threshold * (sizes[start:end, None] + sizes[None, left:] - common)
        x, y = np.nonzero(link & (labels[start:end, None] != labels[None, left:]))
        x, y = x + start, y + left
        while len(x):
            out.append((int(x[0]), int(y[0])))
            labels[labels == labels[y[0]]] = labels[x[0]]
            apart = labels[x] != labels[y]
            x, y = x[apart], y[apart]
        start = end
    return out


def _labelled(buckets: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Adds the components of id and head (mine, its); what is in no component is one of its own."""
    if parts is None:
        return buckets.withColumn("mine", F.col("id")).withColumn("its", F.col("head"))
    rows = small_join(buckets, parts.withColumnRenamed("label", "_mine"), "id", "left")
    rows = small_join(rows, parts.select(F.col("id").alias("head"), F.col("label").alias("_its")), "head", "left")
    return rows.withColumn("mine", F.coalesce("_mine", "id")).withColumn("its", F.coalesce("_its", "head"))


def _order_counts(sets: DataFrame) -> np.ndarray:
    """How often units fall on each of 2^ORDER_BITS places: 8 MB, whatever the number of sets."""

    def count(batches):
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            units = np.frombuffer(flat_bytes(batch.column(0))[0].tobytes(), np.uint64)
            total += np.bincount((units >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.record_batch([pa.array(at[k : k + (1 << 16)]), pa.array(total[at[k : k + (1 << 16)]])], ["place", "n"])

    counts = np.zeros(1 << ORDER_BITS, np.int64)
    summed = sets.select("units").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    for row in summed.toLocalIterator():
        counts[row["place"]] = row["n"]
    return counts


def contested(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ids of members (id, label; one row each) that may have a link to another label, by prefix filtering.

    Units stand in one order for all sets, rare ones first. A set x linked to one of at most its size, y, shares
    threshold * |x| units with it, and 2 * threshold / (1 + threshold) * |y|. So among the first |x| - threshold * |x| + 1
    units of x there is one of the first |y| - 2 * threshold / (1 + threshold) * |y| + 1 of y, its core. What a family of
    texts has in common is in no core as long as its members differ in more units than that. The order is by counts of
    hashed places; any order is exact.
    """
    counts = members.sparkSession.sparkContext.broadcast(_order_counts(sets))
    most = lambda share, n: n - math.ceil(share * n - 1e-9) + 1

    def prefixes(batches):
        for batch in batches:
            ids, labels, parts, cores = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [], []
            for i in range(batch.num_rows):
                units = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                order = np.lexsort((units, counts.value[(units >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]))
                parts.append(units[order[: most(threshold, len(units))]].view(np.int64))
                cores.append(np.arange(len(parts[-1])) < most(2 * threshold / (1 + threshold), len(units)))
            sizes = [len(x) for x in parts]
            flat, core = (np.concatenate(parts), np.concatenate(cores)) if parts else (np.zeros(0, np.int64), np.zeros(0, bool))
            ids, labels = np.repeat(ids, sizes), np.repeat(labels, sizes)
            for k in range(0, len(flat), 1 << 18):
                at = slice(k, k + (1 << 18))
                yield pa.record_batch([pa.array(ids[at]), pa.array(labels[at]), pa.array(flat[at]), pa.array(core[at])], ["id", "label", "unit", "core"])

    held = members.join(sets.hint("merge"), "id").select("id", "label", "units").mapInArrow(prefixes, "id long, label long, unit long, core boolean")
    held = stage(held, "unit_prefixes")
    core = F.when(F.col("core"), F.col("label"))
    shared = held.groupBy("unit").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(core).alias("core_low"), F.max(core).alias("core_high"))
    shared = stage(shared.filter("low <> high AND core_low IS NOT NULL").select("unit", "core_low", "core_high"), "contested_units")
    found = held.join(shared.hint("merge"), "unit").filter("core OR label <> core_low OR label <> core_high")
    return stage(found.select("id").distinct(), "contested")


def rest_links(buckets: DataFrame, parts: DataFrame | None, sets: DataFrame, threshold: float) -> DataFrame | None:
    """The links that join components inside the buckets (bucket, id, n, head); the head has met all members before."""
    members = _labelled(buckets.filter("n > 2"), parts).select("bucket", "id", F.col("mine").alias("label"), (F.col("mine") != F.col("its")).alias("rest"))
    members = stage(members.distinct(), "members")
    # A single member outside the head's component has met a head without others; otherwise there is something to compare.
    still = stage(members.groupBy("bucket").agg(F.count_if("rest").alias("n_rest"), F.count_if(~F.col("rest")).alias("n_main")).filter("n_rest > 1 OR n_rest = 1 AND n_main > 1"), "open_buckets")
    members = stage(members.join(still.hint("merge"), "bucket").select("bucket", "id", "label", "rest"), "open_members")
    if members.isEmpty():
        return None
    sets = wanted_sets(sets, members.select(F.col("id").alias("want")))

    def compare(group: pa.Table) -> pa.Table:
        ids, labels, first, inner = (group.column(c).to_numpy() for c in ("id", "label", "first", "inner"))
        _, once = np.unique(ids, return_index=True)
        order = once[np.lexsort((ids[once], ~first[once]))]
        units = group.column("units")
        found = joining_links([np.frombuffer(units[int(i)].as_buffer(), np.uint64) for i in order], labels[order], int(first[order].sum()), bool(inner[0]), threshold)
        ends = np.sort(ids[order][np.array(found, np.int64).reshape(-1, 2)], axis=1)
        return pa.table([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    # The rest is cut into q blocks, the head's component into p. Rest block i meets rest block j > i as (i, j), block m of
    # the head's component as (i, q + m), and itself within (i, q).
    weight = sets.select("id", (F.octet_length("units") / 8).alias("weight"))

    def cut(members: DataFrame) -> DataFrame:
        n_blocks = lambda side: F.greatest(F.lit(1), F.ceil(F.sum(F.when(side, F.col("weight"))) / BLOCK_UNITS))
        return stage(members.join(weight.hint("merge"), "id").groupBy("bucket").agg(n_blocks(F.col("rest")).alias("q"), n_blocks(~F.col("rest")).alias("p")), "bucket_blocks")

    blocks = cut(members)
    large = blocks.filter("q + p > 2").select("bucket")
    if not large.isEmpty():
        # Of large buckets only the members that may have a link to another component stay.
        suspects = members.join(large.hint("merge"), "bucket", "left_semi")
        kept = contested(suspects.select("id", "label").distinct(), sets, threshold)
        kept = small_join(suspects, kept, "id", "left_semi")
        members = stage(members.join(large.hint("merge"), "bucket", "left_anti").unionByName(kept), "open_members")
        blocks = cut(members)
    blocked = members.join(blocks.hint("merge"), "bucket").withColumn("k", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("q")).otherwise(F.col("p"))))
    meets = F.expr(
        """if(rest,
            concat(
                transform(filter(sequence(0L, q - 1), x -> x <> k), x -> struct(least(k, x) AS i, greatest(k, x) AS j, k < x AS first)),
                transform(sequence(q, q + p - 1), x -> struct(k AS i, x AS j, true AS first))),
            transform(sequence(0L, q - 1), x -> struct(x AS i, q + k AS j, false AS first)))"""
    )
    dealt = blocked.select("bucket", "id", "label", "q", F.explode(meets).alias("at")).select("bucket", "id", "label", "at.*", (F.col("at.j") == F.col("q")).alias("inner"))
    met = dealt.join(sets.hint("merge"), "id").select("bucket", "i", "j", "id", "label", "first", "inner", "units")
    return stage(met.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "rest_links")


def near_links(texts: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Verified links between different texts (id, text), and the components they make; both None without links."""
    banded = stage(band_hashes(texts, bands, rows), "bands")
    # Staged, so that the join's own exchange can be split where a bucket is hot.
    shared = stage(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("head")).filter("n > 1"), "shared_buckets")
    buckets = stage(banded.join(shared.hint("merge"), "bucket"), "buckets")
    unstage(banded)
    met = buckets.filter("id <> head")
    first = stage(met.groupBy(F.col("id").alias("b")).agg(F.min("head").alias("a")).select("a", "b"), "first_pairs")
    if first.isEmpty():
        return None, None
    # Units are hashed once for all texts that share a bucket.
    sets = shingle_sets(texts, buckets.select(F.col("id").alias("want")))
    links = verified(first, sets, threshold)
    parts = None if links.isEmpty() else connected_components(links)
    # The other heads of documents that are not in their component; each pair is met once, and no more pairs are left.
    apart = _labelled(met, parts).filter("mine <> its").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    apart = stage(apart.join(first.hint("merge"), ["a", "b"], "left_anti"), "other_pairs")
    if not apart.isEmpty():
        ends = apart.select(F.col("a").alias("want")).unionByName(apart.select(F.col("b").alias("want")))
        more = verified(apart, wanted_sets(sets, ends), threshold)
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = connected_components(links)
    more = rest_links(buckets, parts, sets, threshold)
    if more is not None and not more.isEmpty():
        links = links.unionByName(more)
        parts = connected_components(links)
    unstage(buckets, sets, shared)
    return (None, None) if parts is None else (links, parts)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 20, rows: int = 4) -> DataFrame:
    """One row per input row: id, class_id (smallest id of its group) and kept."""
    content = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    keyed = stage(content.select("id", F.unhex(F.sha2("text", 256)).alias("digest")), "near_digests")
    # Staged, so that the join's own exchange can be split where many texts are equal.
    firsts = stage(keyed.groupBy("digest").agg(F.min("id").alias("first")), "near_firsts")
    # Every document points to the first one of its text; only firsts are hashed and compared.
    copies = stage(keyed.join(firsts.hint("merge"), "digest").select("id", "first"), "near_copies")
    others = copies.filter("id <> first").select("id").distinct()
    single = small_join(content.filter("id IS NOT NULL"), stage(others, "near_others"), "id", "left_anti")
    _, parts = near_links(single, threshold, bands, rows)
    if parts is None:
        label = copies.withColumn("class_id", F.col("first"))
    else:
        label = small_join(copies, parts.withColumnRenamed("id", "first"), "first", "left").withColumn("class_id", F.coalesce("label", "first"))
    return label.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"), F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 20, rows: int = 4
) -> DataFrame:
    """One row of each group, with all its columns: one with the smallest id, null ids last.

    Texts are told apart by their digest and not by an id, so that repeated rows, repeated ids and null ids count too.
    """
    # The row travels as one value, so its columns may have any names.
    digests = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.sha2(text_or_empty(text_col), 256).alias("_digest"))
    per_id = digests.groupBy("_digest", "_id").agg(F.count("*").alias("_n"))
    best = per_id.groupBy("_digest").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_n")).alias("best"))
    firsts = best.select(F.col("_digest").alias("_kept_digest"), F.col("best._id").alias("_kept_id"), F.col("best._n").alias("_rows"))
    # Numbers of texts in the order of their ids.
    numbers = firsts.orderBy(F.col("_kept_id").asc_nulls_last(), "_kept_digest").withColumn("_number", F.monotonically_increasing_id())
    single = stage(one_row_each(digests, stage(numbers, "near_numbers"), "_id").select("_row", "_number"), "near_single")
    _, parts = near_links(single.select(F.col("_number").alias("id"), F.coalesce(F.col("_row").getField(text_col).cast("string"), F.lit("")).alias("text")), threshold, bands, rows)
    if parts is None:
        return single.select("_row.*")
    gone = stage(parts.filter("id <> label").select(F.col("id").alias("_number")), "near_gone")
    return small_join(single, gone, "_number", "left_anti").select("_row.*")
