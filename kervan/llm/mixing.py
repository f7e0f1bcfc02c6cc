"""Mixing sources to target weights: capped water-filling and seeded repetition.

Targets: a total budget is shared over the sources by weight; a source whose share is above `max_epochs` times its
size is clamped there and the excess goes to the others by weight, until no share is above its cap. The state of the
fill is one number, the level `budget / weight`, so each round is one aggregate over the table of sources.

Plan: one row per source, joined to the documents by source (broadcast up to a counted bound), so the mix itself moves
no text. Rows: a source's target is met by whole repetitions of every document and one more repetition of a seeded selection:
documents below a hash threshold are repeated whole, the document at the threshold in part. The threshold is found by
refining histograms of the hash per source, so no task gathers the documents of a source.

Defined results: null text has size 0; rows without an id share one hash; repeated ids are planned row by row; null source is a source of its own, ranked last; sources without words get
target 0; rows with equal hash (repeated rows) share the part that is left over in proportion; an empty table gives an
empty result; a source's taken words differ from its target by less than one word per row at its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_join, stage

WORDS = r"[^\x20\x09-\x0D]+"


def ranked(sources: DataFrame, col: str, out: str) -> DataFrame:
    """0-based rank of distinct values by code point, null last: sorted runs, then one offset per run."""
    runs = stage(
        sources.repartitionByRange(F.col(col).asc_nulls_last())
        .sortWithinPartitions(F.col(col).asc_nulls_last())
        .withColumn("_run", F.spark_partition_id()),
        "source_runs",
    )
    counts = runs.groupBy("_run").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_run").orderBy(F.col(col).asc_nulls_last())
    return (
        runs.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets.hint("merge"), "_run")
        .withColumn(out, (F.col("_before") + F.col("_at")).cast("long"))
        .drop("_run", "_at", "_before")
    )


def water_fill(sources: DataFrame, size_col: str, weight_col: str, total_ratio: float, max_epochs: float) -> DataFrame:
    """Adds `target` to a table of sources; collects three sums a round and nothing else."""
    sources = stage(sources, "mix_sources")
    cap, weight = F.col(size_col) * F.lit(float(max_epochs)), F.col(weight_col).cast("double")
    level = -1.0
    while True:
        clamped = cap <= weight * F.lit(level)
        row = sources.agg(
            F.sum(F.col(size_col)).alias("size"),
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~clamped, weight)), F.lit(0.0)).alias("weight"),
        ).first()
        if not row["size"] or row["weight"] <= 0:
            level = float("inf") if row["size"] else 0.0
            break
        found = (total_ratio * row["size"] - row["used"]) / row["weight"]
        if found <= level:
            break
        level = found
    share = F.least(cap, weight * F.lit(level)) if level != float("inf") else cap
    return sources.withColumn("target", share.cast("double"))


def _extra(rows: DataFrame, wanted: DataFrame, bits: int = 12, rounds: int = 5) -> DataFrame:
    """Per source: the hash `_edge` below which rows are taken, and the fraction of each row at the edge.

    wanted: _source_rank, _need (words). Each round fixes `bits` more bits of the 60-bit hash.
    """
    state = wanted.select("_source_rank", F.col("_need").cast("double").alias("_need"), F.lit(0).cast("long").alias("_prefix"))
    state = stage(state, "edge0")
    for k in range(rounds):
        shift = 60 - bits * (k + 1)
        prefix_here = F.shiftright("_hash", shift + bits)
        histogram = (
            small_join(rows, state, "_source_rank")
            .filter(prefix_here == F.col("_prefix"))
            .groupBy("_source_rank", F.shiftright("_hash", shift).alias("_bin"))
            .agg(F.sum("size").alias("_words"), F.first("_need").alias("_need"))
        )
        upto = Window.partitionBy("_source_rank").orderBy("_bin")
        total = F.sum("_words").over(upto)
        # The first bin whose running total reaches the need holds the edge.
        state = stage(
            histogram.withColumn("_upto", total)
            .filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_words") < F.col("_need")))
            .groupBy("_source_rank")
            .agg(F.min(F.struct("_bin", "_upto", "_words", "_need")).alias("_b"))
            .select(
                "_source_rank",
                (F.col("_b._need") - (F.col("_b._upto") - F.col("_b._words"))).alias("_need"),
                F.col("_b._bin").alias("_prefix"),
                F.col("_b._words").alias("_at_edge"),
            ),
            f"edge{k + 1}",
        )
    return state.select("_source_rank", F.col("_prefix").alias("_edge"), (F.col("_need") / F.col("_at_edge")).alias("_part"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    """id, source, size and hash of each row, and further columns. The hash has 60 bits of md5, on which SQL engines agree."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 15), 16, 10).cast("long")
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), size.alias("size"), hashed.alias("_hash"), *more)


def source_plan(rows: DataFrame, weights: tuple[int, ...], total_ratio: float, max_epochs: float) -> DataFrame:
    """One staged row per source of the measured rows: source_size, target, whole repetitions and the edge of one more."""
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sizes, "_source", "_source_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_source_rank") % len(weights) + 1).cast("int"))
    sources = stage(water_fill(sources.withColumn("_weight", weight), "source_size", "_weight", total_ratio, max_epochs), "mix_targets")

    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(max_epochs)))).otherwise(0)
    plan = sources.withColumn("_whole", epochs.cast("long"))
    plan = plan.withColumn("_need", F.round(F.col("target") - F.col("_whole") * F.col("source_size")))
    numbered = small_join(rows.select("_source", "_hash", "size"), plan.select("_source", "_source_rank"), "_source").drop("_source")
    edges = _extra(stage(numbered, "mix_rows"), plan.filter("_need > 0"))
    known = plan.select("_source", "_source_rank", F.col("source_size").cast("long").alias("source_size"), "target", "_whole")
    return stage(small_join(known, edges, "_source_rank", "left"), "mix_plan")


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to measured rows their source's plan and _fraction and _more, the part of one more repetition."""
    part = F.when(F.col("_edge").isNull(), 0.0).when(F.col("_hash") < F.col("_edge"), 1.0).when(F.col("_hash") == F.col("_edge"), F.col("_part")).otherwise(0.0)
    extra = F.when(F.col("_fraction") >= 1.0, F.col("size")).otherwise(F.round(F.col("_fraction") * F.col("size")).cast("long"))
    return small_join(rows, plan, "_source").withColumn("_fraction", part).withColumn("_more", extra)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    total_ratio: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, whole (full copies) and partial (words of one more)."""
    rows = stage(_measured(docs, id_col, text_col, source_col, seed), "mix_sizes")
    out = _planned(rows, source_plan(rows, weights, total_ratio, max_epochs))
    return out.select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("_whole") * F.col("size") + F.col("_more")).cast("long").alias("taken"),
        (F.col("_whole") + F.when((F.col("_more") == F.col("size")) & (F.col("_fraction") > 0), 1).otherwise(0)).cast("long").alias("whole"),
        F.when((F.col("_more") < F.col("size")), F.col("_more")).otherwise(0).cast("long").alias("partial"),
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    total_ratio: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: each row of docs once for every whole repetition, and cut after its last words for the rest.

    Each row is planned by itself, whatever other rows share its id; the row travels as one value, so its columns may
    have any names.
    """
    rows = stage(_measured(docs, id_col, text_col, source_col, seed), "mix_sizes")
    plan = source_plan(rows, weights, total_ratio, max_epochs)
    carried = _measured(docs, id_col, text_col, source_col, seed, F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    planned = _planned(carried, plan)
    whole = F.col("_whole") + F.when((F.col("_more") == F.col("size")) & (F.col("_fraction") > 0), 1).otherwise(0)
    cut = F.when(F.col("_more") < F.col("size"), F.col("_more")).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<bigint>")))
    spread = planned.select("_row", F.explode(copies).alias("_words"))
    own = F.col("_row").getField(text_col)
    text = F.when(F.col("_words") < 0, own).otherwise(_first_words(own, F.col("_words")))
    return spread.select(*[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def _first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its n-th word."""
    kept = F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int"))
    return F.array_join(kept, "")
