"""Exact dedup: tree-merge of sorted digest runs, DataFrame operations only.

Every document belongs to a run (its input partition, so neither ids nor texts can make one run large). Each run is reduced
to one row per digest. In binomial rounds, `fan_in` neighbouring runs exchange and merge their rows, keeping for each digest the
identifier that stays and the number of copies. A digest matches only if the SHA-256, the byte length and a second,
independent hash agree. The verdict then walks the same tree down, so a text that a third of all rows share never
meets in one task: a task sees at most `fan_in` rows of a digest per run.

Defined results: a null text counts as empty, all empty texts are equal; null ids lose against any other id and
stay only where no row of the group has an id; rows that repeat an id and a text all count and share their flags;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_row_each, shuffle_partitions, stage, text_or_empty

KEY = ["_digest", "_bytes", "_check"]


def lowered_text(text_col: str) -> Column:
    return F.translate(text_or_empty(text_col), string.ascii_uppercase, string.ascii_lowercase)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rounds, runs = 1, fan_in
    while runs < shuffle_partitions(spark):
        rounds, runs = rounds + 1, runs * fan_in
    best = F.max if keep == "largest" else F.min

    keyed = docs.select(F.col(id_col).alias("_id"), lowered_text(text_col).alias("_text")).select(
        "_id",
        F.unhex(F.sha2("_text", 256)).alias("_digest"),
        F.octet_length("_text").cast("long").alias("_bytes"),
        F.xxhash64("_text").alias("_check"),
        (F.spark_partition_id() % runs).alias("_run"),
    )
    keyed = stage(keyed.sortWithinPartitions(*KEY), "digest_runs")

    levels = [stage(keyed.groupBy(*KEY, "_run").agg(best("_id").alias("_keep"), F.count("*").alias("_size")), "level0")]
    for r in range(1, rounds + 1):
        merged = (
            levels[-1]
            .withColumn("_run", F.floor(F.col("_run") / fan_in))
            .groupBy(*KEY, "_run")
            .agg(best("_keep").alias("_keep"), F.sum("_size").alias("_size"))
        )
        levels.append(stage(merged, f"level{r}"))

    verdict = levels.pop()
    while levels:
        below = levels.pop().select(*KEY, "_run", F.floor(F.col("_run") / fan_in).alias("_up"))
        above = verdict.withColumnRenamed("_run", "_up")
        verdict = below.join(above.hint("merge"), [*KEY, "_up"]).select(*KEY, "_run", "_keep", "_size")
    return keyed.join(verdict.hint("merge"), [*KEY, "_run"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each text, with all its columns: that of the id that stays, null ids only where no row of the text has
    an id; of rows that repeat id and text one stays, which one is not defined."""
    kept = exact_groups(docs.select(id_col, text_col), id_col, text_col, **options).filter("kept")
    kept = kept.groupBy(F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_digest")).agg(F.count("*").alias("_rows"))
    # The row travels as one value, so its columns may have any names.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.sha2(lowered_text(text_col), 256).alias("_digest"))
    return one_row_each(rows, stage(kept, "kept_texts"), "_id").select("_row.*")
