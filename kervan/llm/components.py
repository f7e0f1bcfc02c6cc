"""Connected components of a pair table."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_join, stage, unstage


def connected_components(pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, label) for every id in pairs (a, b); label is the smallest id of its component.

    Each round takes the smallest label among neighbours and then jumps to the label's own label, so the rounds grow
    with the logarithm of the longest chain. Each round is staged and the one before it deleted; nothing is collected but counts. A table of labels
    below the counted broadcast bound is broadcast, beyond it the joins shuffle both sides. The rounds end when no label
    changes; labels only fall, so they do end. With max_rounds, a table that needs more of them is an error.
    """
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = stage(both, "edges")
    labels = stage(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    for round_no in itertools.count(1):
        near = stage(small_join(both, labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("near")), "near")
        step = stage(small_join(labels.select("id", "label"), near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        heads = step.select(F.col("id").alias("label"), F.col("label").alias("head_label"))
        jumped = stage(small_join(step, heads, "label", "left").select("id", "old", F.least("label", "head_label").alias("label")), "labels")
        unstage(labels, near, step)
        labels = jumped
        if jumped.filter("label <> old").isEmpty():
            unstage(both)
            return jumped.select("id", "label")
        if round_no == max_rounds:
            raise RuntimeError(f"components are not complete after {max_rounds} rounds")
