"""Bounded labelled samples and their split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out(id_col: str, modulus: int, held: int) -> Column:
    """Whether the id is in the held-out fold; a null id is in none."""
    return F.coalesce(fold(id_col, modulus) == held, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held: int, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most `bound` labelled documents outside the held-out fold: the smallest hashes of the id.

    The sample's ids are bounded by `bound`, so they are broadcast and the texts are not shuffled. Null ids and
    labels other than 0 and 1 are left out; of an id with several labels the largest counts.
    """
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col, modulus) != held))
    chosen = chosen.groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("sample"), "_label_id"), "_label_id").limit(bound)
    texts = docs.select(F.col(id_col).alias("_doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("_doc_id") == F.col("_label_id")).select("text", "label", F.col("_label_id").cast("long").alias("id"))
