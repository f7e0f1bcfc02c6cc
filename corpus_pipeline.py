"""The training-data pipeline: quality, exact dedup, near dedup, mixing, packing.

Each stage works on all that its predecessor kept and is written as Parquet and read again before the next one.

Defined results: stages judge rows, not ids, so rows with a null id take part in all of them. Null texts count as empty
everywhere. Repeated rows (and texts equal but for A-Z case) leave one row in exact dedup, that of the largest id, a null id
only where there is no other; near copies leave the one with the smallest id. A null source is a source of its own. The mix
writes a document as often as it takes it, the last time cut to the words that are left. An empty table gives an empty result.
Columns beside those of documents, whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kervan.llm.common import stage
from kervan.llm.exact_dedup import drop_copies
from kervan.llm.mixing import mixed_documents
from kervan.llm.near_dedup import drop_near_duplicates
from kervan.llm.packing import pack_documents
from kervan.llm.quality import fit, keep_good
from kervan.llm.queries import vocabulary
from kervan.session import ship_package, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return drop_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, to meet their source's target."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix in sequences of at most 4096 tokens."""
    ship_package(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier, the signatures and the tokenizer have no SQL form; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
