"""Token counts with a digest cache.

The cache is a Parquet table (content_sha256, tokenizer_version, n_tokens). Documents are reduced to the digest of
their normalised content (null becomes empty; nothing that could change a count), joined to the cache by content and
tokenizer version, and only one document of each distinct digest that is missing is encoded and appended.

Defined results: null and empty texts have 0 bytes and 0 tokens (if the tokenizer gives none); repeated rows each get
their row; an empty table gives an empty result; a cache of another tokenizer or library version is ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stage, text_or_empty
from .tokenizing import sub_batches, tokenizer_version, worker_pieces

CACHE_SCHEMA = "content_sha256 binary, tokenizer_version string, n_tokens bigint"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is empty."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. Without cache_path the cache lives for this call."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache_path = cache_path or new_path(spark, "token_cache")
    content = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    digests = stage(content.select("_id", "_digest", F.octet_length("_text").cast("long").alias("_bytes")), "token_digests")

    stored = read_cache(spark, cache_path).filter(F.col("tokenizer_version") == version).select(F.col("content_sha256").alias("_digest"))
    missing = (
        digests.groupBy("_digest")
        .agg(F.min(F.struct(F.col("_id").isNull().alias("_void"), "_id")).alias("_first"))
        .join(stored.hint("merge"), "_digest", "left_anti")
        .select(F.col("_digest").alias("_want"), F.col("_first._id").alias("_first_id"))
    )
    # One document's text for each missing digest; rows that repeat an id and a text are reduced afterwards.
    texts = content.join(
        missing.hint("merge"), F.col("_id").eqNullSafe(F.col("_first_id")) & (F.col("_digest") == F.col("_want")), "left_semi"
    ).select("_digest", "_text")

    def encode(batches):
        pieces = worker_pieces(tokenizer_path)
        for batch in batches:
            text = batch.column(1)
            for at, n in sub_batches(text):
                found = pieces.counts(text.slice(at, n))
                yield pa.record_batch([batch.column(0).slice(at, n), pa.array(found, pa.int64())], ["_digest", "n_tokens"])

    encoded = texts.mapInArrow(encode, "_digest binary, n_tokens bigint")
    encoded.select(F.col("_digest").alias("content_sha256"), F.lit(version).alias("tokenizer_version"), "n_tokens").write.mode("append").parquet(cache_path)

    known = (
        read_cache(spark, cache_path)
        .filter(F.col("tokenizer_version") == version)
        .groupBy(F.col("content_sha256").alias("_digest"))
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    known = stage(known, "token_known")
    return digests.join(known.hint("merge"), "_digest").select(
        F.col("_id").alias(id_col),
        F.col("_bytes").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
