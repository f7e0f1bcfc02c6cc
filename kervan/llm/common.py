"""Staging, prefix sums and Arrow helpers that several operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import remove_folder, shared_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/kervan/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, gives honest statistics."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that no result reads any more."""
    for table in tables:
        remove_folder(table.sparkSession, table.stage_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def with_run_start(df: DataFrame, run_col: str, order_cols: list[str], value_col: str, out_col: str) -> DataFrame:
    """Exclusive prefix sum of value_col over (run_col, order_cols), in two levels.

    run_col numbers the range partitions in order. Rows of one run meet in one task (a range partition of the
    input); across runs only one total per run is summed, so no task ever sees the whole table.
    """
    totals = df.groupBy(run_col).agg(F.sum(value_col).alias("_total"))
    before = Window.orderBy(run_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(run_col, F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias("_before"))
    inside = Window.partitionBy(run_col).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value_col).over(inside), F.lit(0)).cast("long"))
        .join(offsets.hint("merge"), run_col)
        .withColumn(out_col, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )


BROADCAST_ROWS = 100_000


def small_join(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Null-safe equi-join with a table of short rows, one per key. `few` is counted first: it is broadcast only up to
    BROADCAST_ROWS rows, beyond that both sides are shuffled and AQE splits the hot keys."""
    few = few.withColumnRenamed(key, "_few_key")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few.hint("merge")
    return rows.join(few, F.col(key).eqNullSafe(F.col("_few_key")), how).drop("_few_key")


def one_row_each(docs: DataFrame, kept: DataFrame, id_col: str) -> DataFrame:
    """One row of docs (with _digest) for each row of kept (_kept_id, _kept_digest, and _rows, the number of such rows in
    docs), with the columns of both. Which of the rows that repeat id and text stays is not defined."""
    same = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest"))
    once = docs.join(kept.filter("_rows = 1").hint("merge"), same)
    many = kept.filter("_rows > 1")
    n_many = many.count()
    if not n_many:
        return once
    # Rows that repeat are reduced in each task before they meet.
    many = docs.join(F.broadcast(many) if n_many <= BROADCAST_ROWS else many.hint("merge"), same)
    return once.unionByName(many.dropDuplicates(["_kept_id", "_kept_digest"]))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, end to end, and the n + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
