"""Incremental mode: new page files flow through the column jobs into an upsert, batch by batch.

The table is kept as versions: a base with all rows, and after it versions that hold only the rows of their batch's keys. A
reader takes the newest row of each key. Every `rebase` batches a version is written as the next base. A version counts
once its marker is written; the newest marker says where its base is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.upsert import KEY, upsert
from ..session import broadcast_small

MARKER = "version long, base long"
REBASE = 20


def _markers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MARKER).parquet(f"{root}/complete")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MARKER)


def newest_version(spark: SparkSession, root: str, below: int | None = None) -> tuple[int, int] | None:
    """(version, base) of the newest complete version, of those below a number if one is given."""
    markers = _markers(spark, root) if below is None else _markers(spark, root).filter(F.col("version") < below)
    row = markers.agg(F.max(F.struct("version", "base")).alias("m")).first()["m"]
    return (row["version"], row["base"]) if row else None


def _versions(spark: SparkSession, root: str, empty: DataFrame, below: int | None) -> DataFrame | None:
    """Rows of the newest base and of the complete versions after it, with their version."""
    newest = newest_version(spark, root, below)
    if newest is None:
        return None
    version, base = newest
    schema = StructType([*empty.schema.fields, StructField("version", LongType())])
    rows = spark.read.schema(schema).parquet(f"{root}/rows")
    rows = rows.filter(F.col("version").between(base, version))
    # What a failed attempt left has no marker.
    return rows.join(broadcast_small(_markers(spark, root).select("version").distinct()), "version", "left_semi")


def _newest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    latest = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n", "version")


def current_version(spark: SparkSession, root: str, empty: DataFrame, keys: list[str] | None = None, below: int | None = None) -> DataFrame:
    """The table as of the newest complete version, of those below a number if one is given."""
    rows = _versions(spark, root, empty, below)
    return empty if rows is None else _newest_rows(rows, keys or KEY).select(empty.columns)


def _rows(root: str, version: int) -> str:
    return f"{root}/rows/version={version:012d}"


def merge_batch(
    batch: DataFrame, batch_id: int, root: str, to_batch: Callable[[DataFrame], DataFrame], empty: DataFrame, keys: list[str], rebase: int = REBASE
) -> None:
    """Merges a batch into a new version, which holds the batch's keys alone unless it is a base. A batch that is retried
    starts from the version before its own again: what a failed attempt left is replaced, and a complete version stays as
    it is."""
    spark = batch.sparkSession
    if not _markers(spark, root).filter(F.col("version") == batch_id).isEmpty():
        return
    new, newest = to_batch(batch), newest_version(spark, root, below=batch_id)
    stored, base = empty, batch_id
    if newest is not None:
        rows = _versions(spark, root, empty, below=batch_id)
        if batch_id - newest[1] < rebase:
            base = newest[1]
            rows = rows.join(new.select(*keys).distinct(), keys, "left_semi")
        stored = _newest_rows(rows, keys).select(empty.columns)
    merged = upsert(stored, new, F.current_timestamp(), keys)
    merged.select(empty.columns).write.mode("overwrite").parquet(_rows(root, batch_id))
    spark.createDataFrame([(batch_id, base)], MARKER).coalesce(1).write.mode("append").parquet(f"{root}/complete")


def run_incremental(pages: DataFrame, root: str, checkpoint: str, to_batch: Callable[[DataFrame], DataFrame], empty: DataFrame, keys: list[str]):
    """pages: a streaming DataFrame. Each micro-batch is turned into upsert rows (with seq) by `to_batch` and merged into
    a new version of the table, exactly once."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, root, to_batch, empty, keys)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
