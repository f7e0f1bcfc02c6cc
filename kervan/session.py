"""Session helpers shared by every job."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app_name: str = "kervan", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs expect: UTC, AQE, Arrow."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's modules, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="kervan-"), "kervan_modules.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # The setting cannot be changed in a running session, so the folder is kept here.
        application = spark.sparkContext.applicationId
        if application not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="kervan-shared-")
        base = _LOCAL_FOLDERS[application]
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, for results of Python that a job reads more than once."""
    path = f"{shared_folder(df.sparkSession)}/kervan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, uri: str) -> None:
    """Deletes a folder; the URI's scheme names the file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


BROADCAST_ROWS = 100_000


def broadcast_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of short rows, counted: to be broadcast up to `most` rows, to be merge-joined beyond."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


PAGES_PER_TASK = 4_000


def spread(df: DataFrame, key: str, rows: int = PAGES_PER_TASK) -> DataFrame:
    """Short rows dealt by key over tasks of about `rows` rows. For work that costs far more than the table's bytes tell, as
    pages rendered from keys do: a million keys are a few MB, which Spark reads in one task or two."""
    tasks = max(-(-df.count() // rows), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, key)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
