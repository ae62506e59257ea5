"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether a query's shuffle files are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textmason")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a scratch folder of its own: on a
    cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="textmason-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Queries run inside delete their shuffle files when they end, not when the driver collects its memory."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """Store ``df`` as a table in the shared folder, in folders of the columns ``by``, and read it back.

    Rounds of an iterative job start from stored data, so a lost executor costs one
    round, and the sizes the optimizer sees are those of the real files. Nothing reads the
    shuffle files of the write again, so they are deleted with its end.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "cut")
    with passing_shuffles(spark):
        df.write.partitionBy(*by).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


#: Tasks a core for stored texts that are parsed.
TASKS_A_CORE = 4


@contextmanager
def fine_tasks(spark: SparkSession):
    """Jobs run inside read stored tables in several tasks a core.

    The engine packs files by their bytes to about a task a core, and one task more than cores takes
    twice the time, if parsing a few megabytes of texts takes minutes.
    """
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows of a stored table that may be sent whole to every task.
SENT_ROWS = 100_000


def dealt(stored: DataFrame) -> DataFrame:
    """A stored table for a join that deals it by key, if it has many rows.

    The engine judges it by its compressed files, which can be a small part of what its rows take
    in the driver's memory. The count reads footers only.
    """
    return stored.hint("merge") if stored.count() > SENT_ROWS else stored


def forget(*stored: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` stored and no later table reads."""
    for table in stored:
        delete_folder(table.sparkSession, table.stored_at)


def delete_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder of stored rows, on any file system Spark can write to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder_exists(spark: SparkSession, uri: str) -> bool:
    """Whether a folder of stored rows is there; of one written by partition, whether it has rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, plain path) of an address."""
    if "://" in uri and not uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), local_path(uri)


def local_path(uri: str) -> str:
    """Plain path for ``file:`` addresses; others are returned unchanged."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    return os.path.abspath(uri) if "://" not in uri else uri


#: Rows and bytes handed to a Python worker at once; texts may be long, and rows are many.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small, whatever it allowed before."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, str(most)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Ledger:
    """Stages of a run, stored below a folder under keys of their inputs and parameters.

    A stage that is whole is read instead of computed, so a run whose driver died goes on after
    its last whole stage. What a stage left half written is replaced.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def stage(self, name: str, key: str, build) -> DataFrame:
        path = f"{self.folder}/{name}-{key}"
        if not folder_exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        stored = self.spark.read.parquet(path)
        stored.stored_at = path
        return stored


def fingerprint(df: DataFrame, *parameters) -> str:
    """Key of a table's rows, in any order, and of parameters."""
    row = F.xxhash64(*(F.to_json(F.struct(c)) for c in df.columns))
    found = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    told = repr((df.schema.simpleString(), tuple(found), parameters))
    return hashlib.sha256(told.encode("utf-8")).hexdigest()[:24]
