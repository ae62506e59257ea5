"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmason.session import BATCH_BYTES, BATCH_ROWS, bound_batches

#: Size up to which a table may be sent to every executor.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: bool = False
) -> DataFrame:
    """(doc_id, text) of a table, whatever else it has; a null text is empty.

    With ``carry`` also ``rest``, the whole row as a struct.
    """
    bound_batches(docs.sparkSession)
    columns = [
        docs[id_column].cast("bigint").alias("doc_id"),
        F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"),
    ]
    if carry:
        columns.append(F.struct(*(docs[name].alias(name) for name in docs.columns)).alias("rest"))
    return docs.select(*columns)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    """How many partitions the session sizes its shuffles for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of a string column as UTF-8 bytes; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def small_bytes(spark: SparkSession, path: str):
    """The file at ``path`` for every executor; refused beyond ``BROADCAST_BYTES``.

    Vocabulary files have a fixed size that doesn't grow with the corpus.
    """
    with open(path, "rb") as stream:
        data = stream.read(BROADCAST_BYTES + 1)
    if len(data) > BROADCAST_BYTES:
        raise ValueError(f"{path} is larger than {BROADCAST_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def join_salted(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 32):
    """Left join with a table that has one row for each of some ``keys``.

    Rows with equal keys are dealt to ``salts`` parts by ``spread``, and ``small`` is repeated
    for each, so that no task gets all rows of a hot key.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(each, [*keys, "_salt"], "left").drop("_salt")


def join_dealt(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 1024):
    """The same join for keys most of which are rare.

    A row of ``small`` is repeated for those parts only that rows of its key are in, so it is
    repeated at most as often as its key occurs. ``rows`` is computed twice.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    each = dealt.select(*keys, "_salt").distinct().join(small, keys)
    return dealt.join(each, [*keys, "_salt"], "left").drop("_salt")


def return_memory() -> None:
    """Give memory that a worker has freed back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not this C library
        pass


def tidy(function):
    """The same function over batches; the worker's freed memory is returned at its end."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            return_memory()

    return run


def tidy_group(function):
    """The same function over a group, likewise."""

    def run(key, *tables):
        result = function(key, *tables)
        return_memory()
        return result

    # cogrouped functions are told apart by how many tables they take
    return (lambda key, a: run(key, a)) if function.__code__.co_argcount == 2 else (
        lambda key, a, b: run(key, a, b)
    )


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nobody holds any more.

    It does so when the driver's memory is collected, which a driver with free memory puts
    off; a job of several large steps would keep the files of all of them on the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mix64(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    out = values.astype(np.uint64, copy=True)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[0] ... starts[0] + lengths[0] - 1, starts[1] ...`` in one array."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def add_arrays(partials: DataFrame, kind: str, size: int) -> np.ndarray:
    """Element-wise sum of ``data`` (arrays of ``kind`` as bytes) over rows of (data, part).

    Parts are first added in groups of about the square root of their number, so that neither a
    task nor the driver gets all of them; the result has ``size`` entries, whatever the input.
    """

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, kind)
        for chunk in table.column("data").iterchunks():
            for value in chunk:
                total += np.frombuffer(value.as_buffer(), kind)
        return pa.table({"data": pa.array([total.tobytes()], pa.binary())})

    def added(rows: DataFrame, key) -> DataFrame:
        keyed = rows.select("data", key.alias("part"))
        return keyed.groupBy("part").applyInArrow(lambda table: add(table), "data BINARY")

    groups = int(partitions(partials.sparkSession) ** 0.5)
    if groups > 8:
        partials = added(partials, F.pmod("part", F.lit(groups)))
    rows = added(partials, F.lit(0)).collect()
    return np.frombuffer(rows[0].data, kind) if rows else np.zeros(size, kind)
