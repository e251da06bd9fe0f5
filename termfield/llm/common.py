"""Small helpers the operators share: shared-folder tables, folds, row identity."""

from __future__ import annotations

import sys
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.

    Where that is unset a local session (tests) gets a folder of its own; on a cluster it is an
    error, since other executors would miss what one writes to its own disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='termfield-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class _Places(threading.local):
    """Paths of the tables a thread has written, and names of those in the catalog: queries in other threads have their own."""

    def __init__(self) -> None:
        self.listed: list[tuple[str, str | None]] = []


_PLACES = _Places()


def place() -> int:
    """How many tables this thread has written; see :func:`discard`."""
    return len(_PLACES.listed)


def discard(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete the tables this thread has written since ``since``, but for the last ``keep``, which no longer need the others."""
    listed = _PLACES.listed
    spent = listed[since : len(listed) - keep]
    del listed[since : len(listed) - keep]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path, name in spent:
        if name is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


#: Bytes of an Arrow batch that goes to Python; buffers on both sides grow with it.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, batch_bytes: int = 4 << 20):
    """Python gets rows in batches of so many bytes for the jobs inside, since rows may hold large values."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(batch_bytes))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def written(df: DataFrame, tag: str, batch_bytes: int = 4 << 20, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back.

    A lost executor costs nothing that was written, and two readers of a table with
    generated keys see the same keys.  Python gets rows in batches of ``batch_bytes``, since
    rows may hold large values.  ``codec`` zstd halves digits and letters that are random.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with small_batches(spark, batch_bytes):
        df.write.option("compression", codec).parquet(path)
    _PLACES.listed.append((path, None))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """A written table that joins on ``key`` without a shuffle of its own."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    _PLACES.listed.append((path, name))
    return spark.table(name)


def fold(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remembered(name: str, key: tuple, make):
    """One object for all tasks of a worker process, such as an encoder with what it remembers."""
    kept = sys.__dict__.setdefault(f"_termfield_{name}", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def slices(batches, rows: int = 256):
    """Short slices of Arrow batches, so that a task holds few texts as Python objects at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
