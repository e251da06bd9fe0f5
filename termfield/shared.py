"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset a local session gets one of its own, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='termfield-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: what follows does not compute it again, nor does a lost executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = (path, None)
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it is a written table, else :func:`written`."""
    return df if "_written" in df.__dict__ else written(df, name)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """A written table that joins on ``keys`` without a shuffle of its own."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    label = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", path).saveAsTable(label)
    out = spark.table(label)
    out.__dict__["_written"] = (path, label)
    return out


def spent(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more; others are left alone."""
    for t in tables:
        path, label = t.__dict__.pop("_written", (None, None)) if t is not None else (None, None)
        if path is None:
            continue
        spark = t.sparkSession
        if label is not None:
            spark.sql(f"DROP TABLE IF EXISTS {label}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
