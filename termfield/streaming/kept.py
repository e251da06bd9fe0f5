"""Models kept from streams: cells, marginals and N side by side, with expiry and compaction.

One streaming aggregation counts every row four times: for its cell, its target, its feature and
the whole.  All four lie in one state store and come out of the same batch, so a reader never sees
cells that marginals or N don't fit.  Rows are summed in the JVM before they are shuffled, so a hot
target, or N, moves as one row a task.  Counts go by slots of event time.  State holds slots that
late rows may still change, the table holds slots until they expire, and compaction replaces what
batches piled up by the newest count of each cell and slot.

Rows whose target, feature or time is null are left out; so are rows of slots that the watermark
has passed.  Repeated rows all count.  An empty table is a model without cells, N being 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from ..model import TermModel, with_nonzero

SCHEMA = "kind string, target string, feature string, slot long, f double, batch long"


def kept_counts(stream: DataFrame, target: str, feature: str, time: str, slot: str = "1 day", late: str = "1 day", count: str | None = None) -> DataFrame:
    """(kind, target, feature, slot, f): counts of each slot for every kind: cell, row (no feature), col (no target) and all (neither).

    ``slot`` is the length of a slot, and slots are numbered from 1970 on; rows that are ``late``
    behind the newest time seen can be left out once their slot has ended by then.
    """
    f = F.lit(1.0) if count is None else F.col(count).cast("double")
    at = F.col(time)
    if stream.schema[time].dataType == TimestampNTZType():
        # What the clock shows, taken as UTC; watermarks need the plain type.
        at = F.from_utc_timestamp(at.cast("timestamp"), F.current_timezone())
    rows = stream.select(at.alias("time"), F.col(target).cast("string").alias("t"), F.col(feature).cast("string").alias("c"), f.alias("f")).withWatermark("time", late)
    key = lambda kind, t, c: F.struct(F.lit(kind).alias("kind"), t.cast("string").alias("target"), c.cast("string").alias("feature"))
    t, c, none = F.col("t"), F.col("c"), F.lit(None)
    keys = F.array(key("cell", t, c), key("row", t, none), key("col", none, c), key("all", none, none))
    each = rows.where("time is not null and t is not null and c is not null").select("time", "f", F.explode(keys).alias("k"))
    got = each.groupBy(F.window("time", slot).alias("w"), "k.kind", "k.target", "k.feature").agg(F.sum("f").alias("f"))
    number = F.expr("unix_micros(w.start) div (unix_micros(w.end) - unix_micros(w.start))")
    return got.select("kind", "target", "feature", number.alias("slot"), "f")


def keep_model(counts: DataFrame, path: str, checkpoint: str, keep: int | None = None, every: int = 16, **trigger) -> StreamingQuery:
    """Write what each batch of :func:`kept_counts` changes below ``path``; :func:`kept_model` reads it.

    ``keep``: slots that stay, counted back from the newest (None: all).  Each ``every`` batches the
    table is compacted.  A batch that runs again after a failure writes its own folder again; one
    that a compacted table already holds only renews its state.  Both folders must be shared by all machines.
    ``trigger``: as of ``DataStreamWriter.trigger``; all that is there now, if none is given.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= _folders(spark, path)[0]:
            # The table holds it, but its state is still to be written.
            batch.write.format("noop").mode("overwrite").save()
            return
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")
        if (number + 1) % every == 0:
            compact(spark, path, keep)

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _finished(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the folders that were written to their end, ascending: of compacted tables (base) and of batches."""
    fs, folder = _files(spark, path)
    out: dict[str, list[int]] = {"base": [], "batch": []}
    for s in fs.listStatus(folder) if fs.exists(folder) else []:
        kind, _, number = s.getPath().getName().partition("=")
        if kind in out and fs.exists(_files(spark, f"{s.getPath()}/_SUCCESS")[1]):
            out[kind].append(int(number))
    return {k: sorted(v) for k, v in out.items()}


def _folders(spark: SparkSession, path: str) -> tuple[int, list[str], int]:
    """(newest compacted batch or -1, folders that make up the table, newest batch or -1)."""
    found = _finished(spark, path)
    base = found["base"][-1] if found["base"] else -1
    later = [b for b in found["batch"] if b > base]
    folders = [f"{path}/base={base:012d}"] * (base >= 0) + [f"{path}/batch={b:012d}" for b in later]
    return base, folders, later[-1] if later else base


def kept_rows(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    """(kind, target, feature, slot, f, batch): the newest count of each cell, marginal and N in each slot that has not expired."""
    folders = _folders(spark, path)[1]
    rows = spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)
    if keep is not None and folders:
        newest = rows.where("kind = 'all'").agg(F.max("slot")).first()[0]
        if newest is not None:
            rows = rows.where(F.col("slot") > newest - keep)
    newest = rows.groupBy("kind", "target", "feature", "slot").agg(F.max_by("f", "batch").alias("f"), F.max("batch").alias("batch"))
    return newest


def compact(spark: SparkSession, path: str, keep: int | None = None) -> None:
    """Replace batches by one table without expired slots.

    What the compaction before this one replaced is deleted now and not then, so who was
    reading it had the batches in between to end.
    """
    before, _, last = _folders(spark, path)
    if last > before:
        kept_rows(spark, path, keep).write.mode("overwrite").parquet(f"{path}/base={last:012d}")
    for kind, numbers in _finished(spark, path).items():
        for n in numbers:
            if n < before or (kind == "batch" and n == before):
                fs, folder = _files(spark, f"{path}/{kind}={n:012d}")
                fs.delete(folder, True)


def kept_model(spark: SparkSession, path: str, keep: int | None = None) -> TermModel:
    """The model of the newest ``keep`` slots (None: all), whose marginals and N are the kept ones."""
    rows = kept_rows(spark, path, keep)
    total = lambda kind, *by: rows.where(F.col("kind") == kind).groupBy(*by).agg(F.sum("f").alias("f"))
    cells = total("cell", "target", "feature").where("f != 0")
    sides = [with_nonzero(total(kind, F.col(by).alias("term")), cells, by) for kind, by in (("row", "target"), ("col", "feature"))]
    return TermModel(*sides, cells, None, {"N": float(total("all").first()[0] or 0), "locked": False})
