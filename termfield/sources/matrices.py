"""Matrix files: word vectors as text, MatrixMarket, model directories, sparse and dense SVD text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import ModelError, TermModel, from_triplets, in_order, to_arrays, values
from ..operators.filters import numbered
from . import binary
from .triplets import read_info


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(line, text): lines with numbers from 0 in file order, files of a folder by name; the numbering counts lines of splits."""
    text = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("text string").csv(path) if encoding != "UTF-8" else spark.read.text(path).toDF("text")
    # A task may read several splits, in any order, but each of them in its own.
    at = text.select(F.struct("_metadata.file_path", "_metadata.file_block_start").alias("p"), F.monotonically_increasing_id().alias("i"), "text")
    low = at.groupBy("p").agg(F.min("i").alias("low"), F.count("*").alias("n"))
    # One row for each split of the file.
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = low.select("p", "low", before.alias("before"))
    return at.join(F.broadcast(low), "p").select((F.col("i") - F.col("low") + F.col("before")).alias("line"), "text")


def _split(c: Column | str = "text") -> Column:
    return F.split(F.trim(c), r"\s+")


def read_word_vectors(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(pos, term, vec) from a text file: sizes in the first line, then a label and its numbers.

    The sizes must be true.
    """
    lines = numbered_lines(spark, path, encoding)
    head = lines.where("line = 0").first()
    try:
        nr, nc = map(int, head["text"].split())
    except (AttributeError, TypeError, ValueError):
        raise ModelError("the first line must hold the numbers of rows and columns") from None
    parts = _split()
    rows = lines.where("line > 0 and text != ''").select("line", parts.alias("w"))
    rows = rows.select((F.col("line") - 1).alias("pos"), F.element_at("w", 1).alias("term"), F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x: x.cast("double")).alias("vec"))
    got = rows.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
    if got["n"] != nr or (nr and (got["lo"] != nc or got["hi"] != nc)):
        raise ModelError(f"expected {nr} x {nc} numbers, found {got['n']} rows of {got['lo']} to {got['hi']}")
    return rows


def word_vector_model(spark: SparkSession, path: str, encoding: str = "UTF-8") -> TermModel:
    vectors = read_word_vectors(spark, path, encoding)
    long = vectors.select("pos", F.col("term").alias("target"), F.posexplode("vec").alias("k", "score"))
    named = long.select("pos", "target", F.concat(F.lit("V"), (F.col("k") + 1).cast("string")).alias("feature"), "score", "k")
    out = from_triplets(named, score="score", raw=False, order="pos")
    cols = out.cols.withColumn("ord", F.substring("term", 2, 20).cast("long"))
    return out.replaced(cols=cols)


def shortest(x: Column) -> Column:
    """A number as text without a trailing .0."""
    plain = F.when((x == F.rint(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))
    return plain


def write_word_vectors(model: TermModel | DataFrame, path: str, digits: int | None = None, cols: DataFrame | None = None) -> None:
    """A folder of text files that follow one another: sizes, then a label and its numbers a line, in the order of the labels.

    Labels must be unique and hold no white space.  ``digits`` rounds.
    """
    if isinstance(model, TermModel):
        table, cols = to_arrays(model.primary, model.cols), model.cols
        order = "ord" if "ord" in model.rows.columns else "term"
        n = cols.count()
        zero = F.array_repeat(F.lit(0.0), n)
        table = model.rows.select("term", F.col(order).alias("pos")).join(table, "term", "left").withColumn("vec", F.coalesce("vec", zero))
    else:
        table = model.select("term", F.col("pos" if "pos" in model.columns else "term").alias("pos"), "vec")
        first = table.first()
        n = len(first["vec"]) if first else 0
    if table.where(F.col("term").rlike(r"\s") | (F.col("term") == "")).limit(1).count():
        raise ModelError("labels must not be empty or hold white space")
    if table.groupBy("term").count().where("count > 1").limit(1).count():
        raise ModelError("labels must be unique")
    value = lambda x: shortest(F.round(x, digits) if digits is not None else x)
    lines = table.select("pos", F.concat_ws(" ", "term", F.transform("vec", value)).alias("value"))
    head = table.agg(F.concat_ws(" ", F.count("*").cast("string"), F.lit(str(n))).alias("value")).select(F.lit(0).alias("part"), F.lit(None).cast(dict(lines.dtypes)["pos"]).alias("pos"), "value")
    every = head.union(lines.select(F.lit(1).alias("part"), "pos", "value"))
    # Ranges in order; names of the parts rise with them, so the parts one after another are the file.
    every.repartitionByRange("part", "pos").sortWithinPartitions("part", "pos").select("value").write.mode("overwrite").text(path)


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """((i, j, value), rows, columns) of a coordinate file; a symmetric one is filled up.

    Numbers count from 1; pattern files have the value 1.
    """
    lines = numbered_lines(spark, path)
    first = lines.where("line = 0").first()
    kind = first["text"].lower().split() if first else []
    if len(kind) < 5 or kind[:3] != ["%%matrixmarket", "matrix", "coordinate"] or kind[3] not in ("real", "integer", "pattern") or kind[4] not in ("general", "symmetric"):
        raise ModelError("only real, integer or pattern coordinate files, general or symmetric, can be read")
    body = lines.where(~F.col("text").startswith("%") & (F.trim("text") != ""))
    size = body.orderBy("line").first()
    nr, nc, nnz = map(int, size["text"].split())
    w = _split()
    cells = body.where(F.col("line") != size["line"]).select(w.alias("w"))
    value = F.lit(1.0) if kind[3] == "pattern" else F.element_at("w", 3).cast("double")
    cells = cells.select(F.element_at("w", 1).cast("long").alias("i"), F.element_at("w", 2).cast("long").alias("j"), value.alias("value"))
    if cells.count() != nnz:
        raise ModelError(f"the file does not hold the {nnz} cells it names")
    if kind[4] == "symmetric":
        cells = cells.union(cells.where("i != j").select("j", "i", "value"))
    return cells, nr, nc


def _exists(spark: SparkSession, path: str) -> str | None:
    """The file, or its compressed form; two forms at once are an error."""
    jvm = spark.sparkContext._jvm
    found = []
    for end in ("", ".gz", ".bz2"):
        p = jvm.org.apache.hadoop.fs.Path(path + end)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            found.append(path + end)
    if len(found) > 1:
        raise ModelError(f"there are several forms of {path}")
    return found[0] if found else None


def read_model_directory(spark: SparkSession, path: str) -> TermModel:
    """A directory with globals.tbl, rows.tbl, cols.tbl and the counts: M (dense text) or M.mtx (coordinates)."""
    path = path.rstrip("/")
    files = {}
    for name in ("globals.tbl", "rows.tbl", "cols.tbl"):
        files[name] = _exists(spark, f"{path}/{name}")
        if files[name] is None:
            raise ModelError(f"{path} has no {name}")
    facts = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(files["globals.tbl"]).limit(2).collect()
    if len(facts) != 1 or "N" not in facts[0]:
        raise ModelError("globals.tbl must be one row that holds N")
    known = {k: v for k, v in facts[0].asDict().items() if k != "N"}
    infos = []
    for name in ("rows.tbl", "cols.tbl"):
        lines = numbered_lines(spark, files[name])
        order = read_info(spark, files[name])
        at = lines.where("line > 0").select(F.split("text", "\t").alias("w"), "line")
        names = lines.where("line = 0").first()["text"].split("\t")
        place = at.select(F.element_at("w", names.index("term") + 1).alias("term"), F.col("line").alias("ord"))
        infos.append(order.join(place, "term"))
    rows, cols = infos
    dense, sparse = _exists(spark, f"{path}/M"), _exists(spark, f"{path}/M.mtx")
    if (dense is None) == (sparse is None):
        raise ModelError("the directory must hold either M or M.mtx")
    if sparse:
        cells, nr, nc = read_matrix_market(spark, sparse)
    else:
        nr, nc = rows.count(), cols.count()
        rank = numbered_lines(spark, dense).where(F.trim("text") != "").select("line", _split().alias("w"))
        if rank.where(F.size("w") != nc).limit(1).count() or rank.count() != nr:
            raise ModelError(f"M does not hold {nr} x {nc} numbers")
        cells = rank.select((F.col("line") + 1).alias("i"), F.posexplode("w").alias("j", "x")).select("i", (F.col("j") + 1).cast("long").alias("j"), F.col("x").cast("double").alias("value")).where("value != 0")
    if (nr, nc) != (rows.count(), cols.count()):
        raise ModelError("the sizes of the matrix and of its info tables differ")
    labelled = cells.join(rows.select(F.col("ord").alias("i"), F.col("term").alias("target")), "i").join(cols.select(F.col("ord").alias("j"), F.col("term").alias("feature")), "j")
    counts = labelled.select("target", "feature", F.col("value").alias("f"))
    out = from_triplets(counts, rowinfo=None, colinfo=None, N=float(facts[0]["N"]), globals=known)
    # Labels without a cell stay.
    fill = lambda info, computed: info.join(computed.select("term", "nnzero"), "term", "left").withColumn("nnzero", F.coalesce("nnzero", F.lit(0).cast("long")))
    return out.replaced(rows=fill(rows.drop("nnzero"), out.rows), cols=fill(cols.drop("nnzero"), out.cols))


def write_model_directory(model: TermModel, path: str) -> None:
    """The counts of a model as a directory of tables that :func:`read_model_directory` reads part by part."""
    spark, path = model.spark, path.rstrip("/")
    spark.createDataFrame([(float(model.N),)], "N double").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/globals.tbl")
    for side in ("rows", "cols"):
        in_order(getattr(model, side)).drop("ord").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/{side}.tbl")
    values(model.cells).write.mode("overwrite").parquet(f"{path}/cells.parquet")


def read_svd_text(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, int, int]:
    """((i, j, value) counted from 0, rows, columns) of a sparse or dense text matrix for SVD tools.

    dense: sizes, then all numbers row by row.  sparse: sizes and the number of cells, then for
    each column how many cells it has and a line of row and value for each.
    """
    lines = numbered_lines(spark, path).where(F.trim("text") != "")
    head = lines.where("line = 0").first()["text"].split()
    if kind == "dense":
        nr, nc = map(int, head[:2])
        rows = lines.where("line > 0").select((F.col("line") - 1).alias("i"), _split().alias("w"))
        if rows.where(F.size("w") != nc).limit(1).count():
            raise ModelError("a dense matrix must have one row a line")
        cells = rows.select("i", F.posexplode("w").alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("value"))
        return cells.where("value != 0"), nr, nc
    if kind != "sparse":
        raise ValueError("kind must be sparse or dense")
    nr, nc, nnz = map(int, head[:3])
    words = lines.where("line > 0").select("line", _split().alias("w"))
    starts = words.where(F.size("w") == 1)
    # One head a column, numbered in order of their lines.
    column = numbered(starts, "line").select("line", (F.col("k") - 1).cast("long").alias("j"), F.element_at("w", 1).cast("long").alias("n"))
    cell = words.where(F.size("w") == 2)
    span = column.select("j", F.explode(F.when(F.col("n") > 0, F.sequence(F.col("line") + 1, F.col("line") + F.col("n"))).otherwise(F.array().cast("array<bigint>"))).alias("line"))
    cells = cell.join(span, "line").select(F.element_at("w", 1).cast("long").alias("i"), "j", F.element_at("w", 2).cast("double").alias("value"))
    if cells.count() != nnz:
        raise ModelError(f"the file does not hold the {nnz} cells it names")
    return cells, nr, nc


def read_svd_binary(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, int, int]:
    """The same from a binary file of big-endian 32-bit numbers (sizes, counts, rows, float values).

    Files that all machines mount are read in ranges by the data source svd_binary (:mod:`.binary`); through
    other file systems, which offer no places to split at, a file is one task's work.
    """
    if kind not in ("sparse", "dense"):
        raise ValueError("kind must be sparse or dense")
    # A path without a scheme is one of the default file system.
    local = path.startswith("file:") or (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:")
    if local and (plain := binary.mounted(path)) is not None:
        spark.dataSource.register(binary.SvdBinary)
        sizes = binary.header(plain, kind)
        return spark.read.format("svd_binary").option("kind", kind).load(plain), sizes[0], sizes[1]
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for data in b.column(0):
                raw = data.as_buffer()
                if kind == "dense":
                    nr, nc = np.frombuffer(raw, ">i4", 2)
                    x = np.frombuffer(raw, ">f4", int(nr) * int(nc), 8).astype(float)
                    at = np.flatnonzero(x)
                    i, j, v = at // nc, at % nc, x[at]
                else:
                    nr, nc, nnz = np.frombuffer(raw, ">i4", 3)
                    place, i, j, v = 12, np.zeros(nnz, np.int64), np.zeros(nnz, np.int64), np.zeros(nnz)
                    done = 0
                    for c in range(nc):
                        n = int(np.frombuffer(raw, ">i4", 1, place)[0])
                        pair = np.frombuffer(raw, ">i4", 2 * n, place + 4).reshape(n, 2)
                        i[done : done + n], j[done : done + n] = pair[:, 0], c
                        v[done : done + n] = np.ascontiguousarray(pair[:, 1]).view(">f4")
                        done, place = done + n, place + 4 + 8 * n
                cols = [pa.array(np.r_[-1, i], pa.int64()), pa.array(np.r_[-1, j], pa.int64()), pa.array(np.r_[float(nr), v])]
                yield pa.RecordBatch.from_arrays(cols, names=["i", "j", "value"])
                yield pa.RecordBatch.from_arrays([pa.array([-2], pa.int64()), pa.array([-2], pa.int64()), pa.array([float(nc)])], names=["i", "j", "value"])

    got = files.mapInArrow(run, "i long, j long, value double")
    sizes = {r["i"]: int(r["value"]) for r in got.where("i < 0").collect()}
    return got.where("i >= 0"), sizes[-1], sizes[-2]
