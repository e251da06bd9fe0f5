"""Triplet files: lines of target, feature and count, or of pairs of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ModelError, TermModel, from_triplets


#: Encodings the reader knows; other ones of one byte a character are recoded after reading.
READABLE = {"UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "US-ASCII", "ISO-8859-1"}


def recoded(df: DataFrame, encoding: str) -> DataFrame:
    """Text columns that were read byte by byte, in the encoding they are in."""
    high = range(128, 256)
    have, want = "".join(map(chr, high)), "".join(bytes([b]).decode(encoding, "replace")[:1] for b in high)
    return df.withColumns({c: F.translate(F.col(f"`{c}`"), have, want) for c, t in df.dtypes if t == "string"})


def read_columns(spark: SparkSession, path: str, schema: str | None, header: bool = False, sep: str = "\t", quote: str = "", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text; without a schema types are inferred and whole numbers become doubles.

    Files ending in .gz and .bz2 are unpacked by the reader.  Text in other encodings than
    UTF-8 whose line ends are not single bytes (UTF-16) is read as whole files.
    """
    own = encoding.upper() not in READABLE
    reader = spark.read.option("sep", sep).option("quote", quote).option("escape", "").option("header", header).option("encoding", "ISO-8859-1" if own else encoding)
    if encoding.upper().replace("-", "").startswith(("UTF16", "UTF32")):
        reader = reader.option("multiLine", True)
    if schema is not None:
        df = reader.option("mode", "FAILFAST").schema(schema).csv(path)
        return recoded(df, encoding) if own else df
    df = reader.option("inferSchema", True).csv(path)
    if any(t in ("date", "timestamp", "timestamp_ntz") for _, t in df.dtypes):
        # Labels such as 1995-01 are no times.
        df = reader.schema(", ".join(f"`{c}` {'string' if t in ('date', 'timestamp', 'timestamp_ntz') else t}" for c, t in df.dtypes)).csv(path)
    df = recoded(df, encoding) if own else df
    whole = [c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")]
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in whole})


def read_info(spark: SparkSession, path: str, header: list[str] | bool = True, sep: str = "\t", quote: str = "", encoding: str = "UTF-8") -> DataFrame:
    """A table of labels (term, f, ...); ``header`` gives names if the file has none."""
    df = read_columns(spark, path, None, header is True, sep, quote, encoding)
    if isinstance(header, list):
        if len(header) != len(df.columns):
            raise ModelError(f"the table has {len(df.columns)} columns, {len(header)} names were given")
        df = df.toDF(*header)
    if "term" not in df.columns:
        raise ModelError("info tables need a column term")
    out = df.withColumn("term", F.col("term").cast("string"))
    return out.withColumn("f", F.col("f").cast("double")) if "f" in out.columns else out


def read_triplets(
    spark: SparkSession,
    path: str,
    freq: bool = False,
    value_first: bool = False,
    tokens: bool = False,
    rowinfo: str | DataFrame | None = None,
    rowinfo_header: list[str] | bool = True,
    colinfo: str | DataFrame | None = None,
    colinfo_header: list[str] | bool = True,
    N: float | None = None,
    span_size: float | None = None,
    sep: str = "\t",
    quote: str = "",
    nmax: int | None = None,
    sort: bool = False,
    encoding: str = "UTF-8",
) -> TermModel:
    """A model from a triplet file, by default of scores, with ``freq`` of counts.

    ``tokens`` reads pairs that count 1 each.  External marginals come all together: row and
    column tables and N.  ``span_size`` multiplies the marginals of rows.  ``nmax`` reads the
    first lines only.  Labels keep the order of their first line unless ``sort``.
    """
    freq = freq or tokens
    given = [rowinfo is not None, colinfo is not None, N is not None]
    if freq and any(given) and not all(given):
        raise ModelError("external marginals need the tables of rows and columns and N")
    names = ("value double, target string, feature string" if value_first else "target string, feature string, value double") if not tokens else "target string, feature string"
    lines = read_columns(spark, path, names, False, sep, quote, encoding)
    if nmax is not None:
        lines = lines.limit(nmax)
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    info = []
    for table, header in ((rowinfo, rowinfo_header), (colinfo, colinfo_header)):
        info.append(read_info(spark, table, header, sep, quote, encoding) if isinstance(table, str) else table)
    if span_size is not None and info[0] is not None and "f" in info[0].columns:
        info[0] = info[0].withColumn("f", F.col("f") * F.lit(float(span_size)))
    out = from_triplets(lines, score=None if tokens else "value", raw=freq, rowinfo=info[0], colinfo=info[1], N=N, order=None if sort else "line")
    if span_size is not None and freq and info[0] is None:
        out = out.replaced(rows=out.rows.withColumn("f", F.col("f") * F.lit(float(span_size))))
    return out


def from_term_documents(table: DataFrame, term: str = "term", document: str = "doc", count: str = "n", by_document: bool = False, raw: bool = True) -> TermModel:
    """A model from a term-document table; nulls in the counts are refused."""
    if table.where(F.col(count).isNull()).limit(1).count():
        raise ModelError("a term-document table must not hold nulls")
    return from_triplets(table, document if by_document else term, term if by_document else document, count, raw=raw)
