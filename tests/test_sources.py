import struct

import numpy as np
import pytest
from goldens import HIERO, model
from pyspark.sql import functions as F

from termfield.model import ModelError
from termfield.sources import binary
from termfield.sources import matrices as mx
from termfield.sources import triplets as tr


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_triplet_layouts(spark, tmp_path):
    a = put(tmp_path / "a.tsv", "cat\tPet\t3\ndog\tPet\t2\ncat\tPet\t1\n")
    b = put(tmp_path / "b.tsv", "3\tcat\tPet\n2\tdog\tPet\n1\tcat\tPet\n")
    c = put(tmp_path / "c.tsv", "cat\tPet\ncat\tPet\n\"q\tPet\n")
    want = {("cat", "Pet"): 4.0, ("dog", "Pet"): 2.0}
    for path, first in ((a, False), (b, True)):
        m = tr.read_triplets(spark, path, freq=True, value_first=first)
        assert {(r.target, r.feature): r.f for r in m.cells.collect()} == want and m.N == 6
    m = tr.read_triplets(spark, c, tokens=True)
    assert {r.target: r.f for r in m.cells.collect()} == {"cat": 2.0, '"q': 1.0}
    scores = tr.read_triplets(spark, a)
    assert scores.cells is None and scores.scores.count() == 2
    assert tr.read_triplets(spark, a, freq=True, nmax=1).cells.count() == 1
    assert [r.term for r in m.labels()[0].collect()] == ["cat", '"q']


def test_marginals_and_span(spark, tmp_path):
    a = put(tmp_path / "a.tsv", "cat\tPet\t3\n")
    rows, cols = put(tmp_path / "r.tsv", "term\tf\ncat\t10\ndog\t5\n"), put(tmp_path / "c.tsv", "Pet\t7\tx\n")
    m = tr.read_triplets(spark, a, freq=True, rowinfo=rows, colinfo=cols, colinfo_header=["term", "f", "kind"], N=1000, span_size=4)
    assert m.rows.first().f == 40 and m.cols.first().f == 7 and m.N == 1000 and m.check()
    with pytest.raises(ModelError, match="external"):
        tr.read_triplets(spark, a, freq=True, rowinfo=rows)


def test_encodings_and_compression(spark, tmp_path):
    import bz2
    import gzip

    text = "Ťéşt\tÄ\t1\nTest\tB\t2\n"
    for name, data in (("a.gz", gzip.compress(text.encode())), ("a.bz2", bz2.compress(text.encode()))):
        (tmp_path / name).write_bytes(data)
        assert {r.target for r in tr.read_triplets(spark, str(tmp_path / name), freq=True).cells.collect()} == {"Ťéşt", "Test"}
    latin = put(tmp_path / "l.tsv", "Šá\tB\t1\n", "iso8859-2")
    assert tr.read_triplets(spark, latin, freq=True, encoding="ISO-8859-2").cells.first().target == "Šá"
    wide = put(tmp_path / "w.tsv", text, "utf-16")
    assert {r.target for r in tr.read_triplets(spark, wide, freq=True, encoding="UTF-16").cells.collect()} == {"Ťéşt", "Test"}


VECTORS = """7 6
knife 0.5 0.2 0.8 0 0 0
cat 0.5 0.6 0 0 0.1 0.3
dog 1.2 0.8 0.1 0.4 0.3 0.2
boat 0.6 0.4 0.2 0 0 0
cup 1 0.1 0.1 0 0 0
pig 0.1 0.2 0 0 0.1 0.3
banana 0.1 0 0 0 0.2 0
"""


def test_word_vectors(spark, tmp_path):
    path = put(tmp_path / "v.txt", VECTORS)
    got = mx.read_word_vectors(spark, path).orderBy("pos").collect()
    assert [r.term for r in got] == list(HIERO["rows"]) and got[2].vec == [1.2, 0.8, 0.1, 0.4, 0.3, 0.2]
    assert mx.word_vector_model(spark, path).dim() == (7, 6)
    rows = [(i, t, [(x + 0.1) / 100 for x in v]) for i, (t, v) in enumerate(HIERO["rows"].items())]
    table = spark.createDataFrame(rows, "pos int, term string, vec array<double>")
    mx.write_word_vectors(table, str(tmp_path / "out"), digits=1)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == VECTORS
    again = mx.read_word_vectors(spark, str(tmp_path / "out")).count()
    assert again == 7
    for bad in ("7 5\na 1 2\n", "x\n", "2 2\na 1 2\n"):
        with pytest.raises(ModelError):
            mx.read_word_vectors(spark, put(tmp_path / "bad.txt", bad))
    with pytest.raises(ModelError, match="white space"):
        mx.write_word_vectors(table.withColumn("term", F.lit("a b")), str(tmp_path / "no"))


def test_coordinate_files(spark, tmp_path):
    path = put(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate real general\n% note\n2 3 2\n1 3 2.5\n2 1 4\n")
    cells, nr, nc = mx.read_matrix_market(spark, path)
    assert (nr, nc) == (2, 3) and {tuple(r) for r in cells.collect()} == {(1, 3, 2.5), (2, 1, 4.0)}
    sym = put(tmp_path / "s.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n2 2 2\n1 1\n2 1\n")
    assert mx.read_matrix_market(spark, sym)[0].count() == 3
    with pytest.raises(ModelError):
        mx.read_matrix_market(spark, put(tmp_path / "x.mtx", "%%MatrixMarket matrix array real general\n1 1\n1\n"))


@pytest.mark.parametrize("dense", [True, False])
def test_model_directory(spark, tmp_path, dense):
    names, feats = list(HIERO["rows"]), HIERO["features"]
    put(tmp_path / "globals.tbl", "N\tkind\n957\ttest\n")
    put(tmp_path / "rows.tbl", "term\tf\n" + "".join(f"{t}\t{sum(v)}\n" for t, v in HIERO["rows"].items()))
    put(tmp_path / "cols.tbl", "term\tf\n" + "".join(f"{f}\t{sum(v[k] for v in HIERO['rows'].values())}\n" for k, f in enumerate(feats)))
    if dense:
        put(tmp_path / "M", "".join(" ".join(map(str, v)) + "\n" for v in HIERO["rows"].values()))
    else:
        cells = [(i + 1, j + 1, x) for i, v in enumerate(HIERO["rows"].values()) for j, x in enumerate(v) if x]
        put(tmp_path / "M.mtx", f"%%MatrixMarket matrix coordinate integer general\n7 6 {len(cells)}\n" + "".join(f"{i} {j} {x}\n" for i, j, x in cells))
    m = mx.read_model_directory(spark, str(tmp_path)).check()
    assert m.N == 957 and [r.term for r in m.labels()[0].collect()] == names
    assert {tuple(r) for r in m.cells.collect()} == {tuple(r) for r in model(spark, HIERO).cells.collect()}
    put(tmp_path / ("M.mtx" if dense else "M"), "x")
    with pytest.raises(ModelError, match="either"):
        mx.read_model_directory(spark, str(tmp_path))


SVD = [(20, 10, 15, 0, 2), (10, 5, 8, 1, 0), (0, 1, 2, 6, 3), (1, 0, 0, 10, 5)]


def test_svd_files(spark, tmp_path):
    want = {(i, j, float(x)) for i, r in enumerate(SVD) for j, x in enumerate(r) if x}
    dense = put(tmp_path / "d.txt", "4 5\n" + "".join(" ".join(map(str, r)) + "\n" for r in SVD))
    columns = [[(i, r[j]) for i, r in enumerate(SVD) if r[j]] for j in range(5)]
    sparse = put(tmp_path / "s.txt", f"4 5 {len(want)}\n" + "".join(f"{len(c)}\n" + "".join(f"{i} {x}\n" for i, x in c) for c in columns))
    (tmp_path / "d.bin").write_bytes(struct.pack(">2i", 4, 5) + struct.pack(">20f", *[x for r in SVD for x in r]))
    (tmp_path / "s.bin").write_bytes(struct.pack(">3i", 4, 5, len(want)) + b"".join(struct.pack(">i", len(c)) + b"".join(struct.pack(">if", i, x) for i, x in c) for c in columns))
    for read, path, kind in (
        (mx.read_svd_text, dense, "dense"), (mx.read_svd_text, sparse, "sparse"), (mx.read_svd_binary, str(tmp_path / "d.bin"), "dense"), (mx.read_svd_binary, str(tmp_path / "s.bin"), "sparse"),
    ):
        cells, nr, nc = read(spark, path, kind)
        assert (nr, nc) == (4, 5) and {tuple(r) for r in cells.collect()} == want


def test_binary_files_are_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(6)
    m = np.where(rng.random((50, 30)) < 0.3, rng.normal(size=(50, 30)), 0).astype(">f4")
    m[:, 7] = 0  # a column without cells
    (tmp_path / "d.bin").write_bytes(struct.pack(">2i", *m.shape) + m.tobytes())
    columns = [[(int(i), float(m[i, j])) for i in np.flatnonzero(m[:, j])] for j in range(30)]
    many = sum(map(len, columns))
    (tmp_path / "s.bin").write_bytes(struct.pack(">3i", 50, 30, many) + b"".join(struct.pack(">i", len(c)) + b"".join(struct.pack(">if", i, x) for i, x in c) for c in columns))
    want = {(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))}
    spark.dataSource.register(binary.SvdBinary)
    for kind, name in (("dense", "d.bin"), ("sparse", "s.bin")):
        df = spark.read.format("svd_binary").option("kind", kind).option("bytes", 400).load(str(tmp_path / name))
        assert {tuple(r) for r in df.collect()} == want
        parts = binary.SvdReader(str(tmp_path / name), kind, 400).partitions()
        assert len(parts) > 5 and [p.first for p in parts[1:]] == [p.last for p in parts[:-1]]
        assert df.rdd.getNumPartitions() == len(parts)
    (tmp_path / "short.bin").write_bytes(struct.pack(">2i", 50, 30) + b"1234")
    with pytest.raises(Exception, match="shorter"):
        spark.read.format("svd_binary").option("kind", "dense").load(str(tmp_path / "short.bin")).collect()
    (tmp_path / "none.bin").write_bytes(struct.pack(">3i", 0, 0, 0))
    cells, nr, nc = mx.read_svd_binary(spark, str(tmp_path / "none.bin"), "sparse")
    assert (nr, nc) == (0, 0) and cells.collect() == []


def test_word_vectors_in_several_parts(spark, tmp_path):
    rows = [(i, f"w{i:03d}", [float(i), i / 8]) for i in range(200)]
    table = spark.createDataFrame(rows, "pos int, term string, vec array<double>").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mx.write_word_vectors(table, str(tmp_path / "v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "v").glob("part-*"))
    text = "".join(f.read_text() for f in files).splitlines()
    assert len(files) > 2 and text[0] == "200 2" and text[1] == "w000 0 0" and text[200] == "w199 199 24.875"
    assert [(r.pos, r.term, r.vec) for r in mx.read_word_vectors(spark, str(tmp_path / "v")).orderBy("pos").collect()] == rows


def test_lines_of_many_splits_are_numbered(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for k, n in enumerate((50, 2000, 3)):
        (tmp_path / "t" / f"part-{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [r.text for r in mx.numbered_lines(spark, str(tmp_path / "t")).orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{k} {i}" for k, n in enumerate((50, 2000, 3)) for i in range(n)]


def test_term_documents(spark):
    t = spark.createDataFrame([("a", "d1", 2.0), ("b", "d1", None)], "term string, doc string, n double")
    with pytest.raises(ModelError):
        tr.from_term_documents(t)
    assert tr.from_term_documents(t.dropna(), by_document=True).cells.first().target == "d1"
