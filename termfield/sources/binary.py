"""Binary SVD files as a data source: ``spark.read.format("svd_binary").option("kind", "dense").load(path)``.

A file holds big-endian 32-bit numbers.  dense: sizes, then floats row by row, so a range of rows
lies at a known place.  sparse: sizes and the number of cells, then for each column how many cells
it has, and a row and a float for each; a first pass that skips from count to count finds where
ranges of columns lie.  Every range of about ``bytes`` bytes is a partition that reads its own part of the
file only, as a stream of Arrow batches.  Paths are those of a file system that all machines mount; for
others, :func:`.matrices.read_svd_binary` reads a file through Spark as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "i long, j long, value double"
#: Numbers of a batch.
_BATCH = 1 << 18


def mounted(path: str) -> str | None:
    """The path of a file that open() reaches, or None."""
    plain = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return plain if "://" not in plain and os.path.isfile(plain) else None


@dataclass
class Part(InputPartition):
    first: int  # row (dense) or column (sparse)
    last: int
    offset: int  # bytes

    def __init__(self, first: int, last: int, offset: int):
        super().__init__(None)
        self.first, self.last, self.offset = first, last, offset


def header(path: str, kind: str) -> list[int]:
    """Sizes of the file: rows, columns and, if sparse, cells."""
    import numpy as np

    many = 2 if kind == "dense" else 3
    with open(path, "rb") as f:
        found = np.frombuffer(f.read(4 * many), ">i4")
    if len(found) < many or (found < 0).any():
        raise ValueError("the file has no sizes")
    return [int(x) for x in found]


class SvdReader(DataSourceReader):
    def __init__(self, path: str, kind: str, size: int):
        self.path, self.kind, self.size = path, kind, size

    def partitions(self) -> list[InputPartition]:
        import numpy as np

        sizes = header(self.path, self.kind)
        nr, nc = sizes[:2]
        there = os.path.getsize(self.path)
        if self.kind == "dense":
            if there < 8 + 4 * nr * nc:
                raise ValueError("the file is shorter than its sizes say")
            step = max(1, self.size // max(1, 4 * nc))
            return [Part(a, min(nr, a + step), 8 + 4 * nc * a) for a in range(0, nr, step)] or [Part(0, 0, 8)]
        out, first, begun, place, cells = [], 0, 12, 12, 0
        with open(self.path, "rb") as f:
            for c in range(nc):
                f.seek(place)
                count = np.frombuffer(f.read(4), ">i4")
                if not len(count) or place + 4 + 8 * int(count[0]) > there:
                    raise ValueError("the file is shorter than its sizes say")
                cells += int(count[0])
                place += 4 + 8 * int(count[0])
                if place - begun >= self.size or c == nc - 1:
                    out.append(Part(first, c + 1, begun))
                    first, begun = c + 1, place
        if cells != sizes[2]:
            raise ValueError(f"the file does not hold the {sizes[2]} cells it names")
        return out or [Part(0, 0, 12)]

    def read(self, partition: Part) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def batch(i, j, v):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(i, np.int64)), pa.array(np.asarray(j, np.int64)), pa.array(np.asarray(v, float))], names=["i", "j", "value"])

        nc = header(self.path, self.kind)[1]
        with open(self.path, "rb") as f:
            f.seek(partition.offset)
            if self.kind == "dense":
                step = max(1, _BATCH // max(1, nc))
                for a in range(partition.first, partition.last, step):
                    rows = min(step, partition.last - a)
                    x = np.frombuffer(f.read(4 * nc * rows), ">f4").astype(float)
                    at = np.flatnonzero(x)
                    yield batch(a + at // nc, at % nc, x[at])
                return
            for c in range(partition.first, partition.last):
                left = int(np.frombuffer(f.read(4), ">i4")[0])
                while left:
                    n = min(left, _BATCH)
                    pair = np.frombuffer(f.read(8 * n), ">i4").reshape(n, 2)
                    yield batch(pair[:, 0], np.full(n, c), np.ascontiguousarray(pair[:, 1]).view(">f4"))
                    left -= n


class SvdBinary(DataSource):
    """Options: kind (sparse or dense), bytes (of a partition, 32 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "svd_binary"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind, path = self.options.get("kind", "dense"), mounted(self.options["path"])
        if kind not in ("sparse", "dense"):
            raise ValueError("kind must be sparse or dense")
        if path is None:
            raise ValueError("svd_binary reads files that all machines mount")
        return SvdReader(path, kind, int(self.options.get("bytes", 32 << 20)))
