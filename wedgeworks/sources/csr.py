"""Binary compressed-sparse-row graph files as a Spark data source.

Layout: vertex and entry counts, vertex + 1 offsets, then (tail, weight) entries; 64-bit
integers and doubles, or 32-bit integers and floats.  Little-endian, no magic number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wedgeworks.operators.stats import csr_offsets

SCHEMA = "head bigint, tail bigint, weight double"
#: Entries, and offsets, read at a time.
CHUNK = 1 << 20
TYPES = {64: (np.dtype("<i8"), np.dtype([("tail", "<i8"), ("weight", "<f8")])), 32: (np.dtype("<i4"), np.dtype([("tail", "<i4"), ("weight", "<f4")]))}


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


class Slice(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CsrReader(DataSourceReader):
    """Slices of whole vertices: equal in vertices, or in entries with ``balance=edges``."""

    def __init__(self, options):
        self.path, self.width = options["path"], int(options.get("width", 64))
        self.parts, self.balance = int(options.get("numpartitions", 8)), options.get("balance", "vertices")
        self.index, self.entry = TYPES[self.width]
        if self.parts < 1 or self.balance not in ("vertices", "edges"):
            raise ValueError("numPartitions is at least 1; balance is vertices or edges")

    def header(self, file) -> tuple[int, int]:
        step = self.index.itemsize
        raw = file.read_at(2 * step, 0) if file.size() >= 2 * step else b""
        if len(raw) < 2 * step:
            raise ValueError(f"{self.path}: no header")
        nv, ne = (int(x) for x in np.frombuffer(raw, self.index))
        expected = step * (2 + nv + 1) + ne * self.entry.itemsize
        if nv < 0 or ne < 0 or file.size() != expected:
            raise ValueError(f"{self.path}: {file.size()} bytes, but {nv} vertices and {ne} entries take {expected}")
        return nv, ne

    def offsets(self, file, first: int, last: int) -> np.ndarray:
        step = self.index.itemsize
        return np.frombuffer(file.read_at((last - first) * step, (2 + first) * step), self.index).astype(np.int64)

    def partitions(self):
        with _open(self.path) as file:
            nv, ne = self.header(file)
            cuts = [nv * i // self.parts for i in range(self.parts)] if self.balance == "vertices" else self.balanced(file, nv, ne)
        cuts.append(nv)
        return [Slice(a, b) for a, b in zip(cuts, cuts[1:])]

    def balanced(self, file, nv: int, ne: int) -> list[int]:
        """Greedy cuts by binary search in the offsets: a few reads of one offset for each cut."""
        capacity, cuts, base = ne // self.parts, [0], 0
        for p in range(1, self.parts):
            low, high = (cuts[-1] if p == 1 else cuts[-1] + 1), nv + 1
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if self.offsets(file, middle, middle + 1)[0] - base >= capacity else (middle + 1, high)
            cuts.append(min(low, nv))
            base = int(self.offsets(file, cuts[-1], cuts[-1] + 1)[0])
        return cuts

    def read(self, partition):
        with _open(self.path) as file:
            nv, _ = self.header(file)
            start = self.index.itemsize * (2 + nv + 1)
            for first in range(partition.first, partition.last, CHUNK):
                last = min(first + CHUNK, partition.last)
                bounds = self.offsets(file, first, last + 1)
                for at in range(int(bounds[0]), int(bounds[-1]), CHUNK):
                    end = min(at + CHUNK, int(bounds[-1]))
                    rows = np.frombuffer(file.read_at((end - at) * self.entry.itemsize, start + at * self.entry.itemsize), self.entry)
                    head = first + np.searchsorted(bounds, np.arange(at, end), side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(rows["tail"].astype(np.int64)), pa.array(rows["weight"].astype(np.float64))], ["head", "tail", "weight"])


class CsrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options)


def read_csr(spark: SparkSession, path: str, width: int = 64, parts: int = 8, balance: str = "vertices") -> DataFrame:
    spark.dataSource.register(CsrSource)
    return spark.read.format("csr").option("width", width).option("numPartitions", parts).option("balance", balance).load(path)


def write_csr(symmetric: DataFrame, nv: int, path: str, width: int = 64) -> None:
    """Write a symmetric edge table as one file, streamed through the driver in sorted order.

    Executors pack sorted rows into the file's binary form; the driver holds one partition's bytes at a time.
    """
    index, entry = TYPES[width]
    if "weight" not in symmetric.columns:
        symmetric = symmetric.withColumn("weight", F.lit(1.0))
    symmetric = symmetric.persist()
    total = symmetric.count()
    offsets = csr_offsets(symmetric, nv).orderBy("id").select("offset")
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_output_stream(inner) as out:
        out.write(np.array([nv, total], index).tobytes())
        for row in offsets.mapInArrow(_packed(index), "b binary").toLocalIterator():
            out.write(bytes(row[0]))
        out.write(np.array([total], index).tobytes())
        for row in symmetric.orderBy("head", "tail").select("tail", "weight").mapInArrow(_packed(entry), "b binary").toLocalIterator():
            out.write(bytes(row[0]))
    symmetric.unpersist()


def _packed(kind: np.dtype):
    def run(parts):
        for part in parts:
            rows = np.zeros(part.num_rows, kind)
            if kind.names:
                for i, name in enumerate(kind.names):
                    rows[name] = part.column(i).to_numpy()
            else:
                rows[:] = part.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["b"])

    return run
