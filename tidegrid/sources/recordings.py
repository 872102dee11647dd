"""Recordings as data sources that many tasks read: ranges of `.npy` files and of raw streams cut off by a crash, and a stream that follows one to its end.

Files are opened by pyarrow's file systems, so a path or an address is one that all executors reach. Only headers and sizes are read to plan; a task seeks to
its range and reads no more.

    spark.dataSource.register(NpyRecordings); spark.read.format("npy_recordings").load("/shared/sessions")
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .tables import RECORDING_COLUMNS

ROWS = len(RECORDING_COLUMNS)
#: Samples of a part, and bytes of a sample of a raw stream.
PART, SAMPLE_BYTES = 1 << 18, 4 * ROWS
PARTS = "file string, row int, first long, values array<float>"


def files_under(path: str, suffix: str) -> list[tuple[str, int]]:
    """The file itself, or those of a folder and its subfolders with this suffix; with their sizes, by name."""
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    info = fs.get_file_info(inner)
    found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True))
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((head + f.path, f.size) for f in found if f.is_file and (info.is_file or f.path.endswith(suffix)))


def bytes_of(path: str, at: int, size: int) -> bytes:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    with fs.open_input_file(inner) as f:
        f.seek(at)
        return f.read(size)


def npy_header(path: str) -> tuple[int, np.dtype, int]:
    """Where the array starts, its type and its samples; an array that is not ROWS rows of numbers, one after the other, fails."""
    start = bytes_of(path, 0, 12)
    if start[:6] != b"\x93NUMPY":
        raise ValueError(f"{path}: no .npy file")
    size, at = (int.from_bytes(start[8:10], "little"), 10) if start[6] == 1 else (int.from_bytes(start[8:12], "little"), 12)
    told = ast.literal_eval(bytes_of(path, at, size).decode("latin1"))
    kind, shape = np.dtype(told["descr"]), told["shape"]
    if len(shape) != 2 or shape[0] != ROWS or told["fortran_order"] or kind.kind not in "fiu":
        raise ValueError(f"{path}: {ROWS} rows are wanted, the shape is {shape}")
    return at + size, kind, shape[1]


class Range(InputPartition):
    """Samples of a file, and where and how they lie in it; of one row, or of all where row is None."""

    def __init__(self, path: str, row: int | None, first: int, n: int, at: int, kind: str) -> None:
        super().__init__((path, row, first))
        self.path, self.row, self.first, self.n, self.at, self.kind = path, row, first, n, at, kind


def batch(path: str, row: int, first: int, values: np.ndarray) -> pa.RecordBatch:
    held = pa.array([values.astype(np.float32)], pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([row], pa.int32()), pa.array([first], pa.int64()), held], names=["file", "row", "first", "values"])


def read_range(p: Range) -> Iterator[pa.RecordBatch]:
    if p.row is not None:
        size = np.dtype(p.kind).itemsize
        yield batch(p.path, p.row, p.first, np.frombuffer(bytes_of(p.path, p.at, p.n * size), p.kind))
    else:
        values = np.frombuffer(bytes_of(p.path, p.at, p.n * SAMPLE_BYTES), "<f4").reshape(-1, ROWS)
        for row in range(ROWS):
            yield batch(p.path, row, p.first, values[:, row])


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.part = options["path"], int(options.get("part", PART))

    def partitions(self) -> list[Range]:
        out = []
        for path, _ in files_under(self.path, ".npy"):
            start, kind, n = npy_header(path)
            out += [Range(path, row, at, min(self.part, n - at), start + (row * n + at) * kind.itemsize, kind.str) for row in range(ROWS) for at in range(0, n, self.part)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


class RawReader(DataSourceReader):
    """A raw stream is float32, all rows of a sample together. What a crash left of a last sample is cut off."""

    def __init__(self, options: dict) -> None:
        self.path, self.part = options["path"], int(options.get("part", PART))

    def partitions(self) -> list[Range]:
        spans = [(path, size // SAMPLE_BYTES) for path, size in files_under(self.path, ".f32")]
        return [Range(path, None, at, min(self.part, n - at), at * SAMPLE_BYTES, "<f4") for path, n in spans for at in range(0, n, self.part)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


class RawStream(DataSourceStreamReader):
    """Replays one raw stream until all its whole samples are out; what is appended meanwhile follows, `pace` samples at most in a micro-batch. The first one
    after a start takes all there is from the checkpoint on, as Spark asks for the latest offset before it tells where it stands."""

    def __init__(self, options: dict) -> None:
        self.path, self.pace, self.part = options["path"], int(options.get("pace", PART)), int(options.get("part", PART))
        self.at: int | None = None

    def whole(self) -> int:
        return sum(size // SAMPLE_BYTES for _, size in files_under(self.path, ".f32"))

    def initialOffset(self) -> dict:
        return {"sample": 0}

    def latestOffset(self) -> dict:
        self.at = self.whole() if self.at is None else min(self.whole(), self.at + self.pace)
        return {"sample": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        first, last = start["sample"], end["sample"]
        return [Range(self.path, None, at, min(self.part, last - at), at * SAMPLE_BYTES, "<f4") for at in range(first, last, self.part)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


class NpyRecordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_recordings"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


class RawRecordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_recordings"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def streamReader(self, schema) -> RawStream:
        return RawStream(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(NpyRecordings)
    spark.dataSource.register(RawRecordings)
    return spark


def samples_of(parts: DataFrame) -> DataFrame:
    """file, row, sample, value of parts."""
    return parts.select("file", "row", "first", F.posexplode("values").alias("at", "value")).select("file", "row", (F.col("first") + F.col("at")).alias("sample"), "value")


def recording_chunks(parts: DataFrame, size: int) -> DataFrame:
    """file, row, chunk, x for operators/recursive.py, from parts of `size` samples."""
    return parts.select("file", "row", F.floor(F.col("first") / size).cast("long").alias("chunk"), F.col("values").cast("array<double>").alias("x"))


def truncated(spark: SparkSession, path: str) -> DataFrame:
    """file, t, kind, detail: an event for each raw stream that ends within a sample; t is the number of its whole samples."""
    rows = [(p, size // SAMPLE_BYTES, "truncated_recording", f"{size % SAMPLE_BYTES} bytes of a sample cut off") for p, size in files_under(path, ".f32") if size % SAMPLE_BYTES]
    return spark.createDataFrame(rows, "file string, t long, kind string, detail string")
