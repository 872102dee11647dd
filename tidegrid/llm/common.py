"""Helpers that the training-data operators share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and text bytes that an operator's numpy code holds at a time, whatever the size of an Arrow batch.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch on its way to a task's Python.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir or the session's checkpoint folder names it; one of this machine's where the driver is
    the only executor and none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-tidegrid-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs one reread."""
    path = f"{shared_dir(df.sparkSession)}/tidegrid-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


class Scratch:
    """The written tables of one operator; drop() deletes those that nothing reads any more."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        self.tables.append(cut(df, tag))
        return self.tables[-1]

    def drop(self, *keep: DataFrame) -> None:
        for df in self.tables:
            if not any(df is k for k in keep):
                spark = df.sparkSession
                path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = list(keep)


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece has few rows and, unless one text alone is longer, few text bytes."""
    for batch in batches:
        sizes = [(x.as_py() or 0) for x in pa.compute.binary_length(batch.column(text))]
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def short_batches(df: DataFrame) -> DataFrame:
    """df; Arrow batches of its session get at most BATCH_ROWS rows, as rows of whole texts are large."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def map_texts(df: DataFrame, columns: list, text: str, schema: str, make: Callable) -> DataFrame:
    """Run make() once in each task; the function it returns turns one slice of rows into a RecordBatch or a dict of columns."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for piece in slices(batches, text):
            out = step(piece)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return short_batches(df.select(*columns)).mapInArrow(task, schema)


def crc_of_id(col) -> "F.Column":
    """crc32 of the id as text, as the train and held-out folds use it."""
    return F.crc32(F.col(col).cast("string").cast("binary")) if isinstance(col, str) else F.crc32(col.cast("string").cast("binary"))
