"""Scans: recordings as long tables of samples, and vectors as short signals."""

from __future__ import annotations

import io
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StringType, StructField, StructType

#: The header of a recording's CSV file, in order.
RECORDING_COLUMNS = [*(f"EEG {i}" for i in range(1, 9)), *(f"Accelerometer {a}" for a in "XYZ"), *(f"Gyroscope {a}" for a in "XYZ"), "Battery Level", "Counter", "Validation Indicator"]
RECORDING_SCHEMA = StructType([StructField(c, FloatType()) for c in RECORDING_COLUMNS])
EVENTS_JSON = ArrayType(
    StructType([StructField("t_s", DoubleType()), StructField("kind", StringType()), StructField("detail", StringType()), StructField("payload", MapType(StringType(), StringType()))])
)

HOUR = 3_600_000_000
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def horizon(events: DataFrame) -> tuple[str, int]:
    """The first day of the events as a timestamp's text, and the microseconds of the days from it to the last one's end: what grids have to cover."""
    low, high = events.agg(F.date_trunc("day", F.min("ts")).cast("date").cast("string"), F.date_trunc("day", F.max("ts")).cast("date").cast("string")).first()
    days = (date.fromisoformat(high) - date.fromisoformat(low)).days + 1 if low else 0
    return f"{low or '1970-01-01'} 00:00:00", days * DAY


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, channel, sample, us (microseconds since the first day's start), value, from the event table."""
    events = table(spark, sf_dir, "events")
    us = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{horizon(events)[0]}', ts)")
    return events.select(F.col("user_id").alias("session"), F.col("event_type").alias("channel"), F.col("event_id").alias("sample"), us.alias("us"), "value")


def total(spark: SparkSession, sf_dir: str) -> int:
    return horizon(table(spark, sf_dir, "events"))[1]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x: the vector as a signal of 64 samples at 64 Hz."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def read_recording_csv(spark: SparkSession, path: str) -> DataFrame:
    """A recording's CSV file, with or without a byte order mark; a header that differs from RECORDING_COLUMNS fails."""
    return spark.read.schema(RECORDING_SCHEMA).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


#: Samples of a recording that one row of the scan's first step holds.
NPY_SAMPLES = 1 << 16


def read_recording_npy(spark: SparkSession, path: str) -> DataFrame:
    """file, row, sample, value of recordings saved as one array of 17 rows each; another shape fails. A file is read by one task, in parts of NPY_SAMPLES."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                if data.ndim != 2 or data.shape[0] != len(RECORDING_COLUMNS):
                    raise ValueError(f"{name}: {len(RECORDING_COLUMNS)} rows are wanted, the shape is {data.shape}")
                for row in range(data.shape[0]):
                    for at in range(0, data.shape[1], NPY_SAMPLES):
                        part = pa.array([data[row, at : at + NPY_SAMPLES].astype(np.float32)], pa.list_(pa.float32()))
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([row], pa.int32()), pa.array([at], pa.int64()), part], names=["file", "row", "first", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(parts, "file string, row int, first long, values array<float>")
    return rows.select("file", "row", "first", F.posexplode("values").alias("at", "value")).select("file", "row", (F.col("first") + F.col("at")).alias("sample"), "value")


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """The events of session folders: one row for each, with the file it came from."""
    rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.from_json("value", EVENTS_JSON).alias("e"))
    return rows.select("file", F.inline("e"))


def plausible_units(df: DataFrame, low: float = 1.0, high: float = 100.0) -> DataFrame:
    """session, sd, plausible: the median over channels of the signal's standard deviation lies within bounds."""
    sd = df.groupBy("session", "channel").agg(F.stddev_pop("value").alias("sd")).groupBy("session").agg(F.median("sd").alias("sd"))
    return sd.withColumn("plausible", F.col("sd").between(low, high))


def session_folders(spark: SparkSession, root: str, needed: tuple[str, ...] = ("meta.json",)) -> DataFrame:
    """session, path, files, size, modified: the folders under root that hold files, the newest file's time being the folder's. Those without one of the needed
    files are left out. Only names, times and sizes are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    parts = listed.withColumns({"folder": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "name": F.regexp_extract("path", "([^/]*)$", 1)})
    has = [F.bool_or(F.col("name") == n).alias(f"_has{i}") for i, n in enumerate(needed)]
    g = parts.groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("size"), F.max("modificationTime").alias("modified"), *has)
    whole = g.where(" AND ".join(f"_has{i}" for i in range(len(needed))) or "true")
    return whole.select(F.regexp_extract("folder", "([^/]*)$", 1).alias("session"), F.col("folder").alias("path"), "files", "size", "modified")


def latest_session(spark: SparkSession, root: str, needed: tuple[str, ...] = ("meta.json",)) -> DataFrame:
    """The row of session_folders changed last; of equal times the last by name. Empty without sessions."""
    newest = F.max_by(F.struct("session", "path", "files", "size", "modified"), F.struct("modified", "session", "path"))
    return session_folders(spark, root, needed).agg(newest.alias("s")).where("s IS NOT NULL").select("s.*")
