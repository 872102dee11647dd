"""Structured Streaming over recordings: contact windows, session windows and counter gaps, each equal to its batch form on closed windows.

Streams run with availableNow and write Parquet to the folder the executors share; a restart goes on from the checkpoint beside it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-tidegrid-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def events_stream(spark: SparkSession, sf_dir: str, files: int = 64) -> DataFrame:
    """The event files as a stream, the oldest first, at most so many in a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parquet*")
    return s.withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, base: str | None = None) -> DataFrame:
    """Run a stream over all there is, then read what it wrote. With a base folder, a later call goes on from where an earlier one ended."""
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sink = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def contact_windows(stream: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    w = stream.withWatermark("at", late).groupBy(F.window("at", length, slide), F.col("event_type").alias("channel"))
    return w.agg(F.count("*").alias("n"), F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("p2p"))


def session_windows(stream: DataFrame, gap: str, late: str) -> DataFrame:
    return stream.withWatermark("at", late).groupBy(F.session_window("at", gap), F.col("user_id").alias("session")).agg(F.count("*").alias("n"))


def counter_gap_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Gaps of one session's counter in a micro-batch; the last counter is what the state carries on."""
    last = state.get[0] if state.exists else None
    seen = pd.concat([f["event_id"] for f in frames]).sort_values()
    steps = seen.diff() if last is None else seen - seen.shift(fill_value=last)
    gaps = int(((steps - 1).abs().gt(1) & steps.ge(0)).sum())
    state.update((int(seen.iloc[-1]),))
    yield pd.DataFrame({"session": [key[0]], "gaps": [gaps], "seen": [len(seen)]})


def counter_gaps(stream: DataFrame) -> DataFrame:
    return stream.groupBy("user_id").applyInPandasWithState(counter_gap_state, "session long, gaps long, seen long", "last long", "append", GroupStateTimeout.NoTimeout)
