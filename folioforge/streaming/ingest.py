"""Resumable ingestion and a stateful ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioforge.operators.merge import upsert


def ingest_available(spark: SparkSession, source: str, schema, target: str, keys: list[str], checkpoint: str, files: int | None = None) -> None:
    """Merge what is new in a folder of Parquet files into the table ``target`` (a folder of versions), then stop.

    The checkpoint holds what was read: a second call reads only new files, and
    a call that died goes on where it stopped. Each batch writes the version of
    its number, so a batch that is run again writes the same version.
    """
    stream = spark.readStream.schema(schema)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(keys)
        if number > 0:
            new = upsert(batch.sparkSession.read.schema(schema).parquet(f"{target}/v{number - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{target}/v{number}")
        drop_old(batch.sparkSession, target)

    stream.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, target: str) -> tuple[object, list[int]]:
    """(file system, numbers of the finished versions in order), on whatever store the table lies."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v")] if fs.exists(root) else []
    done = [int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return fs, sorted(done)


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The table as the last finished batch left it."""
    _, done = _versions(spark, target)
    if not done:
        raise ValueError(f"{target} has no finished version")
    return spark.read.parquet(f"{target}/v{done[-1]}")


def drop_old(spark: SparkSession, target: str, keep: int = 2) -> list[int]:
    """Remove all finished versions but the last ``keep`` (at least two: a batch that is run again reads the one before)."""
    fs, done = _versions(spark, target)
    old = done[: -max(2, keep)]
    for n in old:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v{n}"), True)
    return old


def ledger_update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Last status of a key and its number of attempts so far."""
    at, status, attempts = state.get if state.exists else (-1, None, 0)
    for b in batches:
        attempts += len(b)
        b = b.sort_values("seq")
        if len(b) and int(b.seq.iloc[-1]) > at:
            at, status = int(b.seq.iloc[-1]), b.status.iloc[-1]
    state.update((at, status, attempts))
    yield pd.DataFrame({"key": [key[0]], "status": [status], "attempts": [attempts]})


def ledger_stream(events: DataFrame) -> DataFrame:
    """(key, status, attempts) of every key a batch touched, of a stream (key, seq long, status)."""
    return events.groupBy("key").applyInPandasWithState(
        ledger_update, "key string, status string, attempts long", "at long, status string, attempts long", "update", GroupStateTimeout.NoTimeout
    )


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Run a stream over what there is and stop."""
    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, group: str, width: str, late: str) -> DataFrame:
    """(window_start, group, n): counts per window of event time; rows later than ``late`` are passed over by a stream."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), group, "n")
