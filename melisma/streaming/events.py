"""Structured Streaming over files as they arrive: event-time windows with late rows, and a training mean kept in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from melisma.tables import shared_dir

ALPHA = 0.1


def file_stream(spark: SparkSession, folder: str, schema, pattern: str, kind: str = "parquet", per_trigger: int = 16) -> DataFrame:
    """New files of a folder that match a pattern, a few at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).format(kind).load(folder)


def event_windows(stream: DataFrame, time: str, by: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """`start`, `by`, `events`: rows per window and value; rows later than the watermark are dropped. Null times fall in no window."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), by, "events")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """`by`, `start`, `end`, `events`: runs of rows of one value less than `gap` apart."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.session_window("_t", gap).alias("w"), by).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def running_mean(stream: DataFrame, by: str = "run", order: str = "line_no", value: str = "loss") -> DataFrame:
    """`by`, `order`, `ema`, `best`: running mean and least value of each run, kept in state from batch to batch; rows of a batch count in order, missing values change nothing."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, best = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for n, x in zip(rows[order], rows[value]):
            if x == x and x is not None:
                mean = x if mean is None else ALPHA * x + (1 - ALPHA) * mean
                best = x if best is None else min(best, x)
            out.append((key[0], n, mean, best))
        state.update((mean, best))
        yield pd.DataFrame(out, columns=[by, order, "ema", "best"])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.select(by, order, value).groupBy(by).applyInPandasWithState(fold, f"{by} {kinds[by]}, {order} {kinds[order]}, ema double, best double", "ema double, best double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all files there are and returns what it wrote.

    Appended rows are as many as the stream's and go to files in the shared folder; in the other modes the result is an
    aggregate, which is kept in the driver's memory.
    """
    spark = stream.sparkSession
    out = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    if mode != "append":
        out.format("memory").queryName(name).start().awaitTermination()
        return spark.table(name)
    path = f"{shared_dir(spark)}/{name}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # a stream without files writes nothing
    out.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
