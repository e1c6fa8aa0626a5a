"""Streaming twins: sums by bin, windows with watermarks, sessions, restartable appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import place
from ..sources.store import exists


def binned(stream: DataFrame, bin_column: Column, sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Running sums by bin with fixed bounds; the state is a row for each bin."""
    return stream.groupBy(*(by or []), bin_column.alias("bin")).agg(*(v.alias(k) for k, v in sums.items()))


def windowed(stream: DataFrame, time: str, size: str, slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None, **sums: Column) -> DataFrame:
    """Sums by event-time window; rows later than the watermark are dropped, and so is the state before it."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("window"), *(by or [])).agg(*(v.alias(k) for k, v in sums.items()))


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes", **sums: Column) -> DataFrame:
    """Sums by session: runs of rows with no gap as long as given."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *by).agg(*(v.alias(k) for k, v in sums.items()))


def spatial_filter(stream: DataFrame, ranges: list[tuple[str, float, float]]) -> DataFrame:
    """Rows within fixed bounds; bounds taken from the data need a batch pass first."""
    for axis, lo, hi in ranges:
        stream = stream.where(F.col(axis).between(lo - 1e-9, hi + 1e-9))
    return stream


def append_records(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Each source once, in Parquet: keys that are seen are state of the stream, and what was stored when it starts is left out."""
    spark = stream.sparkSession
    new = stream.dropDuplicates([key])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    return new.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def csv_writer(stream: DataFrame, path: str, checkpoint: str):
    """Rows appended to text tables as they come; the checkpoint keeps a restart from writing them twice."""
    return stream.writeStream.outputMode("append").format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint)


def drained(df: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a stream over files yields once it has read them, as Parquet in the shared folder."""
    spark = df.sparkSession
    path = place(spark, "stream")
    how = "overwrite" if mode == "complete" else "append"
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode(how).parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")
