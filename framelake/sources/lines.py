"""Text files as numbered lines, in parallel: a file's blocks are counted, then numbered on from the blocks before.

Values carried from a line to those below it (a frame's header, a section's name) go the same way, block by block, so no
file is ever in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, block, i, line_no, line): block is where a part of the file starts, i the line's place in it."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[tuple, int] = {}
        for f in frames:  # lines of a block come in order, in one task
            f = f.copy()
            i = f.groupby(["source", "block"], sort=False).cumcount()
            base = [at.get(k, 0) for k in zip(f["source"], f["block"])]
            f["i"] = i + base
            for k, n in f.groupby(["source", "block"], sort=False).size().items():
                at[k] = at.get(k, 0) + int(n)
            yield f[["source", "block", "i", "line"]]

    numbered = raw.mapInPandas(number, "source string, block long, i long, line string")
    sizes = numbered.groupBy("source", "block").agg(F.max("i").alias("last"))
    ahead = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("source", "block", F.coalesce(F.sum(F.col("last") + 1).over(ahead), F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(sizes), ["source", "block"]).select("source", "block", "i", (F.col("before") + F.col("i")).alias("line_no"), "line")


def carry(lines: DataFrame, **markers: Column) -> DataFrame:
    """Each marker's last value at or above the line, from all blocks of the file."""
    own = W.partitionBy("source", "block").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    out = lines.select("*", *(F.last(m, ignorenulls=True).over(own).alias(k) for k, m in markers.items()))
    ends = out.groupBy("source", "block").agg(*(F.max_by(k, "i").alias(f"{k}_end") for k in markers))
    ends = ends.select("source", "block", *(F.last(f"{k}_end", ignorenulls=True).over(before).alias(f"{k}_before") for k in markers))
    out = out.join(F.broadcast(ends), ["source", "block"])
    return out.select(*lines.columns, *(F.coalesce(k, f"{k}_before").alias(k) for k in markers))


def words(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")
