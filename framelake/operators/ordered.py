"""Operators that need order: unwrapping, islands, gaps, cumulative values, peaks, interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import minimum_image


def unwrap(track: DataFrame, by: list[str], order: str, axes: dict[str, float]) -> DataFrame:
    """Each axis continued across the periodic boundary: the first value plus the summed minimum-image steps."""
    w = W.partitionBy(*by).orderBy(order)
    step = lambda c, n: F.coalesce(minimum_image(F.col(c) - F.lag(c).over(w), n), F.lit(0.0))
    out = track.select("*", *(step(c, n).alias(f"_d{c}") for c, n in axes.items()), *(F.first(c).over(w).alias(f"_0{c}") for c in axes))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    return out.select(*track.columns, *((F.col(f"_0{c}") + F.sum(f"_d{c}").over(run)).alias(f"{c}_unwrapped") for c in axes))


def islands(rows: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """(by, start, stop, length) of the runs of consecutive rows where the flag holds."""
    w = W.partitionBy(*by).orderBy(order)
    numbered = rows.withColumn("_n", F.row_number().over(w)).where(flag)
    numbered = numbered.withColumn("_g", F.col("_n") - F.row_number().over(w))
    return numbered.groupBy(*by, "_g").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("length")).drop("_g")


def longest_run(rows: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    return islands(rows, by, order, flag).groupBy(*by).agg(F.max("length").alias("longest_run"))


def sessions(rows: DataFrame, by: list[str], time: str, gap: float) -> DataFrame:
    """Rows with a number of the run that ends where the time to the next is above the gap."""
    w = W.partitionBy(*by).orderBy(time)
    broken = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_b", broken).withColumn("session", F.sum("_b").over(w)).drop("_b")


def paths(track: DataFrame, by: list[str], order: str, axes: dict[str, float]) -> DataFrame:
    """Rows with a path number that grows where a step is longer than half the cell."""
    w = W.partitionBy(*by).orderBy(order)
    far = F.lit(False)
    for c, n in axes.items():
        far = far | F.coalesce(F.abs(F.col(c) - F.lag(c).over(w)) > n / 2, F.lit(False))
    return track.withColumn("_b", far.cast("int")).withColumn("path", F.sum("_b").over(w)).drop("_b")


def temporal_score(rows: DataFrame, by: list[str], order: str, value: str, valid: str, tolerance: float) -> DataFrame:
    """score 1 at no distance to the nearest valid neighbours before and after, 0 once the farther is off by the tolerance; 0.5 without neighbours."""
    seen = F.when(F.col(valid), F.col(value))
    w = W.partitionBy(*by).orderBy(order)
    before = F.last(seen, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(seen, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    d = F.greatest(F.abs(F.col(value) - before), F.abs(F.col(value) - after))
    return rows.withColumn("score", F.when(F.col(valid), F.when(d.isNull(), 0.5).otherwise(F.greatest(1 - d / tolerance, F.lit(0.0)))).otherwise(0.0))


def fill_gaps(rows: DataFrame, by: list[str], order: str, value: str, candidate: str, most: int, tolerance: float) -> DataFrame:
    """Null values take the candidate in runs of at most `most` rows, if it is near the values around the run; `filled` marks them."""
    w = W.partitionBy(*by).orderBy(order)
    gone = F.col(value).isNull()
    out = rows.withColumn("_n", F.row_number().over(w)).withColumn("_g", F.sum(F.when(gone, 0).otherwise(1)).over(w))
    run = F.count(F.when(gone, 1)).over(W.partitionBy(*by, "_g"))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    near = lambda v: F.coalesce(F.abs(F.col(candidate) - v) <= tolerance, F.lit(True))
    fill = gone & (run <= most) & near(before) & near(after) & F.col(candidate).isNotNull()
    return out.withColumn("filled", fill).withColumn(value, F.when(F.col("filled"), F.col(candidate)).otherwise(F.col(value))).drop("_n", "_g")


def layer_break(heights: DataFrame, by: list[str], height: str, gap_min: float, factor: float) -> DataFrame:
    """(by, break_at): the lower edge of the highest gap of at least max(gap_min, factor * median of the smaller half of the gaps)."""
    w = W.partitionBy(*by).orderBy(height)
    gaps = heights.withColumn("gap", F.col(height) - F.lag(height).over(w)).where("gap is not null")
    half = gaps.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("gap"))).withColumn("_n", F.count("*").over(W.partitionBy(*by)))
    base = half.where("_r <= greatest(1, floor(_n / 2))").groupBy(*by).agg(F.median("gap").alias("base"))
    wide = gaps.join(base, by).where(F.col("gap") >= F.greatest(F.lit(gap_min), factor * F.col("base")))
    return wide.groupBy(*by).agg(F.max(height).alias("break_at"), F.max_by("gap", height).alias("gap"))


def circular_cut(phases: DataFrame, by: list[str], value: str, lower: float, period: float) -> DataFrame:
    """(by, cut, gap): midpoint of the largest gap between wrapped values, relative to lower; the first of equal gaps."""
    p = phases.select(*by, F.pmod(F.col(value) - lower, F.lit(period)).alias("p"))
    w = W.partitionBy(*by).orderBy("p")
    nxt = F.coalesce(F.lead("p").over(w), F.first("p").over(w) + period)
    return p.withColumn("gap", nxt - F.col("p")).groupBy(*by).agg(F.max(F.struct("gap", -F.col("p"))).alias("m")).select(*by, F.pmod(-F.col("m.col2") + F.col("m.gap") / 2, F.lit(period)).alias("cut"), F.col("m.gap").alias("gap"))


def cumulative_average(series: DataFrame, by: list[str], x: list[str], y: str) -> DataFrame:
    return series.withColumn("cumulative", F.avg(y).over(W.partitionBy(*by).orderBy(*x).rowsBetween(W.unboundedPreceding, 0)))


def first_of_equal(series: DataFrame, by: list[str], x: str, order: str) -> DataFrame:
    """The first row of each x."""
    return series.withColumn("_r", F.row_number().over(W.partitionBy(*by, x).orderBy(order))).where("_r = 1").drop("_r")


def integrate(series: DataFrame, by: list[str], x: str, y: str, lo: float, hi: float, baseline: float = 0.0) -> DataFrame:
    """(by, signed, absolute): trapezoids over [lo, hi], end points interpolated; x distinct within each series.

    Absolute areas split segments at their zero.
    """
    w = W.partitionBy(*by).orderBy(x)
    s = series.select(*by, F.col(x).alias("x1"), (F.col(y) - baseline).alias("y1")).withColumn("x0", F.lag("x1").over(W.partitionBy(*by).orderBy("x1"))).withColumn("y0", F.lag("y1").over(W.partitionBy(*by).orderBy("x1")))
    s = s.where((F.col("x0") < hi) & (F.col("x1") > lo))
    at = lambda v: F.col("y0") + (F.col("y1") - F.col("y0")) * (v - F.col("x0")) / (F.col("x1") - F.col("x0"))
    s = s.withColumn("a", F.greatest("x0", F.lit(lo))).withColumn("b", F.least("x1", F.lit(hi)))
    s = s.withColumn("ya", at(F.col("a"))).withColumn("yb", at(F.col("b")))
    h = F.col("b") - F.col("a")
    signed = (F.col("ya") + F.col("yb")) / 2 * h
    crossing = F.col("ya") * F.col("yb") < 0
    absolute = F.when(crossing, (F.col("ya") ** 2 + F.col("yb") ** 2) / (2 * (F.abs("ya") + F.abs("yb"))) * h).otherwise((F.abs("ya") + F.abs("yb")) / 2 * h)
    del w
    return s.groupBy(*by).agg(F.sum(signed).alias("signed"), F.sum(absolute).alias("absolute"))


def first_peak_and_minimum(series: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, peak, minimum): first y >= previous and > next; then the first y <= previous and < next, else the least of the rest."""
    w = W.partitionBy(*by).orderBy(x)
    s = series.withColumn("_p", F.lag(y).over(w)).withColumn("_n", F.lead(y).over(w))
    peak = s.where((F.col(y) >= F.col("_p")) & (F.col(y) > F.col("_n"))).groupBy(*by).agg(F.min(x).alias("peak"))
    tail = s.join(peak, by).where(F.col(x) > F.col("peak"))
    dip = F.min(F.when((F.col(y) <= F.col("_p")) & (F.col(y) < F.col("_n")), F.col(x)))
    least = F.min(F.struct(F.col(y), F.col(x)))
    return tail.groupBy(*by, "peak").agg(F.coalesce(dip, least[x]).alias("minimum"))


def smooth(series: DataFrame, by: list[str], index: str, y: str, sigma: float) -> DataFrame:
    """Gaussian kernel of radius ceil(3 sigma) over whole indices 0 .. n-1; the ends are repeated outwards."""
    r = math.ceil(3 * sigma)
    k = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    w = W.partitionBy(*by).orderBy(index)
    first, last = F.first(y).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last(y).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    at = lambda d: F.coalesce(F.lag(y, -d).over(w), first if d < 0 else last)
    total = sum(k)
    out = F.lit(0.0)
    for d, v in zip(range(-r, r + 1), k):
        out = out + at(d) * (v / total)
    return series.withColumn("smoothed", out)


def plateau(series: DataFrame, by: list[str], x: str, y: str, share: float = 0.8) -> DataFrame:
    """(by, start, stop, length): the longest run of y >= share * max, the farthest of equals."""
    top = series.withColumn("_m", F.max(y).over(W.partitionBy(*by)))
    runs = islands(top, by, x, F.col(y) >= share * F.col("_m"))
    best = runs.groupBy(*by).agg(F.max(F.struct("length", "start", "stop")).alias("b"))
    return best.select(*by, "b.start", "b.stop", "b.length")


def interpolate(series: DataFrame, by: list[str], x: str, y: str, at: float) -> DataFrame:
    """(by, value): linear between the neighbours of x = at, the end values outside."""
    w = W.partitionBy(*by).orderBy(x)
    s = series.withColumn("_x", F.lead(x).over(w)).withColumn("_y", F.lead(y).over(w)).withColumn("_f", F.row_number().over(w))
    inside = (F.col(x) <= at) & (F.col("_x") > at)
    v = F.max(F.when(inside, F.col(y) + (F.col("_y") - F.col(y)) * (at - F.col(x)) / (F.col("_x") - F.col(x))))
    before = F.max(F.when((F.col("_f") == 1) & (F.col(x) > at), F.col(y)))
    after = F.max(F.when(F.col("_x").isNull() & (F.col(x) <= at), F.col(y)))
    return s.groupBy(*by).agg(F.coalesce(v, before, after).alias("value"))


def back_link(lines: DataFrame, by: list[str], order: str, marker: Column, name: str) -> DataFrame:
    """Each row with the marker's value that follows it (or stands in it)."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    return lines.withColumn(name, F.first(marker, ignorenulls=True).over(w))


def time_axis(frames: DataFrame, by: list[str], order: str, timestep_fs: float) -> DataFrame:
    """frame_index from 0, step (the index where there is none), and time."""
    i = (F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1).cast("long")
    step = F.coalesce(F.col("step").cast("long"), i) if "step" in frames.columns else i
    return frames.withColumn("frame_index", i).withColumn("step", step).withColumn("time_fs", F.col("frame_index") * timestep_fs)


def low_ranks(rows: DataFrame, by: list[str], scores: list[Column], tie: str, n: int) -> DataFrame:
    """The n rows with the smallest sum of ranks over the scores; ties by `tie`."""
    out = rows
    for i, s in enumerate(scores):
        out = out.withColumn(f"_r{i}", F.row_number().over(W.partitionBy(*by).orderBy(s, tie)))
    total = sum((F.col(f"_r{i}") for i in range(1, len(scores))), F.col("_r0"))
    out = out.withColumn("rank_score", total)
    return out.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy("rank_score", tie))).where(F.col("_k") <= n).drop("_k", *(f"_r{i}" for i in range(len(scores))))
