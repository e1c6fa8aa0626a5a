"""Weighted histograms with closed right edges, dense output, normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import divided, shell_volume

MAX_BINS = 20_000_000


def bin_index(v: Column, start: float | Column, width: float | Column, n: int | Column) -> Column:
    """floor((v - start) / width) kept within 0 .. n-1, so that the last bin holds its right edge."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.greatest(F.floor((v - start) / width), F.lit(0)), n - 1).cast("int")


def bin_edges(lo: float, hi: float, width: float, *, bounded: bool = False) -> tuple[float, int]:
    """Start and number of bins that cover [lo, hi]; one more where the last edge falls short or a lone bin has no bounds."""
    if hi <= lo:
        hi = lo + width
    n = max(1, math.ceil((hi - lo) / width))
    if lo + n * width < hi or (n == 1 and not bounded):
        n += 1
    return lo, n


def uniform_rdf_bins(r_max: float, width: float) -> tuple[int, float]:
    """Number of bins up to r_max and their width, the number rounded with halves to even."""
    n = max(1, round(r_max / width))
    return n, r_max / n


def reconstructed(edges: DataFrame, by: str, index: str, edge: str, rtol: float = 5e-7) -> DataFrame:
    """(by, index, lo, width, uniform): a uniform grid of doubles from edges that were stored as floats.

    The first edge and the mean width make the grid; `uniform` says whether every stored edge lies on it to the precision
    of its type.
    """
    e = F.col(edge).cast("double")
    ends = edges.groupBy(by).agg(F.min(e).alias("_a"), F.max(e).alias("_z"), F.min(index).alias("_i"), F.count("*").alias("_n"))
    grid = edges.join(ends, by).withColumn("width", (F.col("_z") - F.col("_a")) / (F.col("_n") - 1)).withColumn("lo", F.col("_a") + (F.col(index) - F.col("_i")) * F.col("width"))
    slack = F.greatest(F.abs("_a"), F.abs("_z")) * 2.4e-7 + rtol * F.col("width")
    bad = grid.groupBy(by).agg((F.max(F.abs(e - F.col("lo"))) <= F.max(slack)).alias("uniform"))
    return grid.join(bad, by).select(by, index, "lo", "width", "uniform")


def auto_r_max(heights: list[float], width: float) -> float:
    """Half the smallest height, rounded down to whole bins."""
    return math.floor(min(heights) / 2 / width + 1e-9) * width


def observed_bounds(points: DataFrame, axes: list[str]) -> DataFrame:
    return points.agg(*(f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))))


def histogram(points: DataFrame, axes: list[tuple[str, float, float, int | None]], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Sums by bin of each axis (column, start, width, n); index columns are called i_<column>. Without n, bins go on to either side."""
    at = lambda v, start, width, n: F.floor((v - start) / width).cast("int") if n is None else bin_index(v, start, width, n)
    keys = [at(F.col(c), start, width, n).alias(f"i_{c}") for c, start, width, n in axes]
    return points.groupBy(*(by or []), *keys).agg(*(v.alias(k) for k, v in sums.items()))


def spine(df: DataFrame, n: int, name: str) -> DataFrame:
    """One row for each bin number."""
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias(name))


def dense(bins: DataFrame, name: str, n: int, fill: dict[str, float | None]) -> DataFrame:
    """All bins of one axis; those without samples get the fill (0 for densities, null for means)."""
    out = spine(bins, n, name).join(bins, name, "left")
    return out.select(name, *(F.coalesce(c, F.lit(v)).alias(c) if v is not None else F.col(c) for c, v in fill.items()))


def check_size(bins: DataFrame, most: int = MAX_BINS) -> None:
    """An error if a sparse grid has more bins than the guard allows."""
    if bins.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} bins; use wider ones")


def sparse_grid(points: DataFrame, axes: list[tuple[str, float, float]], mass: str = "mass_amu", side: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Sums of mass and entities by bin of (column, start, width), with a top and a bottom channel; ties (side 0) count half in both."""
    keys = [F.floor((F.col(c) - start) / width).cast("int").alias(f"i_{c}") for c, start, width in axes]
    sums = [F.sum(mass).alias("mass"), F.count("*").cast("double").alias("entities")]
    if side:
        share = {"top": F.when(F.col(side) > 0, 1.0).when(F.col(side) == 0, 0.5).otherwise(0.0), "bottom": F.when(F.col(side) < 0, 1.0).when(F.col(side) == 0, 0.5).otherwise(0.0)}
        sums += [F.sum(v * w).alias(f"{name}_{k}") for k, w in share.items() for name, v in (("mass", F.col(mass)), ("entities", F.lit(1.0)))]
    return points.groupBy(*(by or []), *keys).agg(*sums)


def number_density(bins: DataFrame, count: str, frames: int, width: float, volume: float | None = None) -> DataFrame:
    """count / (frames * slab volume), or by length where there is no volume."""
    return bins.withColumn("number_density", F.col(count) / (frames * (volume if volume is not None else width)))


def framewise_density(bins: DataFrame, by: str, count: str, volume: str) -> DataFrame:
    """Mean over frames of count / volume where the cell varies; frames without volume are left out."""
    return bins.groupBy(by).agg(F.avg(F.when(F.col(volume) > 0, F.col(count) / F.col(volume))).alias("number_density"))


def rdf(pair_counts: DataFrame, expected: DataFrame, n: int, width: float) -> DataFrame:
    """(bin, lo, hi, counts, expected, g): sum of counts over sum of expected; null where nothing is expected.

    pair_counts: (bin, counts); expected: one row with `density`, the sum over frames of ordered pairs by volume.
    """
    out = spine(pair_counts, n, "bin").withColumn("lo", F.col("bin") * F.lit(width)).withColumn("hi", (F.col("bin") + 1) * F.lit(width))
    out = out.join(pair_counts, "bin", "left").join(F.broadcast(expected))  # one row
    out = out.withColumn("expected", F.col("density") * shell_volume(F.col("lo"), F.col("hi")))
    return out.select("bin", "lo", "hi", F.coalesce("counts", F.lit(0)).alias("counts"), "expected", F.when(F.col("expected") > 0, F.coalesce("counts", F.lit(0)) / F.col("expected")).alias("g"))


def fold_sides(bins: DataFrame, value: str, by: str = "bin") -> DataFrame:
    """Equal-weight mean of the top and the bottom profile."""
    return bins.groupBy(by).agg(F.avg(value).alias(value))


def marginal(grid: DataFrame, axis: tuple[str, float, float, float], value: str, volume: float, filters: list[tuple[str, float, float, float, float]] = ()) -> DataFrame:
    """A line from a sparse grid: bins of (index column, start, width) summed into bins of the target width by their centre.

    filters: (index column, start, width, lo, hi), inclusive on bin centres. volume divides the sums.
    """
    for c, start, width, lo, hi in filters:
        grid = grid.where((start + (F.col(c) + 0.5) * width).between(lo, hi))
    c, start, width, target = axis
    out = grid.groupBy(F.floor((F.col(c) + 0.5) * width / target).cast("int").alias("bin")).agg(F.sum(value).alias(value))
    return out.withColumn("density", divided(F.col(value), F.lit(volume)))


def merge_axis(edges: list[float], width: float) -> list[int]:
    """For each bin the number of its group: consecutive bins are merged up to the width, a short rest joins the last group."""
    out, group, start = [], 0, edges[0]
    for i in range(len(edges) - 1):
        out.append(group)
        if edges[i + 1] - start >= width - 1e-12:
            group, start = group + 1, edges[i + 1]
    if out and out[-1] == group and group > 0 and edges[-1] - start < width - 1e-12:
        out = [min(g, group - 1) for g in out]
    return out


def averaged_maps(maps: DataFrame, by: list[str], value: str, frames: str = "n_frames") -> DataFrame:
    """Maps of several sources averaged by their frames."""
    return maps.groupBy(*by).agg((F.sum(F.col(value) * F.col(frames)) / F.sum(frames)).alias(value))


def conserved(points: DataFrame, weight: str, bins: DataFrame, total: str, rtol: float = 1e-12) -> DataFrame:
    """One row: the sums before and after binning, and whether they agree."""
    a, b = points.agg(F.sum(weight).alias("selected")), bins.agg(F.sum(total).alias("binned"))
    return a.join(F.broadcast(b)).withColumn("conserved", F.abs(F.col("selected") - F.col("binned")) <= rtol * F.abs(F.col("selected")))  # one row each


def heatmap_values(counts: DataFrame, x: str, y: str, dx: float, dy: float, mode: str) -> DataFrame:
    """A count map as raw counts, joint density, or density conditional on x."""
    from pyspark.sql import Window as W

    v = F.col("counts")
    if mode == "joint":
        v = v / (F.sum("counts").over(W.partitionBy()) * dx * dy)
    elif mode == "conditional":
        v = v / (F.sum("counts").over(W.partitionBy(x)) * dy)
    elif mode != "raw":
        raise ValueError(f"unknown mode {mode!r}")
    return counts.withColumn("value", v)


def enrichment(counts: DataFrame, x: str, y: str, bulk: Column) -> DataFrame:
    """Conditional share of each y relative to that of the bulk rows; null where the bulk has none."""
    from pyspark.sql import Window as W

    share = F.col("counts") / F.sum("counts").over(W.partitionBy(x))
    own = counts.where(bulk).groupBy(y).agg(F.sum("counts").alias("b"))
    base = own.withColumn("base", F.col("b") / F.sum("b").over(W.partitionBy())).select(y, "base")
    return counts.withColumn("share", share).join(base, y, "left").withColumn("value", F.try_divide("share", "base")).drop("share", "base")
