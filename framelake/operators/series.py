"""Transforms of stored series before display: rebin, normalise, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import interpolate
from .statistics import sem

REDUCERS = {"mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max}


def rebin(series: DataFrame, by: list[str], x: str, y: str, width: float, reducer: str = "mean") -> DataFrame:
    """Groups floor((x - least x) / width) of each series: x by mean, y by the reducer."""
    least = series.groupBy(*by).agg(F.min(x).alias("_0"))
    g = series.join(least, by).withColumn("group_id", F.floor((F.col(x) - F.col("_0")) / width).cast("long"))
    return g.groupBy(*by, "group_id").agg(F.avg(x).alias("x"), REDUCERS[reducer](F.col(y)).alias("y"))


def grouped(series: DataFrame, by: list[str], x: str, y: str, reducer: str = "mean", width: float | None = None) -> DataFrame:
    """Groups of equal x, or of a width from 0: n, reduced y, std and sem."""
    key = F.col(x) if width is None else F.floor(F.col(x) / width).cast("long")
    out = series.groupBy(*by, key.alias("x")).agg(F.count(y).alias("n"), REDUCERS[reducer](F.col(y)).alias("y"), F.stddev_samp(y).alias("std"))
    return out.withColumn("sem", sem(F.col("std"), F.col("n")))


def normalise(series: DataFrame, by: list[str], x: str, y: str, mode: str, target: float = 1.0, reference: float = 0.0) -> DataFrame:
    """y * target / source: source is the largest y, the area, the value at x = reference, or 1 (factor); null where it is about 0."""
    if mode == "none":
        return series.withColumn("normalised", F.col(y))
    if mode == "factor":
        return series.withColumn("normalised", F.col(y) * target)
    if mode == "max":
        source = series.groupBy(*by).agg(F.max(y).alias("_s"))
    elif mode == "area":
        source = trapezoid(series, by, x, y)
    elif mode == "value_at_x":
        source = interpolate(series, by, x, y, reference).withColumnRenamed("value", "_s")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return series.join(source, by).withColumn("normalised", F.when(F.abs("_s") > 1e-300, F.col(y) * target / F.col("_s"))).drop("_s")


def trapezoid(series: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(x)
    part = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    return series.withColumn("_p", part).groupBy(*by).agg(F.sum("_p").alias("_s"))


def group_layers(series: DataFrame, group: str, x: str, y: str, reducer: str = "mean") -> DataFrame:
    """Members of a group combined at each x."""
    return series.groupBy(group, x).agg(REDUCERS[reducer](F.col(y)).alias("y"))


def axis_limits(series: DataFrame, x: str, y: str, *, nonzero: bool = False, padding: float = 0.05) -> DataFrame:
    """One row of limits with padding; x of values other than 0 if asked."""
    s = series.where(F.col(y) != 0) if nonzero else series
    a = s.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    pad = lambda c: (F.col(f"{c}1") - F.col(f"{c}0")) * padding
    return a.select(*((F.col(f"{c}{i}") + (pad(c) if i else -pad(c))).alias(f"{c}_{n}") for c in "xy" for i, n in enumerate(("min", "max"))))


def common_edges(bounds: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """Edges shared by all sources, from their bounds."""
    b = bounds.agg(F.floor(F.min(lo) / width).alias("a"), F.ceil(F.max(hi) / width).alias("z"))
    return b.select(F.explode(F.sequence("a", "z")).alias("k")).select((F.col("k") * F.lit(width)).alias("edge"))


def prepare(series: DataFrame, by: list[str], x: str, y: str, *, width: float | None = None, reducer: str = "mean", mode: str = "none", target: float = 1.0, least: int = 1) -> DataFrame:
    """A series as it is shown: groups of x with n, y, std and sem, scaled alike, thin groups left out."""
    out = grouped(series, by, x, y, reducer, width).where(F.col("n") >= least)
    out = normalise(out, by, "x", "y", mode, target)
    scale = F.try_divide("normalised", "y")
    return out.select(*by, "x", "n", F.col("normalised").alias("y"), (F.col("std") * scale).alias("std"), (F.col("sem") * scale).alias("sem"))


def interface_view(bins: DataFrame, view: str, value: str, by: str = "bin", side: str = "side") -> DataFrame:
    """One side of an interface, both folded into one, all rows (full), or both sides beside one another (comparison)."""
    if view in ("top", "bottom"):
        return bins.where(F.col(side) == view)
    if view == "folded":
        return bins.groupBy(by).agg(F.avg(value).alias(value))
    if view == "comparison":
        return bins.groupBy(by).agg(*(F.max(F.when(F.col(side) == s, F.col(value))).alias(f"{value}_{s}") for s in ("top", "bottom")))
    if view == "full":
        return bins
    raise ValueError(f"unknown view {view!r}")


def available_statistics(stats: DataFrame) -> list[str]:
    """Error statistics that the columns allow, the preferred one first."""
    return statistics_of(stats.columns)


def statistics_of(columns: list[str]) -> list[str]:
    have = set(columns)
    ci = ["block_ci"] if {"numerator", "denominator", "block"} <= have else []
    return ci + [c for c in ("block_sem", "block_std", "sample_sem", "sample_std") if c in have] + ["none"]


def provenance(stats: DataFrame, wanted: str) -> str:
    """Where an error bar comes from, in words."""
    return provenance_of(stats.columns, wanted)


def provenance_of(columns: list[str], wanted: str) -> str:
    if wanted not in statistics_of(columns):
        return "none"
    if wanted in ("block_ci", "none"):
        return {"block_ci": "bootstrap over contiguous blocks", "none": "none"}[wanted]
    kind, spread = wanted.split("_")
    return f"{spread} over {kind}s"


def unpivot(records: DataFrame, keys: list[str], quantities: list[str]) -> DataFrame:
    """(keys, quantity, value) in a row for each quantity that is known."""
    return records.select(*keys, F.inline(F.array(*(F.struct(F.lit(q).alias("quantity"), F.col(q).cast("double").alias("value")) for q in quantities)))).where("value is not null")


def bulk_rows(series: DataFrame, by: list[str], x: str, y: str, mode: str = "auto", low: float | None = None, high: float | None = None) -> DataFrame:
    """(by, start, stop) of the bulk: the longest plateau, or the range that is given."""
    from .ordered import plateau

    if mode == "auto":
        return plateau(series, by, x, y).select(*by, "start", "stop")
    return series.select(*by).distinct().select(*by, F.lit(low).alias("start"), F.lit(high).alias("stop"))
