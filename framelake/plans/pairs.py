"""Pair analyses: radial distribution functions, coordination numbers and their cutoffs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import histogram, pairs, statistics
from ..operators.fits import local_minimum
from ..schema import RDF_BIN, RDF_SIGMA, TAPER


def rdf(a: DataFrame, b: DataFrame, frames: DataFrame, lengths: tuple[float, float, float], r_max: float, width: float = RDF_BIN) -> DataFrame:
    """(bin, lo, hi, counts, expected, g, sample_n, sample_std, sample_sem) of a pair of selections in an orthorhombic cell.

    frames: frame_index and volume. g is the ratio of sums; its spread is that of counts / expected by frame, frames
    without pairs included.
    """
    n, width = histogram.uniform_rdf_bins(r_max, width)
    counted = pairs.auto_pairs(a, b, lengths, r_max)
    by_frame = counted.groupBy("frame_index", histogram.bin_index(F.col("r"), 0.0, width, n).alias("bin")).agg(F.count("*").alias("counts"))
    na, nb = (s.groupBy("frame_index").agg(F.count("*").alias(c)) for s, c in ((a, "na"), (b, "nb")))
    same = a.select("frame_index", "atom_index").join(b.select("frame_index", "atom_index"), ["frame_index", "atom_index"]).groupBy("frame_index").agg(F.count("*").alias("both"))
    density = frames.join(na, "frame_index").join(nb, "frame_index").join(same, "frame_index", "left")
    density = density.select("frame_index", ((F.col("na") * F.col("nb") - F.coalesce("both", F.lit(0))) / F.col("volume")).alias("density"))
    total = density.agg(F.sum("density").alias("density"), F.count("*").alias("frames"))
    sums = by_frame.groupBy("bin").agg(F.sum("counts").alias("counts"))
    out = histogram.rdf(sums, total.select("density"), n, width)
    shell = F.lit(4.0 / 3.0 * np.pi) * ((((F.col("bin") + 1) * width) ** 3) - ((F.col("bin") * width) ** 3))
    v = by_frame.join(density, "frame_index").withColumn("v", F.col("counts") / (F.col("density") * shell)).groupBy("bin").agg(F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("q"))
    out = out.join(v, "bin", "left").join(F.broadcast(total.select("frames")))  # one row
    mean = F.coalesce("s", F.lit(0.0)) / F.col("frames")
    std = F.when(F.col("frames") > 1, F.sqrt(F.greatest(F.coalesce("q", F.lit(0.0)) - F.col("frames") * mean**2, F.lit(0.0)) / (F.col("frames") - 1)))
    return out.withColumn("sample_n", F.col("frames")).withColumn("sample_std", std).withColumn("sample_sem", statistics.sem(std, F.col("frames"))).drop("s", "q", "frames")


def cutoff(profile: DataFrame, by: str, x: str = "centre", y: str = "g", sigma: float = RDF_SIGMA) -> DataFrame:
    """(by, peak, minimum, cutoff): first minimum behind the first peak of the smoothed curve, placed on the raw one. A curve is a bounded group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[np.isfinite(pdf[y].astype(float))].sort_values(x)
        out = dict.fromkeys(("peak", "minimum", "cutoff"), np.nan)
        xs, ys = d[x].to_numpy(float), d[y].to_numpy(float)
        if len(xs) > 4:
            s = sigma / np.diff(xs).mean()
            r = int(np.ceil(3 * s))
            k = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
            smooth = np.convolve(np.pad(ys, r, mode="edge"), k / k.sum(), "valid")
            peaks = np.flatnonzero((smooth[1:-1] >= smooth[:-2]) & (smooth[1:-1] > smooth[2:])) + 1
            if len(peaks):
                p = int(peaks[0])
                dips = np.flatnonzero((smooth[1:-1] <= smooth[:-2]) & (smooth[1:-1] < smooth[2:])) + 1
                dips = dips[dips > p]
                m = int(dips[0]) if len(dips) else p + int(np.argmin(smooth[p:]))
                if m < len(xs) - 1:
                    out = {"peak": xs[p], "minimum": xs[m], "cutoff": local_minimum(xs, ys, m)}
        return pd.DataFrame([{by: pdf[by].iloc[0], **out}])

    return profile.select(by, x, y).groupBy(by).applyInPandas(one, f"{by} {dict(profile.dtypes)[by]}, peak double, minimum double, cutoff double")


def coordination(a: DataFrame, b: DataFrame, lengths: tuple[float, float, float], cutoff_a: float, width: float = TAPER) -> DataFrame:
    """(frame_index, atom_index, coordination) of every centre."""
    return pairs.coordination(a, b, lengths, cutoff_a, width)


def mean_coordination(values: DataFrame) -> DataFrame:
    """(frame_index, mean, n) by frame."""
    return values.groupBy("frame_index").agg(F.avg("coordination").alias("mean"), F.count("*").alias("n"))
