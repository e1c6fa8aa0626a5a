"""Electrostatic potential: planar averages, geometric windows, records, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import islands
from ..schema import BOHR_A, CSHE_OFFSET, HARTREE_EV

# Support of the solvent, window padding and kernel width, in units of angstrom.
SUPPORT, PADDING, BANDWIDTH = 0.015, 5.0, 1.5


def planar_average(cells: DataFrame) -> DataFrame:
    """(source, iz, value): mean over x and y of a volumetric field, summed before the shuffle."""
    return cells.groupBy("source", "iz").agg(F.avg("value").alias("value"))


def profile(cells: DataFrame, header: DataFrame) -> DataFrame:
    """(source, iz, z, value_ev): planar average of a Hartree field in eV at its height in angstrom; header has nz and dz in Bohr."""
    return planar_average(cells).join(F.broadcast(header.select("source", "dz")), "source").select("source", "iz", (F.col("iz") * F.col("dz") * BOHR_A).alias("z"), (F.col("value") * HARTREE_EV).alias("value_ev"))


def largest_gap(heights: DataFrame, period: Column | float) -> DataFrame:
    """(source, gap_from, gap): the largest periodic gap between substrate heights."""
    w = W.partitionBy("source").orderBy("z")
    nxt = F.coalesce(F.lead("z").over(w), F.first("z").over(w) + period)
    return heights.withColumn("gap", nxt - F.col("z")).groupBy("source").agg(F.max(F.struct("gap", F.col("z").alias("gap_from"))).alias("m")).select("source", "m.gap_from", "m.gap")


def window(density: DataFrame, support: float = SUPPORT, padding: float = PADDING) -> DataFrame:
    """(source, lo, hi, n_runs, valid): the one supported run of (source, z, density) less the padding; a shrunk or a second run is invalid."""
    runs = islands(density, ["source"], "z", F.col("density") >= support)
    out = runs.groupBy("source").agg(F.count("*").alias("n_runs"), F.min("start").alias("lo"), F.max("stop").alias("hi"))
    out = out.withColumn("lo", F.col("lo") + padding).withColumn("hi", F.col("hi") - padding)
    return out.withColumn("valid", (F.col("n_runs") == 1) & (F.col("lo") < F.col("hi")))


def in_window(profiles: DataFrame, windows: DataFrame) -> DataFrame:
    """(source, mean, std, range, gradient, n): values of the profile within each source's window; the gradient by least squares."""
    p = profiles.join(F.broadcast(windows.where("valid").select("source", "lo", "hi")), "source").where(F.col("z").between(F.col("lo"), F.col("hi")))
    return p.groupBy("source").agg(F.avg("value_ev").alias("mean"), F.stddev_samp("value_ev").alias("std"), (F.max("value_ev") - F.min("value_ev")).alias("range"), F.regr_slope("value_ev", "z").alias("gradient"), F.count("*").alias("n"))


def records(means: DataFrame, fermi: DataFrame) -> DataFrame:
    """(source, reference, fermi_ev, potential_cshe, status): incomplete where a Fermi energy or a window is missing."""
    out = means.select("source", F.col("mean").alias("reference")).join(fermi, "source", "full")
    u = F.col("reference") - F.col("fermi_ev") - CSHE_OFFSET
    return out.withColumn("potential_cshe", u).withColumn("status", F.when(u.isNull(), "incomplete").otherwise("complete"))


def sensitivity(windows: DataFrame, step: float = 0.5) -> DataFrame:
    """Four windows moved or resized by the step, beside each source's own."""
    moves = F.array(*(F.struct(F.lit(n).alias("perturbation"), F.lit(a).alias("da"), F.lit(b).alias("db")) for n, a, b in (("up", step, step), ("down", -step, -step), ("narrow", step, -step), ("wide", -step, step))))
    out = windows.where("valid").select("source", "lo", "hi", F.inline(moves))
    return out.select("source", "perturbation", (F.col("lo") + F.col("da")).alias("lo"), (F.col("hi") + F.col("db")).alias("hi"), F.lit(True).alias("valid"))
