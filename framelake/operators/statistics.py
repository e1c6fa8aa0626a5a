"""Frame moments, block statistics, bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import BLOCK_FRAMES, BLOCK_MAX, BLOCK_MIN_FRAMES
from .tables import numbered


def block_count(frames: int) -> int:
    """Contiguous blocks of a series: none below 100 frames, else one for each 25 frames, 20 at most."""
    return 0 if frames < BLOCK_MIN_FRAMES else min(BLOCK_MAX, frames // BLOCK_FRAMES)


def with_blocks(frames: DataFrame, order: str, count: int, name: str = "block") -> DataFrame:
    """Blocks of equal length by order; the first ones get the frames left over. frames: one row per frame."""
    ranked = numbered(frames, [order], "_i")
    ranked = ranked.join(F.broadcast(ranked.agg(F.count("*").alias("_n"))))  # one row
    short, more = F.floor(F.col("_n") / count), F.col("_n") % count
    first = F.floor(F.col("_i") / (short + 1))
    block = F.when(F.col("_i") < more * (short + 1), first).otherwise(more + F.floor((F.col("_i") - more * (short + 1)) / F.greatest(short, F.lit(1))))
    return ranked.withColumn(name, block.cast("int")).drop("_i", "_n")


def sem(std: Column, n: Column) -> Column:
    return std / F.sqrt(n)


def moments(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, std (null for one sample) and sem of a value."""
    out = samples.groupBy(*by).agg(F.count(value).alias("sample_n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_std"))
    return out.withColumn("sample_sem", sem(F.col("sample_std"), F.col("sample_n")))


def dense_moments(sums: DataFrame, bin_name: str, value: str, frames: int) -> DataFrame:
    """Moments over all frames, from the sums of those that have samples: absent frames count as 0 and are never made.

    sums has one row for each (bin, frame) with samples.
    """
    v = F.col(value)
    out = sums.groupBy(bin_name).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    mean = F.col("s") / frames
    std = F.sqrt(F.greatest(F.col("q") - frames * mean * mean, F.lit(0.0)) / (frames - 1)) if frames > 1 else F.lit(None).cast("double")
    out = out.withColumn("sample_n", F.lit(frames)).withColumn("mean", mean).withColumn("sample_std", std)
    return out.withColumn("sample_sem", sem(F.col("sample_std"), F.col("sample_n"))).drop("s", "q")


def block_moments(samples: DataFrame, by: list[str], value: str, block: str = "block") -> DataFrame:
    """Mean of each block, then n, std and sem across blocks."""
    means = samples.groupBy(*by, block).agg(F.avg(value).alias("m"))
    out = means.groupBy(*by).agg(F.count("m").alias("block_n"), F.avg("m").alias("block_mean"), F.stddev_samp("m").alias("block_std"))
    return out.withColumn("block_sem", sem(F.col("block_std"), F.col("block_n")))


def pooled(stats: DataFrame, by: list[str], n: str, mean: str, std: str) -> DataFrame:
    """n, mean and std of merged bins, from those of their parts."""
    s = stats.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.col(mean)).alias("s"), F.sum((F.col(n) - 1) * F.coalesce(F.col(std), F.lit(0.0)) ** 2 + F.col(n) * F.col(mean) ** 2).alias("q"))
    s = s.withColumn("mean", F.col("s") / F.col("n"))
    return s.withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("q") - F.col("n") * F.col("mean") ** 2, F.lit(0.0)) / (F.col("n") - 1)))).drop("s", "q")


def frames_first(samples: DataFrame, x: str, y: str, width: float, frame: str, reducer: str = "mean") -> DataFrame:
    """Groups by x bin and frame first, then mean, std and sem over the frames of each bin."""
    reduce = {"mean": F.avg, "median": F.median}[reducer]
    each = samples.groupBy(F.floor(F.col(x) / width).cast("long").alias("bin"), frame).agg(reduce(F.col(y)).alias("v"))
    return moments(each, ["bin"], "v")


def summary(records: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, std (0 for one value) and n over the finite values."""
    v = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.col(value))
    return records.groupBy(*by).agg(F.avg(v).alias("mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("std"), F.count(v).alias("n"))


def trimmed_mean(values: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Mean without the share of the smallest and of the largest values, both rounded down."""
    w = W.partitionBy(*by)
    ranked = values.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    cut = F.floor(F.col("_n") * share)
    return ranked.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut)).groupBy(*by).agg(F.avg(value).alias("trimmed_mean"))


def mobility(atoms: DataFrame) -> DataFrame:
    """(atom_index, mobility): median over frames of the distance to the atom's median position."""
    mid = atoms.groupBy("atom_index").agg(*(F.median(c).alias(f"{c}m") for c in "xyz"))
    d = F.sqrt(sum(((F.col(c) - F.col(f"{c}m")) ** 2 for c in "yz"), (F.col("x") - F.col("xm")) ** 2))
    return atoms.join(mid, "atom_index").groupBy("atom_index").agg(F.median(d).alias("mobility"))


def side_quantile(values: DataFrame, by: list[str], value: str, side: str, q: float) -> DataFrame:
    return values.groupBy(*by).agg(F.percentile(value, F.lit(q if side == "top" else 1 - q)).alias("quantile"))


def temperature(velocities: DataFrame, by: list[str], *, remove_com: bool = True) -> DataFrame:
    """Kinetic temperature of (mass in kg, vx, vy, vz in m/s): sum of m v^2 (less the centre's) over dof * k_B; null without freedom."""
    from ..schema import BOLTZMANN

    m = F.col("mass_kg")
    agg = [F.count("*").alias("n"), F.sum(m).alias("m"), F.sum(m * (F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)).alias("e"), *(F.sum(m * F.col(c)).alias(f"p{c}") for c in ("vx", "vy", "vz"))]
    out = velocities.groupBy(*by).agg(*agg)
    e = F.col("e") - (F.col("pvx") ** 2 + F.col("pvy") ** 2 + F.col("pvz") ** 2) / F.col("m") if remove_com else F.col("e")
    dof = 3 * F.col("n") - (3 if remove_com else 0)
    return out.select(*by, "n", F.when(dof > 0, F.greatest(e, F.lit(0.0)) / (dof * BOLTZMANN)).alias("temperature_k"))


def populations(waters: DataFrame, frames: int) -> DataFrame:
    """(side, mean_count, persistence): waters of a side in contact by frame, and the share of frames with any."""
    each = waters.groupBy("side", "frame_index").agg(F.count_if("contact").alias("n"))
    return each.groupBy("side").agg((F.sum("n") / frames).alias("mean_count"), (F.count_if(F.col("n") > 0) / frames).alias("persistence"))


# ---- resampling: blocks(profile_uid, bin, component, block, numerator, denominator, length)


def subset_blocks(blocks: DataFrame, bins: list[int] | None = None, scale: float = 1.0) -> DataFrame:
    """Blocks of some bins, their numerators (of both sides) rescaled."""
    out = blocks if bins is None else blocks.where(F.col("bin").isin(bins))
    return out.withColumn("numerator", F.col("numerator") * scale)


def combine_sides(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Statistics of both sides together: components 0 and 1, n the smaller, spread unknown."""
    t, b = (d.select("bin", "block", F.col("sample_n").alias(f"n{i}"), F.col("numerator").alias(f"num{i}"), F.col("denominator").alias(f"den{i}")) for i, d in enumerate((top, bottom)))
    both = t.join(b, ["bin", "block"])
    parts = F.array(*(F.struct(F.lit(i).alias("component"), F.col(f"num{i}").alias("numerator"), F.col(f"den{i}").alias("denominator")) for i in range(2)))
    return both.select("bin", "block", F.least("n0", "n1").alias("sample_n"), F.lit(None).cast("double").alias("sample_std"), F.lit(None).cast("double").alias("sample_sem"), F.inline(parts))


def merge_blocks(blocks: DataFrame, factor: int) -> DataFrame:
    """Neighbouring blocks summed by the factor."""
    return blocks.groupBy("bin", "component", F.floor(F.col("block") / factor).cast("int").alias("block")).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))


def weights_of(blocks: int, repeats: int, seed: int) -> np.ndarray:
    """(repeats, blocks) multinomial weights, one matrix for all bins."""
    return np.random.default_rng(seed).multinomial(blocks, np.full(blocks, 1.0 / blocks), size=repeats)


def estimate(w: np.ndarray, num: np.ndarray, den: np.ndarray, kind: str) -> np.ndarray:
    """Draws of an estimator; num and den are (components, blocks)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "ratio":
            return (w @ num[0]) / (w @ den[0])
        if kind == "side_mean":
            return np.mean([(w @ n) / (w @ d) for n, d in zip(num, den)], axis=0)
        if kind == "product":
            return np.prod([(w @ n) / (w @ d) for n, d in zip(num, den)], axis=0)
        if kind == "median":
            v, order = num[0] / den[0], None
            order = np.argsort(v)
            up = np.cumsum(w[:, order], axis=1)
            return v[order][(up >= up[:, -1:] / 2).argmax(axis=1)]
    raise ValueError(f"unknown estimator {kind!r}")


def bootstrap(blocks: DataFrame, *, confidence: float = 0.95, repeats: int = 1000, seed: int = 0, kind: str = "ratio", merge: int = 1) -> DataFrame:
    """(bin, low, high, n_blocks): percentile intervals; null below four blocks or with less than 90 % finite draws.

    A bin has at most 20 blocks and components, so its group is bounded; all bins use the same weights.
    """
    if merge > 1:
        blocks = merge_blocks(blocks, merge)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        num = pdf.pivot_table(index="component", columns="block", values="numerator").to_numpy()
        den = pdf.pivot_table(index="component", columns="block", values="denominator").to_numpy()
        low = high = np.nan
        if num.shape[1] >= 4:
            draws = estimate(weights_of(num.shape[1], repeats, seed), num, den, kind)
            good = draws[np.isfinite(draws)]
            if len(good) >= 0.9 * repeats:
                low, high = np.quantile(good, [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame({"bin": [pdf["bin"].iloc[0]], "low": [low], "high": [high], "n_blocks": [num.shape[1]]})

    out = blocks.groupBy("bin").applyInPandas(one, "bin long, low double, high double, n_blocks long")
    return out.select("bin", F.nanvl("low", F.lit(None).cast("double")).alias("low"), F.nanvl("high", F.lit(None).cast("double")).alias("high"), "n_blocks")


def stability(blocks: DataFrame, **options) -> DataFrame:
    """(merge, median_width): median interval width with blocks merged by 1, 2 and 4."""
    out = None
    for m in (1, 2, 4):
        one = bootstrap(blocks, merge=m, **options).agg(F.median(F.col("high") - F.col("low")).alias("median_width")).select(F.lit(m).alias("merge"), "median_width")
        out = one if out is None else out.unionByName(one)
    return out


def time_step(frames: DataFrame, time: str = "time_fs") -> DataFrame:
    """One row: the spacing of the frames where it is uniform, else null."""
    d = frames.select((F.col(time) - F.lag(time).over(W.orderBy(time))).alias("d"))
    return d.agg(F.when(F.max("d") - F.min("d") <= 1e-9 * F.max("d"), F.min("d")).alias("time_step_fs"))


def batched(frames: DataFrame, order: str, size: int, name: str = "batch") -> DataFrame:
    """Rows with the number of their run of `size` rows in order."""
    return numbered(frames, [order], "_i").withColumn(name, F.floor(F.col("_i") / size).cast("long")).drop("_i")


def batches(values: list, size: int) -> Iterator[list]:
    for i in range(0, math.ceil(len(values) / size)):
        yield values[i * size : (i + 1) * size]
