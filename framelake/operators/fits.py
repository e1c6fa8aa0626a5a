"""Fits of series: linear and polynomial in SQL sums, the others by damped least squares on each bounded series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODELS = {
    "linear": ("slope", "intercept"), "polynomial": (), "logarithmic": ("a", "b"), "exponential": ("a", "b", "c"),
    "power": ("a", "b"), "gaussian": ("height", "centre", "sigma", "offset"), "lorentzian": ("height", "centre", "gamma", "offset"),
}


def linear(series: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """(by, slope, intercept, r2, rmse): rmse over n."""
    out = series.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("_s"), F.regr_count(y, x).alias("n"))
    return out.withColumn("rmse", F.sqrt(F.greatest(F.col("_s") * (1 - F.col("r2")), F.lit(0.0)) / F.col("n"))).drop("_s")


def logarithmic(series: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """y = slope * ln x + intercept over positive x."""
    return linear(series.where(x > 0), by, F.ln(x), y)


def parabola(series: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """(by, c0, c1, c2, vertex_x, vertex_y) of a least-squares parabola, from sums of powers about the mean."""
    mean = series.groupBy(*by).agg(F.avg(x).alias("_m"))
    u = x - F.col("_m")
    s = series.join(mean, by).groupBy(*by, "_m").agg(*(F.sum(u**k).alias(f"s{k}") for k in range(5)), *(F.sum(y * u**k).alias(f"t{k}") for k in range(3)))
    c = lambda n: F.col(n)
    det = c("s0") * (c("s2") * c("s4") - c("s3") ** 2) - c("s1") * (c("s1") * c("s4") - c("s2") * c("s3")) + c("s2") * (c("s1") * c("s3") - c("s2") ** 2)
    d0 = c("t0") * (c("s2") * c("s4") - c("s3") ** 2) - c("s1") * (c("t1") * c("s4") - c("t2") * c("s3")) + c("s2") * (c("t1") * c("s3") - c("t2") * c("s2"))
    d1 = c("s0") * (c("t1") * c("s4") - c("t2") * c("s3")) - c("t0") * (c("s1") * c("s4") - c("s2") * c("s3")) + c("s2") * (c("s1") * c("t2") - c("s2") * c("t1"))
    d2 = c("s0") * (c("s2") * c("t2") - c("s3") * c("t1")) - c("s1") * (c("s1") * c("t2") - c("s2") * c("t1")) + c("t0") * (c("s1") * c("s3") - c("s2") ** 2)
    s = s.withColumn("_0", F.try_divide(d0, det)).withColumn("_1", F.try_divide(d1, det)).withColumn("c2", F.try_divide(d2, det))
    m = F.col("_m")
    s = s.withColumn("c1", F.col("_1") - 2 * F.col("c2") * m).withColumn("c0", F.col("_0") - F.col("_1") * m + F.col("c2") * m * m)
    vx = F.try_divide(-F.col("c1"), 2 * F.col("c2"))
    return s.select(*by, "c0", "c1", "c2", vx.alias("vertex_x"), (F.col("c0") + F.col("c1") * vx / 2).alias("vertex_y"))


def shape(kind: str, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        if kind == "exponential":
            return p[0] * np.exp(p[1] * x) + p[2]
        if kind == "power":
            return p[0] * x ** p[1]
        if kind == "gaussian":
            return p[0] * np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2) + p[3]
        if kind == "lorentzian":
            return p[0] * p[2] ** 2 / ((x - p[1]) ** 2 + p[2] ** 2) + p[3]
    raise ValueError(f"unknown model {kind!r}")


def start(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    span = max(np.ptp(x), 1e-12)
    if kind == "exponential":
        return np.array([np.ptp(y) or 1.0, (1 if y[-1] >= y[0] else -1) / span, y.min()])
    if kind == "power":
        good = (x > 0) & (y > 0)
        b, a = np.polyfit(np.log(x[good]), np.log(y[good]), 1) if good.sum() > 1 else (1.0, 0.0)
        return np.array([np.exp(a), b])
    k = int(np.argmax(np.abs(y - np.median(y))))
    return np.array([y[k] - np.median(y), x[k], span / 6, np.median(y)])


def least_squares(kind: str, x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Parameters and sum of squares by Levenberg and Marquardt's damping."""
    p, damp = start(kind, x, y), 1e-3
    r = y - shape(kind, x, p)
    best = float(r @ r)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        j = np.stack([(shape(kind, x, p + d) - shape(kind, x, p - d)) / (2 * d.sum()) for d in np.diag(step)], axis=1)
        if not np.isfinite(j).all():
            break
        a, g = j.T @ j, j.T @ r
        try:
            q = p + np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g)
        except np.linalg.LinAlgError:
            break
        s = y - shape(kind, x, q)
        now = float(s @ s)
        if np.isfinite(now) and now < best:
            done = best - now <= 1e-14 * best
            p, r, best, damp = q, s, now, max(damp / 3, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p, best


def nonlinear(series: DataFrame, by: str, x: str, y: str, kind: str) -> DataFrame:
    """(by, parameter, value) with r2 and rmse among the parameters; a series is a profile of bounded length."""
    names = MODELS[kind]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna(subset=[x, y]).sort_values(x)
        if kind == "power":
            d = d[d[x] > 0]
        out = {n: np.nan for n in (*names, "r2", "rmse")}
        if len(d) > len(names):
            xs, ys = d[x].to_numpy(float), d[y].to_numpy(float)
            p, ss = least_squares(kind, xs, ys)
            if kind in ("gaussian", "lorentzian"):
                p[2] = abs(p[2])
            total = float(((ys - ys.mean()) ** 2).sum())
            out = dict(zip(names, p)) | {"r2": 1 - ss / total if total else np.nan, "rmse": float(np.sqrt(ss / len(d)))}
        return pd.DataFrame({by: pdf[by].iloc[0], "parameter": list(out), "value": list(out.values())})

    return series.select(by, x, y).groupBy(by).applyInPandas(one, f"{by} {dict(series.dtypes)[by]}, parameter string, value double")


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation with Fritsch and Carlson's slopes."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        return y[0] + d[0] * (at - x[0])
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])
    for e, (i, j) in ((0, (0, 1)), (-1, (-1, -2))):
        v = ((2 * h[i] + h[j]) * d[i] - h[i] * d[j]) / (h[i] + h[j])
        m[e] = 0.0 if v * d[i] <= 0 else 3 * d[i] if d[i] * d[j] < 0 and abs(v) > 3 * abs(d[i]) else v
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    t = (at - x[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * m[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h[k] * m[k + 1]


def local_minimum(x: np.ndarray, y: np.ndarray, centre: int) -> float:
    """Where the curve within a bin of the centre is least, on a dense monotone interpolation."""
    a, z = max(centre - 1, 0), min(centre + 1, len(x) - 1)
    at = np.linspace(x[a], x[z], max(256, 128 * (z - a)))
    return float(at[np.argmin(pchip(x[a : z + 1], y[a : z + 1], at))])
