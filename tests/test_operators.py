"""Operators on small hand-made inputs and against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.functions import units
from framelake.operators import fits, histogram, ordered, pairs, select, statistics, tables
from framelake.operators import series as S
from framelake.plans import alignment, profiles, surface
from framelake.plans import pairs as plans
from framelake.plans import potential

CUBE10 = (10.0, 10.0, 10.0)


def atoms_df(spark, rows):
    """rows: frame, element, x, y, z."""
    out, count = [], {}
    for f, e, x, y, z in rows:
        i = count.get(f, 0)
        count[f] = i + 1
        out.append((f, i, e, e, float(x), float(y), float(z), False))
    df = spark.createDataFrame(out, "frame_index long, atom_index long, element string, raw_species string, x double, y double, z double, is_fixed boolean")
    return df.withColumn("mass_amu", F.element_at(pairs.masses(), F.col("element")))


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    return atoms_df(spark, [(f, "OHPt"[k] if k < 2 else "Pt", *rng.uniform(0, 10, 3)) for f in range(3) for k in rng.integers(0, 3, 60)]).cache()


def brute_pairs(pdf, r_max, same=None):
    out = []
    for f, g in pdf.groupby("frame_index"):
        p = g[["x", "y", "z"]].to_numpy()
        d = p[:, None] - p[None]
        d -= 10 * np.rint(d / 10)
        r = np.sqrt((d**2).sum(-1))
        for i in range(len(p)):
            for j in range(len(p)):
                if i != j and r[i, j] <= r_max:
                    out.append((f, int(g["atom_index"].iloc[i]), int(g["atom_index"].iloc[j]), r[i, j]))
    return out


# ---- pairs


@pytest.mark.parametrize("r_max", [1.0, 2.5, 4.0, 5.0])
def test_pair_strategies_agree(cloud, r_max):
    want = sorted((f, i, j, round(r, 9)) for f, i, j, r in brute_pairs(cloud.toPandas(), r_max))
    for make in (pairs.dense_pairs, pairs.cell_pairs):
        got = make(cloud, cloud, CUBE10, r_max).select("frame_index", "atom_index_a", "atom_index_b", "r").collect()
        assert sorted((a, b, c, round(r, 9)) for a, b, c, r in got) == want
    if r_max <= 2.5:
        got = pairs.image_pairs(cloud, cloud, [10.0, 0, 0, 0, 10.0, 0, 0, 0, 10.0], r_max).select("frame_index", "atom_index_a", "atom_index_b", "r").collect()
        assert sorted((a, b, c, round(r, 9)) for a, b, c, r in got) == want


def test_cells_need_half_a_cell(cloud):
    with pytest.raises(ValueError):
        pairs.cell_pairs(cloud, cloud, CUBE10, 5.5)


def test_nearest(cloud):
    t, s = cloud.where("element = 'O'"), cloud.where("element = 'Pt'")
    a = sorted(map(tuple, pairs.nearest(t, s, CUBE10).collect()))
    b = sorted(map(tuple, pairs.nearest_in_shells(t, s, CUBE10, 0.7).select("frame_index", "atom_index", "nearest", "distance").collect()))
    assert a == b and len(a) == t.count()


def test_coordination_taper(spark):
    df = atoms_df(spark, [(0, "O", 0, 0, 0), (0, "H", 0.7, 0, 0), (1, "O", 0, 0, 0), (1, "H", 1.1, 0, 0), (2, "O", 0, 0, 0), (2, "H", 3, 0, 0)])
    got = [r["coordination"] for r in pairs.coordination(df.where("element = 'O'"), df.where("element = 'H'"), CUBE10, 1.0, 0.4).orderBy("frame_index").collect()]
    assert got == pytest.approx([1.0, 0.5 * (1 + math.cos(math.pi * 0.75)), 0.0])
    hard = pairs.coordination(df.where("element = 'O'"), df.where("element = 'H'"), CUBE10, 1.1).orderBy("frame_index").collect()
    assert [r["coordination"] for r in hard] == [1, 1, 0]


WATER = [(0, "O", 5, 5, 5), (0, "H", 5.8, 5, 5.4), (0, "H", 4.2, 5, 5.4)]


def test_molecules(spark):
    rows = WATER + [(0, "H", 1, 1, 1), (0, "O", 1, 8, 8), (0, "H", 1.9, 8, 8), (0, "O", 3, 2, 2), (0, "O", 3, 3.6, 2), (0, "H", 3, 2.8, 2), (0, "O", 8, 1, 1)]
    df = atoms_df(spark, rows)
    m = pairs.molecules(df, pairs.bonds(df, CUBE10)).collect()
    assert {(r["label"], r["anchor"], tuple(r["members"])) for r in m} == {("mol:H2O", 0, (0, 1, 2)), ("mol:H", 3, (3,)), ("mol:OH", 4, (4, 5)), ("mol:O", 9, (9,))}  # 6, 7, 8 are ambiguous


def test_centre_of_mass_across_the_boundary(spark):
    df = atoms_df(spark, [(0, "O", 9.9, 5, 5), (0, "H", 0.5, 5, 5.4), (0, "H", 9.3, 5, 5.4)])
    m = pairs.molecules(df, pairs.bonds(df, CUBE10))
    c = pairs.centres_of_mass(m, df, CUBE10).first()
    assert c["mass"] == pytest.approx(18.015) and c["x"] == pytest.approx(9.9 + (0.6 - 0.6) * 1.008 / 18.015)
    whole = profiles.apply_pbc(df.withColumn("x", F.col("x") + 0.5), CUBE10, whole=True).orderBy("atom_index").collect()
    assert [round(r["x"], 6) for r in whole] == pytest.approx([0.4, 1.0, -0.2])


# ---- analyses


def test_rdf_two_atoms(spark):
    df = atoms_df(spark, [(0, "O", 0, 0, 0), (0, "H", 1, 0, 0)])
    frames = spark.createDataFrame([(0, 1000.0)], "frame_index long, volume double")
    got = plans.rdf(df.where("element = 'O'"), df.where("element = 'H'"), frames, CUBE10, 2.0, 1.0).orderBy("bin").collect()
    assert [r["counts"] for r in got] == [0, 1]
    assert [r["g"] for r in got] == pytest.approx([0, 1 / (4 / 3 * math.pi * 7 / 1000)])


def test_rdf_against_numpy(spark, cloud):
    frames = spark.createDataFrame([(f, 1000.0) for f in range(3)], "frame_index long, volume double")
    a = cloud.where("element = 'Pt'")
    got = plans.rdf(a, a, frames, CUBE10, 4.0, 0.5).orderBy("bin").toPandas()
    pdf = a.toPandas()
    n = pdf.groupby("frame_index").size()
    r = np.array([x[3] for x in brute_pairs(pdf, 4.0)])
    edges = np.linspace(0, 4, 9)
    expected = (n * (n - 1)).sum() / 1000 * 4 / 3 * np.pi * np.diff(edges**3)
    assert got["g"].to_numpy() == pytest.approx(np.histogram(r, edges)[0] / expected)
    by = np.array([np.histogram([x[3] for x in brute_pairs(g, 4.0)], edges)[0] / (len(g) * (len(g) - 1) / 1000 * 4 / 3 * np.pi * np.diff(edges**3)) for _, g in pdf.groupby("frame_index")])
    assert got["sample_std"].to_numpy() == pytest.approx(by.std(axis=0, ddof=1), abs=1e-9)


def test_cutoff(spark):
    x = np.arange(0.025, 6, 0.05)
    g = 2 * np.exp(-((x - 1.0) ** 2) / 0.02) + 1 / (1 + np.exp(-(x - 2.6) * 6)) + 0.02 * (x - 1.9) ** 2
    df = spark.createDataFrame(pd.DataFrame({"pair": "OH", "centre": x, "g": g}))
    r = plans.cutoff(df, "pair").first()
    assert r["peak"] == pytest.approx(1.0, abs=0.06) and abs(r["cutoff"] - x[np.argmin(np.where((x > 1.2) & (x < 2.6), g, 9))]) < 0.06


def test_water_angles(spark):
    df = atoms_df(spark, WATER)
    a = profiles.angles(profiles.waters(df, CUBE10), 2, CUBE10).first()
    assert a["cos_polar"] == pytest.approx(1.0) and a["cos_azimuthal"] == pytest.approx(0.0) and a["height"] == 5
    o = profiles.orientation(profiles.angles(profiles.waters(df, CUBE10), 2, CUBE10), 0.5).first()
    assert (o["bin"], o["n_valid"]) == (10, 1)


def test_density_conserves_mass(cloud):
    out = profiles.density(cloud, "z", 0.0, 0.5, 20, 3, 100.0).toPandas()
    pdf = cloud.toPandas()
    assert out["point_count"].sum() == len(pdf) and len(out) == 20
    assert (out["density"] * 50 / 1.66053906660).sum() * 3 == pytest.approx(pdf["mass_amu"].sum())
    by = np.array([np.histogram(g["z"], np.linspace(0, 10, 21), weights=g["mass_amu"])[0] for _, g in pdf.groupby("frame_index")]) * 1.66053906660 / 50
    assert out.sort_values("bin")["sample_std"].to_numpy() == pytest.approx(by.std(axis=0, ddof=1), abs=1e-9)


def test_potential_window(spark):
    z = np.arange(0, 40, 0.5)
    rho = np.where((z >= 10) & (z <= 30), 0.03, 0.0)
    line = spark.createDataFrame(pd.DataFrame({"source": "a", "z": z, "density": rho, "value_ev": 2.0 + 0.1 * z}))
    w = potential.window(line)
    assert w.first().asDict() == {"source": "a", "n_runs": 1, "lo": 15.0, "hi": 25.0, "valid": True}
    m = potential.in_window(line, w).first()
    assert (m["n"], m["gradient"], m["mean"]) == (21, pytest.approx(0.1), pytest.approx(4.0))
    assert not potential.window(line, padding=11.0).first()["valid"]
    two = line.withColumn("density", F.when(F.col("z") == 20, 0.0).otherwise(F.col("density")))
    assert not potential.window(two).first()["valid"]
    gap = potential.largest_gap(spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", 9.0)], "source string, z double"), 20.0).first()
    assert (gap["gap_from"], gap["gap"]) == (9.0, 12.0)


# ---- surface


def slab(spark, frames=9, shift=lambda f: 0.0, broken=()):
    rows = []
    for f in range(frames):
        for k, z in enumerate((6.0, 8.0, 10.0)):
            for i in range(9):
                bump = 3.0 if f in broken and k == 2 and i < 8 else 0.0
                rows.append((f, "Pt", i % 3 * 3, i // 3 * 3, z + shift(f) + 0.01 * math.sin(f + i) - bump * (i + 1) / 4))
    return atoms_df(spark, rows)


def test_layered_surface(spark):
    out = surface.layered(slab(spark, shift=lambda f: 0.05 * f)).orderBy("frame_index").toPandas()
    assert out["value"].to_numpy() == pytest.approx(10 + 0.05 * np.arange(9), abs=0.02) and (out["size"] == 9).all() and (out["provenance"] == "direct_layered").all()
    assert (out["confidence"] > 0.9).all()
    low = surface.layered(slab(spark), surface.Options(side="bottom"))
    assert low.toPandas()["value"].to_numpy() == pytest.approx(np.full(9, 6.0), abs=0.02)
    assert surface.trusted(surface.layered(slab(spark))).first()["trusted"]


def test_surface_jump(spark):
    out = surface.layered(slab(spark, shift=lambda f: 5.0 if f == 4 else 0.0)).orderBy("frame_index").toPandas()
    assert out.loc[4, "reason"] == "jump_reject" and np.isnan(out.loc[4, "value"]) and out.loc[4, "confidence"] == 0


def test_rough_surface_and_choice(spark):
    out = surface.rough(slab(spark)).toPandas()
    assert (out["provenance"] == "direct_rough_low_mobility").all() and out["value"].to_numpy() == pytest.approx(np.full(9, 10.0), abs=0.05)
    best, mode = surface.estimate(slab(spark))
    assert mode in ("layered", "rough") and best.count() == 9
    with pytest.raises(ValueError):
        surface.Options(side="left")


def test_surface_elements(spark):
    rng = np.random.default_rng(2)
    rows = [(f, e, x, 0, z + s * rng.normal()) for f in range(6) for e, n, z, s in (("Pt", 12, 5, 0.01), ("O", 8, 9, 1.0), ("H", 16, 9, 1.5)) for x in range(n)]
    assert [r["element"] for r in surface.surface_elements(atoms_df(spark, rows)).collect()] == ["Pt"]


def test_layout(spark):
    p = lambda t, b: spark.createDataFrame([("top", 20.0, t), ("bottom", 20.0, b)], "side string, mean_count double, persistence double")
    assert surface.layout(p(1.0, 1.0), True, True, 40) == "symmetric"
    assert surface.layout(p(1.0, 0.2), True, True, 40) == "single-top"
    assert surface.layout(p(0.0, 1.0), True, True, 40) == "single-bottom"
    assert surface.layout(p(0.0, 0.0), False, False, 40) == "axis"


# ---- alignment


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n in (1, 3, 5):
        c = rng.random((n, n + 1))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n + 1), n))
        got = alignment.assign(c)
        assert sum(c[i, got[i]] for i in range(n)) == pytest.approx(best) and len(set(got)) == n


def test_alignment(spark):
    rng = np.random.default_rng(4)
    top = rng.random((6, 2))
    bottom = (top - [0.3, 0.1]) % 1.0
    best = alignment.suggest(top, bottom, np.eye(2) * 8, 0.5)[0]
    assert best["coverage"] == 1 and best["rmsd"] == pytest.approx(0, abs=1e-6)
    assert len(alignment.symmetries(np.eye(2))) == 8 and len(alignment.symmetries(np.array([[1, 0], [0.5, math.sqrt(3) / 2]]))) == 12
    grid = spark.createDataFrame([(i, j, float(i + 10 * j)) for i in range(4) for j in range(3)], "ix int, iy int, mass double")
    moved = alignment.transfer(grid, (4, 3), (0.1, 0.5), (True, False))
    assert moved.agg(F.sum("mass")).first()[0] == pytest.approx(grid.agg(F.sum("mass")).first()[0])


def test_transfer_of_bins_beside_the_cell(spark):
    """Bins beyond the cell stand for their image along a moved axis, and keep their place along one that is not moved."""
    grid = spark.createDataFrame([(-1, 2, 4.0), (10, -1, 2.0), (3, 10, 6.0)], "ix int, iy int, mass double")
    got = sorted(map(tuple, alignment.transfer(grid, (10, 10), (0.25, 0.0)).select("ix", "iy", "mass").collect()))
    assert got == [(1, 2, 2.0), (2, -1, 1.0), (2, 2, 2.0), (3, -1, 1.0), (5, 10, 3.0), (6, 10, 3.0)]


def test_mirrored_transfer_of_bins_beside_the_cell(spark):
    grid = spark.createDataFrame([(-1, 2, 4.0), (10, -1, 2.0), (3, 10, 6.0)], "ix int, iy int, mass double")
    got = sorted(map(tuple, alignment.transfer(grid, (10, 10), (0.25, 0.0), (True, False)).select("ix", "iy", "mass").collect()))
    assert got == [(1, -1, 1.0), (2, -1, 1.0), (2, 2, 2.0), (3, 2, 2.0), (8, 10, 3.0), (9, 10, 3.0)]


def test_transfer_far_beside_the_cell(spark):
    """Bins more than a shift beside the cell have the remainder of SQL, (11 - ix) % 10 and (12 - ix) % 10; bins without a number are kept."""
    grid = spark.createDataFrame([(12, 2, 4.0), (-3, 2, 2.0), (25, 1, 8.0), (None, None, 6.0)], "ix int, iy int, mass double")
    moved = lambda *a: sorted(map(tuple, alignment.transfer(grid, (10, 10), *a).select("ix", "iy", "mass").where("ix is not null").collect()))
    assert moved((0.25, 0.0), (True, False)) == [(-4, 1, 4.0), (-3, 1, 4.0), (-1, 2, 2.0), (0, 2, 2.0), (4, 2, 1.0), (5, 2, 1.0)]
    assert moved((0.25, 0.0)) == [(-1, 2, 1.0), (0, 2, 1.0), (4, 2, 2.0), (5, 2, 2.0), (7, 1, 4.0), (8, 1, 4.0)]
    none = alignment.transfer(grid, (10, 10), (0.25, 0.0), (True, False)).where("ix is null").collect()
    assert [(r["ix"], r["iy"], r["mass"]) for r in none] == [(None, None, 6.0)]


def test_histogram_without_bounds(spark):
    points = spark.createDataFrame([(-0.7,), (0.2,), (99.9,), (150.0,)], "z double")
    got = sorted(map(tuple, histogram.histogram(points, [("z", 0.0, 0.5, None)], {"n": F.count("*")}).collect()))
    assert got == [(-2, 1), (0, 1), (199, 1), (300, 1)]


# ---- ordered and series


def test_unwrap(spark):
    x = np.cumsum(np.full(30, 1.3))
    df = spark.createDataFrame(pd.DataFrame({"a": 1, "f": range(30), "x": x % 10}))
    got = ordered.unwrap(df, ["a"], "f", {"x": 10.0}).orderBy("f").toPandas()["x_unwrapped"]
    assert got.to_numpy() == pytest.approx(x)


def test_integral_splits_at_zero(spark):
    df = spark.createDataFrame([("s", 0.0, -1.0), ("s", 2.0, 1.0), ("s", 3.0, 1.0)], "g string, x double, y double")
    r = ordered.integrate(df, ["g"], "x", "y", 0.0, 2.5).first()
    assert (r["signed"], r["absolute"]) == (pytest.approx(0.5), pytest.approx(1.5))


def test_smooth_matches_convolution(spark):
    rng = np.random.default_rng(5)
    y = rng.random(40)
    s = 1.5
    r = math.ceil(3 * s)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
    want = np.convolve(np.pad(y, r, mode="edge"), k / k.sum(), "valid")
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "i": range(40), "y": y}))
    assert ordered.smooth(df, ["g"], "i", "y", s).orderBy("i").toPandas()["smoothed"].to_numpy() == pytest.approx(want)


def test_interpolation_is_clamped(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 5.0)], "g int, x double, y double")
    assert [ordered.interpolate(df, ["g"], "x", "y", v).first()["value"] for v in (-1.0, 0.5, 2.0, 9.0)] == [1, 2, 5, 5]


def test_circular_cut(spark):
    df = spark.createDataFrame([(1, v) for v in (0.5, 1.0, 8.0, 9.5)], "g int, v double")
    r = ordered.circular_cut(df, ["g"], "v", 0.0, 10.0).first()
    assert (r["cut"], r["gap"]) == (4.5, 7.0)


def test_fills_only_short_gaps(spark):
    v = [1.0, None, 1.0, None, None, None, 1.0, None, 9.0]
    df = spark.createDataFrame([(1, i, x, 1.1) for i, x in enumerate(v)], "g int, i int, v double, c double")
    assert [r["filled"] for r in ordered.fill_gaps(df, ["g"], "i", "v", "c", 2, 0.5).orderBy("i").collect()] == [False, True, False, False, False, False, False, False, False]


def test_normalise_modes(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0)], "g int, x double, y double")
    got = lambda **k: [r["normalised"] for r in S.normalise(df, ["g"], "x", "y", **k).orderBy("x").collect()]
    assert got(mode="max") == pytest.approx([1 / 3, 1]) and got(mode="area") == pytest.approx([0.5, 1.5]) and got(mode="factor", target=2.0) == [2, 6]
    assert got(mode="value_at_x", reference=0.5) == [0.5, 1.5]
    with pytest.raises(ValueError):
        got(mode="odd")


# ---- histograms and statistics


def test_last_bin_is_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.99, 1.0, 2.0, 2.5, -0.1)], "v double")
    assert [r[0] for r in df.select(histogram.bin_index(F.col("v"), 0.0, 1.0, 2)).collect()] == [0, 0, 1, 1, 1, 0]


def test_bin_rules():
    assert histogram.bin_edges(0.0, 1.0, 0.25) == (0.0, 4) and histogram.bin_edges(2.0, 2.0, 0.5)[1] == 2
    assert histogram.uniform_rdf_bins(2.0, 0.7) == (3, pytest.approx(2 / 3)) and histogram.auto_r_max([10.0, 11.0, 12.0], 0.3) == pytest.approx(4.8)
    assert histogram.merge_axis([0, 1, 2, 3, 4, 5], 2.0) == [0, 0, 1, 1, 1]


def test_blocks():
    assert [statistics.block_count(n) for n in (99, 100, 499, 500, 10_000)] == [0, 4, 19, 20, 20]


def test_dense_moments_count_absent_frames(spark):
    rng = np.random.default_rng(6)
    m = rng.poisson(0.5, (50, 8)).astype(float)
    rows = [(int(b), int(f), float(m[f, b])) for f in range(50) for b in range(8) if m[f, b]]
    out = statistics.dense_moments(spark.createDataFrame(rows, "bin int, frame int, v double"), "bin", "v", 50).orderBy("bin").toPandas()
    assert out["mean"].to_numpy() == pytest.approx(m.mean(axis=0)) and out["sample_std"].to_numpy() == pytest.approx(m.std(axis=0, ddof=1))


def test_bootstrap(spark):
    rng = np.random.default_rng(7)
    num, den = rng.uniform(1, 2, 12), rng.uniform(3, 4, 12)
    df = spark.createDataFrame([(0, 0, b, float(num[b]), float(den[b])) for b in range(12)] + [(1, 0, b, 1.0, 1.0) for b in range(3)], "bin int, component int, block int, numerator double, denominator double")
    got = {r["bin"]: r for r in statistics.bootstrap(df, repeats=500, seed=11).collect()}
    w = np.random.default_rng(11).multinomial(12, np.full(12, 1 / 12), size=500)
    assert (got[0]["low"], got[0]["high"]) == pytest.approx(tuple(np.quantile((w @ num) / (w @ den), [0.025, 0.975])))
    assert got[1]["low"] is None and got[1]["n_blocks"] == 3
    assert [r["merge"] for r in statistics.stability(df.where("bin = 0"), repeats=100, seed=1).orderBy("merge").collect()] == [1, 2, 4]


def test_pooled_statistics(spark):
    rng = np.random.default_rng(8)
    v = [rng.random(n) for n in (3, 1, 6)]
    df = spark.createDataFrame([(0, len(x), float(x.mean()), float(x.std(ddof=1)) if len(x) > 1 else None) for x in v], "b int, n int, m double, s double")
    r, allv = statistics.pooled(df, ["b"], "n", "m", "s").first(), np.concatenate(v)
    assert (r["n"], r["mean"], r["std"]) == (10, pytest.approx(allv.mean()), pytest.approx(allv.std(ddof=1)))


def test_marginals_conserve(spark, cloud):
    grid = histogram.sparse_grid(cloud.withColumn("side", F.lit(0)), [("x", 0.0, 0.5), ("z", 0.0, 0.5)], side="side")
    line = histogram.marginal(grid, ("i_z", 0.0, 0.5, 1.0), "mass", 1.0)
    assert line.agg(F.sum("mass")).first()[0] == pytest.approx(cloud.agg(F.sum("mass_amu")).first()[0])
    assert grid.agg(F.sum(F.col("mass_top") + F.col("mass_bottom") - F.col("mass"))).first()[0] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        histogram.check_size(grid, 3)


# ---- fits


@pytest.mark.parametrize("kind,p", [("exponential", (2.0, -0.7, 1.0)), ("power", (3.0, 1.7)), ("gaussian", (4.0, 2.0, 0.6, 0.5)), ("lorentzian", (4.0, 2.0, 0.6, 0.5))])
def test_nonlinear_fits(spark, kind, p):
    x = np.linspace(0.1, 5, 60)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x, "y": fits.shape(kind, x, np.array(p))}))
    got = {r["parameter"]: r["value"] for r in fits.nonlinear(df, "g", "x", "y", kind).collect()}
    assert [got[n] for n in fits.MODELS[kind]] == pytest.approx(p, rel=1e-4) and got["r2"] == pytest.approx(1)


def test_polynomial_and_linear(spark):
    rng = np.random.default_rng(9)
    x, noise = rng.uniform(0, 9, 50), rng.normal(0, 0.1, 50)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x, "y": 1 + 2 * x - 0.5 * x * x + noise}))
    r = fits.parabola(df, ["g"], F.col("x"), F.col("y")).first()
    c = np.polyfit(x, 1 + 2 * x - 0.5 * x * x + noise, 2)
    assert (r["c2"], r["c1"], r["c0"]) == pytest.approx(tuple(c), rel=1e-6) and r["vertex_x"] == pytest.approx(-c[1] / 2 / c[0])
    s = fits.linear(df, ["g"], F.col("x"), F.col("y")).first()
    assert (s["slope"], s["intercept"]) == pytest.approx(tuple(np.polyfit(x, df.toPandas()["y"], 1)))


def test_pchip_is_monotone():
    x, y = np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 1, 3, 10])
    v = fits.pchip(x, y, np.linspace(0, 4, 401))
    assert (np.diff(v) >= -1e-12).all() and fits.pchip(x, y, x) == pytest.approx(y)
    assert fits.local_minimum(np.arange(5.0), np.array([3.0, 1, 0.5, 2, 3]), 2) == pytest.approx(2.0, abs=0.2)


# ---- selections and tables


def test_selectors():
    assert select.species_query("*") == ("all", None) and select.species_query("mol:HO") == ("molecule", "mol:OH") and select.species_query("H2O") == ("molecule", "mol:H2O")
    assert select.species_query("O") == ("element", "O") and select.species_query("species:O1") == ("raw", "O1") and select.species_query("element:pt") == ("element", "Pt") and select.species_query("Zz9") == ("raw", "Zz9")
    assert select.atom_indices("atoms[3..5,4,1]") == [3, 4, 5, 1]
    for bad in (lambda: select.atom_indices("atoms[9]", 5), lambda: select.pair_selector("molecules"), lambda: select.validate_nearest_axes(["x", "y"]), lambda: select.species_filter("H2O")):
        with pytest.raises(ValueError):
            bad()


def test_frame_selection(spark):
    f = spark.createDataFrame([(i, i * 500.0, i * 10) for i in range(10)], "frame_index long, time_fs double, step long")
    got = lambda s: [r[0] for r in select.select_frames(f, s).orderBy("frame_index").select("frame_index").collect()]
    assert got("first:3") == [0, 1, 2] and got("last:2f") == [8, 9] and got("first:25%") == [0, 1] and got("first:0") == [0]
    assert got("range:2:4") == [2, 3] and got("range:1ps:2ps") == [2, 3, 4] and got("range:20step:40step") == [2, 3, 4] and got("last:1ps") == [7, 8, 9] and got("first:1ps") == [0, 1, 2]


def test_table_filters(spark):
    df = spark.createDataFrame([(1, "Apple", 1.0), (2, None, None), (3, "pear", 3.0), (4, "APRICOT", 4.0)], "i int, t string, v double")
    got = lambda *a, **k: [r["i"] for r in tables.filter_table(df, *a, **k).orderBy("i").collect()]
    assert got("v", "ge", "3") == [3, 4] and got("v", "ne", "3") == [1, 2, 4] and got("t", "ne", "pear") == [1, 2, 4]
    assert got("t", "startswith", "ap") == [1, 4] and got("t", "startswith", "ap", case_sensitive=True) == [] and got("t", "startswith", "ap", invert=True) == [2, 3]
    assert got("t", "in", "apple,pear") == [1, 3] and got("t", "not-in", "apple") == [2, 3, 4] and got("t", "regex", "^a.*t$") == [4]
    with pytest.raises(ValueError):
        got("t", "gt", "x")


def test_dedupe(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "b", "a", None, None, "c"])], "i int, k string")
    got = lambda keep: sorted(r["i"] for r in tables.dedupe(df, ["k"], "i", keep).collect())
    assert got("first") == [0, 1, 3, 5] and got("last") == [1, 2, 4, 5] and got("none") == [1, 5]


# ---- geometry


def test_cells(spark):
    m = G.cell_matrix((3, 4, 5), (90, 80, 70))
    v = abs(np.linalg.det(np.array(m).reshape(3, 3)))
    row = spark.range(1).select(F.array(*(F.lit(x) for x in m)).alias("c")).select(G.volume(F.col("c")).alias("v"), *(h.alias(f"h{i}") for i, h in enumerate(G.heights(F.col("c"))))).first()
    assert row["v"] == pytest.approx(v) and [row[f"h{i}"] for i in range(3)] == pytest.approx(list(1 / np.linalg.norm(np.linalg.inv(np.array(m).reshape(3, 3)), axis=0)))
    for bad in (((0, 1, 1), (90, 90, 90)), ((1, 1, 1), (30, 30, 90))):
        with pytest.raises(ValueError):
            G.cell_matrix(*bad)
    assert units.frame_timestep_fs(0.5, "ps", 4) == 2000 and units.axis_index(" Z") == 2


def test_bin_volumes():
    rng = np.random.default_rng(10)
    for cell in ([3, 0, 0, 0, 4, 0, 0, 0, 5], [3, 0, 0.5, 1, 4, -1.5, 0.3, 0.2, 5]):
        m = np.array(cell, float).reshape(3, 3)
        z = (rng.random((400_000, 3)) @ m)[:, 2] + 1.0
        edges = np.linspace(z.min() - 0.5, z.max() + 0.5, 9)
        got = G.bin_volumes([float(v) for v in cell], edges.tolist(), 2, 1.0)
        assert sum(got) == pytest.approx(abs(np.linalg.det(m))) and got == pytest.approx((np.histogram(z, edges)[0] / len(z) * abs(np.linalg.det(m))).tolist(), abs=0.3)
