"""Profiles along an axis or a distance: density, position, orientation, temperature, periodic wrapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cos_azimuthal, cos_polar, minimum_image, wrap
from ..operators import histogram, pairs, statistics
from ..schema import A3_CM3, A3_NM3, AMU_G, AMU_KG, ANGLE_BINS


def density(points: DataFrame, coordinate: str, start: float, width: float, n: int, frames: int, area: float, mass: str = "mass_amu") -> DataFrame:
    """(bin, lo, hi, point_count, density in g/cm^3, number_density in 1/nm^3, sample_std, sample_sem): all bins, empty ones 0.

    Sums by (bin, frame) come from one aggregate; spreads are over all frames of the mass density.
    """
    volume = area * width
    each = points.groupBy(histogram.bin_index(F.col(coordinate), start, width, n).alias("bin"), "frame_index").agg(F.sum(mass).alias("m"), F.count("*").alias("c"))
    factor = AMU_G / A3_CM3 / volume
    spread = statistics.dense_moments(each.withColumn("v", F.col("m") * factor), "bin", "v", frames).select("bin", "sample_std", "sample_sem")
    sums = each.groupBy("bin").agg(F.sum("m").alias("m"), F.sum("c").alias("point_count"))
    out = histogram.spine(points, n, "bin").join(sums, "bin", "left").join(spread, "bin", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "bin", (start + F.col("bin") * width).alias("lo"), (start + (F.col("bin") + 1) * width).alias("hi"), zero("point_count").cast("long").alias("point_count"), (zero("m") * factor / frames).cast("double").alias("density"),
        (zero("point_count") / (frames * volume * A3_NM3)).alias("number_density"), F.coalesce("sample_std", F.lit(0.0)).alias("sample_std"), F.coalesce("sample_sem", F.lit(0.0)).alias("sample_sem"),
    )


def densities(atoms: DataFrame, coordinate: str, start: float, width: float, n: int, frames: int, area: float) -> DataFrame:
    """Densities of all elements in one pass: (species, bin, point_count, density, number_density) where there are samples."""
    volume = area * width
    each = atoms.groupBy(F.col("element").alias("species"), histogram.bin_index(F.col(coordinate), start, width, n).alias("bin")).agg(F.sum("mass_amu").alias("m"), F.count("*").alias("point_count"))
    return each.select("species", "bin", "point_count", (F.col("m") * (AMU_G / A3_CM3 / volume) / frames).alias("density"), (F.col("point_count") / (frames * volume * A3_NM3)).alias("number_density"))


def positions(points: DataFrame, frames: DataFrame, lengths: tuple[float, float, float]) -> DataFrame:
    """(atom_index, frame_index, step, time_fs, x, y, z): wrapped positions with the frame's time."""
    meta = frames.select("frame_index", "step", "time_fs")
    return points.join(F.broadcast(meta), "frame_index").select("atom_index", "frame_index", "step", "time_fs", *(wrap(F.col(c), n).alias(c) for c, n in zip("xyz", lengths)))


def waters(atoms: DataFrame, lengths: tuple[float, float, float]) -> DataFrame:
    """(frame_index, anchor, o, h1, h2): points of each water; hydrogens in order of index."""
    m = pairs.molecules(atoms, pairs.bonds(atoms, lengths)).where("label = 'mol:H2O'").select("frame_index", "anchor", F.posexplode("members").alias("k", "atom_index"))
    p = m.join(atoms.select("frame_index", "atom_index", F.struct("x", "y", "z").alias("p")), ["frame_index", "atom_index"])
    return p.groupBy("frame_index", "anchor").agg(*(F.max(F.when(F.col("k") == i, F.col("p"))).alias(n) for i, n in enumerate(("o", "h1", "h2"))))


def angles(water: DataFrame, axis: int, lengths: tuple[float, float, float]) -> DataFrame:
    """Waters with cos_polar, cos_azimuthal and the oxygen's height."""
    v = lambda n: tuple(F.col(n)[c] for c in "xyz")
    return water.select("frame_index", "anchor", F.col("o")["xyz"[axis]].alias("height"), cos_polar(v("o"), v("h1"), v("h2"), axis, lengths).alias("cos_polar"), cos_azimuthal(v("o"), v("h1"), v("h2"), axis, lengths).alias("cos_azimuthal"))


def orientation(angle: DataFrame, width: float) -> DataFrame:
    """(bin, n_valid, mean_polar, mean_azimuthal) by height."""
    return angle.groupBy(F.floor(F.col("height") / width).cast("int").alias("bin")).agg(F.count("cos_polar").alias("n_valid"), F.avg("cos_polar").alias("mean_polar"), F.avg("cos_azimuthal").alias("mean_azimuthal"))


def orientation_map(angle: DataFrame, width: float, value: str = "cos_polar", bins: int = ANGLE_BINS) -> DataFrame:
    """(bin, angle_bin, counts): heights by cosines over [-1, 1]."""
    keys = [F.floor(F.col("height") / width).cast("int").alias("bin"), histogram.bin_index(F.col(value), -1.0, 2.0 / bins, bins).alias("angle_bin")]
    return angle.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").cast("double").alias("counts"))


def temperatures(velocities: DataFrame, factor: float, regions: DataFrame | None = None, *, remove_com: bool = True) -> DataFrame:
    """(frame_index, group, n, temperature_k) by element, or by region where regions (region, atom_index) are given."""
    v = velocities.withColumn("mass_kg", F.col("mass_amu") * AMU_KG)
    for c in ("vx", "vy", "vz"):
        v = v.withColumn(c, F.col(c) * factor)
    v = v.withColumn("group", F.col("element")) if regions is None else v.join(F.broadcast(regions.select("atom_index", F.col("region").cast("string").alias("group"))), "atom_index")
    return statistics.temperature(v, ["frame_index", "group"], remove_com=remove_com)


def apply_pbc(atoms: DataFrame, lengths: tuple[float, float, float], *, whole: bool = False) -> DataFrame:
    """Atoms wrapped one by one, or waters moved as a whole by their centre of mass and all other atoms alone."""
    if not whole:
        return atoms.select(*(wrap(F.col(c), lengths["xyz".index(c)]).alias(c) if c in "xyz" else F.col(c) for c in atoms.columns))
    mol = pairs.molecules(atoms, pairs.bonds(atoms, lengths)).where("label = 'mol:H2O'")
    com = pairs.centres_of_mass(mol, atoms, lengths).select("frame_index", "anchor", *(F.col(c).alias(f"c{c}") for c in "xyz"))
    base = atoms.select("frame_index", F.col("atom_index").alias("anchor"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    own = mol.select("frame_index", "anchor", F.explode("members").alias("atom_index")).join(com, ["frame_index", "anchor"]).join(base, ["frame_index", "anchor"])
    out = atoms.join(own.drop("anchor"), ["frame_index", "atom_index"], "left")

    def moved(c: str, n: float):
        near = F.col(f"a{c}") + minimum_image(F.col(c) - F.col(f"a{c}"), n)
        return F.when(F.col(f"c{c}").isNull(), wrap(F.col(c), n)).otherwise(near + wrap(F.col(f"c{c}"), n) - F.col(f"c{c}"))

    return out.select(*(moved(c, lengths["xyz".index(c)]).alias(c) if c in "xyz" else F.col(c) for c in atoms.columns))


def resolve(*candidates):
    """The first that is given: explicit, stored, input file, frame."""
    return next((c for c in candidates if c is not None), None)
