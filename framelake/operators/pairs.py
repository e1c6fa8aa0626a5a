"""Pair joins within a frame: dense, by cell lists, by images; nearest neighbours; bonds and molecules.

Atoms come as (frame_index, atom_index, x, y, z) with further columns kept as asked. Cells are orthorhombic lengths given
as numbers, or columns of the frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import cartesian, distance, minimum_image, taper
from ..schema import ELEMENTS, OH_CUTOFF

DENSE_PAIRS, DENSE_FILL = 250_000, 0.25


def side(atoms: DataFrame, suffix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return atoms.select("frame_index", *(F.col(c).alias(f"{c}_{suffix}") for c in ("atom_index", "x", "y", "z", *keep)))


def point(suffix: str) -> tuple[Column, Column, Column]:
    return F.col(f"x_{suffix}"), F.col(f"y_{suffix}"), F.col(f"z_{suffix}")


def dense_pairs(a: DataFrame, b: DataFrame, lengths: tuple, r_max: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs of different atoms of a frame up to r_max, by minimum image; an equi-join on the frame."""
    pairs = side(a, "a", keep).join(side(b, "b", keep), "frame_index").where(F.col("atom_index_a") != F.col("atom_index_b"))
    return pairs.withColumn("r", distance(point("a"), point("b"), lengths)).where(F.col("r") <= r_max)


def cell_pairs(a: DataFrame, b: DataFrame, lengths: tuple[float, float, float], r_max: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """As dense_pairs, by a grid of cells no smaller than r_max: each atom of b goes into its cell and all neighbours.

    Valid up to half the shortest length. Neighbours that coincide on a short axis are taken once.
    """
    if r_max > min(lengths) / 2 + 1e-12:
        raise ValueError("a minimum image needs r_max of at most half the cell")
    n = [max(1, int(math.floor(length / r_max))) for length in lengths]

    def axis(s: str, c: str, i: int) -> Column:
        f = F.col(f"{c}_{s}") / lengths[i]
        return F.least(F.floor((f - F.floor(f)) * n[i]).cast("int"), F.lit(n[i] - 1))

    own = F.struct(*(axis("a", c, i).alias(c) for i, c in enumerate("xyz")))
    left = side(a, "a", keep).withColumn("cell", own)
    near = lambda c, i: F.array_distinct(F.array(*(F.pmod(axis("b", c, i) + d, F.lit(n[i])) for d in (-1, 0, 1))))
    right = side(b, "b", keep)
    for i, c in enumerate("xyz"):
        right = right.withColumn(f"_{c}", F.explode(near(c, i)))
    right = right.withColumn("cell", F.struct(*(F.col(f"_{c}").alias(c) for c in "xyz"))).drop("_x", "_y", "_z")
    pairs = left.join(right, ["frame_index", "cell"]).where(F.col("atom_index_a") != F.col("atom_index_b")).drop("cell")
    return pairs.withColumn("r", distance(point("a"), point("b"), lengths)).where(F.col("r") <= r_max)


def image_pairs(a: DataFrame, b: DataFrame, cell: list[float], r_max: float, images: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs in a general cell: all shifts up to `images` cells, several images of a pair reduced to the nearest.

    Images fall into cubes of r_max; each atom of a looks into its own and the 26 around it, by an equi-join.
    """
    shifts = F.array(*(F.array(*(F.lit(float(v)) for v in (i, j, k))) for i in range(-images, images + 1) for j in range(-images, images + 1) for k in range(-images, images + 1)))
    matrix = F.array(*(F.lit(float(v)) for v in cell))
    zero = (F.lit(0.0),) * 3
    moved = side(b, "b", keep).withColumn("_s", F.explode(shifts))
    at = cartesian(tuple(F.col("_s")[i] for i in range(3)), matrix, zero)
    left = side(a, "a", keep)
    for c, d in zip("xyz", at):
        moved = moved.withColumn(f"_{c}", F.col(f"{c}_b") + d).withColumn(f"_c{c}", F.floor(F.col(f"_{c}") / r_max))
        own = F.floor(F.col(f"{c}_a") / r_max)
        left = left.withColumn(f"_c{c}", F.explode(F.sequence(own - 1, own + 1)))
    pairs = left.join(moved, ["frame_index", "_cx", "_cy", "_cz"]).where(F.col("atom_index_a") != F.col("atom_index_b"))
    pairs = pairs.withColumn("r", distance(point("a"), (F.col("_x"), F.col("_y"), F.col("_z")))).where(F.col("r") <= r_max)
    names = [f"{c}_{s}" for s in "ab" for c in keep]
    return pairs.groupBy("frame_index", "atom_index_a", "atom_index_b", *names).agg(F.min("r").alias("r"))


def pairs_within(a: DataFrame, b: DataFrame, lengths: tuple[float, float, float], r_max: float, n_a: int, n_b: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dense for few pairs of a frame or a cutoff that fills much of the cell, by cells else."""
    fill = 4 / 3 * math.pi * r_max**3 / math.prod(lengths)
    dense = n_a * n_b <= DENSE_PAIRS or fill > DENSE_FILL or r_max > min(lengths) / 2
    return (dense_pairs if dense else cell_pairs)(a, b, lengths, r_max, keep)


def largest_frame(atoms: DataFrame) -> int:
    """Most atoms in a frame: one aggregate."""
    return atoms.groupBy("frame_index").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def auto_pairs(a: DataFrame, b: DataFrame, lengths: tuple, r_max: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """pairs_within() by the largest frames of both sides, so that no frame makes all its pairs once it is large."""
    if r_max > min(lengths) / 2:
        return dense_pairs(a, b, lengths, r_max, keep)
    return pairs_within(a, b, lengths, r_max, largest_frame(a), largest_frame(b), keep)


def without_shared(pairs: DataFrame) -> DataFrame:
    """Pairs of entities that have no member atom in common (members_a, members_b)."""
    return pairs.where(~F.arrays_overlap("members_a", "members_b"))


def nearest(targets: DataFrame, substrate: DataFrame, lengths: tuple) -> DataFrame:
    """(frame_index, atom_index, nearest, distance): each target's nearest substrate atom, ties to the lower index; summed before the shuffle."""
    pairs = side(targets, "a").join(side(substrate, "b"), "frame_index").withColumn("r", distance(point("a"), point("b"), lengths))
    best = pairs.groupBy("frame_index", F.col("atom_index_a").alias("atom_index")).agg(F.min(F.struct("r", "atom_index_b")).alias("m"))
    return best.select("frame_index", "atom_index", F.col("m.atom_index_b").alias("nearest"), F.col("m.r").alias("distance"))


def nearest_in_shells(targets: DataFrame, substrate: DataFrame, lengths: tuple[float, float, float], first: float) -> DataFrame:
    """As nearest(), by cell lists of a radius that doubles for the targets without a hit; dense once it reaches half the cell."""
    out, left, r = None, targets, first
    while r < min(lengths) / 2:
        hits = cell_pairs(left, substrate, lengths, r).groupBy("frame_index", F.col("atom_index_a").alias("atom_index")).agg(F.min(F.struct("r", "atom_index_b")).alias("m"))
        hits = hits.select("frame_index", "atom_index", F.col("m.atom_index_b").alias("nearest"), F.col("m.r").alias("distance"))
        out = hits if out is None else out.unionByName(hits)
        left = left.join(hits, ["frame_index", "atom_index"], "left_anti")
        r *= 2
    rest = nearest(left, substrate, lengths)
    return rest if out is None else out.unionByName(rest)


def coordination(centres: DataFrame, neighbours: DataFrame, lengths: tuple, cutoff: float, width: float = 0.0) -> DataFrame:
    """(frame_index, atom_index, coordination): taper weights summed over neighbours; 0 without any."""
    pairs = auto_pairs(centres, neighbours, lengths, cutoff + width / 2)
    sums = pairs.groupBy("frame_index", F.col("atom_index_a").alias("atom_index")).agg(F.sum(taper(F.col("r"), cutoff, width)).alias("s"))
    return centres.select("frame_index", "atom_index").join(sums, ["frame_index", "atom_index"], "left").select("frame_index", "atom_index", F.coalesce("s", F.lit(0.0)).alias("coordination"))


def bonds(atoms: DataFrame, lengths: tuple, cutoff: float = OH_CUTOFF) -> DataFrame:
    """(frame_index, o, h, r): oxygen and hydrogen within the cutoff, inclusive."""
    pairs = auto_pairs(atoms.where("element = 'O'"), atoms.where("element = 'H'"), lengths, cutoff)
    return pairs.select("frame_index", F.col("atom_index_a").alias("o"), F.col("atom_index_b").alias("h"), "r")


def molecules(atoms: DataFrame, bond: DataFrame) -> DataFrame:
    """(frame_index, label, anchor, members): free H and O, OH, H2O, H3O.

    A hydrogen with several oxygens is ambiguous, and so are these; an oxygen with an ambiguous hydrogen or with more than
    three hydrogens is in no molecule.
    """
    edges = bond.withColumn("deg", F.count("*").over(W.partitionBy("frame_index", "h")))  # a hydrogen has few oxygens
    own = edges.groupBy("frame_index", "o").agg(F.sort_array(F.collect_list("h")).alias("hs"), F.max("deg").alias("most"))
    oxygen = atoms.where("element = 'O'").select("frame_index", F.col("atom_index").alias("o")).join(own, ["frame_index", "o"], "left")
    hs = F.coalesce(F.col("hs"), F.array().cast("array<long>"))
    kinds = F.element_at(F.array(*(F.lit(f"mol:{k}") for k in ("O", "OH", "H2O", "H3O"))), F.size("hs") + 1)
    heavy = oxygen.withColumn("hs", hs).where((F.coalesce("most", F.lit(0)) <= 1) & (F.size("hs") <= 3))
    heavy = heavy.select("frame_index", kinds.alias("label"), F.col("o").alias("anchor"), F.concat(F.array(F.col("o").cast("long")), "hs").alias("members"))
    free = atoms.where("element = 'H'").select("frame_index", F.col("atom_index").alias("h")).join(bond.select("frame_index", "h"), ["frame_index", "h"], "left_anti")
    free = free.select("frame_index", F.lit("mol:H").alias("label"), F.col("h").alias("anchor"), F.array(F.col("h").cast("long")).alias("members"))
    return heavy.unionByName(free)


def centres_of_mass(molecule: DataFrame, atoms: DataFrame, lengths: tuple) -> DataFrame:
    """(frame_index, anchor, label, mass, x, y, z): mass-weighted mean of the members, each by its image nearest the anchor."""
    each = molecule.select("frame_index", "label", "anchor", F.explode("members").alias("atom_index")).join(atoms.select("frame_index", "atom_index", "mass_amu", "x", "y", "z"), ["frame_index", "atom_index"])
    base = atoms.select("frame_index", F.col("atom_index").alias("anchor"), *(F.col(c).alias(f"{c}0") for c in "xyz"))
    each = each.join(base, ["frame_index", "anchor"])
    mean = lambda c, n: (F.max(f"{c}0") + F.sum(F.col("mass_amu") * minimum_image(F.col(c) - F.col(f"{c}0"), n)) / F.sum("mass_amu")).alias(c)
    return each.groupBy("frame_index", "label", "anchor").agg(F.sum("mass_amu").alias("mass"), *(mean(c, n) for c, n in zip("xyz", lengths)))


def unordered_pairs(species: DataFrame) -> DataFrame:
    """(a, b) of all unordered pairs of distinct species, itself included; the list of species is short by nature."""
    names = species.select(F.sort_array(F.collect_set("species")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return names.select(F.inline(pairs))


def distinct_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) once for each unordered pair, the smaller first."""
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def fingerprints(atoms: DataFrame) -> DataFrame:
    """(frame_index, fingerprint): a digest of each frame's atoms in order and their elements; a frame is a bounded group."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("atom_index", "element"))), lambda x: F.concat(x["atom_index"].cast("string"), F.lit(":"), x["element"]))
    return atoms.groupBy("frame_index").agg(F.sha2(F.concat_ws(",", members), 256).alias("fingerprint"))


def reusable(stored: DataFrame, atoms: DataFrame) -> DataFrame:
    """(frame_index, valid): whether what is stored of a frame, by its fingerprint, still belongs to it."""
    now = fingerprints(atoms).withColumnRenamed("fingerprint", "_now")
    return now.join(stored.select("frame_index", "fingerprint"), "frame_index", "left").select("frame_index", F.coalesce(F.col("_now") == F.col("fingerprint"), F.lit(False)).alias("valid"))


def ordered_pairs(species: DataFrame) -> DataFrame:
    names = species.select(F.sort_array(F.collect_set("species")).alias("s"))
    return names.select(F.inline(F.flatten(F.transform("s", lambda a: F.transform("s", lambda b: F.struct(a.alias("a"), b.alias("b")))))))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """The last right value at or before each left row, by key: both sides in one window, so no row meets more than its own."""
    both = left.withColumn("_t", F.col(left_time)).withColumn("_k", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).unionByName(
        right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_k"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    w = W.partitionBy(key).orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_k = 1").drop("_t", "_k", "_v")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """|A ∩ B| as one row."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"))


def interval_overlaps(source: DataFrame, target_width: float, period: float) -> DataFrame:
    """(…, target, weight): share of each periodic source bin (lo, hi) that lies in each target bin; weights of a bin sum to 1."""
    n = int(round(period / target_width))
    width = period / n
    each = source.withColumn("_k", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1e-12) / width))))
    share = (F.least("hi", (F.col("_k") + 1) * width) - F.greatest("lo", F.col("_k") * width)) / (F.col("hi") - F.col("lo"))
    return each.withColumn("target", F.pmod(F.col("_k"), F.lit(n)).cast("long")).withColumn("weight", share).drop("_k").where("weight > 0")


def masses() -> Column:
    """Element symbol to mass as a map column."""
    return F.create_map(*(F.lit(x) for s, (_, m) in ELEMENTS.items() for x in (s, m)))
