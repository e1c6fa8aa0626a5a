"""Selections: species, atom lists, frames, spatial ranges, groups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import parse_selection_token
from ..schema import ELEMENTS, MIN_MOLECULE_FRAMES
from .tables import numbered

SPATIAL_TOLERANCE = 1e-9


def molecule_label(species: str) -> str | None:
    """`mol:H2O` and the like in their usual form; None for what isn't a molecule (bare H and O are elements)."""
    name = species.strip()
    body = name[4:] if name.lower().startswith("mol:") else name
    usual = {"H": "H", "O": "O", "OH": "OH", "HO": "OH", "H2O": "H2O", "OH2": "H2O", "HOH": "H2O", "H3O": "H3O", "OH3": "H3O"}.get(body.upper())
    if usual is None or (usual in "HO" and body is name):
        return None
    return f"mol:{usual}"


def species_query(species: str) -> tuple[str, str | None]:
    """Kind and value of a selector: all, elements, molecules, raw, element, molecule or atoms."""
    name = species.strip()
    low = name.lower()
    if low in ("all", "*"):
        return "all", None
    if low in ("elements", "molecules"):
        return low, None
    if low.startswith("atoms["):
        return "atoms", name
    if low.startswith("species:"):
        return "raw", name[8:]
    if low.startswith("element:"):
        return "element", name[8:].strip().capitalize()
    if label := molecule_label(name):
        return "molecule", label
    if name in ELEMENTS:
        return "element", name
    return "raw", name


def species_filter(species: str) -> Column:
    """The predicate of a selector on atoms."""
    kind, value = species_query(species)
    if kind in ("all", "elements"):
        return F.lit(True)
    if kind == "element":
        return F.col("element") == value
    if kind == "raw":
        return F.col("raw_species") == value
    if kind == "atoms":
        return F.col("atom_index").isin(atom_indices(value))
    raise ValueError(f"{species!r} selects molecules, which need a bond topology")


def pair_selector(value: str) -> str:
    """A side of a pair in its usual form; selectors of groups are an error."""
    kind, name = species_query(value)
    if kind in ("elements", "molecules"):
        raise ValueError(f"a pair can't have the group {value!r}")
    return {"all": "all", "raw": f"species:{name}"}.get(kind) or str(name)


def atom_indices(label: str, atoms: int | None = None) -> list[int]:
    """Numbers of `atoms[0..5,8]`, ranges inclusive, each once, in order; checked against the number of atoms."""
    m = re.fullmatch(r"\s*atoms\[([\d.,\s]*)\]\s*", label, re.IGNORECASE)
    if not m:
        raise ValueError(f"not an atom list: {label!r}")
    out: dict[int, None] = {}
    for part in m[1].split(","):
        ends = [int(x) for x in part.strip().split("..")]
        out |= dict.fromkeys(range(ends[0], ends[-1] + 1))
    if atoms is not None and any(i >= atoms for i in out):
        raise ValueError(f"an index of {label!r} isn't below {atoms}")
    return list(out)


def available_species(atoms: DataFrame) -> DataFrame:
    """(kind, species): all elements, and raw labels of elements that have several."""
    split = atoms.groupBy("element").agg(F.count_distinct("raw_species").alias("n")).where("n > 1").select("element")
    raw = atoms.join(split, "element", "left_semi").select(F.lit("raw").alias("kind"), F.col("raw_species").alias("species"))
    return atoms.select(F.lit("element").alias("kind"), F.col("element").alias("species")).unionByName(raw).distinct()


def select_frames(frames: DataFrame, selector: str, timestep_fs: float | None = None) -> DataFrame:
    """Rows of the frames that `first:N`, `last:N` or `range:a:b` keeps; at least one frame stays.

    Units: f (frames), % (of all, rounded down), ps and step. Ranges are half open for f and %, closed for ps and step.
    frames has one row per frame (frame_index, and time_fs or step as needed); counts come from one aggregate.
    """
    kind, _, rest = selector.partition(":")
    values = [parse_selection_token(t) for t in rest.split(":")]
    unit = next((u for _, u in reversed(values)), "f")
    at = {"ps": F.col("time_fs") / 1000.0, "step": F.col("step")}.get(unit)
    keep: list[Column] = []
    total = F.col("_n")
    rank = F.col("_i")
    last_at = F.col("_last")
    low, high = values[0][0], values[-1][0]
    if unit == "f":
        a, z = F.lit(int(low)), F.lit(int(high))
    elif unit == "%":
        a, z = (F.floor(total * v / 100.0) for v in (low, high))
    if kind == "first":
        keep = [rank < F.greatest(z, F.lit(1))] if at is None else [(at <= high) | (rank == 0)]
    elif kind == "last":
        keep = [rank >= total - F.greatest(z, F.lit(1))] if at is None else [(at >= last_at - high) | (rank == total - 1)]
    elif kind == "range":
        inside = (rank >= a) & (rank < F.greatest(z, a + 1)) if at is None else (at >= low) & (at <= high)
        keep = [inside]
    else:
        raise ValueError(f"unknown frame selector {selector!r}")
    n = frames.agg(F.count("*").alias("_n"), F.max(at if at is not None else F.lit(0.0)).alias("_last"))
    ranked = numbered(frames, ["frame_index"], "_i")
    return ranked.join(F.broadcast(n)).where(reduce(lambda p, q: p & q, keep)).drop("_i", "_n", "_last")  # n is one row


def spatial_range(axis: str, raw: str) -> tuple[str, str | float, str | float]:
    """Axis and bounds of `min:max`; either may be a number or the words min and max."""
    lo, sep, hi = raw.partition(":")
    if not sep:
        raise ValueError(f"a range needs a colon: {raw!r}")
    bound = lambda t, word: word if t.strip().lower() in ("", word) else float(t)
    return axis, bound(lo, "min"), bound(hi, "max")


def spatial_filter(points: DataFrame, ranges: list[tuple[str, str | float, str | float]]) -> DataFrame:
    """Points within all ranges, bounds inclusive to 1e-9; an open bound takes the data's own and so never excludes."""
    out = points
    for axis, lo, hi in ranges:
        if lo != "min":
            out = out.where(F.col(axis) >= float(lo) - SPATIAL_TOLERANCE)
        if hi != "max":
            out = out.where(F.col(axis) <= float(hi) + SPATIAL_TOLERANCE)
        out = out.where(F.col(axis).isNotNull())
    return out


def keep_groups(atoms: DataFrame, centres: DataFrame, ranges: list[tuple[str, str | float, str | float]], group: str) -> DataFrame:
    """All atoms of the groups whose centre (frame_index, group, x, y, z) lies within the ranges."""
    return atoms.join(spatial_filter(centres, ranges).select("frame_index", group), ["frame_index", group], "left_semi")


def substrate(atoms: DataFrame, elements: list[str] | None = None, indices: list[int] | None = None, *, include_fixed: bool = False) -> DataFrame:
    """Candidates for a surface: of these elements or indices, fixed atoms only if asked for."""
    out = atoms if include_fixed else atoms.where(~F.coalesce("is_fixed", F.lit(False)))
    if elements is not None:
        out = out.where(F.col("element").isin(elements))
    return out if indices is None else out.where(F.col("atom_index").isin(indices))


def finite_between(v: Column, lo: float, hi: float, width: float) -> Column:
    """Finite and within the edges, to a tolerance of 1e-9 widths (1e-12 at least)."""
    tolerance = max(1e-9 * width, 1e-12)
    return v.isNotNull() & ~F.isnan(v) & v.between(lo - tolerance, hi + tolerance)


def populated(bins: DataFrame, least: int, count: str = "point_count") -> DataFrame:
    return bins.where(F.col(count) >= least)


def active_labels(presence: DataFrame, min_frames: int = MIN_MOLECULE_FRAMES) -> DataFrame:
    """Labels of (label, frame_index) with enough consecutive frames; H2O needs none, one frame is enough."""
    frames = presence.select("label", "frame_index").distinct()
    island = frames.withColumn("island", F.col("frame_index") - F.row_number().over(W.partitionBy("label").orderBy("frame_index")))
    runs = island.groupBy("label", "island").agg(F.count("*").alias("run")).groupBy("label").agg(F.max("run").alias("longest_run"))
    return runs.where((F.col("label") == "mol:H2O") | (F.col("longest_run") >= min_frames))


def face(points: DataFrame, height: str, depth: float, side: str = "side") -> DataFrame:
    """Points of a side within the depth below its outermost one."""
    outer = points.groupBy(side).agg(F.max(height).alias("_outer"))
    return points.join(outer, side).where(F.col(height) >= F.col("_outer") - depth).drop("_outer")


def visible(series: DataFrame, flags: DataFrame) -> DataFrame:
    """Series that no flag of (series_id, enabled) turns off."""
    return series.join(flags.where(~F.col("enabled")).select("series_id"), "series_id", "left_anti")


def validate_nearest_axes(axes: list[str], unit: str = "mass") -> None:
    """A nearest-distance distribution pairs distance with at most one Cartesian axis and has no volume units."""
    if "distance" not in axes or len(axes) > 2 or any(a not in ("x", "y", "z", "distance") for a in axes):
        raise ValueError("a nearest-distance distribution has the axis distance, alone or with x, y or z")
    if "^3" in unit:
        raise ValueError("a nearest-distance distribution has no volume to divide by")




def value_filter(points: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Points whose value lies within the bounds that are given, inclusive; missing values stay only without bounds."""
    if low is not None:
        points = points.where(F.col(value) >= low)
    return points if high is None else points.where(F.col(value) <= high)
