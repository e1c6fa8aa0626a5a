"""Units and scales as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import VELOCITY_MS

#: Factor and name of density units that have a usual form; all others pass through.
DENSITY_UNITS = {"g/A^3": (1e24, "g/cm^3"), "atom/A^3": (1e3, "atom/nm^3"), "molecule/A^3": (1e3, "molecule/nm^3")}
TIME_FS = {"fs": 1.0, "ps": 1e3, "ns": 1e6, "s": 1e15}
#: Time unit of each unit style of the LAMMPS input language, in femtoseconds.
STYLE_TIME_FS = {"real": 1.0, "metal": 1e3, "si": 1e15, "cgs": 1e15, "electron": 1.0, "micro": 1e9, "nano": 1e6}
AXES = {"x": 0, "y": 1, "z": 2}


def density(value: Column, unit: Column) -> tuple[Column, Column]:
    """A density and its unit in the usual form."""
    factor = F.create_map(*(F.lit(x) for u, (f, _) in DENSITY_UNITS.items() for x in (u, f)))
    name = F.create_map(*(F.lit(x) for u, (_, n) in DENSITY_UNITS.items() for x in (u, n)))
    return value * F.coalesce(factor[unit], F.lit(1.0)), F.coalesce(name[unit], unit)


def prefix_exponent(largest: Column) -> Column:
    """The multiple of three that an engineering prefix would take; 0 for nothing."""
    return F.when(largest > 0, (F.floor(F.log10(largest) / 3) * 3).cast("int")).otherwise(F.lit(0))


def linear(x: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return x * scale + offset


def velocity_factor(unit: str) -> float:
    return VELOCITY_MS[unit.lower()]


def axis_index(axis: str) -> int:
    return AXES[axis.strip().lower()]


def frame_timestep_fs(timestep: float, unit: str = "fs", stride: int = 1) -> float:
    """Time between stored frames."""
    return timestep * TIME_FS[unit] * stride
