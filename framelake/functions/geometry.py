"""Periodic geometry as Column expressions; cells are nine numbers by row, or three lengths where orthorhombic."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def minimum_image(d: Column, length: Column | float) -> Column:
    """d less the nearest multiple of the length, halves to even."""
    return d - length * F.rint(d / length)


def wrap(v: Column, length: Column | float, origin: Column | float = 0.0) -> Column:
    """A coordinate moved into [origin, origin + length)."""
    f = (v - origin) / length
    return origin + (f - F.floor(f)) * length


def distance(a: Vector, b: Vector, lengths: tuple | None = None) -> Column:
    """Distance of two points, by minimum image where lengths are given."""
    d = [x - y for x, y in zip(a, b)]
    if lengths is not None:
        d = [minimum_image(x, n) for x, n in zip(d, lengths)]
    return F.sqrt(reduce(lambda p, q: p + q, (x * x for x in d)))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def rows(cell: Column) -> tuple[Vector, Vector, Vector]:
    """The three cell vectors of an array of nine."""
    return tuple(tuple(cell[3 * i + j] for j in range(3)) for i in range(3))


def volume(cell: Column) -> Column:
    a, b, c = rows(cell)
    return F.abs(dot(a, cross(b, c)))


def heights(cell: Column) -> Vector:
    """Distances between opposite faces."""
    a, b, c = rows(cell)
    v = volume(cell)
    return tuple(F.try_divide(v, norm(cross(*pair))) for pair in ((b, c), (c, a), (a, b)))


def fractional(p: Vector, cell: Column, origin: Vector) -> Vector:
    """Fractional coordinates in a general cell."""
    a, b, c = rows(cell)
    d = tuple(x - o for x, o in zip(p, origin))
    v = dot(a, cross(b, c))
    return (dot(d, cross(b, c)) / v, dot(d, cross(c, a)) / v, dot(d, cross(a, b)) / v)


def cartesian(f: Vector, cell: Column, origin: Vector) -> Vector:
    m = rows(cell)
    return tuple(origin[j] + sum((f[i] * m[i][j] for i in range(1, 3)), f[0] * m[0][j]) for j in range(3))


def wrap_cell(p: Vector, cell: Column, origin: Vector, pbc: tuple[bool, bool, bool] = (True, True, True)) -> Vector:
    """A point moved into a general cell along its periodic axes."""
    f = fractional(p, cell, origin)
    return cartesian(tuple(x - F.floor(x) if on else x for x, on in zip(f, pbc)), cell, origin)


def cell_matrix(lengths: tuple[float, float, float], angles: tuple[float, float, float] = (90.0, 90.0, 90.0)) -> list[float]:
    """Nine numbers of a cell given by lengths and angles in degrees; an error where they span no volume."""
    ca, cb, cg = (0.0 if abs(x - 90) < 1e-12 else math.cos(math.radians(x)) for x in angles)
    sg = math.sqrt(max(0.0, 1 - cg * cg))
    if min(lengths) <= 0 or sg < 1e-12:
        raise ValueError("cell lengths must be positive and its vectors independent")
    a, b, c = lengths
    cx, cy = c * cb, c * (ca - cb * cg) / sg
    left = c * c - cx * cx - cy * cy
    if left <= 0:
        raise ValueError("cell angles span no volume")
    return [a, 0.0, 0.0, b * cg, b * sg, 0.0, cx, cy, math.sqrt(left)]


def is_orthorhombic(cell: Column, tolerance: float = 1e-8) -> Column:
    """Whether a cell's vectors lie along the axes."""
    return reduce(lambda p, q: p & q, (F.abs(cell[i]) <= tolerance for i in (1, 2, 3, 5, 6, 7)))


def is_prismatic(cell: Column, axis: int = 2, tolerance: float = 1e-8) -> Column:
    """Whether one vector lies along the axis and the others across it."""
    own = [F.abs(cell[3 * axis + j]) <= tolerance for j in range(3) if j != axis]
    rest = [F.abs(cell[3 * i + axis]) <= tolerance for i in range(3) if i != axis]
    return reduce(lambda p, q: p & q, own + rest)


def cell_kind(cell: Column) -> Column:
    return F.when(is_orthorhombic(cell), "orthorhombic").when(is_prismatic(cell), "prismatic").otherwise("general")


def canonical(v: Column, lower: Column | float, period: Column | float, cut: Column | float) -> Column:
    """Height above a circular cut: mod(mod(v - lower) - cut)."""
    return F.pmod(F.pmod(v - lower, F.lit(period)) - cut, F.lit(period))


def uncanonical(c: Column, lower: Column | float, period: Column | float, cut: Column | float) -> Column:
    """The wrapped Cartesian position of a canonical height."""
    return lower + F.pmod(c + cut, F.lit(period))


def shell_volume(lo: Column, hi: Column) -> Column:
    return F.lit(4.0 / 3.0 * math.pi) * (hi * hi * hi - lo * lo * lo)


def taper(r: Column, cutoff: float, width: float) -> Column:
    """1 inside, a cosine half wave across the width, 0 outside; a hard inclusive cutoff without width."""
    if width <= 1e-12:
        return F.when(r <= cutoff, 1.0).otherwise(0.0)
    lo, hi = cutoff - width / 2, cutoff + width / 2
    return F.when(r <= lo, 1.0).when(r < hi, 0.5 * (1 + F.cos(F.lit(math.pi) * (r - lo) / width))).otherwise(0.0)


def cos_polar(o: Vector, h1: Vector, h2: Vector, axis: int = 2, lengths: tuple | None = None) -> Column:
    """Cosine between a water's bisector and an axis; null where a bond or the bisector has no length."""
    u = [tuple(minimum_image(x - y, n) if n is not None else x - y for x, y, n in zip(h, o, lengths or (None,) * 3)) for h in (h1, h2)]
    n = [norm(v) for v in u]
    b = tuple(F.try_divide(p, n[0]) + F.try_divide(q, n[1]) for p, q in zip(*u))
    return F.try_divide(b[axis], norm(b))


def cos_azimuthal(o: Vector, h1: Vector, h2: Vector, axis: int = 2, lengths: tuple | None = None) -> Column:
    """Cosine between the plane's normal, projected off the axis, and the first axis in the plane; null below 1e-12."""
    u = [tuple(minimum_image(x - y, n) if n is not None else x - y for x, y, n in zip(h, o, lengths or (None,) * 3)) for h in (h1, h2)]
    c = cross(*u)
    flat = tuple(F.lit(0.0) if i == axis else x for i, x in enumerate(c))
    length = norm(flat)
    first = 0 if axis != 0 else 1
    return F.when(length > 1e-12, F.try_divide(flat[first], length))


def slab_volume(cell: Column, axis: int, width: Column | float) -> Column:
    """Volume of a slice across an axis: area of the cell's cross-section times the width."""
    own = rows(cell)[axis]
    return F.try_divide(volume(cell), norm(own)) * width


def divided(x: Column, v: Column) -> Column:
    """x / v, 0 where v isn't above 0."""
    return F.when(v > 0, x / v).otherwise(F.lit(0.0))


def align_lateral(p: tuple[Column, Column], matrix: tuple[tuple[int, int], tuple[int, int]], shift: tuple[float, float]) -> tuple[Column, Column]:
    """Fractional lateral coordinates through an integer matrix and a translation, modulo 1."""
    return tuple(F.pmod(p[0] * matrix[0][j] + p[1] * matrix[1][j] + shift[j], F.lit(1.0)) for j in range(2))


def bin_volumes(cell: list[float], edges: list[float], axis: int = 2, origin: float = 0.0) -> list[float]:
    """Volume of the cell between each pair of edges across an axis, for any cell.

    A point of the cell is at height f1 h1 + f2 h2 + f3 h3 with f uniform in [0, 1], h being the vectors' components along the
    axis; the share below a height is the distribution of that sum, in closed form by inclusion and exclusion.
    """
    rows_ = [cell[3 * i : 3 * i + 3] for i in range(3)]
    a, b, c = rows_
    whole = abs(sum(a[i] * (b[(i + 1) % 3] * c[(i + 2) % 3] - b[(i + 2) % 3] * c[(i + 1) % 3]) for i in range(3)))
    h = [r[axis] for r in rows_]
    low = origin + sum(x for x in h if x < 0)
    size = max(abs(x) for x in h)
    steps = [abs(x) for x in h if abs(x) > 1e-9 * size]
    k = len(steps)

    def below(z: float) -> float:
        t = min(max(z - low, 0.0), sum(steps))
        parts = ((-1) ** sum(s) * max(t - sum(x for x, on in zip(steps, s) if on), 0.0) ** k for s in product((0, 1), repeat=k))
        return whole * math.fsum(parts) / (math.factorial(k) * math.prod(steps))

    v = [below(e) for e in edges]
    return [max(y - x, 0.0) for x, y in zip(v, v[1:])]
