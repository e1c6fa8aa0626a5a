"""Figures as text, what may be shown how, and named settings of figures.

Series and maps are drawn as SVG by DataFrame operations: a profile is a bounded group, and its points are scaled by limits that
come from one aggregate. There is no window or widget here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import exists

WIDTH, HEIGHT = 640, 400
SETTINGS = "profile_key string, name string, settings string, version long, deleted boolean, active boolean"


def scaled(rows: DataFrame, c: str, lo: str, hi: str, size: int, *, upward: bool = False):
    """A column as whole pixels between its limits; a lone value stands in the middle."""
    share = F.coalesce(F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.5))
    return F.floor((1 - share if upward else share) * size).cast("int")


def polylines(series: DataFrame, figure: str, name: str, x: str, y: str, *, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(figure, name, points): each series of a figure as the points of a polyline, in order of x; all series share the figure's limits."""
    limits = series.groupBy(figure).agg(*(f(c).alias(f"_{n}{c}") for c in (x, y) for n, f in (("a", F.min), ("z", F.max))))
    p = series.join(limits, figure).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = F.concat_ws(",", scaled(p, x, f"_a{x}", f"_z{x}", width).cast("string"), scaled(p, y, f"_a{y}", f"_z{y}", height, upward=True).cast("string"))
    points = F.transform(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), at.alias("at")))), lambda v: v["at"])
    return p.groupBy(figure, name).agg(F.concat_ws(" ", points).alias("points"))


def svg_lines(series: DataFrame, figure: str, name: str, x: str, y: str, **size: int) -> DataFrame:
    """(figure, value): one SVG text for each figure, its series in order of name."""
    lines = polylines(series, figure, name, x, y, **size)
    one = F.concat(F.lit('<polyline fill="none" data-name="'), F.col(name).cast("string"), F.lit('" points="'), "points", F.lit('"/>'))
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), one.alias("s")))), lambda v: v["s"])
    return lines.groupBy(figure).agg(_document(F.concat_ws("", body), **size).alias("value"))


def svg_heatmap(cells: DataFrame, figure: str, ix: str, iy: str, value: str, *, cell: int = 8) -> DataFrame:
    """(figure, value): a square for each cell of a map, its opacity in hundredths of the figure's largest value."""
    top = cells.groupBy(figure).agg(F.max(value).alias("_top"), (F.max(ix) + 1).alias("_nx"), (F.max(iy) + 1).alias("_ny"))
    c = cells.join(top, figure)
    shade = F.floor(F.coalesce(F.try_divide(F.col(value), F.col("_top")), F.lit(0.0)) * 100).cast("int")
    one = F.format_string('<rect x="%d" y="%d" opacity="%d%%"/>', (F.col(ix) * cell).cast("int"), ((F.col("_ny") - 1 - F.col(iy)) * cell).cast("int"), shade)
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ix).alias("i"), F.col(iy).alias("j"), one.alias("s")))), lambda v: v["s"])
    drawn = c.groupBy(figure).agg(F.concat_ws("", body).alias("body"), (F.max("_nx") * cell).alias("w"), (F.max("_ny") * cell).alias("h"))
    head = F.format_string('<svg viewBox="0 0 %d %d">', F.col("w").cast("int"), F.col("h").cast("int"))
    return drawn.select(figure, F.concat(head, "body", F.lit("</svg>")).alias("value"))


def _document(body, width: int = WIDTH, height: int = HEIGHT):
    return F.concat(F.lit(f'<svg viewBox="0 0 {width} {height}">'), body, F.lit("</svg>"))


@dataclass(frozen=True)
class Contract:
    """What a source offers: its quantities with the dimensions that each depends on, and the views that it has."""

    quantities: dict[str, tuple[str, ...]]
    views: tuple[str, ...] = ("line", "heatmap")
    texts: frozenset[str] = field(default_factory=frozenset)

    def verdict(self, view: str, **roles: str) -> str:
        """preferred, allowed or invalid: a line needs x and y of the same dimension, a heatmap x and y of different ones and z of both."""
        needed = {"line": ("x", "y"), "heatmap": ("x", "y", "z")}.get(view)
        if view not in self.views or needed is None or set(needed) - set(roles) or any(r not in self.quantities or r in self.texts for r in roles.values()):
            return "invalid"
        x, y = self.quantities[roles["x"]], self.quantities[roles["y"]]
        if view == "line":
            return "preferred" if x == y and len(y) == 1 else "allowed" if set(x) < set(y) else "invalid"
        z = self.quantities[roles["z"]]
        return "preferred" if len(x) == len(y) == 1 and x != y and set(z) == {*x, *y} else "invalid"


class Actions:
    """Named actions with the fields that each asks for; a name can be taken once."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, ...]] = {}

    def register(self, name: str, fields: tuple[str, ...]) -> None:
        if name in self.known:
            raise ValueError(f"the action {name!r} is there already")
        self.known[name] = fields

    def missing(self, name: str, values: dict[str, str]) -> list[str]:
        """Fields of an action that lack a value; an unknown action is an error."""
        if name not in self.known:
            raise ValueError(f"no action {name!r}")
        return [f for f in self.known[name] if not values.get(f)]


def log_settings(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Appends changes (profile_key, name, settings, deleted, active) as the next version; nothing that is stored is rewritten."""
    last = spark.read.schema(SETTINGS).parquet(path).agg(F.max("version")).first()[0] if exists(spark, path) else None
    rows.select("profile_key", "name", "settings", F.lit((last or 0) + 1).cast("long").alias("version"), "deleted", "active").write.mode("append").parquet(path)


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(profile_key, name, settings, active): the last version of each name that isn't deleted; the one set active last is active."""
    log = spark.read.schema(SETTINGS).parquet(path)
    now = log.groupBy("profile_key", "name").agg(F.max_by("settings", "version").alias("settings"), F.max_by("deleted", "version").alias("deleted"), F.max(F.when(F.col("active"), F.col("version"))).alias("since")).where("not deleted")
    newest = F.max("since").over(W.partitionBy("profile_key"))
    return now.select("profile_key", "name", "settings", F.coalesce(F.col("since") == newest, F.lit(False)).alias("active"))


def copied(current: DataFrame, name: str, new: str) -> DataFrame:
    """The change that copies settings to a new name."""
    return current.where(F.col("name") == name).select("profile_key", F.lit(new).alias("name"), "settings", F.lit(False).alias("deleted"), F.lit(False).alias("active"))
