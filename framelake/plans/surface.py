"""Surface planes of a slab by frame: layered and rough estimates, choice of layout, distances to the surface."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import temporal_score
from ..operators.statistics import mobility as _mobility
from ..schema import ELEMENTS


# Defaults, and the weights in the confidence and composite scores below, which results must agree with.


@dataclass(frozen=True)
class Options:
    """Parameters of the estimates, in angstrom where they are lengths."""

    side: str = "top"
    gap_min: float = 0.25
    gap_factor: float = 3.0
    layer_fraction: float = 0.03
    layer_atoms: int = 2
    layer_spread: float = 0.75
    rough_fraction: float = 0.35
    rough_min: int = 3
    rough_cap: int = 6
    rough_spread: float = 1.5
    quantile: float = 0.9
    mass_weight: float = 0.1
    fill_gap: int = 2
    fill_tolerance: float = 0.75
    jump: float = 1.5
    confidence: float = 0.55

    def __post_init__(self) -> None:
        if self.side not in ("top", "bottom"):
            raise ValueError(f"side is top or bottom, not {self.side!r}")
        if not 0 < self.quantile < 1 or not 0 < self.rough_fraction <= 1 or not 0 <= self.confidence <= 1:
            raise ValueError("a fraction is out of its range")
        if min(self.gap_min, self.gap_factor, self.layer_spread, self.rough_spread, self.fill_tolerance, self.jump) <= 0 or min(self.layer_atoms, self.rough_min, self.rough_cap) < 1 or self.fill_gap < 0:
            raise ValueError("a length, factor or count is out of its range")


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def surface_elements(atoms: DataFrame, override: list[str] | None = None) -> DataFrame:
    """(element): at most four, of low mobility and 3 % abundance; without a difference in mobility, of 8 % abundance and a quarter of the largest mass."""
    spark = atoms.sparkSession
    if override:
        return spark.createDataFrame([(e,) for e in override], "element string")
    z = atoms.groupBy("atom_index").agg(F.first("element").alias("element"), F.median("z").alias("m"))
    mob = atoms.join(z.select("atom_index", "m"), "atom_index").groupBy("atom_index", "element").agg(F.median(F.abs(F.col("z") - F.col("m"))).alias("mob"))
    mass = F.create_map(*(F.lit(x) for s, (_, w) in ELEMENTS.items() for x in (s, w)))
    e = mob.groupBy("element").agg(F.count("*").alias("n"), F.median("mob").alias("mob")).withColumn("mass", mass[F.col("element")])
    every = W.partitionBy()  # a row for each element
    e = e.withColumn("total", F.sum("n").over(every)).withColumn("low", F.min("mob").over(every)).withColumn("high", F.max("mob").over(every))
    slow = (F.col("mob") <= F.greatest(F.col("low") + 0.02, F.col("low") * 2.5)) & (F.col("n") >= F.greatest(F.lit(2), F.ceil(0.03 * F.col("total"))))
    abundant = F.col("n") >= F.greatest(F.lit(2), F.ceil(0.08 * F.col("total")))
    heavy = abundant & (F.col("mass") >= 0.25 * F.max(F.when(abundant, F.col("mass"))).over(every))
    e = e.withColumn("by_mobility", (F.col("high") - F.col("low")) > 1e-8).withColumn("ok", F.when(F.col("by_mobility"), slow).otherwise(heavy))
    order = W.orderBy(F.when(F.col("by_mobility"), F.col("mob")).otherwise(0.0), F.desc("n"), F.desc("mass"), "element")
    return e.where("ok").withColumn("r", F.row_number().over(order)).where("r <= 4").select("element")


def layers(candidates: DataFrame, options: Options) -> DataFrame:
    """(frame_index, atom_index, z, in_layer, n, gap, base, has_break): the outermost layer of each frame behind its outermost wide gap."""
    top = options.side == "top"
    w = W.partitionBy("frame_index").orderBy("z", "atom_index")
    g = candidates.select("frame_index", "atom_index", "z").withColumn("gap", F.col("z") - F.lag("z").over(w))
    ranked = g.where("gap is not null").withColumn("r", F.row_number().over(W.partitionBy("frame_index").orderBy("gap"))).withColumn("k", F.count("*").over(W.partitionBy("frame_index")))
    base = ranked.groupBy("frame_index").agg(F.median(F.when(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("k") / 2)), F.col("gap"))).alias("base"), F.max("gap").alias("largest"))
    g = g.join(base, "frame_index", "left")
    wide = F.col("gap") >= F.greatest(F.lit(options.gap_min), options.gap_factor * F.col("base"))
    widest = (F.col("gap") == F.col("largest")) & (F.col("gap") >= 2 * options.gap_min)
    outer = F.max if top else F.min
    cut = g.groupBy("frame_index").agg(F.count("*").alias("n"), F.coalesce(outer(F.when(wide, F.col("z"))), F.min(F.when(widest, F.col("z")))).alias("cut"))
    g = g.join(cut, "frame_index")
    inside = F.col("z") >= F.col("cut") if top else F.col("z") < F.col("cut")
    return g.select("frame_index", "atom_index", "z", F.coalesce(inside, F.lit(False)).alias("in_layer"), "n", F.col("largest").alias("gap"), "base", F.col("cut").isNotNull().alias("has_break"))


def layered(candidates: DataFrame, options: Options = Options()) -> DataFrame:
    """(frame_index, value, confidence, provenance, reason, size, spread): the layer's median height, with rejections, tracked fill of short gaps and jump rejection."""
    top = options.side == "top"
    atoms = layers(candidates, options)
    inner = F.when(F.col("in_layer"), F.col("z"))
    bulk = F.when(~F.col("in_layer"), F.col("z"))
    f = atoms.groupBy("frame_index").agg(F.first("n").alias("n"), F.first("gap").alias("gap"), F.first("base").alias("base"), F.first("has_break").alias("has_break"), F.count(inner).alias("size"), F.median(inner).alias("m"), F.stddev_pop(inner).alias("spread"), (F.min(inner) if top else F.max(inner)).alias("edge"), F.percentile(bulk, F.lit(0.75 if top else 0.25)).alias("bulk"))
    least = F.greatest(F.lit(options.layer_atoms), F.ceil(options.layer_fraction * F.col("n")))
    overlap = F.col("edge") <= F.col("bulk") if top else F.col("edge") >= F.col("bulk")
    reason = F.when(F.col("n") < 2, "insufficient_candidates").when(~F.col("has_break"), "no_layer_break").when(F.col("size") < least, "top_layer_too_small").when(F.col("spread") > options.layer_spread, "top_layer_too_broad").when(F.coalesce(overlap, F.lit(False)), f"{options.side}_layer_overlaps_bulk").otherwise("")
    f = f.withColumn("reason", reason).withColumn("value", F.when(F.col("reason") == "", F.col("m")))

    # Short gaps follow the atoms of the nearest frame that has a layer.
    w = W.orderBy("frame_index")  # a row for each frame
    f = f.withColumn("run", F.sum(F.when(F.col("value").isNull(), 0).otherwise(1)).over(w))
    f = f.withColumn("missing", F.count(F.when(F.col("value").isNull(), 1)).over(W.partitionBy("run")))
    seen = F.when(F.col("has_break") & (F.col("size") > 0), F.col("frame_index"))
    before, after = F.last(seen, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(seen, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    f = f.withColumn("from", F.when(before.isNull() | (after - F.col("frame_index") < F.col("frame_index") - before), after).otherwise(before))
    f = f.withColumn("left", F.last("value", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("right", F.first("value", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
    holes = f.where(F.col("value").isNull() & (F.col("missing") <= options.fill_gap)).select("frame_index", "from")
    members = atoms.where("in_layer").select(F.col("frame_index").alias("from"), "atom_index")
    tracked = holes.join(members, "from").join(candidates.select("frame_index", "atom_index", "z"), ["frame_index", "atom_index"]).groupBy("frame_index").agg(F.median("z").alias("tm"), F.stddev_pop("z").alias("ts"), F.count("*").alias("tn"))
    f = f.join(tracked, "frame_index", "left")
    off = F.coalesce(F.greatest(F.abs(F.col("tm") - F.col("left")), F.abs(F.col("tm") - F.col("right"))), F.lit(0.0))
    fill = F.col("value").isNull() & F.col("tm").isNotNull()
    f = f.withColumn("fill", fill & (off <= options.fill_tolerance)).withColumn("reason", F.when(F.col("fill"), "").when(fill, "tracked_fill_inconsistent").otherwise(F.col("reason")))
    f = f.withColumn("provenance", F.when(F.col("fill"), "tracked_fill").when(F.col("value").isNotNull(), "direct_layered").otherwise("missing"))
    f = f.withColumn("value", F.when(F.col("fill"), F.col("tm")).otherwise(F.col("value"))).withColumn("spread", F.when(F.col("fill"), F.col("ts")).otherwise(F.col("spread"))).withColumn("size", F.when(F.col("fill"), F.col("tn")).otherwise(F.col("size")))
    f = without_jumps(f, options)
    threshold = F.greatest(F.lit(options.gap_min), options.gap_factor * F.greatest(F.col("base"), F.lit(1e-12)))
    score = 0.35 * clip(F.col("gap") / threshold, 0.0, 1.5) / 1.5 + 0.25 * clip(F.col("size") / F.greatest(F.lit(float(options.layer_atoms)), options.layer_fraction * F.col("n")), 0.0, 1.0)
    score = score + 0.2 * clip(1 - F.col("spread") / options.layer_spread, 0.0, 1.0) + 0.2 * F.col("score")
    confidence = F.when(F.col("value").isNull(), 0.0).when(F.col("provenance") == "tracked_fill", 0.75 * score).otherwise(score)
    return f.select("frame_index", "value", confidence.alias("confidence"), "provenance", "reason", F.col("size").cast("long").alias("size"), "spread")


def without_jumps(f: DataFrame, options: Options) -> DataFrame:
    """Values that jump from both neighbours are dropped; `score` is the temporal score."""
    f = f.withColumn("one", F.lit(0)).withColumn("valid", F.col("value").isNotNull())
    f = temporal_score(f, ["one"], "frame_index", "value", "valid", options.jump)
    jump = F.col("valid") & (F.col("score") <= 0)
    return f.withColumn("reason", F.when(jump, "jump_reject").otherwise(F.col("reason"))).withColumn("provenance", F.when(jump, "missing").otherwise(F.col("provenance"))).withColumn("value", F.when(~jump, F.col("value"))).drop("one", "valid")


def rough(candidates: DataFrame, options: Options = Options(), cell_length: float | None = None) -> DataFrame:
    """(frame_index, value, confidence, provenance, reason, size, spread): the median of slow, heavy atoms near the outer side; the side's quantile where there are too few."""
    top = options.side == "top"
    sign = 1.0 if top else -1.0
    mob = _mobility(candidates)
    mass = F.create_map(*(F.lit(x) for s, (_, w) in ELEMENTS.items() for x in (s, w)))
    a = candidates.groupBy("atom_index").agg(F.median(F.col("z") * sign).alias("h"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.first(mass[F.col("element")]).alias("mass")).join(mob, "atom_index")
    d = a.withColumn("gap", F.lag("h").over(W.orderBy(F.desc("h"), "atom_index")) - F.col("h")).withColumn("outer", F.max("h").over(W.partitionBy()))  # a row for each atom
    d = d.withColumn("r", F.row_number().over(W.orderBy(F.col("gap").asc_nulls_last()))).withColumn("k", F.count("gap").over(W.partitionBy()))
    base = F.median(F.when((F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("k") / 2))), F.col("gap"))).over(W.partitionBy())
    d = d.withColumn("base", base)
    wide = (F.col("gap") > 1e-6) & (F.col("gap") >= F.greatest(F.lit(options.gap_min), options.gap_factor * F.col("base")))
    gap = F.coalesce(F.max_by(F.when(wide, F.col("gap")), F.when(wide, F.col("h"))).over(W.partitionBy()), F.max("gap").over(W.partitionBy()))
    d = d.withColumn("envelope", F.greatest(0.75 * gap, 3 * F.col("base"), F.lit(options.gap_min))).withColumn("depth", F.col("outer") - F.col("h"))
    tries = d.withColumn("times", F.explode(F.array(*map(F.lit, (1.0, 1.5, 2.0, 3.0))))).where(F.col("depth") <= F.col("envelope") * F.col("times"))
    fits = tries.groupBy("times").agg(F.count("*").alias("n"), (F.max("hi") - F.min("lo")).alias("span")).where(F.col("n") >= options.rough_min)
    if cell_length:
        fits = fits.where(F.col("span") <= 0.35 * cell_length)
    chosen = tries.join(F.broadcast(fits.agg(F.min("times").alias("times"))), "times")  # one row
    n = F.count("*").over(W.partitionBy())
    combined = F.row_number().over(W.orderBy("mobility", "atom_index")) + options.mass_weight * F.row_number().over(W.orderBy(F.desc("mass"), "atom_index"))
    chosen = chosen.withColumn("n", n).withColumn("combined", combined)
    want = F.least(F.greatest(F.ceil(options.rough_fraction * F.col("n")), F.lit(options.rough_min)), F.lit(options.rough_cap), F.col("n"))
    chosen = chosen.withColumn("place", F.row_number().over(W.orderBy("combined", "atom_index"))).where(F.col("place") <= want)
    near = chosen.agg(clip(1 - F.max("depth") / F.max(F.col("envelope") * F.col("times")), 0.0, 1.0).alias("near"))
    slow = candidates.join(F.broadcast(chosen.select("atom_index")), "atom_index", "left_semi").groupBy("frame_index").agg(F.median("z").alias("m"), F.stddev_pop("z").alias("s"), F.count("*").alias("size"))
    f = candidates.groupBy("frame_index").agg(F.percentile("z", F.lit(options.quantile if top else 1 - options.quantile)).alias("q"), F.stddev_pop("z").alias("qs"))
    f = f.join(slow, "frame_index", "left").join(F.broadcast(near))  # one row
    narrow = F.col("s") <= options.rough_spread
    any_slow = F.max(narrow.cast("int")).over(W.partitionBy())
    f = f.withColumn("low_mobility", F.coalesce(any_slow == 1, F.lit(False)))
    f = f.withColumn("value", F.when(F.col("low_mobility"), F.when(narrow, F.col("m"))).otherwise(F.col("q"))).withColumn("spread", F.when(F.col("low_mobility"), F.col("s")).otherwise(F.col("qs")))
    f = f.withColumn("reason", F.when(F.col("value").isNull(), "reference_set_too_broad").otherwise("")).withColumn("provenance", F.when(F.col("value").isNull(), "missing").when(F.col("low_mobility"), "direct_rough_low_mobility").otherwise("direct_rough_quantile"))
    f = without_jumps(f, options)
    score = 0.35 * clip(1 - F.col("spread") / options.rough_spread, 0.0, 1.0) + 0.2 * F.col("score") + 0.25 * F.when(F.col("low_mobility"), 1.0).otherwise(0.6) + 0.2 * F.when(F.col("low_mobility"), F.coalesce("near", F.lit(1.0))).otherwise(1.0)
    return f.select("frame_index", "value", F.when(F.col("value").isNull(), 0.0).otherwise(score).alias("confidence"), "provenance", "reason", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "spread")


def composite(estimate: DataFrame, spread_limit: float, options: Options = Options()) -> DataFrame:
    """One row: valid_fraction, median_confidence, smoothness, spread_quality and their weighted score."""
    ok = F.col("value").isNotNull()
    step = estimate.where(ok).withColumn("d", F.abs(F.col("value") - F.lag("value").over(W.orderBy("frame_index"))))
    smooth = step.agg(F.median("d").alias("d"))
    a = estimate.agg(F.avg(ok.cast("double")).alias("valid_fraction"), F.coalesce(F.median(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("median_confidence"), F.count(F.when(ok, 1)).alias("n"), F.count("*").alias("all"), F.median(F.when(ok, F.col("spread"))).alias("s"))
    a = a.join(F.broadcast(smooth))  # one row each
    a = a.withColumn("smoothness", F.when(F.col("n") <= 1, F.when((F.col("n") == F.col("all")) & (F.col("n") > 0), 1.0).otherwise(0.0)).otherwise(clip(1 - F.col("d") / options.jump, 0.0, 1.0)))
    a = a.withColumn("spread_quality", F.coalesce(clip(1 - F.col("s") / spread_limit, 0.0, 1.0), F.lit(0.0)))
    return a.select("valid_fraction", "median_confidence", "smoothness", "spread_quality", (0.35 * F.col("valid_fraction") + 0.35 * F.col("median_confidence") + 0.15 * F.col("smoothness") + 0.15 * F.col("spread_quality")).alias("score"))


def trusted(estimate: DataFrame, options: Options = Options()) -> DataFrame:
    """One row: whether all frames are valid and the median confidence is high enough."""
    return estimate.agg((F.every(F.col("value").isNotNull()) & (F.median("confidence") >= options.confidence)).alias("trusted"))


def estimate(candidates: DataFrame, mode: str = "auto", options: Options = Options(), cell_length: float | None = None) -> tuple[DataFrame, str]:
    """The layered or the rough estimate; auto takes the better by score, valid fraction and confidence. The choice needs two single rows on the driver."""
    if mode in ("layered", "rough"):
        return (layered(candidates, options), mode) if mode == "layered" else (rough(candidates, options, cell_length), mode)
    both = {"layered": (layered(candidates, options), options.layer_spread), "rough": (rough(candidates, options, cell_length), options.rough_spread)}
    rank = {k: composite(e, s, options).first() for k, (e, s) in both.items()}
    best = max(both, key=lambda k: (rank[k]["score"], rank[k]["valid_fraction"], rank[k]["median_confidence"], k == "layered"))
    return both[best][0], best


def distances(points: DataFrame, top: DataFrame, bottom: DataFrame, layout: str, period: float) -> DataFrame:
    """Points with distance, top_distance, bottom_distance and side; c is the canonical height, is_substrate marks the slab.

    symmetric: the larger of both, side its sign, 0 within 1e-10. single-top: fluid below the bottom plane belongs above
    the top one, a period up; single-bottom alike.
    """
    t, b = (e.select("frame_index", F.col("value").alias(n), F.coalesce("spread", F.lit(0.0)).alias(f"{n}_s")) for e, n in ((top, "_t"), (bottom, "_b")))
    p = points.join(F.broadcast(t), "frame_index", "left").join(F.broadcast(b), "frame_index", "left")  # a row for each frame
    up, down = F.col("c") - F.col("_t"), F.col("_b") - F.col("c")
    fluid = ~F.col("is_substrate")
    tolerance = 1e-10 * max(1.0, abs(period))
    if layout == "single-top":
        up = F.when(fluid & (F.col("c") < F.col("_b") - F.greatest(F.lit(tolerance), F.col("_b_s"))), up + period).otherwise(up)
        distance, side = up, F.lit(1)
    elif layout == "single-bottom":
        down = F.when(fluid & (F.col("c") > F.col("_t") + F.greatest(F.lit(tolerance), F.col("_t_s"))), down + period).otherwise(down)
        distance, side = down, F.lit(-1)
    elif layout == "symmetric":
        distance, side = F.greatest(up, down), F.when(up - down > 1e-10, 1).when(up - down < -1e-10, -1).otherwise(0)
    else:
        distance, side = F.col("c"), F.lit(0)
    return p.withColumn("distance", distance).withColumn("top_distance", up).withColumn("bottom_distance", down).withColumn("side", side.cast("int")).drop("_t", "_b", "_t_s", "_b_s")


def layout(populations: DataFrame, top_trusted: bool, bottom_trusted: bool, waters: int, requested: str = "auto") -> str:
    """symmetric, single-top, single-bottom or axis: contact that persists on both sides or on one, else a trusted plane."""
    if requested != "auto":
        return requested
    return layout_of({r["side"]: r for r in populations.collect()}, top_trusted, bottom_trusted, waters)  # two rows


def layout_of(rows: dict, top_trusted: bool, bottom_trusted: bool, waters: int) -> str:
    contact = {s: s in rows and rows[s]["mean_count"] >= 0.10 * waters and rows[s]["persistence"] >= 0.90 for s in ("top", "bottom")}
    if all(contact.values()) and top_trusted and bottom_trusted:
        return "symmetric"
    for s, ok in (("top", top_trusted), ("bottom", bottom_trusted)):
        if contact[s] and ok:
            return f"single-{s}"
    return "single-top" if top_trusted else "single-bottom" if bottom_trusted else "axis"


def nearest_distances(points: DataFrame, substrate: DataFrame, lengths: tuple[float, float, float], *, symmetric: bool = False, middle: float | None = None) -> DataFrame:
    """(frame_index, atom_index, distance, side): distance to the nearest substrate atom; symmetric takes each half of the slab alone, the nearer side wins."""
    from ..operators.pairs import nearest_in_shells

    first = min(lengths) / 8
    if not symmetric:
        return nearest_in_shells(points, substrate, lengths, first).select("frame_index", "atom_index", "distance", F.lit(0).alias("side"))
    up, down = (nearest_in_shells(points, substrate.where(w), lengths, first).select("frame_index", "atom_index", F.col("distance").alias(n)) for w, n in ((F.col("z") >= middle, "_u"), (F.col("z") < middle, "_d")))
    both = up.join(down, ["frame_index", "atom_index"], "full")
    side = F.when(F.col("_d").isNull() | (F.col("_u") < F.col("_d") - 1e-10), 1).when(F.col("_u").isNull() | (F.col("_d") < F.col("_u") - 1e-10), -1).otherwise(0)
    return both.select("frame_index", "atom_index", F.least("_u", "_d").alias("distance"), side.alias("side"))


def bind(reference: DataFrame, frames: DataFrame) -> DataFrame:
    """The reference joined to the frames again; an error if a frame has no plane or the other way round."""
    a, b = reference.select("frame_index").distinct(), frames.select("frame_index").distinct()
    odd = a.join(b, "frame_index", "left_anti").unionByName(b.join(a, "frame_index", "left_anti"))
    if not odd.isEmpty():
        raise ValueError("the surface reference belongs to other frames")
    return frames.join(F.broadcast(reference), "frame_index")  # a row for each frame


def cache_key(**options: object) -> str:
    """Names a stored estimate by all that it depends on."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()[:16]
