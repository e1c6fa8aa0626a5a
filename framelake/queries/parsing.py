"""Selectors, options, registries and cell scalars, applied to texts and numbers made of the driver's tables."""

import json

import numpy as np
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import geometry, text, units
from ..operators import fits, histogram, select, series, statistics
from ..plans import alignment, profiles, surface
from ..schema import HARTREE_EV
from ..sources import store
from ..sources.each import parsed
from . import query

T = A.table


def key():
    return F.col("n_nationkey")


def chosen(options):
    """The nation's key picks one of the texts."""
    return F.element_at(F.array(*map(F.lit, options)), (key() % len(options) + 1).cast("int"))


def picked(values):
    """The same in SQL."""
    return f"({list(values)!r})[n_nationkey % {len(values)} + 1]".replace("None", "NULL")


def nations(spark, sf_dir, value):
    return T(spark, sf_dir, "nation").select(key().alias("source"), value.alias("text"))


_LABELS = ("mol:HO", "H2O", "H", "mol:h", "Pt", "hoh", "mol:OH3", "mol:X")
_USUAL = ("mol:OH", "mol:H2O", None, "mol:H", None, "mol:H2O", "mol:H3O", None)


@query(f"SELECT n_nationkey AS source, {picked(_USUAL)} AS label FROM nation")
def p2_molecule_label(spark, sf_dir):
    return parsed(nations(spark, sf_dir, chosen(_LABELS)), lambda t: [(select.molecule_label(t),)], "label string")


_PAIR_IN = ("all", "*", "elements", "O", "mol:HO", "species:H1", "element:pt", "molecules", "atoms[0..2]")
_PAIR_OUT = ("all", "all", None, "O", "mol:OH", "species:H1", "Pt", None, "atoms[0..2]")


@query(f"SELECT n_nationkey AS source, {picked(_PAIR_OUT)} AS side FROM nation WHERE {picked(_PAIR_OUT)} IS NOT NULL")
def p21_pair_selector(spark, sf_dir):
    return parsed(nations(spark, sf_dir, chosen(_PAIR_IN)), lambda t: [(select.pair_selector(t),)], "side string")


@query("SELECT n_nationkey AS source, true AS valid FROM nation WHERE n_nationkey % 5 IN (0, 1)")
def p22_nearest_axes(spark, sf_dir):
    def parse(t):
        axes, unit = t.split("|")
        select.validate_nearest_axes(axes.split(","), unit)
        return [(True,)]

    return parsed(nations(spark, sf_dir, chosen(("distance|amu/A", "x,distance|1/A^2", "x,y|amu", "distance|amu/A^3", "x,y,distance|amu"))), parse, "valid boolean")


@query("SELECT n_nationkey AS source, round((10.0 + n_nationkey) * cos(radians(60 + n_regionkey)), 9) AS bx, round((10.0 + n_nationkey) * sin(radians(60 + n_regionkey)), 9) AS b_y, 12.0::DOUBLE AS cz FROM nation")
def f3_cell_matrix(spark, sf_dir):
    def parse(t):
        b, gamma = map(float, t.split())
        c = geometry.cell_matrix((8.0, b, 12.0), (90.0, 90.0, gamma))
        return [(round(c[3], 9), round(c[4], 9), c[8])]

    t = F.concat_ws(" ", (key() + 10).cast("string"), (F.col("n_regionkey") + 60).cast("string"))
    return parsed(T(spark, sf_dir, "nation").select(key().alias("source"), t.alias("text")), parse, "bx double, b_y double, cz double")


@query("SELECT n_nationkey AS source FROM nation WHERE n_nationkey % 3 <> 0")
def f3_singular_cells(spark, sf_dir):
    def parse(t):
        geometry.cell_matrix((1.0, 1.0, float(t)), (90.0, 90.0, 90.0 if float(t) < 2 else 120.0))
        return [()]

    return parsed(nations(spark, sf_dir, (key() % 3).cast("string")), parse, "none int").select("source")


@query("SELECT n_nationkey AS source, round(floor(least(n_nationkey + 7.0, 12.5) / 2 / 0.25 + 1e-9) * 0.25, 9)::DOUBLE AS r_max FROM nation")
def f5_auto_r_max(spark, sf_dir):
    return parsed(nations(spark, sf_dir, F.concat((key() + 7).cast("string"), F.lit(" 12.5"))), lambda t: [(round(histogram.auto_r_max([float(x) for x in t.split()], 0.25), 9),)], "r_max double")


@query("SELECT n_nationkey AS source, greatest(1, round_even((n_nationkey + 1) / 4.0 / 0.1, 0))::BIGINT AS bins, round((n_nationkey + 1) / 4.0 / greatest(1, round_even((n_nationkey + 1) / 4.0 / 0.1, 0)), 9)::DOUBLE AS width FROM nation")
def f6_uniform_bins(spark, sf_dir):
    def parse(t):
        n, width = histogram.uniform_rdf_bins(float(t), 0.1)
        return [(n, round(width, 9))]

    return parsed(nations(spark, sf_dir, ((key() + 1) / 4.0).cast("string")), parse, "bins long, width double")


@query("WITH s AS (SELECT n_nationkey, greatest(1, ceil((n_nationkey + 0.3) / 0.5))::BIGINT AS n FROM nation) SELECT n_nationkey AS source, n + (n = 1)::INT AS bins FROM s")
def f9_bin_edges(spark, sf_dir):
    return parsed(nations(spark, sf_dir, key().cast("string")), lambda t: [(histogram.bin_edges(2.0, 2.3 + float(t), 0.5)[1],)], "bins long")


@query("SELECT n_nationkey AS source, i AS bin, round(1.5 + i * (0.1 + n_nationkey / 100.0), 5)::DOUBLE AS lo, round(0.1 + n_nationkey / 100.0, 6)::DOUBLE AS width FROM nation, range(0, 41) r(i) WHERE n_nationkey % 6 <> 0")
def f10_bin_reconstruction(spark, sf_dir):
    """Edges stored as floats, every sixth series with one edge out of place."""
    i = F.explode(F.sequence(F.lit(0), F.lit(40)))
    n = T(spark, sf_dir, "nation").select(key().alias("source"), (0.1 + key() / 100.0).alias("w"), i.alias("bin"))
    off = F.when((F.col("source") % 6 == 0) & (F.col("bin") == 20), 0.01).otherwise(0.0)
    stored = n.select("source", F.col("bin").cast("long").alias("bin"), (1.5 + F.col("bin") * F.col("w") + off).cast("float").alias("edge"))
    out = histogram.reconstructed(stored, "source", "bin", "edge")
    return out.where("uniform").select("source", "bin", F.round("lo", 5).alias("lo"), F.round("width", 6).alias("width"))


@query("SELECT n_nationkey AS source, i AS bin, CASE WHEN i < n_nationkey + 5 THEN 80.0 ELSE 0 END::DOUBLE AS volume FROM nation, range(0, 31) r(i)")
def f11_bin_volumes(spark, sf_dir):
    """Prisms leaning in x and y, whose slices are all alike, with bins beyond the cell."""

    def parse(t):
        k = float(t)
        v = geometry.bin_volumes([10.0, 0.0, 0.0, k, 8.0, 0.0, 0.0, 0.0, 5 + k], [float(i) for i in range(32)])
        return [(i, round(x, 6) + 0.0) for i, x in enumerate(v)]

    return parsed(nations(spark, sf_dir, key().cast("string")), parse, "bin long, volume double")


@query("SELECT n_nationkey AS source, round((CASE WHEN n_nationkey = 0 THEN 0.5 ELSE 0.5 END) * 60.0 * (n_nationkey + 2), 6)::DOUBLE AS below_middle FROM nation")
def f11_skewed_volumes(spark, sf_dir):
    """A general cell is symmetric about its centre: half of it lies below the middle height."""

    def parse(t):
        k = float(t)
        cell = [5.0, 0.0, 1.0, 1.0, 6.0, 2.0, 0.0, 0.0, 2 * (k + 2)]
        top = 1.0 + 2.0 + 2 * (k + 2)
        return [(round(geometry.bin_volumes(cell, [0.0, top / 2, top])[0], 6),)]

    return parsed(nations(spark, sf_dir, key().cast("string")), parse, "below_middle double")


@query("SELECT n_nationkey AS source, (CASE n_nationkey % 3 WHEN 0 THEN 2.18769126364e6 ELSE 1e5 END)::DOUBLE AS factor FROM nation")
def f21_velocity_factor(spark, sf_dir):
    return parsed(nations(spark, sf_dir, chosen(("Atomic", "angstrom/fs", "ANGSTROM/FS"))), lambda t: [(units.velocity_factor(t),)], "factor double")


@query("SELECT n_nationkey AS source, n_nationkey % 3 AS axis FROM nation")
def f22_axis_token(spark, sf_dir):
    return parsed(nations(spark, sf_dir, chosen((" X ", "y", "Z "))), lambda t: [(units.axis_index(t),)], "axis long")


_TOKENS = ("5ps", "50%", "1000f", "500step", "2.5e1 ps", "12", "ps5")


@query(f"SELECT n_nationkey AS source, ([5.0, 50, 1000, 500, 25, 12])[n_nationkey % 7 + 1]::DOUBLE AS value, (['ps', '%', 'f', 'step', 'ps', 'f'])[n_nationkey % 7 + 1] AS unit FROM nation WHERE n_nationkey % {len(_TOKENS)} <> 6")
def f23_selection_token(spark, sf_dir):
    return parsed(nations(spark, sf_dir, chosen(_TOKENS)), lambda t: [text.parse_selection_token(t)], "value double, unit string")


_FERMI = (
    "  Fermi energy [a.u.]:  -0.25", "fermi ENERGY [hartree]: 0.5", "  Fermi energy:   0.125", "Fermi energy [eV]: -3.5", "  E(Fermi) =  -0.75 a.u.", "fermi energy: 0.5", "E(Fermi) = 1.0 eV",
    "Fermi energy [eV]: 1.25 and Fermi energy: 2", "no energy here", "Fermi energy: +1E-1",
)
_FERMI_EV = (-0.25 * HARTREE_EV, 0.5 * HARTREE_EV, 0.125 * HARTREE_EV, -3.5, -0.75 * HARTREE_EV, None, None, 2 * HARTREE_EV, None, 0.1 * HARTREE_EV)


@query(f"SELECT n_nationkey, round({picked(_FERMI_EV)}, 6)::DOUBLE AS fermi_ev FROM nation")
def f25_fermi_forms(spark, sf_dir):
    return T(spark, sf_dir, "nation").select("n_nationkey", F.round(text.fermi_ev(chosen(_FERMI)), 6).alias("fermi_ev"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS stamp FROM events")
def f29_timestamps(spark, sf_dir):
    return T(spark, sf_dir, "events").select("event_id", text.utc_iso(F.col("ts")).alias("stamp"))


@query("SELECT n_nationkey AS source, 'run' || n_nationkey || '-pos.density.h5' AS name, 'run' || n_nationkey || '-pos_2.density.h5' AS second FROM nation")
def f31_output_names(spark, sf_dir):
    names = text.output_name(F.concat(F.lit("run"), key().cast("string"), F.lit("-pos.xyz")), "density")
    return T(spark, sf_dir, "nation").select(key().alias("source"), names.alias("name"), text.numbered_name(names, F.lit(2)).alias("second"))


@query("SELECT n_nationkey AS source, round(n_nationkey + 3 - 1 / 255.0, 9)::DOUBLE AS minimum FROM nation")
def f33_local_minimum(spark, sf_dir):
    """A valley of straight sides: the dense samples nearest to its bottom lie half a step beside it, the first is taken."""

    def parse(t):
        x = np.arange(12, dtype=float) + float(t)
        return [(round(fits.local_minimum(x, np.abs(x - float(t) - 3), 3), 9),)]

    return parsed(nations(spark, sf_dir, key().cast("string")), parse, "minimum double")


@query("SELECT * FROM (VALUES ('charge', 'e'), ('charge_std', 'e'), ('charge_sem', 'e')) t(quantity, unit)")
def x1_schema_registry(spark, sf_dir):
    store.register_analysis("charges", 4, {"charge": "e"})
    return spark.createDataFrame(sorted(store.analysis("charges")["units"].items()), "quantity string, unit string")


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def x2_format_registry(spark, sf_dir):
    from ..shared import place

    read = lambda s, p: s.read.csv(p, sep="|", schema="key string, name string")
    store.register_format("pipes", read, lambda d, p: d.write.mode("overwrite").csv(p, sep="|"))
    path = place(spark, "formats")
    T(spark, sf_dir, "nation").select(key().cast("string").alias("key"), F.col("n_name").alias("name")).write.parquet(f"{path}/a")
    store.convert(spark, f"{path}/a", f"{path}/b", "parquet", "pipes")
    return store.FORMATS["pipes"][0](spark, f"{path}/b")


@query("SELECT * FROM (VALUES ('linear', 2), ('polynomial', 0), ('logarithmic', 2), ('exponential', 3), ('power', 2), ('gaussian', 4), ('lorentzian', 4)) t(model, parameters)")
def x4_fit_models(spark, sf_dir):
    return spark.createDataFrame([(k, len(v)) for k, v in fits.MODELS.items()], "model string, parameters int")


@query("SELECT n_nationkey AS source, CASE WHEN n_nationkey % 2 = 0 THEN 'explicit' WHEN n_nationkey % 3 = 0 THEN 'stored' WHEN n_nationkey % 5 = 0 THEN 'input' WHEN n_nationkey % 7 = 0 THEN 'frame' END AS origin FROM nation")
def c12_cell_precedence(spark, sf_dir):
    t = F.concat_ws("|", *(F.when(key() % k == 0, n).otherwise("") for k, n in ((2, "explicit"), (3, "stored"), (5, "input"), (7, "frame"))))
    return parsed(nations(spark, sf_dir, t), lambda t: [(profiles.resolve(*(x or None for x in t.split("|"))),)], "origin string")


_BOTH = "n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0"


@query("""WITH f AS (SELECT n_nationkey, n_nationkey % 2 = 0 AS ct, n_nationkey % 3 = 0 AS cb, n_nationkey % 5 <> 0 AS tt, n_nationkey % 7 <> 0 AS tb FROM nation)
SELECT n_nationkey AS source, CASE WHEN ct AND cb AND tt AND tb THEN 'symmetric' WHEN ct AND tt THEN 'single-top' WHEN cb AND tb THEN 'single-bottom' WHEN tt THEN 'single-top' WHEN tb THEN 'single-bottom' ELSE 'axis' END AS layout FROM f""")
def g6_layout(spark, sf_dir):
    t = F.concat_ws(" ", *(F.when(c, "1").otherwise("0") for c in (key() % 2 == 0, key() % 3 == 0, key() % 5 != 0, key() % 7 != 0)))

    def parse(t):
        ct, cb, tt, tb = (x == "1" for x in t.split())
        rows = {s: {"mean_count": 12.0 if on else 3.0, "persistence": 0.95} for s, on in (("top", ct), ("bottom", cb))}
        return [(surface.layout_of(rows, tt, tb, 100),)]

    return parsed(nations(spark, sf_dir, t), parse, "layout string")


@query("SELECT n_nationkey AS source, 'ok' AS options FROM nation WHERE n_nationkey % 5 IN (0, 3)")
def g8_options(spark, sf_dir):
    def parse(t):
        surface.Options(**json.loads(t))
        return [("ok",)]

    return parsed(nations(spark, sf_dir, chosen(('{"side": "bottom"}', '{"side": "left"}', '{"quantile": 1.5}', '{"layer_atoms": 4, "gap_min": 0.5}', '{"gap_min": 0}'))), parse, "options string")


@query("SELECT n_nationkey AS source, substr(sha256('{\"axis\": \"z\", \"mode\": \"layered\", \"region\": ' || n_regionkey || '}'), 1, 16) AS key FROM nation")
def g9_cache_key(spark, sf_dir):
    return parsed(T(spark, sf_dir, "nation").select(key().alias("source"), F.col("n_regionkey").cast("string").alias("text")), lambda t: [(surface.cache_key(region=int(t), mode="layered", axis="z"),)], "key string")


@query("SELECT n_nationkey AS source, substr(sha256('[(' || n_regionkey || ', ' || n_nationkey || '), (' || (n_regionkey + 7) || ', 1)]'), 1, 32) AS reference_id FROM nation")
def l1_snapshot_id(spark, sf_dir):
    t = F.concat_ws(" ", (F.col("n_regionkey") + 7).cast("string"), F.lit("1"), F.col("n_regionkey").cast("string"), key().cast("string"))

    def parse(t):
        v = [int(x) for x in t.split()]
        return [(alignment.snapshot_id([tuple(v[:2]), tuple(v[2:])]),)]

    return parsed(T(spark, sf_dir, "nation").select(key().alias("source"), t.alias("text")), parse, "reference_id string")


@query("SELECT n_nationkey, ([8, 12, 4, 2, 4])[n_nationkey % 5 + 1]::BIGINT AS symmetries FROM nation")
def l2_lattice_symmetries(spark, sf_dir):
    """Square, hexagonal, rectangular, oblique and rhombic lattices, each in ever more skewed bases."""
    b1 = F.array(F.lit(10.0), F.lit(0.0))
    b2 = [(0.0, 10.0), (5.0, 8.660254037844386), (0.0, 7.0), (2.2, 7.0), (8.0, 6.0)]
    own = F.element_at(F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in b2)), (key() % 5 + 1).cast("int"))
    skew = F.floor(key() / 5)
    basis = F.array(b1[0], b1[1], own[0] + skew * 10.0, own[1])
    out = alignment.lattice_symmetries(T(spark, sf_dir, "nation").select("n_nationkey", basis.alias("basis")), "n_nationkey")
    return out.groupBy("n_nationkey").agg(F.count_distinct("matrix").alias("symmetries"))


_COLUMNS = ("bin,value", "bin,sample_std,sample_sem", "bin,block_std,block_sem", "numerator,denominator,block,block_sem", "sample_std")
_FIRST = ("none", "sample_sem", "block_sem", "block_ci", "sample_std")


@query(f"SELECT n_nationkey AS source, {picked(_FIRST)} AS statistic FROM nation")
def d6_preferred_statistic(spark, sf_dir):
    return parsed(nations(spark, sf_dir, chosen(_COLUMNS)), lambda t: [(series.statistics_of(t.split(","))[0],)], "statistic string")


_WORDS = ("none", "sem over samples", "sem over blocks", "bootstrap over contiguous blocks", "std over samples")


@query(f"SELECT n_nationkey AS source, {picked(_WORDS)} AS provenance FROM nation")
def d16_error_provenance(spark, sf_dir):
    def parse(t):
        columns = t.split(",")
        return [(series.provenance_of(columns, series.statistics_of(columns)[0]),)]

    return parsed(nations(spark, sf_dir, chosen(_COLUMNS)), parse, "provenance string")


@query(f"WITH {A.ATOMS_SQL}, f AS (SELECT DISTINCT frame_index FROM atoms) SELECT frame_index, ((row_number() OVER (ORDER BY frame_index) - 1) // 3)::BIGINT AS batch FROM f")
def w19_frame_batches(spark, sf_dir):
    return statistics.batched(A.atoms(spark, sf_dir).select("frame_index").distinct(), "frame_index", 3).select("frame_index", "batch")
