from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import geometry as G
from ..functions import text, units
from ..operators import histogram
from . import query

AT, SE = A.ATOMS_SQL, A.SERIES_SQL
T = A.table


@query(f"WITH {AT} SELECT atom_index, round(((x * 3) - 10 * round_even(x * 3 / 10.0, 0)), 9) AS d FROM atoms")
def f1_minimum_image(spark, sf_dir):
    return A.atoms(spark, sf_dir).select("atom_index", F.round(G.minimum_image(F.col("x") * 3, 10.0), 9).alias("d"))


@query(f"WITH {AT} SELECT atom_index, round(2 + ((x * 3 - 2) / 4.0 - floor((x * 3 - 2) / 4.0)) * 4.0, 9) AS x FROM atoms")
def f2_wrap(spark, sf_dir):
    return A.atoms(spark, sf_dir).select("atom_index", F.round(G.wrap(F.col("x") * 3, 4.0, 2.0), 9).alias("x"))


@query(f"WITH {AT}, f AS (SELECT atom_index, x, (y / 8.0) AS fb, (x - (y / 8.0) * 2.0) / 6.0 AS fa FROM atoms) SELECT atom_index, round((fa - floor(fa)) * 6.0 + (fb - floor(fb)) * 2.0, 6) AS x FROM f")
def f2_wrap_triclinic(spark, sf_dir):
    cell = F.array(*(F.lit(float(v)) for v in (6, 0, 0, 2, 8, 0, 0, 0, 10)))
    p = G.wrap_cell((F.col("x"), F.col("y"), F.col("z")), cell, (F.lit(0.0),) * 3)
    return A.atoms(spark, sf_dir).select("atom_index", F.round(p[0], 6).alias("x"))


@query("SELECT n_nationkey, (10.0 + n_nationkey) * 8 * 5 AS volume, round(sqrt(1.0) * (10.0 + n_nationkey), 9)::DOUBLE AS height FROM nation")
def f4_volume_and_heights(spark, sf_dir):
    cell = F.array(10.0 + F.col("n_nationkey"), *(F.lit(float(v)) for v in (0, 0, 0, 8, 0, 0, 0, 5)))
    return T(spark, sf_dir, "nation").select("n_nationkey", G.volume(cell).alias("volume"), F.round(G.heights(cell)[0], 9).alias("height"))


@query("SELECT n_nationkey, round(4 / 3.0 * pi() * ((n_nationkey + 1.0) ** 3 - n_nationkey ** 3), 6) AS volume FROM nation")
def f7_shell_volume(spark, sf_dir):
    n = F.col("n_nationkey").cast("double")
    return T(spark, sf_dir, "nation").select("n_nationkey", F.round(G.shell_volume(n, n + 1), 6).alias("volume"))


@query("SELECT n_nationkey, round(CASE WHEN n_nationkey / 5.0 <= 1.75 THEN 1 WHEN n_nationkey / 5.0 < 3.25 THEN 0.5 * (1 + cos(pi() * (n_nationkey / 5.0 - 1.75) / 1.5)) ELSE 0 END, 9)::DOUBLE AS weight FROM nation")
def f8_taper(spark, sf_dir):
    return T(spark, sf_dir, "nation").select("n_nationkey", F.round(G.taper(F.col("n_nationkey") / 5.0, 2.5, 1.5), 9).alias("weight"))


@query(f"WITH {AT}, c AS (SELECT atom_index, (x - 1) - 10 * floor((x - 1) / 10.0) AS p FROM atoms) SELECT atom_index, round((p - 3) - 10 * floor((p - 3) / 10.0), 9) AS c FROM c")
def f13_canonical_axis(spark, sf_dir):
    return A.atoms(spark, sf_dir).select("atom_index", F.round(G.canonical(F.col("x"), 1.0, 10.0, 3.0), 9).alias("c"))


@query(f"WITH {AT} SELECT atom_index, round(1 + ((x + 3) - 10 * floor((x + 3) / 10.0)), 9) AS z FROM atoms")
def f36_plane_back_mapping(spark, sf_dir):
    return A.atoms(spark, sf_dir).select("atom_index", F.round(G.uncanonical(F.col("x"), 1.0, 10.0, 3.0), 9).alias("z"))


WATER = f"{AT}, u AS (SELECT atom_index, x - 5 AS ax, y - 5 AS ay, z - 5 AS az, y - 5 AS bx, z - 5 AS b_y, x - 5 AS bz FROM atoms), n AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS n FROM u)"


def water(spark, sf_dir):
    five = (F.lit(5.0),) * 3
    return A.atoms(spark, sf_dir), five, (F.col("x"), F.col("y"), F.col("z")), (F.col("y"), F.col("z"), F.col("x"))


@query(f"WITH {WATER} SELECT atom_index, round((az/n + bz/n) / sqrt((ax/n+bx/n)**2 + (ay/n+b_y/n)**2 + (az/n+bz/n)**2), 6) AS cos_polar FROM n")
def f14_cos_polar(spark, sf_dir):
    atoms, o, h1, h2 = water(spark, sf_dir)
    return atoms.select("atom_index", F.round(G.cos_polar(o, h1, h2), 6).alias("cos_polar"))


@query(f"WITH {WATER}, c AS (SELECT atom_index, ay*bz - az*b_y AS cx, az*bx - ax*bz AS cy FROM n) SELECT atom_index, round(cx / sqrt(cx*cx + cy*cy), 5) AS cos_azimuthal FROM c")
def f15_cos_azimuthal(spark, sf_dir):
    atoms, o, h1, h2 = water(spark, sf_dir)
    return atoms.select("atom_index", F.round(G.cos_azimuthal(o, h1, h2), 5).alias("cos_azimuthal"))


@query("SELECT s_suppkey, s_acctbal * CASE s_suppkey % 3 WHEN 0 THEN 1e24 WHEN 1 THEN 1e3 ELSE 1.0 END AS value, CASE s_suppkey % 3 WHEN 0 THEN 'g/cm^3' WHEN 1 THEN 'atom/nm^3' ELSE 'K' END AS unit FROM supplier")
def f17_density_units(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    value, unit = units.density(F.col("s_acctbal"), F.when(k == 0, "g/A^3").when(k == 1, "atom/A^3").otherwise("K"))
    return T(spark, sf_dir, "supplier").select("s_suppkey", value.alias("value"), unit.alias("unit"))


@query("SELECT o_orderstatus, (floor(log10(max(o_totalprice)) / 3) * 3)::INT AS exponent FROM orders GROUP BY 1")
def f18_prefix_exponent(spark, sf_dir):
    return T(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(units.prefix_exponent(F.max("o_totalprice")).alias("exponent"))


@query("SELECT s_suppkey, round(s_acctbal * 2.5 - 3, 6) AS x FROM supplier")
def f20_linear_transform(spark, sf_dir):
    return T(spark, sf_dir, "supplier").select("s_suppkey", F.round(units.linear(F.col("s_acctbal"), 2.5, -3), 6).alias("x"))


@query(f"WITH {SE} SELECT event_id, TRY_CAST(regexp_extract(props, '[-+]?[0-9]+(\\.[0-9]*)?', 0) AS DOUBLE) AS k FROM series")
def f24_number_extraction(spark, sf_dir):
    return A.series(spark, sf_dir).select("event_id", text.last_number(F.col("props")).alias("k"))


@query("SELECT n_nationkey, round((n_nationkey + 0.5)::DOUBLE * 27.211386245988::DOUBLE, 6) AS fermi_ev FROM nation")
def f25_fermi_energy(spark, sf_dir):
    line = F.format_string("  Fermi energy:   %sD+00 a.u.", (F.col("n_nationkey") + 0.5).cast("string"))
    return T(spark, sf_dir, "nation").select("n_nationkey", F.round(text.fermi_ev(line), 6).alias("fermi_ev"))


@query("SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS k FROM part")
def f26_text_key(spark, sf_dir):
    return T(spark, sf_dir, "part").select("p_partkey", text.key(F.col("p_type")).alias("k"))


@query("SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY 1")
def f27_fingerprint(spark, sf_dir):
    keys = F.array_sort(F.collect_list("o_orderkey"))
    return T(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sha2(F.concat_ws(",", keys.cast("array<string>")), 256).alias("fingerprint"))


@query(f"WITH {SE} SELECT event_id, (props->>'$.k')::BIGINT AS k FROM series")
def f28_json_metadata(spark, sf_dir):
    return A.series(spark, sf_dir).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT n_regionkey, 'Region ' || n_regionkey || ' [' || string_agg(n_name, ' ' ORDER BY n_nationkey) || ']' AS label FROM nation GROUP BY 1")
def f30_region_label(spark, sf_dir):
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return T(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("Region "), F.first("n_regionkey").cast("string"), F.lit(" ["), F.concat_ws(" ", names), F.lit("]")).alias("label"))


@query(f"WITH {AT}, f AS (SELECT atom_index, y / 10.0 + 0.25 AS p, x / 10.0 + 0.5 AS q FROM atoms) SELECT atom_index, round(p - floor(p), 9) AS fx, round(q - floor(q), 9) AS fy FROM f")
def f32_lateral_alignment(spark, sf_dir):
    fx, fy = G.align_lateral((F.col("x") / 10.0, F.col("y") / 10.0), ((0, 1), (1, 0)), (0.25, 0.5))
    return A.atoms(spark, sf_dir).select("atom_index", F.round(fx, 9).alias("fx"), F.round(fy, 9).alias("fy"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'orthorhombic' WHEN 1 THEN 'prismatic' ELSE 'general' END AS kind FROM nation")
def f34_cell_kind(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    cell = F.array(F.lit(10.0), F.lit(0.0), F.lit(0.0), F.when(k >= 1, 2.0).otherwise(0.0), F.lit(9.0), F.lit(0.0), F.when(k == 2, 1.0).otherwise(0.0), F.lit(0.0), F.lit(8.0))
    return T(spark, sf_dir, "nation").select("n_nationkey", G.cell_kind(cell).alias("kind"))


@query("SELECT l_returnflag, l_linenumber, round(CASE WHEN l_linenumber - 3 > 0 THEN sum(l_quantity) / (l_linenumber - 3) ELSE 0 END, 6)::DOUBLE AS v FROM lineitem GROUP BY l_returnflag, l_linenumber")
def f35_safe_division(spark, sf_dir):
    g = T(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.sum("l_quantity").alias("s"))
    return g.select("l_returnflag", "l_linenumber", F.round(G.divided(F.col("s"), F.col("l_linenumber") - 3), 6).alias("v"))


@query("SELECT n_nationkey, n_nationkey * 0.5 * 10 AS time_fs FROM nation")
def f38_effective_timestep(spark, sf_dir):
    return T(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * units.frame_timestep_fs(0.5, "fs", 10)).alias("time_fs"))


@query("SELECT n_nationkey, least(greatest(floor((n_nationkey - 2.0) / 3.0)::INT, 0), 6) AS bin FROM nation")
def f9_bin_index(spark, sf_dir):
    return T(spark, sf_dir, "nation").select("n_nationkey", histogram.bin_index(F.col("n_nationkey"), 2.0, 3.0, 7).alias("bin"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'nan' ELSE n_name END IN ('nan') AS missing FROM nation")
def s19_missing_tokens(spark, sf_dir):
    v = F.when(F.col("n_nationkey") % 4 == 0, " NaN ").otherwise(F.col("n_name"))
    return T(spark, sf_dir, "nation").select("n_nationkey", text.missing(v).alias("missing"))
