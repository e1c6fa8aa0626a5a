from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import pairs as P
from ..operators import select
from ..plans import alignment, potential, profiles, surface
from ..plans import pairs as plans
from ..schema import AMU_G, AMU_KG, ELEMENTS
from . import query
from .joins import L, MOLECULES, PAIRS

AT = A.ATOMS_SQL
MASS = "CASE element " + " ".join(f"WHEN '{s}' THEN {ELEMENTS[s][1]}" for s in A.SPECIES) + " END::DOUBLE"


def atoms(spark, sf_dir):
    return A.atoms(spark, sf_dir).withColumn("mass_amu", F.element_at(P.masses(), F.col("element")))


def frames(spark):
    return spark.range(A.FRAMES).select(F.col("id").alias("frame_index"), F.lit(A.CELL**3).alias("volume"), (F.col("id") * 10).alias("step"), (F.col("id") * 5.0).alias("time_fs"))


@query(f"""WITH {AT}, s AS (SELECT least(greatest(floor(z / 0.5)::INT, 0), 19) AS bin, frame_index, sum({MASS}) AS m, count(*) AS c FROM atoms WHERE element = 'O' GROUP BY ALL),
g AS (SELECT b.bin, f.f, coalesce(m, 0) * {AMU_G} * 1e24 / 50.0 AS v, coalesce(c, 0) AS c FROM range(20) b(bin) CROSS JOIN range(10) f(f) LEFT JOIN s ON s.bin = b.bin AND s.frame_index = f.f)
SELECT bin::INT AS bin, sum(c)::BIGINT AS point_count, round(avg(v), 9) AS density, round(sum(c) / (10 * 50.0 * 1e-3), 6) AS number_density, round(stddev_samp(v), 9) AS sample_std FROM g GROUP BY bin""")
def c1_density_profile(spark, sf_dir):
    out = profiles.density(atoms(spark, sf_dir).where(select.species_filter("O")), "z", 0.0, 0.5, 20, A.FRAMES, A.CELL**2)
    return out.select("bin", "point_count", F.round("density", 9).alias("density"), F.round("number_density", 6).alias("number_density"), F.round("sample_std", 9).alias("sample_std"))


@query(f"WITH {AT} SELECT element AS species, least(greatest(floor(z / 0.5)::INT, 0), 19) AS bin, count(*) AS point_count, round(sum({MASS}) * {AMU_G} * 1e24 / 50.0 / 10, 9) AS density FROM atoms GROUP BY ALL")
def c2_all_densities(spark, sf_dir):
    out = profiles.densities(atoms(spark, sf_dir), "z", 0.0, 0.5, 20, A.FRAMES, A.CELL**2)
    return out.select("species", "bin", "point_count", F.round("density", 9).alias("density"))


@query(f"""WITH {PAIRS}, c AS (SELECT least(floor(r / 0.05)::INT, 79) AS bin, count(*) AS counts FROM p WHERE ea = 'O' AND eb = 'H' AND r <= 4.0 GROUP BY 1),
e AS (SELECT sum(na * nb / 1000.0::DOUBLE) AS d FROM (SELECT frame_index, count(*) FILTER (element = 'O') AS na, count(*) FILTER (element = 'H') AS nb FROM atoms GROUP BY 1) WHERE na > 0 AND nb > 0)
SELECT b.bin::INT AS bin, coalesce(counts, 0) AS counts, round(coalesce(counts, 0) / (d * 4.0 / 3.0 * pi() * (((b.bin + 1) * 0.05) ** 3 - (b.bin * 0.05) ** 3)), 6) AS g FROM range(80) b(bin) LEFT JOIN c ON c.bin = b.bin CROSS JOIN e""")
def c3_rdf(spark, sf_dir):
    a = atoms(spark, sf_dir)
    out = plans.rdf(a.where("element = 'O'"), a.where("element = 'H'"), frames(spark), L, 4.0)
    return out.select("bin", "counts", F.round("g", 6).alias("g"))


_RDF = "least(floor(r / 0.1)::INT, 39)"
_SHELL = "(4.0 / 3.0 * pi() * (((b.bin + 1) * 0.1::DOUBLE) ** 3 - (b.bin * 0.1::DOUBLE) ** 3))"
_BY_FRAME = f"""{PAIRS}, n AS (SELECT frame_index, count(*) FILTER (element = 'Pt') AS na, count(*) FILTER (element = 'Au') AS nb FROM atoms GROUP BY 1), e AS (SELECT frame_index, na * nb / 1000.0::DOUBLE AS density FROM n WHERE na > 0 AND nb > 0),
c AS (SELECT frame_index, {_RDF} AS bin, count(*) AS counts FROM p WHERE ea = 'Pt' AND eb = 'Au' AND r <= 4.0 GROUP BY ALL)"""


def platinum_gold(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return plans.rdf(a.where("element = 'Pt'"), a.where("element = 'Au'"), frames(spark), L, 4.0, 0.1)


@query(f"WITH {_BY_FRAME}, t AS (SELECT bin, sum(counts) AS counts FROM c GROUP BY 1) SELECT b.bin::INT AS bin, round((SELECT sum(density) FROM e) * {_SHELL}, 9) AS expected, round(coalesce(counts, 0) / ((SELECT sum(density) FROM e) * {_SHELL}), 6) AS g FROM range(40) b(bin) LEFT JOIN t USING (bin)")
def a10_rdf_ratio(spark, sf_dir):
    return platinum_gold(spark, sf_dir).select("bin", F.round("expected", 9).alias("expected"), F.round("g", 6).alias("g"))


@query(f"WITH {_BY_FRAME}, v AS (SELECT b.bin, e.frame_index, coalesce(counts, 0) / (density * {_SHELL}) AS v FROM range(40) b(bin) CROSS JOIN e LEFT JOIN c ON c.bin = b.bin AND c.frame_index = e.frame_index) SELECT bin::INT AS bin, count(*) AS sample_n, round(coalesce(stddev_samp(v), 0), 4) AS sample_std, round(coalesce(stddev_samp(v), 0) / sqrt(count(*)), 4) AS sample_sem FROM v GROUP BY bin")
def a11_rdf_moments(spark, sf_dir):
    return platinum_gold(spark, sf_dir).select("bin", F.col("sample_n").cast("long").alias("sample_n"), F.round("sample_std", 4).alias("sample_std"), F.round("sample_sem", 4).alias("sample_sem"))


@query(f"""WITH {PAIRS}, w AS (SELECT frame_index, i, sum(CASE WHEN r <= 2.25 THEN 1 WHEN r < 2.75 THEN 0.5 * (1 + cos(pi() * (r - 2.25) / 0.5)) ELSE 0 END) AS s FROM p WHERE ea = 'O' AND eb = 'H' AND r <= 2.75 GROUP BY ALL)
SELECT a.frame_index, atom_index, round(coalesce(s, 0), 6) AS coordination FROM atoms a LEFT JOIN w ON a.frame_index = w.frame_index AND atom_index = i WHERE element = 'O'""")
def c4_coordination(spark, sf_dir):
    """Coordination of every centre within a cutoff that is given."""
    a = atoms(spark, sf_dir)
    return plans.coordination(a.where("element = 'O'"), a.where("element = 'H'"), L, 2.5).withColumn("coordination", F.round("coordination", 6))


@query("SELECT r_regionkey AS pair, round(3.0 + r_regionkey * 0.25, 2)::DOUBLE AS peak, round(5.0 + r_regionkey * 0.25, 2)::DOUBLE AS minimum FROM region")
def c4_cutoff_from_curve(spark, sf_dir):
    """Curves with one peak and one valley of known places."""
    x = F.explode(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: i * 0.05))
    c = A.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pair"), x.alias("centre"))
    u = F.col("centre") - (3.0 + F.col("pair") * 0.25)
    bump = lambda at, width: F.exp(-0.5 * F.pow((u - at) / width, 2))
    curve = c.withColumn("g", 1.0 + 2.0 * bump(0.0, 0.4) - 0.9 * bump(2.0, 0.5))
    out = plans.cutoff(curve, "pair").where(F.abs(F.col("cutoff") - F.col("minimum")) < 0.05)
    return out.select("pair", F.round("peak", 2).alias("peak"), F.round("minimum", 2).alias("minimum"))


@query(f"WITH {AT} SELECT atom_index, frame_index, frame_index * 10 AS step, frame_index * 5.0::DOUBLE AS time_fs, round(x - floor(x / 10.0) * 10.0, 9) AS x, round(z - floor(z / 10.0) * 10.0, 9) AS z FROM atoms WHERE element = 'K'")
def c5_positions(spark, sf_dir):
    out = profiles.positions(atoms(spark, sf_dir).where("element = 'K'"), frames(spark), L)
    return out.select("atom_index", "frame_index", "step", "time_fs", F.round("x", 9).alias("x"), F.round("z", 9).alias("z"))


def bent(spark, sf_dir):
    """Every embedding as a water: the first three components an oxygen, the next ones its hydrogens."""
    e = A.table(spark, sf_dir, "embeddings")
    at = lambda i, k, d: (F.element_at("embedding", i).cast("double") * k + d)
    v = lambda i, k, d: F.struct(*(at(i + j, k, 5.0 + d[j]).alias(c) for j, c in enumerate("xyz")))
    return e.select((F.col("vec_id") % 10).alias("frame_index"), F.col("vec_id").alias("anchor"), v(1, 10, (0, 0, 0)).alias("o"), v(4, 1, (0.8, 0.0, 0.4)).alias("h1"), v(7, 1, (-0.8, 0.0, 0.4)).alias("h2"))


_D = ", ".join(f"d{h}{c} - 10.0 * round_even(d{h}{c} / 10.0, 0) AS u{h}{c}" for h in (1, 2) for c in "xyz")
_E = ", ".join(f"(embedding[{3 * h + j + 1}]::DOUBLE + 5.0 + {(0.8, 0.0, 0.4)[j] if h == 1 else (-0.8, 0.0, 0.4)[j]}) - (embedding[{j + 1}]::DOUBLE * 10 + 5.0) AS d{h}{c}" for h in (1, 2) for j, c in enumerate("xyz"))
BENT = f"d AS (SELECT vec_id, embedding[3]::DOUBLE * 10 + 5.0 AS height, {_E} FROM embeddings), u AS (SELECT vec_id, height, {_D} FROM d), n AS (SELECT *, sqrt(u1x*u1x+u1y*u1y+u1z*u1z) AS n1, sqrt(u2x*u2x+u2y*u2y+u2z*u2z) AS n2 FROM u), b AS (SELECT vec_id, height, u1x/n1+u2x/n2 AS bx, u1y/n1+u2y/n2 AS b_y, u1z/n1+u2z/n2 AS bz FROM n), a AS (SELECT vec_id, height, bz / sqrt(bx*bx+b_y*b_y+bz*bz) AS c FROM b)"


@query(f"WITH {BENT} SELECT floor(height / 0.5)::INT AS bin, count(c) AS n_valid, round(avg(c), 6) AS mean_polar FROM a GROUP BY 1")
def c6_orientation(spark, sf_dir):
    out = profiles.orientation(profiles.angles(bent(spark, sf_dir), 2, L), 0.5)
    return out.select("bin", "n_valid", F.round("mean_polar", 6).alias("mean_polar"))


_PLANE = BENT.replace("b AS (SELECT", "x AS (SELECT vec_id, height, u1y*u2z - u1z*u2y AS cx, u1z*u2x - u1x*u2z AS cy FROM u), b AS (SELECT")


@query(f"WITH {_PLANE}, s AS (SELECT floor(x.height)::INT AS bin, c, cx / sqrt(cx*cx + cy*cy) AS az, CASE WHEN x.height > 5 THEN 1 ELSE -1 END AS side FROM a JOIN x USING (vec_id)) SELECT bin, count(c) AS n_valid, round(avg(c), 6) AS mean_polar, round(avg(az), 6) AS mean_azimuthal FROM s WHERE side = 1 GROUP BY 1")
def a15_orientation_means(spark, sf_dir):
    """Both mean angles by height on the upper side."""
    out = profiles.orientation(profiles.angles(bent(spark, sf_dir), 2, L).where("height > 5"), 1.0)
    return out.select("bin", "n_valid", F.round("mean_polar", 6).alias("mean_polar"), F.round("mean_azimuthal", 6).alias("mean_azimuthal"))


@query(f"WITH {BENT} SELECT floor(height / 0.5)::INT AS bin, least(greatest(floor((c + 1) / 0.2)::INT, 0), 9) AS angle_bin, count(*)::DOUBLE AS counts FROM a GROUP BY ALL")
def a16_orientation_map(spark, sf_dir):
    return profiles.orientation_map(profiles.angles(bent(spark, sf_dir), 2, L), 0.5, bins=10)


@query(f"""WITH {AT}, v AS (SELECT frame_index, element AS g, {MASS} * {AMU_KG} AS m, (x - 5) * 100 AS vx, (y - 5) * 100 AS vy, (z - 5) * 100 AS vz FROM atoms)
SELECT frame_index, g AS "group", count(*) AS n, CASE WHEN count(*) > 1 THEN round((sum(m * (vx*vx+vy*vy+vz*vz)) - (sum(m*vx)**2 + sum(m*vy)**2 + sum(m*vz)**2) / sum(m)) / ((3 * count(*) - 3) * 1.380649e-23), 6) END AS temperature_k FROM v GROUP BY ALL""")
def c7_temperature(spark, sf_dir):
    v = atoms(spark, sf_dir).select("frame_index", "atom_index", "element", "mass_amu", *((F.col(c) - 5).alias(f"v{c}") for c in "xyz"))
    return profiles.temperatures(v, 100.0).withColumn("temperature_k", F.round("temperature_k", 6))


def density_line(spark, sf_dir):
    """Prices of each return flag as a smooth line over bins of 2 angstrom."""
    s = A.samples(spark, sf_dir).groupBy(F.col("g").alias("source"), (F.floor(F.col("x") / 4000.0) * 2.0).alias("z"))
    return s.agg((F.count("*") / 1000.0).alias("density"), F.avg("d").alias("value_ev"))


_LINE = f"{A.SAMPLES_SQL}, l AS (SELECT g AS source, floor(x / 4000.0) * 2.0 AS z, count(*) / 1000.0 AS density, avg(d) AS value_ev FROM samples GROUP BY ALL)"
_WINDOW = f"{_LINE}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY z) AS n FROM l), f AS (SELECT *, n - row_number() OVER (PARTITION BY source ORDER BY z) AS k FROM n WHERE density >= 0.1), r AS (SELECT source, k, min(z) AS a, max(z) AS b FROM f GROUP BY ALL), w AS (SELECT source, count(*) AS n_runs, min(a) + 5 AS lo, max(b) - 5 AS hi FROM r GROUP BY 1)"


@query(f"WITH {_WINDOW} SELECT source, n_runs, lo::DOUBLE AS lo, hi::DOUBLE AS hi, n_runs = 1 AND lo < hi AS valid FROM w")
def w15_reservoir_window(spark, sf_dir):
    return potential.window(density_line(spark, sf_dir), 0.1).select("source", "n_runs", "lo", "hi", "valid")


@query(f"WITH {_WINDOW} SELECT l.source, round(avg(value_ev), 6) AS mean, round(stddev_samp(value_ev), 6) AS std, count(*) AS n FROM l JOIN w USING (source) WHERE n_runs = 1 AND lo < hi AND z BETWEEN lo AND hi GROUP BY 1")
def c8_potential_window(spark, sf_dir):
    line = density_line(spark, sf_dir)
    out = potential.in_window(line, potential.window(line, 0.1))
    return out.select("source", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"WITH {_WINDOW}, k AS (SELECT * FROM (VALUES ('up', 0.5, 0.5), ('down', -0.5, -0.5), ('narrow', 0.5, -0.5), ('wide', -0.5, 0.5)) t(perturbation, da, db)) SELECT source, perturbation, (lo + da)::DOUBLE AS lo, (hi + db)::DOUBLE AS hi FROM w CROSS JOIN k WHERE n_runs = 1 AND lo < hi")
def c9_potential_sensitivity(spark, sf_dir):
    return potential.sensitivity(potential.window(density_line(spark, sf_dir), 0.1)).select("source", "perturbation", "lo", "hi")


@query("SELECT coalesce(c_custkey, o_custkey) AS source, round(c_acctbal - n - 0.65, 6) AS potential_cshe, CASE WHEN c_acctbal IS NULL OR n IS NULL THEN 'incomplete' ELSE 'complete' END AS status FROM customer FULL JOIN (SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def c8_potential_records(spark, sf_dir):
    means = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.col("c_acctbal").alias("mean"))
    fermi = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").cast("double").alias("fermi_ev"))
    return potential.records(means, fermi).select("source", F.round("potential_cshe", 6).alias("potential_cshe"), "status")


@query(f"WITH {AT} SELECT frame_index, atom_index, round(x + 7 - floor((x + 7) / 10.0) * 10.0, 9) AS x FROM atoms")
def c10_apply_pbc(spark, sf_dir):
    moved = A.atoms(spark, sf_dir).withColumn("x", F.col("x") + 7)
    return profiles.apply_pbc(moved, L).select("frame_index", "atom_index", F.round("x", 9).alias("x"))


@query(f"WITH {MOLECULES} SELECT frame_index, anchor FROM mol WHERE label = 'mol:H2O'")
def c11_waters(spark, sf_dir):
    return profiles.waters(atoms(spark, sf_dir), L).select("frame_index", "anchor")


def slab(spark, sf_dir):
    """Platinum and gold as a slab: heights drawn to three layers by index."""
    a = A.atoms(spark, sf_dir).where("element IN ('Pt', 'Au', 'Cu')")
    return a.withColumn("z", (F.col("atom_index") % 3) * 2.0 + 2.0 + (F.col("z") - 5) * 0.02)


SLAB = f"{AT}, slab AS (SELECT frame_index, atom_index, element, (atom_index % 3) * 2.0::DOUBLE + 2.0 + (z - 5) * 0.02 AS z FROM atoms WHERE element IN ('Pt', 'Au', 'Cu'))"


@query(f"""WITH {SLAB}, g AS (SELECT *, z - lag(z) OVER (PARTITION BY frame_index ORDER BY z, atom_index) AS gap FROM slab), k AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY gap) AS r, count(*) OVER (PARTITION BY frame_index) AS n FROM g WHERE gap IS NOT NULL),
b AS (SELECT frame_index, median(gap) FILTER (r <= greatest(1, n // 2)) AS base FROM k GROUP BY 1), c AS (SELECT frame_index, max(z) AS cut FROM g JOIN b USING (frame_index) WHERE gap >= greatest(0.25, 3 * base) GROUP BY 1)
SELECT frame_index, round(median(z), 9) AS value, count(*) AS size FROM slab JOIN c USING (frame_index) WHERE z >= cut GROUP BY 1""")
def g2_layered_surface(spark, sf_dir):
    return surface.layered(slab(spark, sf_dir)).select("frame_index", F.round("value", 9).alias("value"), "size")


@query(f"""WITH {SLAB}, a AS (SELECT atom_index, median(z) AS h, min(z) AS lo, max(z) AS hi, max({MASS}) AS mass FROM slab GROUP BY 1), g AS (SELECT *, lag(h) OVER (ORDER BY h DESC, atom_index) - h AS gap, max(h) OVER () AS outermost FROM a),
r AS (SELECT *, row_number() OVER (ORDER BY gap NULLS LAST) AS r, count(gap) OVER () AS k FROM g), b AS (SELECT median(gap) FILTER (r <= greatest(1, k // 2)) AS base, max(gap) AS most FROM r),
w AS (SELECT base, greatest(0.75 * coalesce((SELECT gap FROM r WHERE gap > 1e-6 AND gap >= greatest(0.25, 3 * base) ORDER BY h DESC LIMIT 1), most), 3 * base, 0.25) AS envelope FROM b),
t AS (SELECT r.*, times FROM r, w, (VALUES (1.0), (1.5), (2.0), (3.0)) v(times) WHERE outermost - h <= envelope * times), f AS (SELECT min(times) AS times FROM (SELECT times FROM t GROUP BY 1 HAVING count(*) >= 3)),
c AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY atom_index) + 0.1 * row_number() OVER (ORDER BY mass DESC, atom_index) AS combined FROM t WHERE times = (SELECT times FROM f)),
k AS (SELECT atom_index FROM (SELECT *, row_number() OVER (ORDER BY combined, atom_index) AS place FROM c) WHERE place <= least(greatest(ceil(0.35 * n), 3), 6, n)),
s AS (SELECT frame_index, median(z) AS m FROM slab JOIN k USING (atom_index) GROUP BY 1 HAVING stddev_pop(z) <= 1.5)
SELECT f.frame_index, round(m, 9) AS value, CASE WHEN m IS NULL THEN 'missing' ELSE 'direct_rough_low_mobility' END AS provenance FROM (SELECT DISTINCT frame_index FROM slab) f LEFT JOIN s USING (frame_index)""")
def g3_rough_surface(spark, sf_dir):
    return surface.rough(slab(spark, sf_dir)).select("frame_index", F.round("value", 9).alias("value"), "provenance")


ESTIMATE = f"{AT}, e AS (SELECT frame_index, CASE WHEN frame_index % 4 <> 3 THEN 5 + frame_index * 0.1 + avg(z) * 0.01 END AS value, (0.5 + 0.04 * frame_index)::DOUBLE AS confidence, (0.1 + 0.01 * frame_index)::DOUBLE AS spread FROM atoms GROUP BY 1)"


def estimate(spark, sf_dir):
    """An estimate that lacks every fourth frame."""
    i = F.col("frame_index")
    e = A.atoms(spark, sf_dir).groupBy("frame_index").agg(F.avg("z").alias("z"))
    return e.select("frame_index", F.when(i % 4 != 3, 5 + i * 0.1 + F.col("z") * 0.01).alias("value"), (0.5 + 0.04 * i).alias("confidence"), (0.1 + 0.01 * i).alias("spread"))


@query(f"""WITH {ESTIMATE}, ok AS (SELECT *, abs(value - lag(value) OVER (ORDER BY frame_index)) AS d FROM e WHERE value IS NOT NULL),
q AS (SELECT (SELECT count(*) FROM ok) / (SELECT count(*) FROM e) AS valid_fraction, median(confidence) AS c, least(greatest(1 - median(d) / 1.5, 0), 1) AS smoothness, least(greatest(1 - median(spread) / 0.75, 0), 1) AS spread_quality FROM ok)
SELECT round(valid_fraction, 9)::DOUBLE AS valid_fraction, round(c, 9)::DOUBLE AS median_confidence, round(smoothness, 9)::DOUBLE AS smoothness, round(spread_quality, 9)::DOUBLE AS spread_quality, round(0.35 * valid_fraction + 0.35 * c + 0.15 * smoothness + 0.15 * spread_quality, 9)::DOUBLE AS score FROM q""")
def g4_composite_score(spark, sf_dir):
    out = surface.composite(estimate(spark, sf_dir), 0.75)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(f"""WITH {SLAB}, g AS (SELECT *, z - lag(z) OVER (PARTITION BY frame_index ORDER BY z, atom_index) AS gap FROM slab), k AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY gap) AS r, count(*) OVER (PARTITION BY frame_index) AS n FROM g WHERE gap IS NOT NULL),
b AS (SELECT frame_index, median(gap) FILTER (r <= greatest(1, n // 2)) AS base FROM k GROUP BY 1), c AS (SELECT frame_index, min(z) AS cut FROM g JOIN b USING (frame_index) WHERE gap >= greatest(0.25, 3 * base) GROUP BY 1)
SELECT frame_index, round(median(z), 9) AS value, count(*) AS size FROM slab JOIN c USING (frame_index) WHERE z < cut GROUP BY 1""")
def g10_bottom_estimate(spark, sf_dir):
    """The lower side's plane by the entry of single-sided estimates."""
    found, mode = surface.estimate(slab(spark, sf_dir), "layered", surface.Options(side="bottom"))
    assert mode == "layered"
    return found.select("frame_index", F.round("value", 9).alias("value"), "size")


@query(f"WITH {ESTIMATE} SELECT frame_index, frame_index * 10 AS step, round(value, 9)::DOUBLE AS value FROM e")
def g11_rebound_reference(spark, sf_dir):
    return surface.bind(estimate(spark, sf_dir), frames(spark).select("frame_index", "step")).select("frame_index", "step", F.round("value", 9).alias("value"))


@query("SELECT true AS trusted")
def g5_trust(spark, sf_dir):
    return surface.trusted(surface.layered(slab(spark, sf_dir)))


@query(f"""WITH {AT}, e AS (SELECT element, count(*) AS n, max({MASS}) AS mass FROM atoms GROUP BY 1), t AS (SELECT *, n >= greatest(2, ceil(0.08 * sum(n) OVER ())) AS abundant FROM e)
SELECT element FROM t WHERE abundant AND mass >= 0.25 * (SELECT max(mass) FROM t WHERE abundant) ORDER BY n DESC, mass DESC, element LIMIT 4""")
def g1_surface_elements(spark, sf_dir):
    """Atoms that stand in one frame only don't move, so that abundance and mass decide."""
    return surface.surface_elements(A.atoms(spark, sf_dir))


@query("SELECT 'E' || (s_suppkey % 5) AS element FROM supplier WHERE false UNION ALL SELECT * FROM (VALUES ('Pt'), ('Au')) t(element)")
def g1_slow_elements(spark, sf_dir):
    """Platinum and gold stay in place over the frames, all others move."""
    n = A.table(spark, sf_dir, "nation").withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.lit(8))))
    element = F.element_at(F.array(*map(F.lit, ("Pt", "Au", "O", "H", "K"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    step = F.when(F.col("n_nationkey") % 5 < 2, 0.001).otherwise(0.5)
    return surface.surface_elements(n.select("frame_index", F.col("n_nationkey").alias("atom_index"), element.alias("element"), (F.col("n_nationkey") + F.col("frame_index") * step).alias("z")))


@query(f"WITH {AT}, p AS (SELECT atom_index, z - (3 + frame_index * 0.01) AS up, (7 - frame_index * 0.01) - z AS down FROM atoms) SELECT atom_index, round(greatest(up, down), 9) AS distance, CASE WHEN up - down > 1e-10 THEN 1 WHEN up - down < -1e-10 THEN -1 ELSE 0 END AS side FROM p")
def f12_surface_distance(spark, sf_dir):
    f = frames(spark).select("frame_index")
    top = f.select("frame_index", (3 + F.col("frame_index") * 0.01).alias("value"), F.lit(0.0).alias("spread"))
    bottom = f.select("frame_index", (7 - F.col("frame_index") * 0.01).alias("value"), F.lit(0.0).alias("spread"))
    p = A.atoms(spark, sf_dir).withColumn("c", F.col("z")).withColumn("is_substrate", F.lit(False))
    return surface.distances(p, top, bottom, "symmetric", 10.0).select("atom_index", F.round("distance", 9).alias("distance"), "side")


@query(f"WITH {AT} SELECT atom_index, round(z - 3 + CASE WHEN z < 2 - 1e-9 THEN 10 ELSE 0 END, 9)::DOUBLE AS distance FROM atoms")
def f12_single_top_distance(spark, sf_dir):
    f = frames(spark).select("frame_index")
    plane = lambda v: f.select("frame_index", F.lit(v).alias("value"), F.lit(0.0).alias("spread"))
    p = A.atoms(spark, sf_dir).withColumn("c", F.col("z")).withColumn("is_substrate", F.lit(False))
    return surface.distances(p, plane(3.0), plane(2.0), "single-top", 10.0).select("atom_index", F.round("distance", 9).alias("distance"))


def faces(spark, sf_dir, matrix=((1, 0), (0, 1)), shift=(0.01, 0.02)):
    """A grid of 5 by 5 points for each of five frames; the lower face is the upper one moved, every sixth point left out."""
    n = A.table(spark, sf_dir, "nation").withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    k = F.col("n_nationkey")
    element = F.when(k % 2 == 0, "Pt").otherwise("Au")
    fx, fy = F.floor(k / 5) / 5.0 + F.pmod(k * k, F.lit(7)) / 100.0, (k % 5) / 5.0 + F.pmod(k * 3, F.lit(5)) / 100.0
    top = n.select("frame_index", k.alias("atom_index"), element.alias("element"), F.lit("top").alias("side"), fx.alias("fx"), fy.alias("fy"))
    moved = [F.pmod(fx * matrix[0][j] + fy * matrix[1][j] + shift[j], F.lit(1.0)) for j in range(2)]
    bottom = n.where("n_nationkey % 6 <> 5").select("frame_index", (k + 100).alias("atom_index"), element.alias("element"), F.lit("bottom").alias("side"), moved[0].alias("fx"), moved[1].alias("fy"))
    return top.unionByName(bottom)


_MOVED = "round(10.0 * sqrt(0.01 ** 2 + 0.02 ** 2), 6)::DOUBLE"


@query(f"SELECT f AS frame_index, CASE WHEN n_nationkey % 2 = 0 THEN 'Pt' ELSE 'Au' END AS element, n_nationkey AS top, n_nationkey + 100 AS bottom, {_MOVED} AS r FROM nation, range(5) t(f) WHERE n_nationkey % 6 <> 5")
def j14_interface_matching(spark, sf_dir):
    return alignment.matches(faces(spark, sf_dir), [10.0, 0.0, 0.0, 10.0], 0.5).withColumn("r", F.round("r", 6))


@query("SELECT f AS frame_index, 0 AS rank, round((SELECT count(*) FROM nation WHERE n_nationkey % 6 <> 5) / 25.0, 6)::DOUBLE AS coverage, 0.0::DOUBLE AS rmsd FROM range(5) t(f)")
def l3_alignment_suggestions(spark, sf_dir):
    """The lower face turned by a right angle and moved: the best suggestion lays it on the upper one again."""
    out = alignment.suggestions(faces(spark, sf_dir, ((0, 1), (-1, 0)), (0.3, 0.15)), [10.0, 0.0, 0.0, 10.0], 0.2)
    return out.where("rank = 0").select("frame_index", "rank", F.round("coverage", 6).alias("coverage"), F.round("rmsd", 6).alias("rmsd"))


@query(f"WITH {AT}, g AS (SELECT floor(x)::INT AS ix, floor(y)::INT AS iy, count(*)::DOUBLE AS mass FROM atoms GROUP BY ALL), m AS (SELECT (11 - ix) % 10 AS ix, iy, mass * 0.5 AS mass FROM g UNION ALL SELECT (12 - ix) % 10, iy, mass * 0.5 FROM g) SELECT ix, iy, round(sum(mass), 9) AS mass FROM m GROUP BY ALL")
def l5_mirrored_transfer(spark, sf_dir):
    g = A.atoms(spark, sf_dir).groupBy(F.floor("x").cast("int").alias("ix"), F.floor("y").cast("int").alias("iy")).agg(F.count("*").cast("double").alias("mass"))
    return alignment.transfer(g, (10, 10), (0.25, 0.0), (True, False)).select("ix", "iy", F.round("mass", 9).alias("mass"))


@query(f"WITH {AT}, g AS (SELECT floor(x)::INT AS ix, floor(y)::INT AS iy, count(*)::DOUBLE AS mass FROM atoms GROUP BY ALL), m AS (SELECT (ix + 2) % 10 AS ix, iy, mass * 0.5 AS mass FROM g UNION ALL SELECT (ix + 3) % 10, iy, mass * 0.5 FROM g) SELECT ix, iy, round(sum(mass), 9) AS mass FROM m GROUP BY ALL")
def l4_conservative_transfer(spark, sf_dir):
    g = A.atoms(spark, sf_dir).groupBy(F.floor("x").cast("int").alias("ix"), F.floor("y").cast("int").alias("iy")).agg(F.count("*").cast("double").alias("mass"))
    return alignment.transfer(g, (10, 10), (0.25, 0.0)).select("ix", "iy", F.round("mass", 9).alias("mass"))


@query(f"WITH {AT}, s AS (SELECT atom_index, CASE WHEN z > 5 THEN 1 ELSE -1 END AS side, x, y FROM atoms) SELECT atom_index, round(CASE WHEN side < 0 THEN (y / 10.0 + 0.25 - floor(y / 10.0 + 0.25)) * 10 ELSE x END, 9) AS x FROM s")
def l4_align_positions(spark, sf_dir):
    p = A.atoms(spark, sf_dir).withColumn("side", F.when(F.col("z") > 5, 1).otherwise(-1))
    return alignment.align_positions(p, ((0, 1), (1, 0)), (0.25, 0.5), (10.0, 10.0)).select("atom_index", F.round("x", 9).alias("x"))


@query("SELECT DISTINCT sha256(n_regionkey::VARCHAR) AS reference_id FROM nation")
def k18_reference_store(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").select(F.sha2(F.col("n_regionkey").cast("string"), 256).alias("reference_id"))
    return alignment.store_references(n.where(F.lit(False)), n)


@query(f"WITH {AT} SELECT frame_index, atom_index, element FROM atoms WHERE z >= 4.5 AND z <= 5.5")
def p15_value_filter(spark, sf_dir):
    return select.value_filter(A.atoms(spark, sf_dir), "z", 4.5, 5.5).select("frame_index", "atom_index", "element")


@query(f"WITH {A.SAMPLES_SQL}, s AS (SELECT g, floor(x / 10000.0)::BIGINT AS x, count(w) AS n, avg(w) AS y, stddev_samp(w) AS std FROM samples GROUP BY ALL HAVING count(w) >= 5) SELECT g, x, n, round(y / max(y) OVER (PARTITION BY g), 9) AS y, round(std / max(y) OVER (PARTITION BY g), 6) AS std FROM s")
def d1_series_preparation(spark, sf_dir):
    from ..operators import series

    out = series.prepare(A.samples(spark, sf_dir), ["g"], "x", "w", width=10000.0, mode="max", least=5)
    return out.select("g", "x", "n", F.round("y", 9).alias("y"), F.round("std", 6).alias("std"))


@query(f"WITH {A.SAMPLES_SQL} SELECT d AS bin, (sum(w) FILTER (side = 'O'))::DOUBLE AS v_top, (sum(w) FILTER (side = 'F'))::DOUBLE AS v_bottom FROM samples GROUP BY d")
def d7_interface_comparison(spark, sf_dir):
    from ..operators import series

    s = A.samples(spark, sf_dir).groupBy(F.col("d").alias("bin"), F.when(F.col("side") == "O", "top").otherwise("bottom").alias("side")).agg(F.sum("w").cast("double").alias("v"))
    return series.interface_view(s, "comparison", "v")


@query("SELECT o_orderkey AS record_id, q AS quantity, CASE q WHEN 'o_totalprice' THEN o_totalprice ELSE o_custkey::DOUBLE END AS value FROM orders CROSS JOIN (VALUES ('o_totalprice'), ('o_custkey')) t(q)")
def d11_record_series(spark, sf_dir):
    from ..operators import series

    return series.unpivot(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_totalprice", "o_custkey"), ["record_id"], ["o_totalprice", "o_custkey"])


@query(f"""WITH {PAIRS}, n AS (SELECT p.frame_index, i AS atom_index, min(r) FILTER (b.z >= 5) AS u, min(r) FILTER (b.z < 5) AS d FROM p JOIN atoms b ON b.atom_index = j WHERE ea = 'H' AND eb IN ('Pt', 'Au') GROUP BY ALL)
SELECT frame_index, atom_index, round(least(u, d), 6) AS distance, CASE WHEN d IS NULL OR u < d - 1e-10 THEN 1 WHEN u IS NULL OR d < u - 1e-10 THEN -1 ELSE 0 END AS side FROM n""")
def g7_nearest_by_side(spark, sf_dir):
    a = A.atoms(spark, sf_dir)
    out = surface.nearest_distances(a.where("element = 'H'"), a.where("element IN ('Pt', 'Au')"), L, symmetric=True, middle=5.0)
    return out.withColumn("distance", F.round("distance", 6))


@query(f"WITH {A.SAMPLES_SQL}, l AS (SELECT g AS source, floor(x / 4000.0) * 2.0 AS z FROM samples GROUP BY ALL) SELECT DISTINCT source, 10.0::DOUBLE AS start, 30.0::DOUBLE AS stop FROM l")
def d13_bulk_rows(spark, sf_dir):
    from ..operators import series

    return series.bulk_rows(density_line(spark, sf_dir), ["source"], "z", "density", "manual", 10.0, 30.0)
