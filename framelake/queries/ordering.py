from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import fits, ordered, statistics, tables
from . import query

AT, SE, SA = A.ATOMS_SQL, A.SERIES_SQL, A.SAMPLES_SQL
TRACK = f"{AT}, track AS (SELECT element AS particle, atom_index AS step, CASE WHEN atom_index % 2 = 0 THEN x ELSE x + 4 - 10 * floor((x + 4) / 10) END AS x FROM atoms)"


def track(spark, sf_dir):
    far = F.col("x") + 4 - 10 * F.floor((F.col("x") + 4) / 10)
    return A.atoms(spark, sf_dir).select(F.col("element").alias("particle"), F.col("atom_index").alias("step"), F.when(F.col("atom_index") % 2 == 0, F.col("x")).otherwise(far).alias("x"))


@query(f"WITH {TRACK}, d AS (SELECT *, coalesce(x - lag(x) OVER w - 10.0 * round_even((x - lag(x) OVER w) / 10.0, 0), 0) AS d, first_value(x) OVER w AS x0 FROM track WINDOW w AS (PARTITION BY particle ORDER BY step)) SELECT particle, step, round(x0 + sum(d) OVER (PARTITION BY particle ORDER BY step), 6) AS x_unwrapped FROM d")
def w1_unwrap(spark, sf_dir):
    return ordered.unwrap(track(spark, sf_dir), ["particle"], "step", {"x": 10.0}).select("particle", "step", F.round("x_unwrapped", 6).alias("x_unwrapped"))


@query(f"""WITH {SE}, v AS (SELECT event_id, id, cents, cents > 2000 AS valid, CASE WHEN cents > 2000 THEN cents END AS c FROM series),
n AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(c IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM v)
SELECT event_id, round(CASE WHEN valid THEN CASE WHEN a IS NULL AND b IS NULL THEN 0.5 ELSE greatest(1 - greatest(abs(cents - b), abs(cents - a)) / 5000.0::DOUBLE, 0) END ELSE 0 END, 9)::DOUBLE AS score FROM n""")
def w2_temporal_score(spark, sf_dir):
    v = A.series(spark, sf_dir).withColumn("valid", F.col("cents") > 2000)
    return ordered.temporal_score(v, ["id"], "event_id", "cents", "valid", 5000.0).select("event_id", F.round("score", 9).alias("score"))


@query(f"""WITH {SE}, v AS (SELECT event_id, id, cents, CASE WHEN cents > 1500 THEN cents END AS c FROM series),
g AS (SELECT *, sum(CASE WHEN c IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY event_id) AS g, last_value(c IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(c IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM v),
r AS (SELECT *, count(*) FILTER (c IS NULL) OVER (PARTITION BY id, g) AS run FROM g)
SELECT event_id, c IS NULL AND run <= 2 AND coalesce(abs(cents - b) <= 4000, true) AND coalesce(abs(cents - a) <= 4000, true) AS filled FROM r""")
def w3_fill_gaps(spark, sf_dir):
    v = A.series(spark, sf_dir).withColumn("c", F.when(F.col("cents") > 1500, F.col("cents")))
    return ordered.fill_gaps(v, ["id"], "event_id", "c", "cents", 2, 4000.0).select("event_id", "filled")


@query(f"""WITH {AT}, g AS (SELECT frame_index, z, z - lag(z) OVER (PARTITION BY frame_index ORDER BY z) AS gap FROM atoms), h AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY gap) AS r, count(*) OVER (PARTITION BY frame_index) AS n FROM g WHERE gap IS NOT NULL),
b AS (SELECT frame_index, median(gap) AS base FROM h WHERE r <= greatest(1, n // 2) GROUP BY 1) SELECT frame_index, max(z) AS break_at FROM g JOIN b USING (frame_index) WHERE gap >= greatest(0.2, 3 * base) GROUP BY 1""")
def w4_layer_break(spark, sf_dir):
    return ordered.layer_break(A.atoms(spark, sf_dir), ["frame_index"], "z", 0.2, 3.0).select("frame_index", "break_at")


@query(f"WITH {AT}, g AS (SELECT frame_index, z AS p, coalesce(lead(z) OVER w, first_value(z) OVER w + 10) - z AS gap FROM atoms WINDOW w AS (PARTITION BY frame_index ORDER BY z)) SELECT frame_index, round(max(gap), 9) AS gap FROM g GROUP BY 1")
def w5_circular_cut(spark, sf_dir):
    return ordered.circular_cut(A.atoms(spark, sf_dir), ["frame_index"], "z", 0.0, 10.0).select("frame_index", F.round("gap", 9).alias("gap"))


ISLANDS = f"{SE}, n AS (SELECT id, event_id, cents, row_number() OVER (PARTITION BY id ORDER BY event_id) AS n FROM series), f AS (SELECT *, n - row_number() OVER (PARTITION BY id ORDER BY event_id) AS g FROM n WHERE cents >= 5000), r AS (SELECT id, g, min(event_id) AS start, max(event_id) AS stop, count(*) AS length FROM f GROUP BY ALL)"


@query(f"WITH {ISLANDS} SELECT id, start, stop, length FROM r")
def w7_islands(spark, sf_dir):
    return ordered.islands(A.series(spark, sf_dir), ["id"], "event_id", F.col("cents") >= 5000)


@query(f"WITH {ISLANDS} SELECT id, max(length) AS longest_run FROM r GROUP BY id")
def w6_longest_run(spark, sf_dir):
    return ordered.longest_run(A.series(spark, sf_dir), ["id"], "event_id", F.col("cents") >= 5000)


@query(f"WITH {TRACK}, b AS (SELECT *, coalesce(abs(x - lag(x) OVER (PARTITION BY particle ORDER BY step)) > 5.0, false)::INT AS b FROM track) SELECT particle, step, (sum(b) OVER (PARTITION BY particle ORDER BY step))::BIGINT AS path FROM b")
def w8_paths(spark, sf_dir):
    return ordered.paths(track(spark, sf_dir), ["particle"], "step", {"x": 10.0}).select("particle", "step", "path")


@query(f"WITH {SE}, r AS (SELECT event_id, sum(cents) OVER w AS s, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY kind ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, s::DOUBLE / n AS cumulative FROM r")
def w9_cumulative_average(spark, sf_dir):
    return ordered.cumulative_average(A.series(spark, sf_dir), ["kind"], ["t_us", "event_id"], "cents").select("event_id", "cumulative")


PROFILE = f"{SA}, s AS (SELECT g, d::DOUBLE AS x, sum(w)::DOUBLE AS y FROM samples GROUP BY ALL)"


def profile(spark, sf_dir):
    return A.samples(spark, sf_dir).groupBy("g", F.col("d").cast("double").alias("x")).agg(F.sum("w").cast("double").alias("y"))


@query(f"""WITH {PROFILE}, t AS (SELECT g, x AS x1, y AS y1, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM s WINDOW w AS (PARTITION BY g ORDER BY x)), c AS (SELECT *, greatest(x0, 1.5) AS a, least(x1, 7.25) AS b FROM t WHERE x0 < 7.25 AND x1 > 1.5),
v AS (SELECT g, a, b, y0 + (y1 - y0) * (a - x0) / (x1 - x0) AS ya, y0 + (y1 - y0) * (b - x0) / (x1 - x0) AS yb FROM c) SELECT g, round(sum((ya + yb) / 2 * (b - a)), 6) AS signed FROM v GROUP BY g""")
def w10_integral(spark, sf_dir):
    return ordered.integrate(profile(spark, sf_dir), ["g"], "x", "y", 1.5, 7.25).select("g", F.round("signed", 6).alias("signed"))


@query(f"""WITH {PROFILE}, k AS (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS n FROM s WINDOW w AS (PARTITION BY g ORDER BY x)), a AS (SELECT g, min(x) AS peak FROM k WHERE y >= p AND y > n GROUP BY g)
SELECT g, peak, coalesce(min(x) FILTER (y <= p AND y < n), arg_min(x, (y, x))) AS minimum FROM k JOIN a USING (g) WHERE x > peak GROUP BY ALL""")
def w11_first_peak(spark, sf_dir):
    return ordered.first_peak_and_minimum(profile(spark, sf_dir), ["g"], "x", "y")


@query(f"""WITH {PROFILE}, o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x) AS i, count(*) OVER (PARTITION BY g) AS n FROM s), k AS (SELECT d, exp(-0.5 * (d / 1.2) ** 2) AS w FROM range(-4, 5) t(d))
SELECT a.g, a.x, round(sum(b.y * w) / sum(w), 6) AS smoothed FROM o a CROSS JOIN k JOIN o b ON a.g = b.g AND b.i = least(greatest(a.i + d, 1), a.n) GROUP BY ALL""")
def w12_gaussian_smooth(spark, sf_dir):
    return ordered.smooth(profile(spark, sf_dir), ["g"], "x", "y", 1.2).select("g", "x", F.round("smoothed", 6).alias("smoothed"))


@query(f"WITH {AT}, r AS (SELECT frame_index, atom_index, row_number() OVER (PARTITION BY frame_index ORDER BY z, atom_index) + row_number() OVER (PARTITION BY frame_index ORDER BY x, atom_index) AS rank_score FROM atoms), k AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY rank_score, atom_index) AS k FROM r) SELECT frame_index, atom_index, rank_score FROM k WHERE k <= 5")
def w13_low_ranks(spark, sf_dir):
    out = ordered.low_ranks(A.atoms(spark, sf_dir), ["frame_index"], [F.col("z"), F.col("x")], "atom_index", 5)
    return out.select("frame_index", "atom_index", F.col("rank_score").cast("long").alias("rank_score"))


@query(f"""WITH {PROFILE}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x) AS n, max(y) OVER (PARTITION BY g) AS m FROM s), f AS (SELECT *, n - row_number() OVER (PARTITION BY g ORDER BY x) AS k FROM n WHERE y >= 0.9 * m), r AS (SELECT g, k, min(x) AS start, max(x) AS stop, count(*) AS length FROM f GROUP BY ALL)
SELECT g, start, stop, length FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY length DESC, start DESC) AS b FROM r) WHERE b = 1""")
def w14_plateau(spark, sf_dir):
    return ordered.plateau(profile(spark, sf_dir), ["g"], "x", "y", 0.9)


@query(f"WITH {PROFILE}, k AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM s WINDOW w AS (PARTITION BY g ORDER BY x)) SELECT g, round(y + (ny - y) * (3.4 - x) / (nx - x), 6) AS value FROM k WHERE x <= 3.4 AND nx > 3.4")
def w16_interpolate(spark, sf_dir):
    return ordered.interpolate(profile(spark, sf_dir), ["g"], "x", "y", 3.4).select("g", F.round("value", 6).alias("value"))


@query(f"WITH {SE} SELECT event_id, first_value(CASE WHEN kind = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS linked FROM series")
def w17_back_link(spark, sf_dir):
    return ordered.back_link(A.series(spark, sf_dir), ["id"], "event_id", F.when(F.col("kind") == "purchase", F.col("event_id")), "linked").select("event_id", "linked")


@query(f"WITH {SE} SELECT event_id, row_number() OVER (PARTITION BY id ORDER BY event_id) - 1 AS frame_index, (row_number() OVER (PARTITION BY id ORDER BY event_id) - 1) * 2.5::DOUBLE AS time_fs FROM series")
def w18_time_axis(spark, sf_dir):
    return ordered.time_axis(A.series(spark, sf_dir), ["id"], "event_id", 2.5).select("event_id", "frame_index", "time_fs")


@query(f"WITH {SE}, b AS (SELECT event_id, id, t_us, coalesce(t_us - lag(t_us) OVER (PARTITION BY id ORDER BY t_us) > 3600000000, false)::INT AS b FROM series) SELECT event_id, (sum(b) OVER (PARTITION BY id ORDER BY t_us))::BIGINT AS session FROM b")
def w7_sessions(spark, sf_dir):
    return ordered.sessions(A.series(spark, sf_dir), ["id"], "t_us", 3.6e9).select("event_id", "session")


@query(f"WITH {SA} SELECT g, side, round(regr_slope(w, d), 6) AS slope, round(regr_intercept(w, d), 6) AS intercept, round(regr_r2(w, d), 9) AS r2, count(*) AS n FROM samples GROUP BY ALL")
def d2_linear_fit(spark, sf_dir):
    out = fits.linear(A.samples(spark, sf_dir), ["g", "side"], F.col("d").cast("double"), F.col("w").cast("double"))
    return out.select("g", "side", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 9).alias("r2"), "n")


@query(f"WITH {SA} SELECT g, round(regr_slope(w, ln(x)), 6) AS slope, round(regr_intercept(w, ln(x)), 5) AS intercept FROM samples WHERE x > 0 GROUP BY g")
def d3_logarithmic_fit(spark, sf_dir):
    out = fits.logarithmic(A.samples(spark, sf_dir), ["g"], F.col("x"), F.col("w").cast("double"))
    return out.select("g", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query(f"""WITH {SA}, k AS (SELECT g, d::DOUBLE - avg(d) OVER (PARTITION BY g) AS u, w::DOUBLE AS y, avg(d) OVER (PARTITION BY g) AS m FROM samples), q AS (SELECT g, max(m) AS m, avg(u * u) AS v, avg(u ** 3) AS c3, avg(u ** 4) AS c4, avg(y) AS y0, avg(u * y) AS y1, avg(u * u * y) AS y2 FROM k GROUP BY g),
p AS (SELECT g, m, v, y0, (y2 - v * y0 - c3 / v * y1) / (c4 - v * v - c3 * c3 / v) AS c2, y1, c3 FROM q), r AS (SELECT g, m, c2, (y1 - c2 * c3) / v AS b1, y0 - c2 * v AS b0 FROM p)
SELECT g, round(b0 - b1 * m + c2 * m * m, 5) AS c0, round(b1 - 2 * c2 * m, 5) AS c1, round(c2, 6) AS c2 FROM r""")
def d2_parabola(spark, sf_dir):
    out = fits.parabola(A.samples(spark, sf_dir), ["g"], F.col("d").cast("double"), F.col("w").cast("double"))
    return out.select("g", F.round("c0", 5).alias("c0"), F.round("c1", 5).alias("c1"), F.round("c2", 6).alias("c2"))


#: Curves with known parameters, which a fit must find again.
_CURVES = {
    "exponential": (lambda x, k: (2.0 + k) * F.exp(-0.3 * x) + 1.0, {"a": "2.0 + k", "b": "-0.3", "c": "1.0"}),
    "power": (lambda x, k: (1.0 + k) * F.pow(x, 1.5), {"a": "1.0 + k", "b": "1.5"}),
    "gaussian": (lambda x, k: (3.0 + k) * F.exp(-0.5 * F.pow((x - 5.0) / 1.25, 2)) + 0.5, {"height": "3.0 + k", "centre": "5.0", "sigma": "1.25", "offset": "0.5"}),
    "lorentzian": (lambda x, k: (4.0 + k) * 0.64 / (F.pow(x - 6.0, 2) + 0.64) + 0.25, {"height": "4.0 + k", "centre": "6.0", "gamma": "0.8", "offset": "0.25"}),
}


@query(" UNION ALL ".join(f"SELECT '{m}' AS model, r_regionkey AS series, '{p}' AS parameter, round(({v.replace('k', 'r_regionkey')})::DOUBLE, 3) AS value FROM region" for m, (_, known) in _CURVES.items() for p, v in known.items()))
def d3_nonlinear_fits(spark, sf_dir):
    k = A.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("series"), F.explode(F.sequence(F.lit(1), F.lit(48))).alias("i")).withColumn("x", F.col("i") / 4.0)
    out = None
    for kind, (curve, _) in _CURVES.items():
        fitted = fits.nonlinear(k.withColumn("y", curve(F.col("x"), F.col("series"))), "series", "x", "y", kind)
        one = fitted.where("parameter not in ('r2', 'rmse')").select(F.lit(kind).alias("model"), "series", "parameter", F.round("value", 3).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {PROFILE}, k AS (SELECT g, x, y - 1000 AS y, lag(x) OVER w AS p, lag(y - 1000) OVER w AS q FROM s WINDOW w AS (PARTITION BY g ORDER BY x)) SELECT g, round(sum((y + q) / 2 * (x - p)), 4) AS signed, round(sum(CASE WHEN y * q < 0 THEN (y * y + q * q) / (2 * (abs(y) + abs(q))) ELSE (abs(y) + abs(q)) / 2 END * (x - p)), 4) AS absolute FROM k WHERE p >= 2 AND x <= 8 GROUP BY g")
def d4_integral_over_baseline(spark, sf_dir):
    out = ordered.integrate(profile(spark, sf_dir), ["g"], "x", "y", 2.0, 8.0, 1000.0)
    return out.select("g", F.round("signed", 4).alias("signed"), F.round("absolute", 4).alias("absolute"))


@query(f"WITH {PROFILE} SELECT g, x, round(avg(y) OVER (PARTITION BY g ORDER BY x ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM s")
def d5_cumulative_overlay(spark, sf_dir):
    return ordered.cumulative_average(profile(spark, sf_dir), ["g"], ["x"], "y").select("g", "x", F.round("cumulative", 6).alias("cumulative"))


@query(f"WITH {AT}, k AS (SELECT element, atom_index, row_number() OVER (PARTITION BY element ORDER BY abs(z - 5), atom_index) AS r FROM atoms) SELECT element, atom_index FROM k WHERE r <= 6")
def o4_reference_atoms(spark, sf_dir):
    return ordered.low_ranks(A.atoms(spark, sf_dir), ["element"], [F.abs(F.col("z") - 5)], "atom_index", 6).select("element", "atom_index")


@query("SELECT 0 AS source_order, n_nationkey AS key, n_name AS name, NULL::DOUBLE AS value FROM nation UNION ALL SELECT 1, s_suppkey, NULL, s_acctbal FROM supplier UNION ALL SELECT 2, r_regionkey, r_name, NULL FROM region")
def u2_field_union(spark, sf_dir):
    t = lambda n, *c: A.table(spark, sf_dir, n).select(*(F.col(a).alias(b) for a, b in c))
    out = tables.union_sources([t("nation", ("n_nationkey", "key"), ("n_name", "name")), t("supplier", ("s_suppkey", "key"), ("s_acctbal", "value")), t("region", ("r_regionkey", "key"), ("r_name", "name"))], "key")
    return out.select("source_order", "key", "name", "value")


@query("SELECT s_suppkey % 5 AS region, count(*) AS n, round((sum(m * v * v) - sum(m * v) * sum(m * v) / sum(m)) / ((3 * count(*) - 3) * 1.380649e-23), 3) AS temperature_k FROM (SELECT s_suppkey, 18.0 * 1.66053906660e-27 AS m, s_acctbal / 10.0 AS v FROM supplier) GROUP BY 1")
def a19_kinetic_temperature(spark, sf_dir):
    v = A.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("region"), F.lit(18.0 * 1.66053906660e-27).alias("mass_kg"), (F.col("s_acctbal") / 10.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"))
    return statistics.temperature(v, ["region"]).withColumn("temperature_k", F.round("temperature_k", 3))


@query(f"WITH {AT}, m AS (SELECT element, count(*) AS n, stddev_samp(z) AS s FROM atoms GROUP BY 1) SELECT element, n FROM m ORDER BY round(s, 9), n DESC, element LIMIT 4")
def o3_top_elements(spark, sf_dir):
    m = A.atoms(spark, sf_dir).groupBy("element").agg(F.count("*").alias("n"), F.round(F.stddev_samp("z"), 9).alias("s"))
    return m.orderBy("s", F.desc("n"), "element").limit(4).select("element", "n")


@query(f"WITH {SE} SELECT id, max(event_id) AS last_event, arg_max(cents, event_id) AS cents FROM series GROUP BY id")
def o5_last_match(spark, sf_dir):
    return A.series(spark, sf_dir).groupBy("id").agg(F.max("event_id").alias("last_event"), F.max_by("cents", "event_id").alias("cents"))


@query(f"WITH {SE}, s AS (SELECT id, kind, round(0.35 * avg((cents > 1000)::INT) + 0.65 * least(count(*), 50) / 50.0, 9) AS score FROM series GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, kind) AS r FROM s) SELECT id, kind, score::DOUBLE AS score FROM r WHERE r = 1")
def o6_best_estimate(spark, sf_dir):
    s = A.series(spark, sf_dir).groupBy("id", "kind").agg(F.round(0.35 * F.avg((F.col("cents") > 1000).cast("int")) + 0.65 * F.least(F.count("*"), F.lit(50)) / 50.0, 9).alias("score"))
    return s.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "kind"))).where("r = 1").select("id", "kind", "score")
