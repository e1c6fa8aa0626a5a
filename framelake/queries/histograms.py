from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import histogram, series as S, statistics
from . import query

AT, SA, SE = A.ATOMS_SQL, A.SAMPLES_SQL, A.SERIES_SQL
N, WIDTH = 40, 2500.0
BIN = f"least(greatest(floor(x / {WIDTH})::INT, 0), {N - 1})"


def binned(spark, sf_dir):
    return A.samples(spark, sf_dir).withColumn("bin", histogram.bin_index(F.col("x"), 0.0, WIDTH, N))


@query(f"WITH {SA} SELECT {BIN} AS i_x, sum(w)::BIGINT AS weight, count(*) AS entities FROM samples GROUP BY ALL")
def a1_weighted_histogram(spark, sf_dir):
    return histogram.histogram(A.samples(spark, sf_dir), [("x", 0.0, WIDTH, N)], {"weight": F.sum("w"), "entities": F.count("*")})


@query(f"WITH {SA} SELECT {BIN} AS i_x, least(greatest(floor(w / 5.0)::INT, 0), 9) AS i_w, sum(d)::BIGINT AS weight FROM samples GROUP BY ALL")
def a2_histogram_2d(spark, sf_dir):
    return histogram.histogram(A.samples(spark, sf_dir), [("x", 0.0, WIDTH, N), ("w", 0.0, 5.0, 10)], {"weight": F.sum("d")})


@query(f"""WITH {AT}, t AS (SELECT *, CASE WHEN abs(z - 5.0) < 1e-10 THEN 0 WHEN z > 5 THEN 1 ELSE -1 END AS side FROM atoms)
SELECT element, floor(x / 0.5)::INT AS i_x, floor(y / 0.5)::INT AS i_y, floor(z / 0.5)::INT AS i_z, count(*)::DOUBLE AS entities, sum(CASE side WHEN 1 THEN 1 WHEN 0 THEN 0.5 ELSE 0 END)::DOUBLE AS entities_top,
  sum(CASE side WHEN -1 THEN 1 WHEN 0 THEN 0.5 ELSE 0 END)::DOUBLE AS entities_bottom FROM t GROUP BY ALL""")
def a3_sparse_grid(spark, sf_dir):
    t = A.atoms(spark, sf_dir).withColumn("one", F.lit(1.0)).withColumn("side", F.when(F.abs(F.col("z") - 5.0) < 1e-10, 0).when(F.col("z") > 5, 1).otherwise(-1))
    return histogram.sparse_grid(t, [(c, 0.0, 0.5) for c in "xyz"], "one", "side", ["element"]).select("element", "i_x", "i_y", "i_z", "entities", "entities_top", "entities_bottom")


@query(f"WITH {SA}, h AS (SELECT {BIN} AS bin, sum(w)::BIGINT AS weight FROM samples GROUP BY ALL) SELECT s.bin::INT AS bin, coalesce(weight, 0)::BIGINT AS weight FROM range({N}) s(bin) LEFT JOIN h USING (bin)")
def a5_dense_bins(spark, sf_dir):
    h = binned(spark, sf_dir).groupBy("bin").agg(F.sum("w").alias("weight"))
    return histogram.dense(h, "bin", N, {"weight": 0})


FRAME = "o % 200"


@query(f"""WITH {SA}, h AS (SELECT {BIN} AS bin, {FRAME} AS frame, sum(w)::DOUBLE AS v FROM samples GROUP BY ALL), g AS (SELECT bin, f.frame, coalesce(v, 0) AS v FROM (SELECT DISTINCT bin FROM h) CROSS JOIN range(200) f(frame) LEFT JOIN h USING (bin, frame))
SELECT bin, 200::INT AS sample_n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sample_std, round(stddev_samp(v) / sqrt(200), 6) AS sample_sem FROM g GROUP BY bin""")
def a6_frame_moments(spark, sf_dir):
    h = binned(spark, sf_dir).groupBy("bin", (F.col("o") % 200).alias("frame")).agg(F.sum("w").cast("double").alias("v"))
    out = statistics.dense_moments(h, "bin", "v", 200)
    return out.select("bin", "sample_n", *(F.round(c, 6).alias(c) for c in ("mean", "sample_std", "sample_sem")))


@query(f"WITH {SA} SELECT g, side, count(w) AS sample_n, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS sample_std, round(stddev_samp(w) / sqrt(count(w)), 6) AS sample_sem FROM samples GROUP BY ALL")
def a7_std_and_sem(spark, sf_dir):
    out = statistics.moments(A.samples(spark, sf_dir), ["g", "side"], "w")
    return out.select("g", "side", "sample_n", *(F.round(c, 6).alias(c) for c in ("mean", "sample_std", "sample_sem")))


@query(f"WITH {SA}, f AS (SELECT DISTINCT o AS frame FROM samples), b AS (SELECT frame, (ntile(20) OVER (ORDER BY frame) - 1)::INT AS block FROM f) SELECT block, count(*) AS frames, min(frame) AS first_frame FROM b GROUP BY block")
def a8_blocks(spark, sf_dir):
    frames = A.samples(spark, sf_dir).select(F.col("o").alias("frame")).distinct()
    return statistics.with_blocks(frames, "frame", statistics.block_count(10_000)).groupBy("block").agg(F.count("*").alias("frames"), F.min("frame").alias("first_frame"))


@query(f"""WITH {SA}, f AS (SELECT o AS frame, sum(w)::DOUBLE AS v FROM samples GROUP BY o), b AS (SELECT *, (ntile(20) OVER (ORDER BY frame) - 1)::INT AS block FROM f), m AS (SELECT block, avg(v) AS m FROM b GROUP BY block)
SELECT 0 AS series, count(m) AS block_n, round(avg(m), 6) AS block_mean, round(stddev_samp(m), 6) AS block_std, round(stddev_samp(m) / sqrt(count(m)), 6) AS block_sem FROM m""")
def a9_block_statistics(spark, sf_dir):
    f = A.samples(spark, sf_dir).groupBy(F.col("o").alias("frame")).agg(F.sum("w").cast("double").alias("v"))
    out = statistics.block_moments(statistics.with_blocks(f, "frame", 20).withColumn("series", F.lit(0)), ["series"], "v")
    return out.select("series", "block_n", *(F.round(c, 6).alias(c) for c in ("block_mean", "block_std", "block_sem")))


@query(f"WITH {AT}, h AS (SELECT floor(z / 0.5)::INT AS bin, count(*) AS n FROM atoms GROUP BY ALL) SELECT bin, n, round(n / (10 * 50.0), 9) AS number_density FROM h")
def a17_number_density(spark, sf_dir):
    h = A.atoms(spark, sf_dir).groupBy(F.floor(F.col("z") / 0.5).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return histogram.number_density(h, "n", 10, 0.5, 10 * 10 * 0.5).withColumn("number_density", F.round("number_density", 9))


@query(f"WITH {AT}, h AS (SELECT frame_index, floor(z)::INT AS bin, count(*) AS n, 100.0 + frame_index AS v FROM atoms GROUP BY ALL) SELECT bin, round(avg(n / v), 9) AS number_density FROM h GROUP BY bin")
def a17_framewise_density(spark, sf_dir):
    h = A.atoms(spark, sf_dir).groupBy("frame_index", F.floor("z").cast("int").alias("bin")).agg(F.count("*").alias("n")).withColumn("v", 100.0 + F.col("frame_index"))
    return histogram.framewise_density(h, "bin", "n", "v").withColumn("number_density", F.round("number_density", 9))


@query(f"WITH {SA}, h AS (SELECT side, {BIN} AS bin, sum(w)::DOUBLE AS v FROM samples GROUP BY ALL) SELECT bin, round(avg(v), 6) AS v FROM h GROUP BY bin")
def a18_fold_sides(spark, sf_dir):
    h = binned(spark, sf_dir).groupBy("side", "bin").agg(F.sum("w").cast("double").alias("v"))
    return histogram.fold_sides(h, "v").withColumn("v", F.round("v", 6))


@query("SELECT l_linenumber AS iz, round(avg(round(l_discount * 100)::BIGINT), 9) AS value FROM lineitem GROUP BY ALL")
def a20_planar_average(spark, sf_dir):
    from ..plans.potential import planar_average

    cells = A.table(spark, sf_dir, "lineitem").select(F.lit("f").alias("source"), F.col("l_linenumber").alias("iz"), F.round(F.col("l_discount") * 100).cast("long").alias("value"))
    return planar_average(cells).select("iz", F.round("value", 9).alias("value"))


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS std, count(o_totalprice) AS n FROM orders GROUP BY ALL")
def a21_record_summary(spark, sf_dir):
    out = statistics.summary(A.table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")
    return out.select("o_orderstatus", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query(f"WITH {SE}, r AS (SELECT kind, cents, row_number() OVER (PARTITION BY kind ORDER BY cents) AS r, count(*) OVER (PARTITION BY kind) AS n FROM series) SELECT kind, round(avg(cents), 6) AS trimmed_mean FROM r WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1) GROUP BY kind")
def a25_trimmed_mean(spark, sf_dir):
    return statistics.trimmed_mean(A.series(spark, sf_dir), ["kind"], "cents", 0.1).withColumn("trimmed_mean", F.round("trimmed_mean", 6))


@query(f"WITH {AT}, t AS (SELECT atom_index % 50 AS atom_index, x, y, z FROM atoms), m AS (SELECT atom_index, median(x) AS xm, median(y) AS ym, median(z) AS zm FROM t GROUP BY 1) SELECT atom_index, round(median(sqrt((x - xm) ** 2 + (y - ym) ** 2 + (z - zm) ** 2)), 9) AS mobility FROM t JOIN m USING (atom_index) GROUP BY 1")
def a26_mobility(spark, sf_dir):
    t = A.atoms(spark, sf_dir).withColumn("atom_index", F.col("atom_index") % 50)
    return statistics.mobility(t).withColumn("mobility", F.round("mobility", 9))


@query(f"WITH {AT} SELECT frame_index, round(quantile_cont(z, 0.95), 9) AS quantile FROM atoms GROUP BY 1")
def a27_side_quantile(spark, sf_dir):
    return statistics.side_quantile(A.atoms(spark, sf_dir), ["frame_index"], "z", "top", 0.95).withColumn("quantile", F.round("quantile", 9))


@query(f"WITH {AT}, e AS (SELECT CASE WHEN z > 5 THEN 'top' ELSE 'bottom' END AS side, frame_index, count(*) FILTER (abs(z - 5) > 1.5) AS n FROM atoms WHERE element = 'O' GROUP BY ALL) SELECT side, round(sum(n) / 10.0, 9) AS mean_count, round(count(*) FILTER (n > 0) / 10.0, 9) AS persistence FROM e GROUP BY side")
def a28_contact_populations(spark, sf_dir):
    w = A.atoms(spark, sf_dir).where("element = 'O'").withColumn("side", F.when(F.col("z") > 5, "top").otherwise("bottom")).withColumn("contact", F.abs(F.col("z") - 5) > 1.5)
    return statistics.populations(w, 10).select("side", F.round("mean_count", 9).alias("mean_count"), F.round("persistence", 9).alias("persistence"))


@query(f"WITH {SA}, e AS (SELECT floor(x / 10000.0)::BIGINT AS bin, {FRAME} AS frame, avg(w) AS v FROM samples GROUP BY ALL) SELECT bin, count(v) AS sample_n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sample_std FROM e GROUP BY bin")
def a29_frames_first(spark, sf_dir):
    s = A.samples(spark, sf_dir).withColumn("frame", F.col("o") % 200)
    return statistics.frames_first(s, "x", "w", 10000.0, "frame").select("bin", "sample_n", F.round("mean", 6).alias("mean"), F.round("sample_std", 6).alias("sample_std"))


def blocks(spark, sf_dir):
    f = A.samples(spark, sf_dir).groupBy((F.col("o") % 16).cast("int").alias("block"), F.floor(F.col("x") / 10000.0).alias("bin"))
    return f.agg(F.sum("w").cast("double").alias("numerator"), F.count("*").cast("double").alias("denominator")).withColumn("component", F.lit(0))


BLOCKS = f"{SA}, b AS (SELECT (o % 16)::INT AS block, floor(x / 10000.0)::BIGINT AS bin, sum(w)::DOUBLE AS numerator, count(*)::DOUBLE AS denominator, 0 AS component FROM samples GROUP BY 1, 2)"


def weights_sql(blocks, repeats, seed):
    """The draws' multinomial weights as rows (draw, block, weight); one matrix for all bins."""
    w = statistics.weights_of(blocks, repeats, seed)
    return "w(draw, block, weight) AS (VALUES " + ", ".join(f"({i}, {j}, {n})" for i, row in enumerate(w.tolist()) for j, n in enumerate(row) if n) + ")"


def interval_sql(blocks, merge, repeats=200, seed=3):
    """Percentile intervals of each bin's ratio, from merged blocks numbered in order."""
    return f"""{weights_sql(blocks, repeats, seed)}, m AS (SELECT bin, floor(block / {merge})::INT AS block, sum(numerator) AS num, sum(denominator) AS den FROM b GROUP BY ALL),
full_ AS (SELECT bin FROM m GROUP BY bin HAVING count(*) = {blocks}), d AS (SELECT bin, draw, sum(weight * num) / sum(weight * den) AS v FROM m JOIN full_ USING (bin) JOIN w USING (block) GROUP BY ALL),
i AS (SELECT bin, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM d GROUP BY bin)"""


@query(f"WITH {BLOCKS}, {interval_sql(16, 1)} SELECT bin, round(low, 6) AS low, round(high, 6) AS high, 16::BIGINT AS n_blocks FROM i")
def a30_bootstrap(spark, sf_dir):
    out = statistics.bootstrap(blocks(spark, sf_dir), repeats=200, seed=3).where("n_blocks = 16")
    return out.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n_blocks")


def stability_sql():
    parts = [f"SELECT {m} AS merge, (WITH {interval_sql(16 // m, m)} SELECT round(median(high - low), 6) FROM i) AS median_width" for m in (1, 2, 4)]
    return f"WITH {BLOCKS} " + " UNION ALL ".join(parts)


@query(stability_sql())
def a31_block_stability(spark, sf_dir):
    every = blocks(spark, sf_dir)
    whole = every.groupBy("bin").agg(F.count("*").alias("k")).where("k = 16").select("bin")
    return statistics.stability(every.join(whole, "bin"), repeats=200, seed=3).withColumn("median_width", F.round("median_width", 6))


@query(f"WITH {BLOCKS} SELECT bin, block, component, numerator * 2.5 AS numerator, denominator FROM b WHERE bin IN (1, 3)")
def a43_block_subset(spark, sf_dir):
    return statistics.subset_blocks(blocks(spark, sf_dir), [1, 3], 2.5).select("bin", "block", "component", "numerator", "denominator")


@query(f"WITH {BLOCKS} SELECT bin, component, floor(block / 4)::INT AS block, sum(numerator) AS numerator, sum(denominator) AS denominator FROM b GROUP BY ALL")
def a31_merge_blocks(spark, sf_dir):
    return statistics.merge_blocks(blocks(spark, sf_dir), 4)


@query(f"""WITH {SA}, s AS (SELECT side, (o % 16)::INT AS block, floor(x / 20000.0)::BIGINT AS bin, count(*) AS sample_n, sum(w)::DOUBLE AS numerator, count(*)::DOUBLE AS denominator FROM samples GROUP BY ALL), t AS (SELECT * FROM s WHERE side = 'O'), u AS (SELECT * FROM s WHERE side = 'F')
SELECT bin, block, least(t.sample_n, u.sample_n) AS sample_n, c AS component, CASE c WHEN 0 THEN t.numerator ELSE u.numerator END AS numerator FROM t JOIN u USING (bin, block) CROSS JOIN (VALUES (0), (1)) k(c)""")
def a44_combine_sides(spark, sf_dir):
    s = A.samples(spark, sf_dir).groupBy("side", (F.col("o") % 16).cast("int").alias("block"), F.floor(F.col("x") / 20000.0).alias("bin")).agg(F.count("*").alias("sample_n"), F.sum("w").cast("double").alias("numerator"), F.count("*").cast("double").alias("denominator"))
    return statistics.combine_sides(s.where("side = 'O'"), s.where("side = 'F'")).select("bin", "block", "sample_n", "component", "numerator")


@query("SELECT 86400000.0::DOUBLE AS time_step_fs")
def a45_time_step(spark, sf_dir):
    frames = A.table(spark, sf_dir, "nation").select((F.col("n_nationkey") * F.lit(86400000.0)).alias("time_fs"))
    return statistics.time_step(frames)


@query(f"WITH {SE}, m AS (SELECT id, min(t_us) AS t0 FROM series GROUP BY id), g AS (SELECT s.id, floor((t_us - t0) / 86400000000.0)::BIGINT AS group_id, t_us - 1704067200000000 AS t, cents FROM series s JOIN m USING (id)) SELECT id, group_id, floor(avg(t))::BIGINT AS x, max(cents) AS y FROM g GROUP BY ALL")
def a32_rebin(spark, sf_dir):
    out = S.rebin(A.series(spark, sf_dir).withColumn("t", F.col("t_us") - 1704067200000000), ["id"], "t", "cents", 86400000000.0, "max")
    return out.select("id", "group_id", F.floor("x").alias("x"), "y")


@query(f"WITH {SA} SELECT g, d AS x, count(w) AS n, round(avg(w), 6) AS y, round(stddev_samp(w), 6) AS std, round(stddev_samp(w) / sqrt(count(w)), 6) AS sem FROM samples GROUP BY ALL")
def a33_group_statistics(spark, sf_dir):
    return S.grouped(A.samples(spark, sf_dir), ["g"], "d", "w").select("g", "x", "n", *(F.round(c, 6).alias(c) for c in ("y", "std", "sem")))


@query(f"WITH {SA} SELECT floor(d / 4.0)::BIGINT AS bin, count(*) AS n, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std FROM samples GROUP BY ALL")
def a34_pooled_statistics(spark, sf_dir):
    parts = statistics.moments(A.samples(spark, sf_dir), ["d"], "w").withColumn("bin", F.floor(F.col("d") / 4.0))
    return statistics.pooled(parts, ["bin"], "sample_n", "mean", "sample_std").select("bin", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {SA}, m AS (SELECT g, {BIN} AS bin, sum(w)::DOUBLE AS v, count(DISTINCT d) AS n_frames FROM samples GROUP BY ALL) SELECT bin, round(sum(v * n_frames) / sum(n_frames), 6) AS v FROM m GROUP BY bin")
def a35_weighted_maps(spark, sf_dir):
    m = binned(spark, sf_dir).groupBy("g", "bin").agg(F.sum("w").cast("double").alias("v"), F.count_distinct("d").alias("n_frames"))
    return histogram.averaged_maps(m, ["bin"], "v").withColumn("v", F.round("v", 6))


@query(f"WITH {AT}, g AS (SELECT floor(x / 0.5)::INT AS i_x, floor(z / 0.5)::INT AS i_z, count(*)::DOUBLE AS entities FROM atoms GROUP BY ALL) SELECT floor((i_z + 0.5) * 0.5 / 1.0)::INT AS bin, sum(entities) AS entities, sum(entities) / 200.0::DOUBLE AS density FROM g WHERE (i_x + 0.5) * 0.5 BETWEEN 2 AND 6 GROUP BY 1")
def a36_marginal(spark, sf_dir):
    g = A.atoms(spark, sf_dir).groupBy(F.floor(F.col("x") / 0.5).cast("int").alias("i_x"), F.floor(F.col("z") / 0.5).cast("int").alias("i_z")).agg(F.count("*").cast("double").alias("entities"))
    return histogram.marginal(g, ("i_z", 0.0, 0.5, 1.0), "entities", 200.0, [("i_x", 0.0, 0.5, 2.0, 6.0)])


@query(f"WITH {AT}, g AS (SELECT frame_index % 2 AS side, floor(x)::INT AS bin, sum(round((y - 5) * 1000)::BIGINT) AS c, count(*) AS n FROM atoms GROUP BY ALL), m AS (SELECT side, bin, c / n AS v FROM g) SELECT bin, round(avg(v), 6) AS v FROM m GROUP BY bin")
def a37_orientation_marginal(spark, sf_dir):
    g = A.atoms(spark, sf_dir).groupBy((F.col("frame_index") % 2).alias("side"), F.floor("x").cast("int").alias("bin")).agg(F.sum(F.round((F.col("y") - 5) * 1000).cast("long")).alias("c"), F.count("*").alias("n"))
    return histogram.fold_sides(g.withColumn("v", F.col("c") / F.col("n")), "v").withColumn("v", F.round("v", 6))


@query(f"WITH {SA}, h AS (SELECT least(greatest(floor(x / 1000.0)::INT, 0), 22) AS bin, count(*) AS n FROM samples GROUP BY ALL) SELECT least(floor(bin / 5)::INT, 3) AS merged, sum(n)::BIGINT AS n FROM h GROUP BY 1")
def a38_merge_bins(spark, sf_dir):
    mapping = histogram.merge_axis([1000.0 * i for i in range(24)], 5000.0)
    h = A.samples(spark, sf_dir).groupBy(histogram.bin_index(F.col("x"), 0.0, 1000.0, 23).alias("bin")).agg(F.count("*").alias("n"))
    to = F.element_at(F.array(*(F.lit(g) for g in mapping)), F.col("bin") + 1)
    return h.groupBy(to.alias("merged")).agg(F.sum("n").alias("n"))


@query("SELECT r_regionkey % 2 AS geometry, count(*) AS n_frames FROM region GROUP BY 1")
def a39_geometry_groups(spark, sf_dir):
    return A.table(spark, sf_dir, "region").groupBy((F.col("r_regionkey") % 2).alias("geometry")).agg(F.count("*").alias("n_frames"))


@query(f"WITH {AT} SELECT min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM atoms")
def a40_bounds(spark, sf_dir):
    return histogram.observed_bounds(A.atoms(spark, sf_dir), ["x", "z"])


@query(f"WITH {SA} SELECT sum(w)::BIGINT AS selected, sum(w)::BIGINT AS binned, true AS conserved FROM samples")
def a41_conservation(spark, sf_dir):
    b = binned(spark, sf_dir).groupBy("bin").agg(F.sum("w").alias("t"))
    return histogram.conserved(A.samples(spark, sf_dir), "w", b, "t")


@query(f"WITH {SA}, c AS (SELECT {BIN} AS i, d, count(*) AS counts FROM samples GROUP BY ALL) SELECT i, d, counts, round(counts / (sum(counts) OVER (PARTITION BY i) * 0.5), 9) AS value FROM c")
def f16_conditional_heatmap(spark, sf_dir):
    c = binned(spark, sf_dir).groupBy(F.col("bin").alias("i"), "d").agg(F.count("*").alias("counts"))
    return histogram.heatmap_values(c, "i", "d", WIDTH, 0.5, "conditional").withColumn("value", F.round("value", 9))


@query(f"WITH {SA}, c AS (SELECT {BIN} AS i, d, count(*) AS counts FROM samples GROUP BY ALL), b AS (SELECT d, sum(counts) AS b FROM c WHERE i BETWEEN 5 AND 15 GROUP BY d) SELECT i, c.d, counts, round((counts / sum(counts) OVER (PARTITION BY i)) / (b / (SELECT sum(b) FROM b)), 6) AS value FROM c LEFT JOIN b USING (d)")
def f16_bulk_enrichment(spark, sf_dir):
    c = binned(spark, sf_dir).groupBy(F.col("bin").alias("i"), "d").agg(F.count("*").alias("counts"))
    return histogram.enrichment(c, "i", "d", F.col("i").between(5, 15)).select("i", "d", "counts", F.round("value", 6).alias("value"))


@query(f"WITH {SA}, s AS (SELECT g, d AS x, sum(w)::DOUBLE AS y FROM samples GROUP BY ALL) SELECT g, x, y, round(y * 2 / max(y) OVER (PARTITION BY g), 9) AS normalised FROM s")
def f19_normalise_max(spark, sf_dir):
    s = A.samples(spark, sf_dir).groupBy("g", F.col("d").alias("x")).agg(F.sum("w").cast("double").alias("y"))
    return S.normalise(s, ["g"], "x", "y", "max", 2.0).select("g", "x", "y", F.round("normalised", 9).alias("normalised"))


@query(f"WITH {SA}, s AS (SELECT g, d AS x, sum(w)::DOUBLE AS y FROM samples GROUP BY ALL), a AS (SELECT g, sum(p) AS s FROM (SELECT g, (y + lag(y) OVER v) / 2 * (x - lag(x) OVER v) AS p FROM s WINDOW v AS (PARTITION BY g ORDER BY x)) GROUP BY g) SELECT g, x, round(y / s, 9) AS normalised FROM s JOIN a USING (g)")
def f19_normalise_area(spark, sf_dir):
    s = A.samples(spark, sf_dir).groupBy("g", F.col("d").alias("x")).agg(F.sum("w").cast("double").alias("y"))
    return S.normalise(s, ["g"], "x", "y", "area").select("g", "x", F.round("normalised", 9).alias("normalised"))


@query(f"WITH {SA}, s AS (SELECT g, d AS x, sum(w)::BIGINT AS y FROM samples GROUP BY ALL) SELECT x, max(y) AS y FROM s GROUP BY x")
def d14_group_layers(spark, sf_dir):
    s = A.samples(spark, sf_dir).groupBy("g", F.col("d").alias("x")).agg(F.sum("w").alias("y"))
    return S.group_layers(s.withColumn("all", F.lit(0)), "all", "x", "y", "max").select("x", "y")


@query(f"WITH {SA} SELECT round(min(x) - (max(x) - min(x)) * 0.05, 6) AS x_min, round(max(x) + (max(x) - min(x)) * 0.05, 6) AS x_max, round(min(w) - (max(w) - min(w)) * 0.05::DOUBLE, 6)::DOUBLE AS y_min, round(max(w) + (max(w) - min(w)) * 0.05::DOUBLE, 6)::DOUBLE AS y_max FROM samples")
def d8_axis_limits(spark, sf_dir):
    return S.axis_limits(A.samples(spark, sf_dir), "x", "w").select(*(F.round(c, 6).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")))


@query(f"WITH {AT}, b AS (SELECT element, min(x) AS lo, max(x) AS hi FROM atoms GROUP BY 1), r AS (SELECT floor(min(lo) / 0.25)::BIGINT AS a, ceil(max(hi) / 0.25)::BIGINT AS z FROM b) SELECT k * 0.25::DOUBLE AS edge FROM (SELECT unnest(generate_series(a, z)) AS k FROM r)")
def d12_common_edges(spark, sf_dir):
    b = A.atoms(spark, sf_dir).groupBy("element").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return S.common_edges(b, "lo", "hi", 0.25)


@query(f"WITH {SE} SELECT floor(t_us / 86400000000.0)::BIGINT AS time_bin, floor(cents / 5000.0)::BIGINT AS distance_bin, count(*) AS n, round(avg(id), 6) AS coordination FROM series GROUP BY ALL")
def d10_time_distance_layers(spark, sf_dir):
    s = A.series(spark, sf_dir)
    return s.groupBy(F.floor(F.col("t_us") / 86400000000.0).alias("time_bin"), F.floor(F.col("cents") / 5000.0).alias("distance_bin")).agg(F.count("*").alias("n"), F.round(F.avg("id"), 6).alias("coordination"))


@query(f"WITH {AT}, p AS (SELECT frame_index, element, x FROM atoms) SELECT element, floor(x / 0.1)::BIGINT AS bin, count(*) / 0.1::DOUBLE AS per_angstrom FROM p GROUP BY ALL")
def a46_distance_distribution(spark, sf_dir):
    p = A.atoms(spark, sf_dir).groupBy("element", F.floor(F.col("x") / 0.1).alias("bin")).agg((F.count("*") / 0.1).alias("per_angstrom"))
    return p




@query(f"WITH {AT} SELECT element, floor(x)::INT AS i_x, floor(y)::INT AS i_y, floor(z)::INT AS i_z, count(*)::DOUBLE AS entities FROM atoms GROUP BY ALL")
def a4_two_phase_sums(spark, sf_dir):
    """Sums by bin and frame, merged over the frames."""
    t = A.atoms(spark, sf_dir).withColumn("one", F.lit(1.0))
    each = histogram.sparse_grid(t, [(c, 0.0, 1.0) for c in "xyz"], "one", by=["element", "frame_index"])
    return each.groupBy("element", "i_x", "i_y", "i_z").agg(F.sum("entities").alias("entities"))


@query(f"WITH {AT} SELECT frame_index % 3 AS geometry, floor(x / 2)::INT AS i_x, floor(z / 2)::INT AS i_z, count(*)::DOUBLE AS entities, (count(*) FILTER (z > 5) + 0.5 * count(*) FILTER (z = 5))::DOUBLE AS entities_top FROM atoms WHERE element = 'O' GROUP BY ALL")
def a47_spatial_entities(spark, sf_dir):
    t = A.atoms(spark, sf_dir).where("element = 'O'").withColumn("one", F.lit(1.0)).withColumn("geometry", F.col("frame_index") % 3).withColumn("side", F.signum(F.col("z") - 5))
    return histogram.sparse_grid(t, [("x", 0.0, 2.0), ("z", 0.0, 2.0)], "one", "side", ["geometry"]).select("geometry", "i_x", "i_z", "entities", "entities_top")


@query(f"""WITH {SA}, f AS (SELECT o % 120 AS frame, g, sum(w)::DOUBLE AS v FROM samples GROUP BY ALL), b AS (SELECT frame, (ntile(4) OVER (ORDER BY frame) - 1)::INT AS block FROM (SELECT DISTINCT frame FROM f)), m AS (SELECT g, block, avg(v) AS m FROM f JOIN b USING (frame) GROUP BY ALL),
s AS (SELECT g, count(v) AS sample_n, round(avg(v), 6) AS mean, round(stddev_samp(v), 5) AS sample_std FROM f GROUP BY g) SELECT g, sample_n, mean, sample_std, count(m) AS block_n, round(stddev_samp(m) / sqrt(count(m)), 5) AS block_sem FROM s JOIN m USING (g) GROUP BY ALL""")
def a42_sample_matrix(spark, sf_dir):
    f = A.samples(spark, sf_dir).groupBy((F.col("o") % 120).alias("frame"), "g").agg(F.sum("w").cast("double").alias("v"))
    frames = statistics.with_blocks(f.select("frame").distinct(), "frame", statistics.block_count(120))
    blocked = statistics.block_moments(f.join(frames, "frame"), ["g"], "v").select("g", "block_n", F.round("block_sem", 5).alias("block_sem"))
    return statistics.moments(f, ["g"], "v").select("g", "sample_n", F.round("mean", 6).alias("mean"), F.round("sample_std", 5).alias("sample_std")).join(blocked, "g")


@query(f"""WITH {SA}, c AS (SELECT floor(x / 10000.0)::INT AS i, d, count(*) AS counts FROM samples GROUP BY ALL), t AS (SELECT i, sum(counts) AS n FROM c GROUP BY i), k AS (SELECT *, row_number() OVER (ORDER BY i) AS r, max(n) OVER () AS m FROM t), f AS (SELECT *, r - row_number() OVER (ORDER BY i) AS isl FROM k WHERE n >= 0.8 * m),
r AS (SELECT min(i) AS a, max(i) AS z, count(*) AS len FROM f GROUP BY isl ORDER BY len DESC, a DESC LIMIT 1), b AS (SELECT d, sum(counts) AS b FROM c, r WHERE i BETWEEN a AND z GROUP BY d)
SELECT i, c.d, round((counts / sum(counts) OVER (PARTITION BY i)) / (b / (SELECT sum(b) FROM b)), 6) AS value FROM c LEFT JOIN b USING (d)""")
def d15_enrichment_of_plateau(spark, sf_dir):
    """Values relative to the bulk rows, which are the longest plateau of the row sums."""
    c = A.samples(spark, sf_dir).groupBy(F.floor(F.col("x") / 10000.0).cast("int").alias("i"), "d").agg(F.count("*").alias("counts"))
    rows = c.groupBy("i").agg(F.sum("counts").alias("n")).withColumn("one", F.lit(1))
    bulk = S.bulk_rows(rows, ["one"], "i", "n")
    marked = c.join(F.broadcast(bulk.select("start", "stop")))  # one row
    return histogram.enrichment(marked, "i", "d", F.col("i").between(F.col("start"), F.col("stop"))).select("i", "d", F.round("value", 6).alias("value"))


@query(f"WITH {AT} SELECT floor(frame_index / 2)::INT AS i_frame_index, floor(z / 0.5)::INT AS i_z, count(*) AS n, round(avg(x), 6) AS x FROM atoms WHERE x BETWEEN 4 AND 6 GROUP BY ALL")
def d9_position_projection(spark, sf_dir):
    """Time by height, coloured by x, of the points whose x is in a range."""
    from ..operators import select

    p = select.value_filter(A.atoms(spark, sf_dir), "x", 4.0, 6.0)
    return histogram.histogram(p, [("frame_index", 0.0, 2.0, None), ("z", 0.0, 0.5, None)], {"n": F.count("*"), "s": F.sum("x")}).select("i_frame_index", "i_z", "n", F.round(F.col("s") / F.col("n"), 6).alias("x"))
