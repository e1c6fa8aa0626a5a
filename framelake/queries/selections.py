from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.text import element_of, expand_indices
from ..operators import histogram, pairs, select
from . import query

AT = A.ATOMS_SQL
COLUMNS = ["frame_index", "atom_index", "element"]


@query(f"WITH {AT} SELECT frame_index, atom_index, element FROM atoms WHERE element = 'O'")
def p3_element_filter(spark, sf_dir):
    return A.atoms(spark, sf_dir).where(select.species_filter("element:o")).select(*COLUMNS)


@query(f"WITH {AT} SELECT frame_index, atom_index, element FROM atoms WHERE raw_species = 'Pt1'")
def p1_raw_species_filter(spark, sf_dir):
    return A.atoms(spark, sf_dir).where(select.species_filter("species:Pt1")).select(*COLUMNS)


@query(f"WITH {AT} SELECT frame_index, atom_index, element FROM atoms WHERE atom_index BETWEEN 0 AND 25 OR atom_index = 40")
def p4_atom_list(spark, sf_dir):
    return A.atoms(spark, sf_dir).where(select.species_filter("atoms[0..25,40]")).select(*COLUMNS)


@query("""
WITH e AS (SELECT unnest(['H','He','Li','Be','B','C','N','O','F','Ne','Na','Mg','Al','Si','P','S','Cl','Ar','K','Ca','Sc','Ti','V','Cr','Mn','Fe','Co','Ni','Cu','Zn','Ga','Ge','As','Se','Br','Kr','Rb','Sr','Y','Zr','Nb','Mo','Tc','Ru','Rh','Pd','Ag','Cd','In','Sn','Sb','Te','I','Xe','Cs','Ba','La','Ce','Pr','Nd','Pm','Sm','Eu','Gd','Tb','Dy','Ho','Er','Tm','Yb','Lu','Hf','Ta','W','Re','Os','Ir','Pt','Au','Hg','Tl','Pb','Bi']) AS s),
l AS (SELECT n_nationkey, n_name, regexp_replace(n_name, '[^A-Za-z]', '', 'g') AS a FROM nation)
SELECT n_nationkey, n_name, CASE WHEN n_name = 'NATION_3' THEN 'Pt' ELSE coalesce((SELECT s FROM e WHERE s = n_name),
  (SELECT s FROM e WHERE s = upper(substr(a, 1, 1)) || lower(substr(a, 2, 1))), (SELECT s FROM e WHERE s = upper(substr(a, 1, 1)))) END AS element FROM l""")
def p5_raw_label_to_element(spark, sf_dir):
    return A.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", element_of(F.col("n_name"), {"NATION_3": "Pt"}).alias("element"))


@query(f"WITH {AT} SELECT DISTINCT 'element' AS kind, element AS species FROM atoms UNION SELECT DISTINCT 'raw', raw_species FROM atoms WHERE element IN (SELECT element FROM atoms GROUP BY element HAVING count(DISTINCT raw_species) > 1)")
def p6_available_species(spark, sf_dir):
    return select.available_species(A.atoms(spark, sf_dir))


FRAMES = "f AS (SELECT o_orderkey AS frame_index, (row_number() OVER (ORDER BY o_orderkey) - 1) * 5.0 AS time_fs, (row_number() OVER (ORDER BY o_orderkey) - 1) * 10 AS step FROM orders), n AS (SELECT count(*) AS c, max(time_fs) / 1000.0 AS t FROM f)"


def frames(spark, sf_dir):
    """orders as frames: the key orders them, 5 fs and 10 steps apart."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.orderBy("o_orderkey")) - 1
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_index"), (i * 5.0).alias("time_fs"), (i * 10).cast("long").alias("step"))


@query(f"WITH {FRAMES} SELECT frame_index, step FROM f ORDER BY frame_index LIMIT 7")
def p7_first_frames(spark, sf_dir):
    return select.select_frames(frames(spark, sf_dir), "first:7").select("frame_index", "step")


@query(f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (ORDER BY frame_index) - 1 AS i FROM f) SELECT frame_index, step FROM r, n WHERE i >= floor(c * 10 / 100.0) AND i < floor(c * 12 / 100.0)")
def p7_range_percent(spark, sf_dir):
    return select.select_frames(frames(spark, sf_dir), "range:10%:12%").select("frame_index", "step")


@query(f"WITH {FRAMES} SELECT frame_index, step FROM f, n WHERE time_fs / 1000.0 >= t - 0.25")
def p7_last_picoseconds(spark, sf_dir):
    return select.select_frames(frames(spark, sf_dir), "last:0.25ps").select("frame_index", "step")


@query(f"WITH {AT} SELECT frame_index, atom_index, element FROM atoms WHERE x >= 4.0 - 1e-9 AND x <= 6.0 + 1e-9 AND z <= 5.0 + 1e-9")
def p8_spatial_range(spark, sf_dir):
    ranges = [select.spatial_range("x", "4:6"), select.spatial_range("z", "min:5")]
    return select.spatial_filter(A.atoms(spark, sf_dir), ranges).select(*COLUMNS)


@query(f"WITH {AT}, c AS (SELECT frame_index, element, avg(z) AS z FROM atoms GROUP BY ALL HAVING round(avg(z), 9) >= 5.0) SELECT frame_index, atom_index, element FROM atoms JOIN c USING (frame_index, element)")
def p9_keep_groups_whole(spark, sf_dir):
    atoms = A.atoms(spark, sf_dir)
    centres = atoms.groupBy("frame_index", "element").agg(F.round(F.avg("z"), 9).alias("z"))
    return select.keep_groups(atoms, centres, [select.spatial_range("z", "5.000000001:max")], "element").select(*COLUMNS)


@query(f"WITH {AT} SELECT frame_index, atom_index, element FROM atoms WHERE element IN ('Pt', 'Au') AND NOT is_fixed")
def p10_substrate_candidates(spark, sf_dir):
    return select.substrate(A.atoms(spark, sf_dir), ["Pt", "Au"]).select(*COLUMNS)


@query(f"WITH {AT}, g AS (SELECT frame_index, floor(x)::INT AS i_x, floor(y)::INT AS i_y, count(*)::DOUBLE AS entities FROM atoms GROUP BY ALL) SELECT * FROM g WHERE i_x + 0.5 BETWEEN 3 AND 5.5")
def p14_grid_slice(spark, sf_dir):
    grid = A.atoms(spark, sf_dir).withColumn("m", F.lit(1.0))
    out = histogram.sparse_grid(grid, [("x", 0.0, 1.0), ("y", 0.0, 1.0)], "m", by=["frame_index"])
    return out.where((F.col("i_x") + 0.5).between(3, 5.5)).select("frame_index", "i_x", "i_y", "entities")


@query(f"WITH {A.SAMPLES_SQL} SELECT least(greatest(floor(x / 5000)::INT, 0), 19) AS bin, count(*) AS point_count FROM samples GROUP BY ALL HAVING count(*) >= 30")
def p16_populated_bins(spark, sf_dir):
    bins = A.samples(spark, sf_dir).groupBy(histogram.bin_index(F.col("x"), 0.0, 5000.0, 20).alias("bin")).agg(F.count("*").alias("point_count"))
    return select.populated(bins, 30)


@query(f"WITH {A.SERIES_SQL}, p AS (SELECT DISTINCT kind AS label, id AS frame_index FROM series WHERE cents > 10000), i AS (SELECT label, frame_index - row_number() OVER (PARTITION BY label ORDER BY frame_index) AS g FROM p), r AS (SELECT label, g, count(*) AS n FROM i GROUP BY ALL) SELECT label, max(n) AS longest_run FROM r GROUP BY label HAVING max(n) >= 5")
def p17_active_labels(spark, sf_dir):
    p = A.series(spark, sf_dir).where("cents > 10000").select(F.col("kind").alias("label"), F.col("id").alias("frame_index"))
    return select.active_labels(p).select("label", "longest_run")


@query(f"WITH {AT} SELECT element, atom_index FROM atoms WHERE element NOT IN ('H', 'K')")
def p18_visible_series(spark, sf_dir):
    flags = spark.createDataFrame([("H", False), ("K", False), ("O", True)], "series_id string, enabled boolean")
    return select.visible(A.atoms(spark, sf_dir).withColumn("series_id", F.col("element")), flags).select("element", "atom_index")


@query(f"WITH {A.SAMPLES_SQL} SELECT g, count(*) AS n FROM samples WHERE x BETWEEN 1000 - 1e-6 AND 20000 + 1e-6 GROUP BY g")
def p19_between_edges(spark, sf_dir):
    return A.samples(spark, sf_dir).where(select.finite_between(F.col("x"), 1000, 20000, 1000)).groupBy("g").agg(F.count("*").alias("n"))


@query(f"WITH {AT}, m AS (SELECT *, max(z) OVER (PARTITION BY frame_index) AS top FROM atoms) SELECT frame_index, atom_index, element FROM m WHERE z >= top - 1.5")
def p23_face_depth(spark, sf_dir):
    return select.face(A.atoms(spark, sf_dir), "z", 1.5, "frame_index").select(*COLUMNS)


@query(f"WITH {AT}, s AS (SELECT DISTINCT element FROM atoms) SELECT a.element AS a, b.element AS b FROM s a, s b WHERE a.element <= b.element")
def j15_unordered_pairs(spark, sf_dir):
    return pairs.unordered_pairs(A.atoms(spark, sf_dir).select(F.col("element").alias("species")))


@query("SELECT r_regionkey, unnest(CASE r_regionkey WHEN 0 THEN [4,7,8,9] ELSE [1,2,12] END)::INT AS atom_index FROM region")
def f37_expand_index_lists(spark, sf_dir):
    text = F.when(F.col("r_regionkey") == 0, "4 7..9").otherwise("1..2, 12")
    return A.table(spark, sf_dir, "region").select("r_regionkey", F.explode(expand_indices(text)).alias("atom_index"))
