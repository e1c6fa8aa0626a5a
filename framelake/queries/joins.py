from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import pairs, tables
from . import query

AT, SE = A.ATOMS_SQL, A.SERIES_SQL
L = (A.CELL,) * 3


def mic(c, n=10.0):
    return f"(a.{c} - b.{c} - {n} * round_even((a.{c} - b.{c}) / {n}, 0))"


R = "sqrt(" + " + ".join(f"{mic(c)} * {mic(c)}" for c in "xyz") + ")"
PAIRS = f"{AT}, p AS (SELECT a.frame_index, a.atom_index AS i, b.atom_index AS j, a.element AS ea, b.element AS eb, {R} AS r FROM atoms a JOIN atoms b ON a.frame_index = b.frame_index AND a.atom_index <> b.atom_index)"


@query(f"WITH {PAIRS} SELECT frame_index, count(*) AS n, sum(floor(r * 1e6)::BIGINT)::BIGINT AS checksum FROM p WHERE ea = 'O' AND eb = 'H' AND r <= 4.0 GROUP BY 1")
def j1_dense_pairs(spark, sf_dir):
    at = A.atoms(spark, sf_dir)
    p = pairs.dense_pairs(at.where("element = 'O'"), at.where("element = 'H'"), L, 4.0)
    return p.groupBy("frame_index").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("r") * 1e6)).alias("checksum"))


@query(f"WITH {PAIRS} SELECT frame_index, count(*) AS n, sum(floor(r * 1e6)::BIGINT)::BIGINT AS checksum FROM p WHERE r <= 2.0 GROUP BY 1")
def j2_cell_list_pairs(spark, sf_dir):
    at = A.atoms(spark, sf_dir)
    return pairs.cell_pairs(at, at, L, 2.0).groupBy("frame_index").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("r") * 1e6)).alias("checksum"))


@query(f"WITH {PAIRS} SELECT frame_index, i AS atom_index_a, j AS atom_index_b, round(r, 6) AS r FROM p WHERE ea = 'Pt' AND eb = 'Au' AND r <= 3.0")
def j3_image_pairs(spark, sf_dir):
    at = A.atoms(spark, sf_dir)
    p = pairs.image_pairs(at.where("element = 'Pt'"), at.where("element = 'Au'"), [10.0, 0, 0, 0, 10.0, 0, 0, 0, 10.0], 3.0)
    return p.select("frame_index", "atom_index_a", "atom_index_b", F.round("r", 6).alias("r"))


@query(f"WITH {PAIRS} SELECT frame_index, count(*) AS n FROM p WHERE r <= 3.0 AND ea < eb GROUP BY 1")
def j5_chosen_backend(spark, sf_dir):
    at = A.atoms(spark, sf_dir)
    p = pairs.pairs_within(at, at, L, 3.0, 50, 50, keep=("element",))
    return p.where("element_a < element_b").groupBy("frame_index").agg(F.count("*").alias("n"))


BONDS = f"{PAIRS}, bond AS (SELECT frame_index, i AS o, j AS h, r FROM p WHERE ea = 'O' AND eb = 'H' AND r <= 1.27)"


@query(f"WITH {BONDS} SELECT frame_index, o, h, round(r, 6) AS r FROM bond")
def j6_bonds(spark, sf_dir):
    return pairs.bonds(A.atoms(spark, sf_dir), L).withColumn("r", F.round("r", 6))


MOLECULES = f"""{BONDS}, hd AS (SELECT frame_index, h, count(*) AS deg FROM bond GROUP BY ALL), od AS (SELECT frame_index, o, count(*) AS n, max(deg) AS most FROM bond JOIN hd USING (frame_index, h) GROUP BY ALL),
mol AS (SELECT a.frame_index, 'mol:' || ['O', 'OH', 'H2O', 'H3O'][coalesce(n, 0) + 1] AS label, atom_index AS anchor FROM atoms a LEFT JOIN od ON a.frame_index = od.frame_index AND atom_index = o WHERE element = 'O' AND coalesce(most, 0) <= 1 AND coalesce(n, 0) <= 3
  UNION ALL SELECT a.frame_index, 'mol:H', atom_index FROM atoms a LEFT JOIN hd ON a.frame_index = hd.frame_index AND atom_index = h WHERE element = 'H' AND deg IS NULL)"""


@query(f"WITH {MOLECULES} SELECT frame_index, label, anchor FROM mol")
def a13_molecules(spark, sf_dir):
    at = A.atoms(spark, sf_dir)
    return pairs.molecules(at, pairs.bonds(at, L)).select("frame_index", "label", "anchor")


@query(f"""WITH {MOLECULES}, m AS (SELECT frame_index, anchor, label, anchor AS atom_index FROM mol UNION SELECT mol.frame_index, anchor, label, h FROM mol JOIN bond ON mol.frame_index = bond.frame_index AND anchor = o),
d AS (SELECT m.frame_index, label, anchor, CASE a.element WHEN 'O' THEN 15.999 ELSE 1.008 END::DOUBLE AS mass, b.x AS x0, a.x - b.x - 10.0 * round_even((a.x - b.x) / 10.0, 0) AS dx FROM m JOIN atoms a USING (frame_index, atom_index) JOIN atoms b ON b.frame_index = m.frame_index AND b.atom_index = anchor)
SELECT frame_index, label, anchor, round(sum(mass), 6) AS mass, round(max(x0) + sum(mass * dx) / sum(mass), 6) AS x FROM d GROUP BY ALL""")
def a14_centres_of_mass(spark, sf_dir):
    at = A.atoms(spark, sf_dir).withColumn("mass_amu", F.element_at(pairs.masses(), F.col("element")))
    com = pairs.centres_of_mass(pairs.molecules(at, pairs.bonds(at, L)), at, L)
    return com.select("frame_index", "label", "anchor", F.round("mass", 6).alias("mass"), F.round("x", 6).alias("x"))


@query(f"WITH {PAIRS} SELECT frame_index, i AS atom_index_a, j AS atom_index_b FROM p WHERE ea = 'O' AND eb = 'K' AND r <= 3 AND i // 2 <> j // 2 AND (i // 2) * 2 + 1 <> j AND (i // 2) * 2 <> j")
def j7_no_shared_members(spark, sf_dir):
    at = A.atoms(spark, sf_dir)
    p = pairs.dense_pairs(at.where("element = 'O'"), at.where("element = 'K'"), L, 3.0)
    half = lambda c: F.floor(F.col(c) / 2) * 2
    own = p.withColumn("members_a", F.array(half("atom_index_a"), half("atom_index_a") + 1)).withColumn("members_b", F.array(half("atom_index_b"), half("atom_index_b") + 1))
    return pairs.without_shared(own).select("frame_index", "atom_index_a", "atom_index_b")


NEAREST = f"WITH {PAIRS} SELECT frame_index, i AS atom_index, arg_min(j, (r, j)) AS nearest, round(min(r), 6) AS distance FROM p WHERE ea = 'H' AND eb IN ('Pt', 'Au') GROUP BY ALL"


@query(NEAREST)
def j8_nearest(spark, sf_dir):
    at = A.atoms(spark, sf_dir)
    return pairs.nearest(at.where("element = 'H'"), at.where("element IN ('Pt', 'Au')"), L).withColumn("distance", F.round("distance", 6))


@query(NEAREST)
def j8_nearest_in_shells(spark, sf_dir):
    at = A.atoms(spark, sf_dir)
    return pairs.nearest_in_shells(at.where("element = 'H'"), at.where("element IN ('Pt', 'Au')"), L, 1.0).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {PAIRS}, w AS (SELECT frame_index, i, sum(CASE WHEN r <= 2.75 THEN 1 WHEN r < 3.25 THEN 0.5 * (1 + cos(pi() * (r - 2.75) / 0.5)) ELSE 0 END) AS s FROM p WHERE ea = 'Na' AND eb = 'Cl' AND r <= 3.25 GROUP BY ALL)
SELECT a.frame_index, atom_index, round(coalesce(s, 0), 6) AS coordination FROM atoms a LEFT JOIN w ON a.frame_index = w.frame_index AND atom_index = i WHERE element = 'Na'""")
def j9_coordination(spark, sf_dir):
    at = A.atoms(spark, sf_dir)
    return pairs.coordination(at.where("element = 'Na'"), at.where("element = 'Cl'"), L, 3.0, 0.5).withColumn("coordination", F.round("coordination", 6))


@query(f"WITH {AT} SELECT atom_index, frame_index, round(z - (frame_index * 0.1), 9) AS above FROM atoms")
def j10_frame_metadata(spark, sf_dir):
    planes = spark.range(A.FRAMES).select(F.col("id").alias("frame_index"), (F.col("id") * 0.1).alias("plane"))
    return A.atoms(spark, sf_dir).join(F.broadcast(planes), "frame_index").select("atom_index", "frame_index", F.round(F.col("z") - F.col("plane"), 9).alias("above"))


@query(f"WITH {SE}, l AS (SELECT event_id, id, t_us FROM series WHERE kind = 'purchase'), r AS (SELECT id, t_us, max(cents) AS cents FROM series WHERE kind = 'click' GROUP BY ALL) SELECT l.event_id, r.cents FROM l ASOF LEFT JOIN r ON l.id = r.id AND l.t_us >= r.t_us")
def j11_as_of(spark, sf_dir):
    s = A.series(spark, sf_dir)
    right = s.where("kind = 'click'").groupBy("id", "t_us").agg(F.max("cents").alias("cents"))
    return pairs.as_of(s.where("kind = 'purchase'").select("event_id", "id", "t_us"), right, "id", "t_us", "t_us", "cents").select("event_id", "cents")


@query("SELECT r_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def j12_region_membership(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def j13_left_map(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return A.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j16_skip_existing(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return A.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT n_nationkey, k % 4 AS target, round((least(n_nationkey + 1.3, (k + 1) * 2.5) - greatest(n_nationkey + 0.3, k * 2.5)), 9)::DOUBLE AS weight FROM nation, range(0, 12) t(k) WHERE least(n_nationkey + 1.3, (k + 1) * 2.5) > greatest(n_nationkey + 0.3, k * 2.5)")
def j17_interval_overlap(spark, sf_dir):
    bins = A.table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 0.3).alias("lo"), (F.col("n_nationkey") + 1.3).alias("hi"))
    return pairs.interval_overlaps(bins, 2.5, 10.0).select("n_nationkey", "target", F.round("weight", 9).alias("weight"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linestatus = 'O')")
def u5_overlap(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    return pairs.overlap(li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'"), "k")


@query("SELECT o_custkey AS source, 100 + row_number() OVER (ORDER BY o_custkey) AS record_id FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey > 50)")
def k6_append_records(spark, sf_dir):
    stored = spark.range(51).select(F.col("id").alias("source"), (F.col("id") + 50).alias("record_id"))
    new = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source")).distinct()
    return tables.append_new(stored, new, "source").select("source", "record_id")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_name END AS n_name, n_nationkey AS uid FROM nation")
def k5_upsert(spark, sf_dir):
    stored = A.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("uid"))
    new = A.table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey", F.lit("new").alias("n_name"), F.lit(-1).alias("uid"))
    return tables.upsert(stored, new, ["n_nationkey"], "uid")


@query(f"WITH {PAIRS} SELECT i AS atom_index_a, j AS atom_index_b, round(r, 6) AS r FROM p WHERE i < 60 AND j BETWEEN 20 AND 90 AND r <= 5.0")
def j4_selected_matrix(spark, sf_dir):
    from ..operators import select

    at = A.atoms(spark, sf_dir)
    p = pairs.dense_pairs(at.where(select.species_filter("atoms[0..59]")), at.where(select.species_filter("atoms[20..90]")), L, 5.0)
    return p.select("atom_index_a", "atom_index_b", F.round("r", 6).alias("r"))


@query(f"WITH {PAIRS}, w AS (SELECT frame_index, i, count(*) AS n FROM p WHERE ea = 'K' AND eb = 'Cl' AND r <= 3.0 GROUP BY ALL) SELECT a.frame_index, round(avg(coalesce(n, 0)), 9) AS mean, count(*) AS n FROM atoms a LEFT JOIN w ON a.frame_index = w.frame_index AND atom_index = i WHERE element = 'K' GROUP BY 1")
def a12_coordination_sum(spark, sf_dir):
    from ..plans import pairs as plans

    at = A.atoms(spark, sf_dir)
    out = plans.mean_coordination(plans.coordination(at.where("element = 'K'"), at.where("element = 'Cl'"), L, 3.0, 0.0))
    return out.select("frame_index", F.round("mean", 9).alias("mean"), "n")


@query("SELECT DISTINCT least(o_custkey % 9, o_orderkey % 9) AS a, greatest(o_custkey % 9, o_orderkey % 9) AS b FROM orders")
def u7_distinct_pairs(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).alias("a"), (F.col("o_orderkey") % 9).alias("b"))
    return pairs.distinct_pairs(o, "a", "b")


@query(f"WITH {AT} SELECT DISTINCT frame_index, frame_index % 2 = 0 AND frame_index < 8 AS valid FROM atoms")
def t8_topology_cache(spark, sf_dir):
    """Stored memberships of the first frames; those of odd frames have since lost an atom."""
    at = A.atoms(spark, sf_dir)
    stored = pairs.fingerprints(at.where("frame_index < 8"))
    least = at.groupBy("frame_index").agg(F.min("atom_index").alias("m"))
    now = at.join(least, "frame_index").where("frame_index % 2 = 0 or atom_index <> m")
    return pairs.reusable(stored, now)
