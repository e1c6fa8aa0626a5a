"""Scans and sinks: each query writes files of the driver's tables in a format, reads them back, and returns what came back."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import tables
from ..plans import potential
from ..schema import BOHR_A, HARTREE_EV
from ..shared import place
from ..sources import fields, logs, store, trajectory
from ..sources.each import parsed
from . import query

AT = A.ATOMS_SQL
T = A.table
NL = "\n"
#: Atoms with their number within the frame, as files have them.
NUMBERED = f"{AT}, n AS (SELECT *, (row_number() OVER (PARTITION BY frame_index ORDER BY atom_index) - 1)::INT AS place FROM atoms)"
BACK = f"WITH {NUMBERED} SELECT frame_index AS step, place AS atom_index, raw_species, element, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM n"


def s(c):
    return F.col(c).cast("string")


def lines(*parts):
    return F.concat_ws(NL, *parts)


def written(df, name, value):
    """A folder of text files with a value's lines for each row, rows in order of the first column within files."""
    path = place(df.sparkSession, name)
    df.repartition(3, df.columns[0]).sortWithinPartitions(df.columns[0]).select(value.alias("value")).write.text(path)
    return path


def by_frame(spark, sf_dir, line):
    """Each frame's atoms as text, in order."""
    a = A.atoms(spark, sf_dir).groupBy("frame_index").agg(F.array_sort(F.collect_list(F.struct("atom_index", line.alias("line")))).alias("a"))
    return a.select("frame_index", F.size("a").cast("string").alias("n"), F.concat_ws(NL, F.transform("a", lambda x: x["line"])).alias("body"))


def xyz_file(spark, sf_dir, extra=""):
    line = F.concat_ws(" ", "raw_species", s("x"), s("y"), s("z"))
    head = F.concat(F.lit(f"{extra}i = "), s("frame_index"), F.lit(", time = "), s("frame_index"), F.lit(".5, E = -1.0"))
    return written(by_frame(spark, sf_dir, line), "xyz", lines("n", head, "body"))


def atoms_back(frames, atoms, digits=6):
    at = atoms.join(frames.select("source", "frame_index", "step"), ["source", "frame_index"])
    return at.select("step", "atom_index", "raw_species", "element", *(F.round(c, digits).alias(c) for c in "xyz"))


@query(BACK)
def s1_xyz_scan(spark, sf_dir):
    return atoms_back(*trajectory.read_xyz(spark, xyz_file(spark, sf_dir)))


@query(f"WITH {AT} SELECT DISTINCT frame_index AS step, frame_index + 0.5::DOUBLE AS time_fs, 10.0::DOUBLE AS a, 12.0::DOUBLE AS c, 1.5::DOUBLE AS origin_z, true AS periodic FROM atoms")
def s1_xyz_headers(spark, sf_dir):
    frames, _ = trajectory.read_xyz(spark, xyz_file(spark, sf_dir, 'Lattice="10 0 0 0 11 0 0 0 12" cell_origin="0 0 1.5" '))
    return frames.select("step", "time_fs", F.col("cell")[0].alias("a"), F.col("cell")[8].alias("c"), F.col("origin")[2].alias("origin_z"), F.forall("pbc", lambda x: x).alias("periodic"))


def dump_file(spark, sf_dir):
    # Atoms in reverse order, numbered from 1; positions scaled by a box from 1 to 11.
    a = A.atoms(spark, sf_dir)
    first = a.groupBy("frame_index").agg(F.array_sort(F.collect_list("atom_index")).alias("all"))
    a = a.join(first, "frame_index").withColumn("id", F.array_position("all", F.col("atom_index")))
    line = F.concat_ws(" ", s("id"), "raw_species", *(((F.col(c) - 1) / 10).cast("string") for c in "xyz"))
    body = a.groupBy("frame_index").agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line"))), asc=False).alias("a"))
    item = lambda x: F.lit(f"ITEM: {x}")
    text = lines(item("TIMESTEP"), s("frame_index"), item("NUMBER OF ATOMS"), F.size("a").cast("string"), item("BOX BOUNDS pp pp pp"), F.lit("1 11"), F.lit("1 11"), F.lit("1 11"), item("ATOMS id element xs ys zs"), F.concat_ws(NL, F.transform("a", lambda x: x["line"])))
    return written(body, "dump", text)


@query(BACK)
def s2_lammps_dump_scan(spark, sf_dir):
    return atoms_back(*trajectory.read_lammps_dump(spark, dump_file(spark, sf_dir)))


@query("SELECT n_nationkey AS source, CASE n_regionkey % 2 WHEN 0 THEN 'metal' ELSE 'real' END AS units, (CASE n_regionkey % 2 WHEN 0 THEN 1000 ELSE 1 END * 0.25 * (n_nationkey + 1))::DOUBLE AS frame_timestep_fs, 'run' || n_nationkey || '.dump' AS dump FROM nation")
def s3_script_scan(spark, sf_dir):
    units = F.when(F.col("n_regionkey") % 2 == 0, "metal").otherwise("real")
    text = lines(F.concat(F.lit("units "), units, F.lit(" # style")), F.lit("timestep 0.25"), F.lit("read_data start.data"), F.concat(F.lit("dump d all custom &\n "), (F.col("n_nationkey") + 1).cast("string"), F.lit(" run"), s("n_nationkey"), F.lit(".dump id type x")))

    def parse(text):
        d = trajectory.lammps_input(text)
        return [(d["units"], d["frame_timestep_fs"], d["dump"])]

    return parsed(T(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), text.alias("text")), parse, "units string, frame_timestep_fs double, dump string")


@query(f"WITH {AT} SELECT frame_index, atom_index, element, round(x, 6) AS x FROM atoms WHERE element <> 'Na'")
def s4_generic_table_scan(spark, sf_dir):
    path = place(spark, "generic")
    trajectory.write_frames(A.atoms(spark, sf_dir).select(F.lit("a").alias("source"), "frame_index").distinct(), A.atoms(spark, sf_dir).withColumn("source", F.lit("a")), path)
    store.convert(spark, f"{path}/atoms", f"{path}/csv", "parquet", "csv")
    back = store.read_table(spark, f"{path}/csv", "comma").where("element is not null")  # Na is a mark of a missing value in text tables
    return back.select(F.col("frame_index").cast("long").alias("frame_index"), F.col("atom_index").cast("long").alias("atom_index"), "element", F.round("x", 6).alias("x"))


def stored_trajectory(spark, sf_dir):
    path = place(spark, "trajectory")
    a = A.atoms(spark, sf_dir).withColumn("source", F.lit("a"))
    trajectory.write_frames(a.select("source", "frame_index", (F.col("frame_index") * 10).alias("step")).distinct(), a, path)
    return path


@query(f"WITH {AT} SELECT frame_index, atom_index, element FROM atoms WHERE frame_index >= 3 AND frame_index < 7")
def s5_frame_range_scan(spark, sf_dir):
    return trajectory.read_frames(spark, stored_trajectory(spark, sf_dir), 3, 7)[1].select("frame_index", "atom_index", "element")


def packed(spark, sf_dir):
    path = place(spark, "pack")
    a = A.atoms(spark, sf_dir)
    manifest = store.pack({"frames": a.select("frame_index").distinct(), "atoms": a, "charges": T(spark, sf_dir, "nation")}, path)
    return path, manifest


@query(f"WITH {AT} SELECT frame_index, count(*) AS n FROM atoms WHERE frame_index < 5 GROUP BY 1")
def s6_packed_scan(spark, sf_dir):
    return trajectory.read_frames(spark, packed(spark, sf_dir)[0], stop=5)[1].groupBy("frame_index").agg(F.count("*").alias("n"))


@query(f"WITH {AT} SELECT 'xyz' AS format, count(*) AS atoms, count(DISTINCT frame_index) AS frames FROM atoms UNION ALL SELECT 'stored', count(*), count(DISTINCT frame_index) FROM atoms")
def s7_dispatched_scan(spark, sf_dir):
    text = xyz_file(spark, sf_dir)
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(text), spark._jsc.hadoopConfiguration()).rename(spark._jvm.org.apache.hadoop.fs.Path(text), spark._jvm.org.apache.hadoop.fs.Path(f"{text}.xyz"))
    out = None
    for name, path in (("xyz", f"{text}.xyz"), ("stored", stored_trajectory(spark, sf_dir))):
        frames, atoms = trajectory.read_trajectory(spark, path)
        one = atoms.agg(F.count("*").alias("atoms")).join(frames.agg(F.count("*").alias("frames"))).select(F.lit(name).alias("format"), "atoms", "frames")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {AT} SELECT element, count(*) AS n, round(sum(z), 6) AS z FROM atoms GROUP BY 1")
def s8_eager_scan(spark, sf_dir):
    atoms = trajectory.read_trajectory(spark, stored_trajectory(spark, sf_dir))[1]
    return atoms.groupBy("element").agg(F.count("*").alias("n"), F.round(F.sum("z"), 6).alias("z"))


def cube_file(spark, sf_dir):
    """A field of 3 by 4 by 25 cells for each region: the value of a cell is made of its place and the region's key."""
    z = F.sequence(F.lit(0), F.lit(24))
    columns = spark.range(12).select((F.col("id") / 4).cast("int").alias("ix"), (F.col("id") % 4).cast("int").alias("iy"))
    value = lambda k: (F.col("r_regionkey") * 1000 + F.col("ix") * 100 + F.col("iy") * 25 + k) / 8.0
    row = lambda k: F.concat(value(k).cast("string"), F.when(k % 6 == 5, NL).otherwise(" "))
    body = T(spark, sf_dir, "region").join(F.broadcast(columns)).withColumn("text", F.array_join(F.transform(z, row), ""))  # twelve rows
    body = body.groupBy("r_regionkey").agg(F.concat_ws(NL, F.transform(F.array_sort(F.collect_list(F.struct("ix", "iy", "text"))), lambda x: x["text"])).alias("text"))
    head = lines(F.lit("field"), s("r_regionkey"), F.lit(" 1 0.5 0.0 0.0"), F.lit(" 3 1.0 0 0"), F.lit(" 4 0 1.0 0"), F.lit(" 25 0 0 0.4"), F.lit(" 8 8.0 0.1 0.2 0.3"))
    path = place(spark, "cube")
    body.select(lines(head, "text").alias("value"), s("r_regionkey").alias("region")).repartition("region").write.partitionBy("region").text(path)
    return path


def region_of(c="source"):
    return F.regexp_extract(c, r"region=(\d+)", 1).cast("int")


CELLS = "c AS (SELECT r_regionkey::INT AS region, x::INT AS ix, y::INT AS iy, z::INT AS iz, (r_regionkey * 1000 + x * 100 + y * 25 + z) / 8.0::DOUBLE AS value FROM region, range(3) a(x), range(4) b(y), range(25) d(z))"


@query(f"WITH {CELLS} SELECT region, ix, iy, iz, value::DOUBLE AS value FROM c")
def s9_cube_scan(spark, sf_dir):
    _, _, cells = fields.read_cube(spark, cube_file(spark, sf_dir))
    return cells.select(region_of().alias("region"), "ix", "iy", "iz", "value")


@query("SELECT r_regionkey::INT AS region, 1 AS n_atoms, 3 AS nx, 4 AS ny, 25 AS nz, 0.4::DOUBLE AS dz, 8 AS atomic_number, 0.3::DOUBLE AS z FROM region")
def s9_cube_headers(spark, sf_dir):
    header, atoms, _ = fields.read_cube(spark, cube_file(spark, sf_dir))
    return header.join(atoms.select("source", "atomic_number", "z"), "source").select(region_of().alias("region"), "n_atoms", "nx", "ny", "nz", "dz", "atomic_number", "z")


@query(f"WITH {CELLS} SELECT region, iz, round(avg(value), 9)::DOUBLE AS value FROM c GROUP BY ALL")
def s10_cube_store(spark, sf_dir):
    path = place(spark, "fields")
    header, atoms, cells = fields.read_cube(spark, cube_file(spark, sf_dir))
    store.pack({"header": header, "atoms": atoms, "cells": cells}, path)
    out = potential.planar_average(store.component(spark, path, "cells"))
    return out.select(region_of().alias("region"), "iz", F.round("value", 9).alias("value"))


@query("SELECT n_nationkey AS step, round((n_nationkey * 0.5)::DOUBLE, 6) AS time_fs, round((300 + n_regionkey)::DOUBLE, 6) AS t FROM nation WHERE n_nationkey % 5 <> 0")
def s11_numeric_table_scan(spark, sf_dir):
    row = F.concat_ws("  ", s("n_nationkey"), (F.col("n_nationkey") * 0.5).cast("string"), F.concat(((300 + F.col("n_regionkey")) / 100).cast("string"), F.lit("D+02")))
    text = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("# step time T\n"), s("n_nationkey"), F.lit(" oops 1.0"))).otherwise(row)
    t = logs.read_numeric(spark, written(T(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "temp", text), 3)
    return t.select(F.col("v")[0].cast("long").alias("step"), F.round(F.col("v")[1], 6).alias("time_fs"), F.round(F.col("v")[2], 6).alias("t"))


@query(f"WITH {NUMBERED} SELECT frame_index AS step, frame_index + 0.5::DOUBLE AS time_fs, place AS atom_index, element, round(x, 6) AS vx FROM n")
def s12_velocity_scan(spark, sf_dir):
    frames, v = trajectory.read_velocity_xyz(spark, xyz_file(spark, sf_dir))
    return v.join(frames.select("source", "frame_index", "step", "time_fs"), ["source", "frame_index"]).select("step", "time_fs", "atom_index", "element", F.round("vx", 6).alias("vx"))


def log_file(spark, sf_dir):
    """A log with a block for each nation, whose step is printed behind it."""
    k = s("n_nationkey")
    head = lines(F.lit(" MODULE QUICKSTEP: ATOMIC COORDINATES IN ANGSTROM"), F.concat(F.lit("   1   1  O   8   0.1  0.2  "), k, F.lit(".5  6.0 15.999")), F.concat(F.lit("   2   2  H   1   0.4  0.5  "), k, F.lit(".25  1.0 1.008")))
    scf = lines(F.lit(" SCF WAVEFUNCTION OPTIMIZATION"), F.concat(F.lit("   1 OT DIIS 0.15E+00 1.2 0.5 -10."), k, F.lit(" -1.0E+01")), F.concat(F.lit("   2 OT DIIS 0.15E+00 1.1 0.1 -11."), k, F.lit(" -1.0E-01")), F.concat(F.lit(" ENERGY| Total FORCE_EVAL ( QS ) energy [a.u.]:   -11."), k))
    charges = lines(F.lit(" Mulliken Population Analysis"), F.concat(F.lit("   1 O 1 6.5 -0."), k), F.concat(F.lit("   2 H 2 0.5 0."), k), F.lit(" *** end"), F.lit(" Hirshfeld Charges"), F.concat(F.lit("   1 O 1 6.0 6.25 -0.5")), F.concat(F.lit("   2 H 2 1.0 0.75 0."), k))
    forces = lines(F.lit(" *** end"), F.lit(" ATOMIC FORCES in [a.u.]"), F.concat(F.lit("   1   1   O   0.01   -0.02   0."), k), F.concat(F.lit("   2   2   H   -0.01   0.02   0."), k))
    end = lines(F.concat(F.lit(" Fermi energy: 0."), k, F.lit(" a.u.")), F.concat(F.lit(" MD| Step number "), (F.col("n_nationkey") + 100).cast("string")))
    return written(T(spark, sf_dir, "nation").select("n_nationkey"), "log", lines(head, scf, charges, forces, end))


#: A number whose digits are those of the key behind a point.
DIGITS = "('0.' || n_nationkey)::DOUBLE"


@query("SELECT n_nationkey + 100 AS md_step, i::DOUBLE AS iteration, CASE i WHEN 1 THEN 'OT DIIS' ELSE 'OT DIIS' END AS method, -(('1' || (i - 1) || '.' || n_nationkey)::DOUBLE) AS energy FROM nation, range(1, 3) r(i)")
def s13_log_scan(spark, sf_dir):
    return logs.log_table(logs.read_log(spark, log_file(spark, sf_dir)), "scf").select("md_step", "iteration", "method", "energy")


@query("SELECT n_nationkey + 100 AS md_step, q AS quantity, CASE q WHEN 'energy' THEN -(('11.' || n_nationkey)::DOUBLE) ELSE n_nationkey + 100 END AS value FROM nation CROSS JOIN (VALUES ('energy'), ('md_step')) t(q)")
def s13_log_scalars(spark, sf_dir):
    return logs.log_scalars(logs.read_log(spark, log_file(spark, sf_dir))).select("md_step", "quantity", "value")


@query(f"""SELECT n_nationkey + 100 AS md_step, t AS "table", CASE a WHEN 1 THEN 'O' ELSE 'H' END AS element, CASE t WHEN 'mulliken' THEN CASE a WHEN 1 THEN -{DIGITS} ELSE {DIGITS} END WHEN 'hirshfeld' THEN CASE a WHEN 1 THEN -0.5 ELSE {DIGITS} END ELSE {DIGITS} END AS value
FROM nation, range(1, 3) r(a), (VALUES ('mulliken'), ('hirshfeld'), ('forces')) v(t)""")
def s14_row_parsers(spark, sf_dir):
    log = logs.read_log(spark, log_file(spark, sf_dir))
    out = None
    for name, value in (("mulliken", "charge"), ("hirshfeld", "charge"), ("forces", "fz")):
        one = logs.log_table(log, name).select("md_step", F.lit(name).alias("table"), "element", F.col(value).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_nationkey + 100 AS md_step, a::DOUBLE AS atom, (n_nationkey || CASE a WHEN 1 THEN '.5' ELSE '.25' END)::DOUBLE AS z FROM nation, range(1, 3) r(a)")
def s14_coordinates(spark, sf_dir):
    return logs.log_table(logs.read_log(spark, log_file(spark, sf_dir)), "coordinates").select("md_step", "atom", "z")


def inputs(spark, sf_dir):
    """An input for each nation, whose cell, step, stride, fixed atoms and regions follow from its key."""
    k = F.col("n_nationkey")
    num = lambda c: c.cast("string")
    regions = lines(F.lit("  &THERMAL_REGION"), F.lit("   &DEFINE_REGION"), F.concat(F.lit("    TEMPERATURE [K] "), num(k + 300)), F.concat(F.lit("    LIST 1.."), num(k + 1)), F.lit("   &END"), F.lit("   &DEFINE_REGION"), F.lit("    TEMPERATURE 290"), F.concat(F.lit("    LIST "), num(k + 5)), F.lit("   &END"), F.lit("  &END"))
    motion = lines(F.lit("&MOTION"), F.lit(" &MD"), F.concat(F.lit("  TIMESTEP [fs] "), num((k + 1) * 0.5)), regions, F.lit(" &END"), F.lit(" &CONSTRAINT"), F.lit("  &FIXED_ATOMS"), F.concat(F.lit("   LIST 2 "), num(k + 10), F.lit(".."), num(k + 12)), F.lit("  &END"), F.lit(" &END"), F.lit(" &PRINT"), F.lit("  &TRAJECTORY"), F.lit("   &EACH"), F.concat(F.lit("    MD "), num(k + 1)), F.lit("   &END"), F.lit("  &END"), F.lit(" &END"), F.lit("&END"))
    cell = lines(F.lit("&FORCE_EVAL"), F.lit(" &SUBSYS"), F.lit("  &CELL"), F.when(k % 2 == 0, F.concat(F.lit("   ABC [angstrom] 10 11 "), num(k + 5))).otherwise(lines(F.lit("   A [nm] 1 0 0"), F.lit("   B 0 11 0"), F.concat(F.lit("   C 0 0.5 "), num(k + 5)))), F.lit("  &END"), F.lit(" &END"), F.lit("&END"))
    return T(spark, sf_dir, "nation").select(k.alias("source"), lines(motion, cell).alias("text"))


@query("SELECT n_nationkey AS source, 10.0::DOUBLE AS a, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 0.5 END::DOUBLE AS cy, (n_nationkey + 5)::DOUBLE AS cz, (n_nationkey + 1) * 0.5::DOUBLE AS timestep_fs, n_nationkey + 1 AS stride, '1,' || (n_nationkey + 9) || ',' || (n_nationkey + 10) || ',' || (n_nationkey + 11) AS fixed FROM nation")
def s15_input_metadata(spark, sf_dir):
    def parse(text):
        m = logs.input_metadata(text)
        return [(m["cell"][0], m["cell"][7], m["cell"][8], m["timestep_fs"], m["stride"], ",".join(map(str, m["fixed"])))]

    return parsed(inputs(spark, sf_dir), parse, "a double, cy double, cz double, timestep_fs double, stride long, fixed string")


@query("SELECT n_nationkey AS source, 1 AS region, n_nationkey + 300::DOUBLE AS temperature_k, i AS atom_index FROM nation, range(0, 100) r(i) WHERE i <= n_nationkey UNION ALL SELECT n_nationkey, 2, 290, n_nationkey + 4 FROM nation")
def s16_thermal_regions(spark, sf_dir):
    return parsed(inputs(spark, sf_dir), logs.region_rows, "region int, temperature_k double, atom_index long")


@query("SELECT n_nationkey AS source, 5.0::DOUBLE AS a, n_nationkey::DOUBLE AS xy, (n_nationkey + 2)::DOUBLE AS b, 8.5::DOUBLE AS c FROM nation")
def s17_data_cell(spark, sf_dir):
    k = F.col("n_nationkey")
    text = lines(F.lit("data file\n\n0 5 xlo xhi"), F.concat(F.lit("1 "), (k + 3).cast("string"), F.lit(" ylo yhi")), F.lit("-1.5 7.0 zlo zhi"), F.concat(s("n_nationkey"), F.lit(" 0 0 xy xz yz")))

    def parse(text):
        c = trajectory.lammps_data_cell(text)
        return [(c[0], c[3], c[4], c[8])]

    return parsed(T(spark, sf_dir, "nation").select(k.alias("source"), text.alias("text")), parse, "a double, xy double, b double, c double")


def folder_of_files(spark, sf_dir):
    path = place(spark, "folder")
    n = T(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))
    for name, rows in (("run.inp", "n_nationkey = 3"), ("notes.txt", "n_regionkey = 1"), ("out.log", "n_regionkey = 2")):
        T(spark, sf_dir, "nation").where(rows).select(F.col("n_name").alias("value")).coalesce(1).write.text(f"{path}/{name.replace('.', '_')}")
        fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(path), spark._jsc.hadoopConfiguration())
        at = spark._jvm.org.apache.hadoop.fs.Path
        part = next(f.getPath() for f in fs.listStatus(at(f"{path}/{name.replace('.', '_')}")) if f.getPath().getName().startswith("part-"))
        fs.rename(part, at(f"{path}/{name}"))
        fs.delete(at(f"{path}/{name.replace('.', '_')}"), True)
    del n
    return path


@query("SELECT n_name AS line FROM nation WHERE n_nationkey = 3")
def s18_unique_input(spark, sf_dir):
    path = store.unique_input(store.discover(spark, folder_of_files(spark, sf_dir)))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT k AS kind, f AS name, sum(length(n_name) + 1)::BIGINT AS length FROM nation, (VALUES ('input', 'run.inp', -1), ('other', 'notes.txt', 1), ('log', 'out.log', 2)) v(k, f, r) WHERE CASE r WHEN -1 THEN n_nationkey = 3 ELSE n_regionkey = r END GROUP BY ALL")
def s22_directory_discovery(spark, sf_dir):
    files = store.discover(spark, folder_of_files(spark, sf_dir), exclude=r"\.crc$")
    return files.select("kind", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


@query("SELECT 0 AS profile_index, s_suppkey AS key, s_acctbal AS value, NULL AS name FROM supplier UNION ALL SELECT 1, n_nationkey, NULL, n_name FROM nation")
def s20_member_union(spark, sf_dir):
    path = place(spark, "members")
    store.pack({"b": T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value")), "c": T(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))}, path)
    return store.read_members(spark, path, ["b", "c"])


def collection(spark, sf_dir, analysis="density"):
    """A profile for each pair of return flag and line status: its counts and mean quantities by bin of price."""
    li = A.samples(spark, sf_dir).withColumn("uid", F.concat_ws("-", "g", "side"))
    version = store.analysis(analysis)["version"]
    profiles = li.select(F.col("uid").alias("profile_uid"), F.lit(analysis).alias("analysis"), F.lit(version).alias("schema_version"), F.col("g").alias("species_a"), F.col("side").alias("species_b"), F.lit("z").alias("axis"), F.lit(20000.0).alias("bin_width"), F.lit(10).alias("n_frames"), F.create_map(F.lit("n"), F.lit("1")).alias("units"), F.lit("{}").alias("metadata"))
    profiles = profiles.dropDuplicates(["profile_uid"])
    each = li.groupBy(F.col("uid").alias("profile_uid"), F.floor(F.col("x") / 20000.0).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("n"), F.avg("w").alias("w"))
    q = F.array(*(F.struct(F.lit(c).alias("quantity"), F.col(c).alias("value")) for c in ("n", "w")))
    lo = F.col("bin") * 20000.0
    bins = each.select("profile_uid", "bin", lo.alias("lo"), (lo + 20000.0).alias("hi"), (lo + 10000.0).alias("centre"), F.inline(q))
    path = place(spark, "profiles")
    store.write_profiles(profiles, bins, path)
    return path, profiles, bins


BINNED = f"WITH {A.SAMPLES_SQL}, b AS (SELECT g || '-' || side AS profile_uid, g, side, floor(x / 20000.0)::INT AS bin, count(*)::DOUBLE AS n, round(avg(w), 9) AS w FROM samples GROUP BY ALL)"


@query(f"{BINNED} SELECT profile_uid, bin, n AS value FROM b WHERE g = 'R'")
def s21_profile_scan(spark, sf_dir):
    path, _, _ = collection(spark, sf_dir)
    return store.read_bins(spark, path, store.read_catalogue(spark, path, "density", species_a="R"), ["n"]).select("profile_uid", "bin", "value")


@query(f"{BINNED} SELECT DISTINCT profile_uid, g AS species_a, 'z' AS axis, 20000.0::DOUBLE AS bin_width FROM b")
def s21_profile_headers(spark, sf_dir):
    return store.read_catalogue(spark, collection(spark, sf_dir)[0], "density").select("profile_uid", "species_a", "axis", "bin_width")


@query(f"{BINNED} SELECT profile_uid, bin, (bin + 0.5) * 20000.0::DOUBLE AS centre, w AS value FROM b WHERE g = 'A' AND side = 'F'")
def s23_density_loader(spark, sf_dir):
    path, _, _ = collection(spark, sf_dir)
    out = store.read_bins(spark, path, store.read_catalogue(spark, path, "density", species_a="A", species_b="F", axis="z"), ["w"])
    return out.select("profile_uid", "bin", "centre", F.round("value", 9).alias("value"))


@query(f"{BINNED} SELECT 'any order' AS request, count(DISTINCT profile_uid) AS found FROM b WHERE g = 'N' AND side = 'O' UNION ALL SELECT 'ordered', count(DISTINCT profile_uid) FROM b WHERE g = 'O' AND side = 'N'")
def s24_pair_loader(spark, sf_dir):
    path, _, _ = collection(spark, sf_dir, "rdf")
    found = lambda ordered: store.read_pair(spark, path, "rdf", "O", "N", ordered=ordered).agg(F.count("*").alias("found"))
    return found(False).select(F.lit("any order").alias("request"), "found").unionByName(found(True).select(F.lit("ordered").alias("request"), "found"))


@query(f"{BINNED} SELECT profile_uid, count(*) AS n_bins, sum(n) AS n FROM b WHERE side = 'O' GROUP BY 1")
def s25_position_loader(spark, sf_dir):
    path, _, _ = collection(spark, sf_dir, "position")
    some = store.read_catalogue(spark, path, "position", species_b="O", axis="z")
    return store.read_bins(spark, path, some, ["n"]).groupBy("profile_uid").agg(F.count("*").alias("n_bins"), F.sum("value").alias("n"))


@query("SELECT o_custkey AS source, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) > 1")
def s26_record_scan(spark, sf_dir):
    path = place(spark, "records")
    T(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).write.parquet(path)
    return store.read_records(spark, path, {"source": "bigint", "n": "bigint", "total": "double"}).where("n > 1")


@query(f"WITH {AT} SELECT 'a' AS source, count(DISTINCT frame_index) AS n_frames, min(frame_index) * 10 AS first_step, max(frame_index) * 10 AS last_step, 10::BIGINT AS stride FROM atoms")
def s27_metadata_scan(spark, sf_dir):
    return trajectory.metadata(spark, stored_trajectory(spark, sf_dir))


@query(f"WITH {CELLS} SELECT region, iz, round(iz * 0.4::DOUBLE * {BOHR_A}::DOUBLE, 6) AS z, round(avg(value) * {HARTREE_EV}::DOUBLE, 5) AS value_ev FROM c GROUP BY ALL")
def s28_cube_expansion(spark, sf_dir):
    header, _, cells = fields.read_cube(spark, cube_file(spark, sf_dir))
    return potential.profile(cells, header).select(region_of().alias("region"), "iz", F.round("z", 6).alias("z"), F.round("value_ev", 5).alias("value_ev"))


@query(BACK.replace(", 6)", ", 8)"))
def k1_trajectory_sink(spark, sf_dir):
    a = A.atoms(spark, sf_dir).withColumn("source", F.lit("a"))
    f = a.select("source", "frame_index").distinct().withColumn("step", F.col("frame_index")).withColumn("cell", F.array(*(F.lit(float(v)) for v in (10, 0, 0, 0, 10, 0, 0, 0, 10))))
    text = trajectory.xyz_text(f, a).select("frame_index", "value")
    return atoms_back(*trajectory.read_xyz(spark, written(text, "sink", F.col("value"))), 8)


@query(f"{BINNED} SELECT profile_uid, bin, 'n' AS quantity, n AS value FROM b UNION ALL SELECT profile_uid, bin, 'w', w FROM b")
def k2_profile_sink(spark, sf_dir):
    path, profiles, _ = collection(spark, sf_dir)
    return store.read_bins(spark, path, profiles).select("profile_uid", "bin", "quantity", F.round("value", 9).alias("value"))


@query(f"{BINNED} SELECT profile_uid, count(*) AS n_bins FROM (SELECT profile_uid, bin FROM b UNION ALL SELECT 'second', bin FROM b WHERE g = 'R' AND side = 'F') GROUP BY 1")
def k3_profile_collection(spark, sf_dir):
    path, profiles, bins = collection(spark, sf_dir)
    again = lambda d: d.where("profile_uid = 'R-F'").withColumn("profile_uid", F.lit("second"))
    store.write_profiles(again(profiles).unionByName(profiles), again(bins).unionByName(bins), path)  # what is stored is left out
    return store.read_bins(spark, path, store.read_catalogue(spark, path), ["n"]).groupBy("profile_uid").agg(F.count("*").alias("n_bins"))


@query(f"{BINNED} SELECT g AS species_a, side AS species_b, CASE WHEN side = 'F' THEN 'same' WHEN g = 'N' THEN 'different' ELSE 'new' END AS verdict FROM b GROUP BY ALL")
def k4_rdf_merge(spark, sf_dir):
    _, profiles, bins = collection(spark, sf_dir, "rdf")
    stored_p = profiles.where("species_b = 'F' or species_a = 'N'")
    new_p = profiles.select(F.concat(F.lit("new-"), "profile_uid").alias("profile_uid"), *(c for c in profiles.columns if c != "profile_uid"))
    new_p = new_p.withColumn("species_a", F.when(F.col("profile_uid") == "new-R-F", F.col("species_b")).otherwise(F.col("species_a"))).withColumn("species_b", F.when(F.col("profile_uid") == "new-R-F", F.lit("R")).otherwise(F.col("species_b")))
    new_b = bins.withColumn("profile_uid", F.concat(F.lit("new-"), "profile_uid")).withColumn("value", F.col("value") * F.when(F.col("profile_uid") == "new-N-O", 1.01).otherwise(1 + 1e-9))
    out = store.merge_pairs(stored_p, bins, new_p, new_b)
    a, b = F.greatest("species_a", "species_b"), F.least("species_a", "species_b")
    return out.select(F.when(a.isin("A", "N", "R"), a).otherwise(b).alias("species_a"), F.when(a.isin("A", "N", "R"), b).otherwise(a).alias("species_b"), "verdict")


@query("SELECT n_nationkey, n_name, (n_regionkey * 1.5)::DOUBLE AS v, n_nationkey % 2 = 0 AS even FROM nation")
def k7_table_sink(spark, sf_dir):
    path = place(spark, "table")
    rows = T(spark, sf_dir, "nation").select(s("n_nationkey").alias("n_nationkey"), "n_name", (F.col("n_regionkey") * 1.5).cast("string").alias("v"), (F.col("n_nationkey") % 2 == 0).alias("even"))
    store.typed(rows).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "v", "even")


@query("SELECT c_custkey::DOUBLE AS c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def k8_csv_sink(spark, sf_dir):
    path = place(spark, "csv")
    store.write_table(T(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(s("c_acctbal")).alias("c_acctbal"), "c_mktsegment"), path, "semicolon")
    return store.read_table(spark, path, "semicolon")


@query(f"WITH {CELLS} SELECT region, ix, iy, floor(iz / 6)::INT AS line_no, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM c GROUP BY ALL")
def k9_cube_sink(spark, sf_dir):
    _, _, cells = fields.read_cube(spark, cube_file(spark, sf_dir))
    v = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    out = fields.cube_lines(cells).withColumn("v", v)
    return out.select(region_of().alias("region"), "ix", "iy", "line_no", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT t AS component, (n * (SELECT count(*) FROM nation))::BIGINT AS n_rows FROM (VALUES ('scf', 2), ('mulliken', 2), ('hirshfeld', 2), ('coordinates', 2), ('scalars', 2)) v(t, n)")
def k10_log_extraction(spark, sf_dir):
    found = logs.log_tables(logs.read_log(spark, log_file(spark, sf_dir)), drop=("forces",))
    return store.pack(found, place(spark, "extracted")).select("component", "n_rows")


@query("SELECT 2 * n_nationkey AS md_step, i::DOUBLE AS iteration FROM nation, range(1, 3) r(i) WHERE false UNION ALL SELECT n_nationkey + 100, i FROM nation, range(1, 3) r(i)")
def p20_dropped_sections(spark, sf_dir):
    found = logs.log_tables(logs.read_log(spark, log_file(spark, sf_dir)), drop=("forces", "mulliken", "hirshfeld", "coordinates", "scalars"))
    assert set(found) == {"scf"}
    return found["scf"].select("md_step", "iteration")


@query(f"WITH {AT} SELECT 'frames' AS component, (SELECT count(DISTINCT frame_index) FROM atoms) AS n_rows UNION ALL SELECT 'atoms', (SELECT count(*) FROM atoms) UNION ALL SELECT 'charges', (SELECT count(*) FROM nation)")
def k11_pack_directory(spark, sf_dir):
    return packed(spark, sf_dir)[1].select("component", "n_rows")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def k12_component_export(spark, sf_dir):
    path, _ = packed(spark, sf_dir)
    store.convert(spark, f"{path}/charges", f"{path}-out", "parquet", "orc")
    return spark.read.orc(f"{path}-out").select("n_nationkey", "n_name", "n_regionkey")


@query(f"WITH {AT} SELECT frame_index, count(*) AS n FROM atoms WHERE z > 5 GROUP BY 1")
def k13_spool(spark, sf_dir):
    """Transformed rows kept in the shared folder and read twice."""
    from ..shared import cut

    kept = cut(A.atoms(spark, sf_dir).where("z > 5"))
    return kept.groupBy("frame_index").agg(F.count("*").alias("n")).where("n > 0")


@query("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def k14_conversion(spark, sf_dir):
    path = place(spark, "convert")
    T(spark, sf_dir, "region").select("r_regionkey", "r_name").write.parquet(f"{path}/a")
    for a, b in (("parquet", "json"), ("json", "orc"), ("orc", "csv")):
        store.convert(spark, f"{path}/{'a' if a == 'parquet' else a}", f"{path}/{b}", a, b)
    return store.FORMATS["csv"][0](spark, f"{path}/csv").select("r_regionkey", "r_name")


@query("SELECT a AS analysis, v AS schema_version, 6::BIGINT AS n_profiles FROM (VALUES ('density', 2), ('position', 2), ('rdf', 1)) t(a, v) WHERE false UNION ALL SELECT a, v, (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem) FROM (VALUES ('density', 2), ('position', 2), ('rdf', 1)) t(a, v)")
def k16_typed_sinks(spark, sf_dir):
    out = None
    for name in ("density", "position", "rdf"):
        one = store.read_catalogue(spark, collection(spark, sf_dir, name)[0], name).groupBy("analysis", "schema_version").agg(F.count("*").alias("n_profiles"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_regionkey AS state, sha256(string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey)) AS members_sha256, count(*) AS n FROM nation GROUP BY 1")
def k17_topology_store(spark, sf_dir):
    path = place(spark, "topology")
    n = T(spark, sf_dir, "nation").withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.lit(2))))  # the same members in three frames
    states = n.groupBy(F.col("n_regionkey").alias("state"), "frame_index").agg(F.array_sort(F.collect_list("n_nationkey")).alias("members"))
    states = states.withColumn("members_sha256", F.sha2(F.concat_ws(",", F.col("members").cast("array<string>")), 256))
    tables.dedupe(states, ["state", "members_sha256"], "frame_index").write.parquet(path)
    return spark.read.parquet(path).select("state", "members_sha256", F.size("members").cast("long").alias("n"))
