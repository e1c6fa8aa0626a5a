"""Readers and writers against small files written here."""

import math

import pytest
from pyspark.sql import functions as F

from framelake.sources import fields, logs, store, trajectory
from framelake.sources.lines import carry, read_lines

XYZ = """3
Lattice="10 0 0 0 11 0 0 0 12" i = 5, time = 2.500, E = -1.0
O 1.0 2.0 3.0
H1 1.5D0 2.0 3.0
H 1.0 2.5 3.0
2
pbc="T T F" i = 6, time = 3.0
Pt 0 0 0
Xx 1 1 1
"""

DUMP = """ITEM: TIMESTEP
0
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS pp pp pp
0 5
0 6
1 8
ITEM: ATOMS id type element xu yu zu
2 1 H 1.0 2.0 3.0
1 2 O 0.5 0.5 1.5
ITEM: TIMESTEP
10
ITEM: NUMBER OF ATOMS
1
ITEM: BOX BOUNDS xy xz yz pp pp pp
0 6 1.0
0 6 0.0
0 7 0.0
ITEM: ATOMS id element xs ys zs
1 O 0.5 0.5 0.5
"""

CUBE = """c1
c2
 1 0.0 0.0 0.0
 2 1.0 0 0
 2 0 1.0 0
 8 0 0 0.5
 8 8.0 0.1 0.2 0.3
""" + "\n".join(" ".join(f"{v:.1f}" for v in range(a, min(a + 6, a - a % 8 + 8))) for a in (0, 6, 8, 14, 16, 22, 24, 30)) + "\n"  # fmt: skip


@pytest.fixture
def write(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return put


def test_xyz(spark, write):
    frames, atoms = trajectory.read_xyz(spark, write("a.xyz", XYZ), {"Xx": "Au"})
    f = frames.orderBy("frame_index").collect()
    assert [(r["frame_index"], r["step"], r["time_fs"], r["pbc"]) for r in f] == [(0, 5, 2.5, [True] * 3), (1, 6, 3.0, [True, True, False])]
    assert f[0]["cell"] == [10, 0, 0, 0, 11, 0, 0, 0, 12] and f[1]["cell"] is None
    a = atoms.orderBy("frame_index", "atom_index").collect()
    assert [(r["frame_index"], r["atom_index"], r["element"], r["raw_species"], r["x"]) for r in a] == [(0, 0, "O", "O", 1.0), (0, 1, "H", "H1", 1.5), (0, 2, "H", "H", 1.0), (1, 0, "Pt", "Pt", 0.0), (1, 1, "Au", "Xx", 1.0)]
    assert a[0]["mass_amu"] == 15.999


def test_xyz_in_blocks(spark, write):
    path = write("b.xyz", "".join(f"2\ni = {k}, time = {k}.0\nO {k} 0 0\nH 0 {k} 0\n" for k in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = read_lines(spark, path).orderBy("line_no").collect()
        assert len({r["block"] for r in lines}) > 3 and [r["line_no"] for r in lines] == list(range(1600))
        frames, atoms = trajectory.read_xyz(spark, path)
        assert atoms.where("element = 'O'").select(F.count_if(F.col("x") == F.col("frame_index"))).first()[0] == 400
        assert frames.where("frame_index = step").count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_xyz_round_trip(spark, write, tmp_path):
    frames, atoms = trajectory.read_xyz(spark, write("a.xyz", XYZ), {"Xx": "Au"})
    text = "\n".join(r["value"] for r in trajectory.xyz_text(frames, atoms).orderBy("frame_index").collect()) + "\n"
    again = trajectory.read_xyz(spark, write("c.xyz", text), {"Xx": "Au"})[1]
    columns = ["frame_index", "atom_index", "element", "x", "y", "z"]
    assert sorted(atoms.select(columns).collect()) == sorted(again.select(columns).collect())
    trajectory.write_frames(frames, atoms, str(tmp_path / "t"))
    f, a = trajectory.read_frames(spark, str(tmp_path / "t"), 1, 2)
    assert (f.count(), a.count()) == (1, 2)
    assert "PushedFilters: [IsNotNull(frame_index), GreaterThanOrEqual(frame_index,1), LessThan(frame_index,2)]" in a._jdf.queryExecution().executedPlan().toString()


def test_lammps(spark, write):
    frames, atoms = trajectory.read_lammps_dump(spark, write("d.dump", DUMP))
    f = frames.orderBy("frame_index").collect()
    assert [r["step"] for r in f] == [0, 10] and f[0]["cell"] == [5, 0, 0, 0, 6, 0, 0, 0, 7] and f[0]["origin"] == [0, 0, 1]
    assert f[1]["cell"] == [5, 0, 0, 1, 6, 0, 0, 0, 7]
    a = {(r["frame_index"], r["atom_index"]): r for r in atoms.collect()}
    assert (a[0, 1]["element"], a[0, 1]["x"], a[0, 0]["z"]) == ("H", 1.0, 1.5)
    assert (a[1, 0]["x"], a[1, 0]["y"], a[1, 0]["z"]) == (3.0, 3.0, 3.5)
    script = trajectory.lammps_input("units metal\ntimestep 0.001\nread_data s.data # c\ndump d1 all custom 10 out.dump id &\n type x\n")
    assert script["dump"] == "out.dump" and script["frame_timestep_fs"] == pytest.approx(10.0) and script["read_data"] == "s.data"
    assert trajectory.lammps_data_cell("0 5 xlo xhi\n0 6.5 ylo yhi\n-1 7 zlo zhi\n1 0 0 xy xz yz\n") == [5, 0, 0, 1, 6.5, 0, 0, 0, 8]


def test_velocities(spark, write):
    from framelake.operators.statistics import temperature
    from framelake.schema import AMU_KG, BOLTZMANN, VELOCITY_MS

    v = math.sqrt(3 * BOLTZMANN * 320 / (39.0983 * AMU_KG)) / VELOCITY_MS["atomic"]
    path = write("v.xyz", f"1\n i = 10, time = 5.000, E = -1.0\nK {v} 0 0\n")
    frames, atoms = trajectory.read_velocity_xyz(spark, path)
    k = VELOCITY_MS["atomic"]
    rows = atoms.select("frame_index", (F.col("mass_amu") * AMU_KG).alias("mass_kg"), *((F.col(c) * k).alias(c) for c in ("vx", "vy", "vz")))
    assert temperature(rows, ["frame_index"], remove_com=False).first()["temperature_k"] == pytest.approx(320)
    assert temperature(rows, ["frame_index"]).first()["temperature_k"] is None
    assert frames.first()["step"] == 10 and frames.first()["time_fs"] == 5.0


def test_cube(spark, write):
    header, atoms, cells = fields.read_cube(spark, write("p.cube", CUBE))
    h = header.first()
    assert (h["n_atoms"], h["nx"], h["ny"], h["nz"], h["dz"]) == (1, 2, 2, 8, 0.5)
    assert atoms.first()["atomic_number"] == 8
    got = {(r["ix"], r["iy"], r["iz"]): r["value"] for r in cells.collect()}
    assert len(got) == 32 and all(v == 16 * x + 8 * y + z for (x, y, z), v in got.items())
    assert fields.check_cube(header, cells).count() == 0 and fields.check_cube(header, cells.where("iz > 0")).count() == 1
    assert fields.cube_lines(cells).count() == 8


def test_numeric_table(spark, write):
    t = logs.read_numeric(spark, write("a.temp", "# step time\n1 0.5 300.0 310\n2 1.0 oops 1\n3 1.5 3.0D2 320\n"), 4)
    assert [r["v"] for r in t.orderBy("line_no").collect()] == [[1, 0.5, 300, 310], [3, 1.5, 300, 320]]
    assert [(r["step"], r["region"], r["temperature_k"]) for r in logs.temperatures(t, 2).orderBy("step", "region").collect()] == [(1, 1, 300), (1, 2, 310), (3, 1, 300), (3, 2, 320)]


LOG = """ MODULE QUICKSTEP: ATOMIC COORDINATES IN ANGSTROM
   1   1  O   8   0.1  0.2  0.3  6.0 15.999
   2   2  H   1   0.4  0.5  0.6  1.0 1.008
 SCF WAVEFUNCTION OPTIMIZATION
   1 OT DIIS 0.15E+00 1.2 0.5 -10.5 -1.0E+01
   2 OT DIIS 0.15E+00 1.1 0.1 -10.6 -1.0E-01
 ENERGY| Total FORCE_EVAL ( QS ) energy [a.u.]:   -10.600
 Mulliken Population Analysis
   1 O 1 6.5 -0.5
   2 H 2 0.5 0.5
 Fermi energy: 0.1 a.u.
 MD| Step number 7
 SCF WAVEFUNCTION OPTIMIZATION
   1 OT DIIS 0.15E+00 1.2 0.5 -10.7 -1.0E+01
 Fermi energy: 0.2 a.u.
 MD| Step number 8
"""


def test_log(spark, write):
    path = write("o.out", LOG)
    log = logs.read_log(spark, path)
    scf = logs.log_table(log, "scf").orderBy("line_no").collect()
    assert [(r["iteration"], r["energy"], r["md_step"]) for r in scf] == [(1, -10.5, 7), (2, -10.6, 7), (1, -10.7, 8)]
    charges = logs.enriched(logs.log_table(log, "mulliken"), logs.log_table(log, "coordinates")).orderBy("atom").collect()
    assert [(r["element"], r["charge"], r["x"]) for r in charges] == [("O", -0.5, 0.1), ("H", 0.5, 0.4)]
    assert logs.log_scalars(log).where("quantity = 'energy'").first()["value"] == -10.6
    assert logs.last_fermi(spark, path).first()["fermi_ev"] == pytest.approx(0.2 * 27.211386245988)


INPUT = """&MOTION
 &MD
  TIMESTEP [fs] 0.5
  &THERMAL_REGION
   &DEFINE_REGION
    TEMPERATURE [K] 320
    LIST 1..2 5
   &END
   &DEFINE_REGION
    TEMPERATURE 330
    LIST 3
   &END
  &END
 &END
 &CONSTRAINT
  &FIXED_ATOMS
   LIST 4 6..7
  &END
 &END
 &PRINT
  &TRAJECTORY
   &EACH
    MD 10
   &END
  &END
 &END
&END
&FORCE_EVAL
 &SUBSYS
  &CELL
   ABC [angstrom] 10 11 12
  &END
 &END
&END
"""


def test_input(spark):
    m = logs.input_metadata(INPUT)
    assert m == {"cell": pytest.approx([10, 0, 0, 0, 11, 0, 0, 0, 12]), "timestep_fs": 0.5, "stride": 10, "fixed": [3, 5, 6]}
    assert sorted(logs.thermal_regions(spark, INPUT).collect()) == [(1, 320.0, 0), (1, 320.0, 1), (1, 320.0, 4), (2, 330.0, 2)]
    with pytest.raises(ValueError):
        logs.input_cell("&CELL\nABC 1 2 3\nA 1 0 0\nB 0 2 0\nC 0 0 4\n&END")


def test_profiles(spark, tmp_path):
    path, uid = str(tmp_path / "r"), store.profile_uid(analysis="rdf", a="O", b="H")
    p = spark.createDataFrame([(uid, "rdf", 1, "O", "H", None, 0.05, 10, {"g": "1"}, "{}")], "profile_uid string, analysis string, schema_version int, species_a string, species_b string, axis string, bin_width double, n_frames int, units map<string,string>, metadata string")
    b = spark.createDataFrame([(uid, 0, 0.0, 1.0, 0.5, "g", 1.5), (uid, 0, 0.0, 1.0, 0.5, "counts", 3.0)], "profile_uid string, bin int, lo double, hi double, centre double, quantity string, value double")
    store.write_profiles(p, b, path)
    store.write_profiles(p, b, path)
    assert spark.read.parquet(f"{path}/bins").count() == 2
    found = store.read_pair(spark, path, "rdf", "H", "O", ordered=False)
    assert store.read_bins(spark, path, found, ["g"]).first()["value"] == 1.5
    assert store.read_pair(spark, path, "rdf", "H", "O", ordered=True).count() == 0
    store.write_profiles(p.withColumn("schema_version", F.lit(9)), b, str(tmp_path / "old"))
    with pytest.raises(ValueError):
        store.read_catalogue(spark, str(tmp_path / "old"), "rdf")


def test_tables(spark, write, tmp_path):
    df = store.read_table(spark, write("t.csv", "a;b;a\n1;x;n/a\n2;-;3\n3;y;4\n"))
    assert df.columns == ["a", "b", "a_2"] and [t for _, t in df.dtypes] == ["double", "string", "double"]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x", None), (2, None, 3), (3, "y", 4)]
    store.write_table(df, str(tmp_path / "o"), "tab")
    store.convert(spark, str(tmp_path / "o"), str(tmp_path / "o2"), "csv", "parquet")
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 3


def test_folders(spark, write, tmp_path):
    write("a.xyz", XYZ), write("b.inp", INPUT), write("c.cube", CUBE)
    files = store.discover(spark, str(tmp_path))
    assert {r["kind"] for r in files.collect()} == {"trajectory", "input", "cube"}
    assert store.unique_input(files).endswith("b.inp")
    with pytest.raises(ValueError):
        store.unique_input(files.where("kind = 'cube'"))
    frames, atoms = trajectory.read_xyz(spark, str(tmp_path / "a.xyz"))
    manifest = store.pack({"frames": frames, "atoms": atoms}, str(tmp_path / "pack"))
    assert {r["component"]: r["n_rows"] for r in manifest.collect()} == {"frames": 2, "atoms": 5}
    assert store.component(spark, str(tmp_path / "pack"), "atoms").count() == 5


def test_carry(spark, write):
    lines = read_lines(spark, write("m.txt", "a\n# one\nb\nc\n# two\nd\n"))
    got = carry(lines, head=F.when(F.col("line").startswith("#"), F.col("line"))).orderBy("line_no").collect()
    assert [r["head"] for r in got] == [None, "# one", "# one", "# one", "# two", "# two"]
