"""Long tables of the engine, the element table and units.

frames: one row per (source, frame_index); atoms: one row per atom sample; profiles, bins, stats and blocks hold results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FRAMES = "source string, frame_index int, step long, time_fs double, cell array<double>, origin array<double>, pbc array<boolean>"
ATOMS = "source string, frame_index int, atom_index int, element string, raw_species string, mass_amu double, x double, y double, z double, is_fixed boolean"
PROFILES = "profile_uid string, analysis string, schema_version int, species_a string, species_b string, axis string, bin_width double, n_frames int, units map<string,string>, metadata string"
BINS = "profile_uid string, bin int, lo double, hi double, centre double, quantity string, value double"
STATS = "profile_uid string, bin int, quantity string, point_count long, sample_n int, sample_std double, sample_sem double, block_n int, block_std double, block_sem double"
BLOCKS = "profile_uid string, bin int, quantity string, component int, block int, numerator double, denominator double, length int"
GRID = "profile_uid string, geom_group int, ix int, iy int, iz int, id int, mass double, entities double, mass_top double, mass_bottom double, entities_top double, entities_bottom double"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# Public constants that results must agree with.
AMU_G = 1.66053906660e-24
AMU_KG = 1.66053906660e-27
A3_CM3, A3_NM3 = 1e-24, 1e-3
OH_CUTOFF = 1.27
MIN_MOLECULE_FRAMES = 5
RDF_BIN, RDF_SIGMA, TAPER = 0.05, 0.10, 0.50
ANGLE_BINS = 50
BOHR_A, HARTREE_EV = 0.529177210903, 27.211386245988
CSHE_OFFSET = 0.65
BOLTZMANN = 1.380649e-23
VELOCITY_MS = {"atomic": 2.18769126364e6, "angstrom/fs": 1e5}
BLOCK_MIN_FRAMES, BLOCK_MAX, BLOCK_FRAMES = 100, 20, 25

#: Schema version of each analysis.
VERSIONS = {"density": 2, "position": 2, "coordination": 2, "orientation": 2, "rdf": 1, "temperature": 1, "potential": 3}

#: Atoms of each molecule label, anchor first.
MOLECULES = {"mol:H": 1, "mol:O": 1, "mol:OH": 2, "mol:H2O": 3, "mol:H3O": 4}

# Symbol, atomic number, standard atomic weight (public values).
_ELEMENTS = """
H 1 1.008, He 2 4.002602, Li 3 6.94, Be 4 9.0121831, B 5 10.81, C 6 12.011, N 7 14.007, O 8 15.999, F 9 18.998403163,
Ne 10 20.1797, Na 11 22.98976928, Mg 12 24.305, Al 13 26.9815385, Si 14 28.085, P 15 30.973761998, S 16 32.06, Cl 17 35.45,
Ar 18 39.948, K 19 39.0983, Ca 20 40.078, Sc 21 44.955908, Ti 22 47.867, V 23 50.9415, Cr 24 51.9961, Mn 25 54.938044,
Fe 26 55.845, Co 27 58.933194, Ni 28 58.6934, Cu 29 63.546, Zn 30 65.38, Ga 31 69.723, Ge 32 72.63, As 33 74.921595,
Se 34 78.971, Br 35 79.904, Kr 36 83.798, Rb 37 85.4678, Sr 38 87.62, Y 39 88.90584, Zr 40 91.224, Nb 41 92.90637,
Mo 42 95.95, Tc 43 97.90721, Ru 44 101.07, Rh 45 102.9055, Pd 46 106.42, Ag 47 107.8682, Cd 48 112.414, In 49 114.818,
Sn 50 118.71, Sb 51 121.76, Te 52 127.6, I 53 126.90447, Xe 54 131.293, Cs 55 132.90545196, Ba 56 137.327, La 57 138.90547,
Ce 58 140.116, Pr 59 140.90766, Nd 60 144.242, Pm 61 144.91276, Sm 62 150.36, Eu 63 151.964, Gd 64 157.25, Tb 65 158.92535,
Dy 66 162.5, Ho 67 164.93033, Er 68 167.259, Tm 69 168.93422, Yb 70 173.054, Lu 71 174.9668, Hf 72 178.49, Ta 73 180.94788,
W 74 183.84, Re 75 186.207, Os 76 190.23, Ir 77 192.217, Pt 78 195.084, Au 79 196.966569, Hg 80 200.592, Tl 81 204.38,
Pb 82 207.2, Bi 83 208.9804
"""
ELEMENTS = {s: (int(n), float(m)) for s, n, m in (e.split() for e in _ELEMENTS.replace("\n", " ").split(",") if e.strip())}


def elements(spark: SparkSession) -> DataFrame:
    """(element, atomic_number, mass_amu): a static table of 83 rows, small enough to broadcast."""
    return spark.createDataFrame([(s, n, m) for s, (n, m) in ELEMENTS.items()], "element string, atomic_number int, mass_amu double")
