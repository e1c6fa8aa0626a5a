"""Simulation logs and inputs: numeric tables, sectioned output logs, input metadata."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import cell_matrix
from ..functions.text import NUMBER, fermi_ev, number
from ..functions.units import TIME_FS
from .lines import carry, read_lines, words


def read_numeric(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(source, line_no, v): white-space tables of numbers; comments and lines that aren't all numbers are left out."""
    lines = read_lines(spark, path).where(~F.col("line").rlike(r"^\s*(#|$)"))
    v = F.transform(words(F.col("line")), number)
    out = lines.select("source", "line_no", v.alias("v")).where(~F.exists("v", lambda x: x.isNull()) & (F.size("v") >= (width or 3)))
    return out.where(F.size("v") == width) if width else out


#: Marker of each section of an output log, and the pattern of its rows with the names of what it captures.
SECTIONS = {
    "scf": (r"SCF WAVEFUNCTION OPTIMIZATION", rf"^\s*(\d+)\s+(\S+(?:\s\S+)?)\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})\s*$", ("iteration", "method", "step_size", "time_s", "convergence", "energy", "change")),
    "mulliken": (r"Mulliken Population Analysis", rf"^\s*(\d+)\s+([A-Z][a-z]?)\s+(\d+)\s+({NUMBER})\s+({NUMBER})\s*$", ("atom", "element", "kind", "population", "charge")),
    "hirshfeld": (r"Hirshfeld Charges", rf"^\s*(\d+)\s+([A-Z][a-z]?)\s+(\d+)\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})\s*$", ("atom", "element", "kind", "reference", "population", "charge")),
    "forces": (r"ATOMIC FORCES", rf"^\s*(\d+)\s+(\d+)\s+([A-Z][a-z]?)\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})\s*$", ("atom", "kind", "element", "fx", "fy", "fz")),
    "coordinates": (r"MODULE .*ATOMIC COORDINATES", rf"^\s*(\d+)\s+(\d+)\s+([A-Z][a-z]?)\s+(\d+)\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})", ("atom", "kind", "element", "atomic_number", "x", "y", "z")),
}
#: Values that stand on lines of their own.
SCALARS = {"energy": r"ENERGY\|.*:\s*(" + NUMBER + ")", "md_step": r"(?i)(?:STEP NUMBER|MD\| Step number)\s*=?\s*(\d+)", "temperature_k": r"(?i)TEMPERATURE\s*\[K\]\s*=?\s*(" + NUMBER + ")", "volume": r"(?i)CELL\|\s*Volume.*?:\s*(" + NUMBER + ")"}
TEXT_COLUMNS = ("method", "element")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the section they stand in and the MD step printed after them."""
    from pyspark.sql import Window as W

    name = F.coalesce(*(F.when(F.col("line").rlike(m), k) for k, (m, _, _) in SECTIONS.items()))
    ended = F.col("line").rlike(r"^\s*(\*\*\*|===|ENERGY\||MD\|)")
    lines = carry(read_lines(spark, path), section=F.coalesce(name, F.when(ended, F.lit("-"))), step_before=F.when(F.col("line").rlike(SCALARS["md_step"]), F.col("line_no")))
    steps = lines.where(F.col("line").rlike(SCALARS["md_step"])).select(F.col("source").alias("s"), F.regexp_extract("line", SCALARS["md_step"], 1).cast("long").alias("md_step"), F.lag("line_no").over(W.partitionBy("source").orderBy("line_no")).alias("p"))
    out = lines.join(steps, (F.col("source") == F.col("s")) & F.col("step_before").eqNullSafe(F.col("p")), "left")
    own = F.when(F.col("line").rlike(SCALARS["md_step"]), F.regexp_extract("line", SCALARS["md_step"], 1).cast("long"))  # a step's line is its own
    return out.select("source", "line_no", "line", "section", F.coalesce(own, "md_step").alias("md_step"))


def log_table(log: DataFrame, section: str) -> DataFrame:
    """The rows of a section as typed columns."""
    _, pattern, names = SECTIONS[section]
    rows = log.where((F.col("section") == section) & F.col("line").rlike(pattern))
    take = lambda i, n: (F.trim(F.regexp_extract("line", pattern, i)) if n in TEXT_COLUMNS else number(F.regexp_extract("line", pattern, i))).alias(n)
    return rows.select("source", "line_no", "md_step", *(take(i, n) for i, n in enumerate(names, 1)))


def log_scalars(log: DataFrame) -> DataFrame:
    """(source, line_no, md_step, quantity, value)."""
    out = None
    for k, pattern in SCALARS.items():
        one = log.where(F.col("line").rlike(pattern)).select("source", "line_no", "md_step", F.lit(k).alias("quantity"), number(F.regexp_extract("line", pattern, 1)).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def enriched(rows: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Rows of atoms with their coordinates."""
    return rows.join(coordinates.select("source", "atom", "x", "y", "z").dropDuplicates(["source", "atom"]), ["source", "atom"], "left")


def last_fermi(spark: SparkSession, path: str) -> DataFrame:
    """(source, fermi_ev): the last Fermi energy of each file."""
    lines = read_lines(spark, path).where(F.col("line").rlike("(?i)fermi"))
    found = lines.select("source", "line_no", fermi_ev(F.col("line")).alias("fermi_ev")).where("fermi_ev is not null")
    return found.groupBy("source").agg(F.max_by("fermi_ev", "line_no").alias("fermi_ev"))


def section_of(text: str, *names: str) -> str:
    """The text between &NAME and its &END, nested; empty if there is none."""
    for name in names:
        m = re.search(rf"(?im)^\s*&{name}\b.*$", text)
        if not m:
            return ""
        depth, end = 1, m.end()
        for t in re.finditer(r"(?im)^\s*&(\w+)", text[m.end() :]):
            depth += -1 if t[1].upper() == "END" else 1
            end = m.end() + t.start()
            if depth == 0:
                break
        text = text[m.end() : end]
    return text


def input_cell(text: str) -> list[float] | None:
    """Nine numbers of the cell of an input: ABC with angles, or the vectors A, B and C; both at odds are an error."""
    cell = section_of(text, "FORCE_EVAL", "SUBSYS", "CELL") or section_of(text, "CELL")
    scale = {"angstrom": 1.0, "bohr": 0.529177210903, "nm": 10.0}

    def values(key: str) -> list[float] | None:
        m = re.search(rf"(?im)^\s*{key}\s+(?:\[(\w+)\]\s+)?((?:{NUMBER}\s*){{3}})", cell)
        return [float(x.replace("D", "E")) * scale[(m[1] or "angstrom").lower()] for x in re.findall(NUMBER, m[2])] if m else None

    abc, vectors = values("ABC"), [values(k) for k in "ABC"]
    angles = values("ALPHA_BETA_GAMMA") or [90.0, 90.0, 90.0]
    a = cell_matrix(tuple(abc), tuple(angles)) if abc else None
    b = [x for v in vectors for x in v] if all(vectors) else None
    if a and b and any(abs(x - y) > 1e-6 for x, y in zip(a, b)):
        raise ValueError("the cell's lengths and its vectors disagree")
    return b or a


def input_metadata(text: str) -> dict:
    """timestep and stride (as fs between stored frames) and the fixed atoms, from 0."""
    out: dict = {"cell": input_cell(text)}
    if m := re.search(rf"(?im)^\s*TIMESTEP\s+(?:\[(\w+)\]\s+)?({NUMBER})", text):
        out["timestep_fs"] = float(m[2]) * TIME_FS[(m[1] or "fs").lower()]
    stride = re.search(r"(?im)^\s*MD\s+(\d+)", section_of(text, "MOTION", "PRINT", "TRAJECTORY"))
    out["stride"] = int(stride[1]) if stride else 1
    out["fixed"] = expand(" ".join(re.findall(r"(?im)^\s*LIST\s+(.*)$", section_of(text, "MOTION", "CONSTRAINT", "FIXED_ATOMS"))))
    return out


def expand(text: str) -> list[int]:
    """Zero-based numbers of a list `4 7..9`, which counts from one."""
    return [i - 1 for a, _, b in (p.partition("..") for p in text.split()) for i in range(int(a), int(b or a) + 1)]


def region_rows(text: str) -> list[tuple[int, float | None, int]]:
    """(region, temperature, atom from 0) of an input's thermal regions."""
    body, rows = section_of(text, "MOTION", "MD", "THERMAL_REGION") or section_of(text, "THERMAL_REGION"), []
    for i, part in enumerate(re.split(r"(?im)^\s*&DEFINE_REGION\b.*$", body)[1:], 1):
        t = re.search(rf"(?im)^\s*TEMPERATURE\s+(?:\[\w+\]\s+)?({NUMBER})", part)
        rows += [(i, float(t[1]) if t else None, a) for a in expand(" ".join(re.findall(r"(?im)^\s*LIST\s+(.*)$", part)))]
    return rows


def thermal_regions(spark: SparkSession, text: str) -> DataFrame:
    """(region, temperature_k, atom_index) of an input's thermal regions."""
    return spark.createDataFrame(region_rows(text), "region int, temperature_k double, atom_index int")


def temperatures(table: DataFrame, regions: int) -> DataFrame:
    """(source, step, time_fs, region, temperature_k) of a region temperature table: a row for each region."""
    each = F.transform(F.sequence(F.lit(1), F.lit(regions)), lambda i: F.struct(i.alias("region"), F.element_at("v", i + 2).alias("temperature_k")))
    return table.select("source", F.col("v")[0].cast("long").alias("step"), F.col("v")[1].alias("time_fs"), F.inline(each))



def log_tables(log: DataFrame, drop: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """A DataFrame for each section but the dropped ones, which are never planned."""
    out = {k: log_table(log, k) for k in SECTIONS if k not in drop}
    return out | ({} if "scalars" in drop else {"scalars": log_scalars(log)})
