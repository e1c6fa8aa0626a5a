"""Trajectories: XYZ with its extensions, velocity XYZ, LAMMPS dumps and scripts; Parquet in and out."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NUMBER, element_of, number
from ..functions.units import STYLE_TIME_FS
from ..operators.pairs import masses
from .lines import carry, read_lines, words

COUNT = r"^\s*\d+\s*$"


def _framed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of XYZ frames with their frame's first line, comment and number of atoms."""
    lines = read_lines(spark, path)
    return carry(lines, start=F.when(F.col("line").rlike(COUNT), F.col("line_no")), n=F.when(F.col("line").rlike(COUNT), F.trim("line").cast("int")))


def _starts(lines: DataFrame) -> DataFrame:
    """One row a frame, numbered by place: (source, start, frame_index, comment)."""
    from pyspark.sql import Window as W

    heads = lines.where(F.col("line_no") == F.col("start") + 1).select("source", "start", F.col("line").alias("comment"))
    return heads.withColumn("frame_index", (F.row_number().over(W.partitionBy("source").orderBy("start")) - 1).cast("int"))


def _rows(spark: SparkSession, path: str, names: tuple[str, str, str], aliases: dict[str, str] | None) -> tuple[DataFrame, DataFrame]:
    lines = _framed(spark, path)
    heads = _starts(lines)
    at = F.col("line_no") - F.col("start") - 2
    w = words(F.col("line"))
    body = lines.where((at >= 0) & (at < F.col("n"))).select("source", "start", at.cast("int").alias("atom_index"), w[0].alias("raw_species"), *(number(w[i + 1]).alias(c) for i, c in enumerate(names)))
    body = body.join(heads.select("source", "start", "frame_index"), ["source", "start"]).drop("start")
    return body.withColumn("element", element_of(F.col("raw_species"), aliases)), heads


def comment_fields(comment: Column) -> dict[str, Column]:
    """step and time of `i = …, time = …`, and the extended keys Lattice, pbc and cell_origin; a lattice alone is fully periodic."""
    take = lambda p: F.nullif(F.regexp_extract(comment, p, 1), F.lit(""))
    array = lambda p: F.transform(F.split(F.trim(take(p)), r"\s+"), number)
    lattice = array(r'(?i)lattice\s*=\s*"([^"]*)"')
    pbc = F.transform(F.split(F.trim(take(r'(?i)pbc\s*=\s*"([^"]*)"')), r"\s+"), lambda x: F.upper(x).isin("T", "1", "TRUE"))
    always = F.when(lattice.isNotNull(), F.array(F.lit(True), F.lit(True), F.lit(True)))
    return {
        "step": take(r"\bi\s*=\s*(\d+)").cast("long"), "time_fs": number(take(r"(?i)\btime\s*=\s*(" + NUMBER + ")")), "cell": lattice,
        "pbc": F.coalesce(pbc, always), "origin": array(r'(?i)cell_origin\s*=\s*"([^"]*)"'),
    }


def read_xyz(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of XYZ files; any number of atoms in each frame."""
    atoms, heads = _rows(spark, path, ("x", "y", "z"), aliases)
    frames = heads.select("source", "frame_index", *(c.alias(k) for k, c in comment_fields(F.col("comment")).items()))
    return frames, atoms.withColumn("mass_amu", F.element_at(masses(), F.col("element"))).withColumn("is_fixed", F.lit(False))


def read_velocity_xyz(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, velocities) of an XYZ file whose coordinates are velocities."""
    atoms, heads = _rows(spark, path, ("vx", "vy", "vz"), aliases)
    return heads.select("source", "frame_index", *(c.alias(k) for k, c in comment_fields(F.col("comment")).items())), atoms.withColumn("mass_amu", F.element_at(masses(), F.col("element")))


def read_lammps_dump(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of text dumps: ITEM blocks, tilted boxes, scaled coordinates; labels from the columns element or type."""
    item = F.regexp_extract(F.col("line"), r"^ITEM: (\w+)", 1)
    lines = read_lines(spark, path)
    lines = carry(lines, start=F.when(item == "TIMESTEP", F.col("line_no")), item_at=F.when(item != "", F.col("line_no")), item=F.when(item != "", item), head=F.when(item == "ATOMS", F.col("line")))
    inside = lines.where(F.col("line_no") > F.col("item_at")).withColumn("k", F.col("line_no") - F.col("item_at") - 1)
    w = words(F.col("line"))
    nums = F.transform(w, number)
    boxes = inside.where("item = 'BOX'").groupBy("source", "start").agg(F.array_sort(F.collect_list(F.struct("k", nums.alias("v")))).alias("b"))
    steps = inside.where("item = 'TIMESTEP'").select("source", "start", F.trim("line").cast("long").alias("step"))
    v = lambda i, j: F.get(F.col("b")[i]["v"], F.lit(j))
    xy, xz, yz = (F.coalesce(v(i, 2), F.lit(0.0)) for i in range(3))
    zero = F.lit(0.0)
    lo = (v(0, 0) - F.least(zero, xy, xz, xy + xz), v(1, 0) - F.least(zero, yz), v(2, 0))
    hi = (v(0, 1) - F.greatest(zero, xy, xz, xy + xz), v(1, 1) - F.greatest(zero, yz), v(2, 1))
    from pyspark.sql import Window as W

    frames = steps.join(boxes, ["source", "start"]).withColumn("frame_index", (F.row_number().over(W.partitionBy("source").orderBy("start")) - 1).cast("int"))
    cell = F.array(hi[0] - lo[0], zero, zero, xy, hi[1] - lo[1], zero, xz, yz, hi[2] - lo[2])
    frames = frames.select("source", "start", "frame_index", "step", cell.alias("cell"), F.array(*lo).alias("origin"), F.array(*[F.lit(True)] * 3).alias("pbc"))
    names = F.slice(words(F.col("head")), 3, 1000)
    named = F.map_from_arrays(names, F.slice(w, 1, F.size(names)))
    body = inside.where("item = 'ATOMS'").join(frames.select("source", "start", "frame_index", "cell", "origin"), ["source", "start"]).withColumn("m", named)
    get = lambda *keys: F.coalesce(*(F.try_element_at("m", F.lit(k)) for k in keys))

    def coordinate(c: str, i: int) -> Column:
        plain = number(get(f"{c}u", c))
        scaled = [number(get(f"{k}s", f"{k}su")) for k in "xyz"]
        return F.coalesce(plain, F.col("origin")[i] + scaled[0] * F.col("cell")[i] + scaled[1] * F.col("cell")[3 + i] + scaled[2] * F.col("cell")[6 + i])

    atoms = body.select("source", "frame_index", (F.coalesce(get("id").cast("int") - 1, F.col("k").cast("int"))).alias("atom_index"), get("element", "type").alias("raw_species"), *(coordinate(c, i).alias(c) for i, c in enumerate("xyz")))
    atoms = atoms.withColumn("element", element_of(F.col("raw_species"), aliases))
    return frames.drop("start"), atoms.withColumn("mass_amu", F.element_at(masses(), F.col("element"))).withColumn("is_fixed", F.lit(False))


def lammps_input(text: str) -> dict:
    """units, timestep, boundary, data file and dump of a script: what a dump needs to be read."""
    out: dict = {"units": "lj", "boundary": "p p p"}
    for line in re.sub(r"&\s*\n", " ", text).splitlines():
        w = line.split("#")[0].split()
        if not w:
            continue
        if w[0] in ("units", "read_data", "timestep"):
            out[w[0]] = float(w[1]) if w[0] == "timestep" else w[1]
        elif w[0] == "boundary":
            out["boundary"] = " ".join(w[1:4])
        elif w[0] == "dump" and len(w) > 5:
            out |= {"stride": int(w[4]), "dump": w[5]}
    if "timestep" in out:
        out["frame_timestep_fs"] = out["timestep"] * STYLE_TIME_FS.get(out["units"], 1.0) * out.get("stride", 1)
    return out


def lammps_data_cell(text: str) -> list[float]:
    """Nine numbers of the cell in a data file: bounds and tilt."""
    bounds = {m[3][0]: (float(m[1]), float(m[2])) for m in re.finditer(rf"^\s*({NUMBER})\s+({NUMBER})\s+([xyz])lo\s+\3hi", text.replace("xlo", "xlo"), re.M)}
    if set(bounds) != set("xyz"):
        bounds = {m[3]: (float(m[1]), float(m[2])) for m in re.finditer(rf"^\s*({NUMBER})\s+({NUMBER})\s+([xyz])lo\s+[xyz]hi", text, re.M)}
    t = re.search(rf"^\s*({NUMBER})\s+({NUMBER})\s+({NUMBER})\s+xy\s+xz\s+yz", text, re.M)
    xy, xz, yz = (float(t[i]) for i in (1, 2, 3)) if t else (0.0, 0.0, 0.0)
    a, b, c = (bounds[k][1] - bounds[k][0] for k in "xyz")
    return [a, 0.0, 0.0, xy, b, 0.0, xz, yz, c]


def read_frames(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of a stored trajectory; the frame range reaches the scans as a pushed filter."""
    out = []
    for name in ("frames", "atoms"):
        df = spark.read.parquet(f"{path}/{name}")
        if start is not None:
            df = df.where(F.col("frame_index") >= start)
        out.append(df.where(F.col("frame_index") < stop) if stop is not None else df)
    return out[0], out[1]


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(source, n_frames, first_step, last_step, stride) of a stored trajectory, from its frames alone; no stride where it isn't uniform."""
    f = spark.read.parquet(f"{path}/frames").groupBy("source").agg(F.count("*").alias("n_frames"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count_distinct("step").alias("k"))
    span = F.try_divide(F.col("last_step") - F.col("first_step"), F.col("n_frames") - 1)
    return f.select("source", "n_frames", "first_step", "last_step", F.when((F.col("k") == F.col("n_frames")) & (span == F.floor(span)), span.cast("long")).alias("stride"))


def write_frames(frames: DataFrame, atoms: DataFrame, path: str, compression: str = "zstd") -> None:
    """Parquet by source, atoms sorted by frame within files so that ranges prune row groups."""
    frames.write.mode("overwrite").option("compression", compression).parquet(f"{path}/frames")
    atoms.sortWithinPartitions("source", "frame_index", "atom_index").write.mode("overwrite").option("compression", compression).parquet(f"{path}/atoms")


def xyz_text(frames: DataFrame, atoms: DataFrame) -> DataFrame:
    """(source, frame_index, value): each frame as the text of its XYZ block; a frame is a bounded group."""
    line = F.concat_ws(" ", "raw_species", *(F.format_string("%.8f", F.col(c)) for c in "xyz"))
    body = atoms.groupBy("source", "frame_index").agg(F.array_sort(F.collect_list(F.struct("atom_index", line.alias("s")))).alias("a"))
    cell = F.concat_ws(" ", F.transform("cell", lambda x: F.format_string("%.8f", x)))
    head = F.concat(F.when(F.col("cell").isNotNull(), F.concat(F.lit('Lattice="'), cell, F.lit('" '))).otherwise(F.lit("")), F.lit("i = "), F.coalesce(F.col("step"), F.col("frame_index").cast("long")).cast("string"))
    return body.join(frames, ["source", "frame_index"]).select("source", "frame_index", F.concat_ws("\n", F.size("a").cast("string"), head, F.concat_ws("\n", F.transform("a", lambda x: x["s"]))).alias("value"))


FORMATS = {".xyz": read_xyz, ".extxyz": read_xyz, ".lammpstrj": read_lammps_dump, ".dump": read_lammps_dump}


def read_trajectory(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """By the path's ending; a folder is a stored trajectory."""
    reader = FORMATS.get(PurePosixPath(path.rstrip("/")).suffix.lower())
    return reader(spark, path, **options) if reader else read_frames(spark, path)
