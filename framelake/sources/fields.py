"""Volumetric fields: cube files as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number
from .lines import read_lines, words


def read_cube(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, atoms, cells): header has the number of atoms, the origin and three grid vectors (Bohr) with their counts; cells are (source, ix, iy, iz, value), z running fastest."""
    from pyspark.sql import Window as W

    lines = read_lines(spark, path)
    w = words(F.col("line"))
    nums = F.transform(w, number)
    head = lines.where(F.col("line_no").between(2, 5)).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("line_no", nums.alias("v")))).alias("h"))
    v = lambda i: F.col("h")[i]["v"]
    header = head.select("source", F.abs(v(0)[0]).cast("int").alias("n_atoms"), F.slice(v(0), 2, 3).alias("origin"), *(F.abs(v(i + 1)[0]).cast("int").alias(n) for i, n in enumerate(("nx", "ny", "nz"))), *(F.slice(v(i + 1), 2, 3).alias(f"v{c}") for i, c in enumerate("xyz")))
    header = header.withColumn("dz", F.col("vz")[2])
    body = lines.where("line_no >= 6").join(F.broadcast(header), "source")
    atoms = body.where(F.col("line_no") < 6 + F.col("n_atoms")).select("source", (F.col("line_no") - 6).cast("int").alias("atom_index"), nums[0].cast("int").alias("atomic_number"), nums[1].alias("charge"), *(nums[i + 2].alias(c) for i, c in enumerate("xyz")))
    values = body.where(F.col("line_no") >= 6 + F.col("n_atoms")).select("source", "block", "i", "line_no", "ny", "nz", F.filter(nums, lambda x: x.isNotNull()).alias("v"))
    own = W.partitionBy("source", "block").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    counts = values.groupBy("source", "block").agg(F.sum(F.size("v")).alias("n"))
    counts = counts.select("source", "block", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    values = values.withColumn("own", F.coalesce(F.sum(F.size("v")).over(own), F.lit(0))).join(F.broadcast(counts), ["source", "block"])
    cells = values.select("source", "ny", "nz", (F.col("before") + F.col("own")).alias("at"), F.posexplode("v").alias("p", "value")).withColumn("k", F.col("at") + F.col("p"))
    plane = F.col("ny") * F.col("nz")
    return header.drop("h"), atoms, cells.select("source", F.floor(F.col("k") / plane).cast("int").alias("ix"), F.floor((F.col("k") % plane) / F.col("nz")).cast("int").alias("iy"), (F.col("k") % F.col("nz")).cast("int").alias("iz"), "value")


def check_cube(header: DataFrame, cells: DataFrame) -> DataFrame:
    """(source, expected, found) of fields whose number of values is wrong; empty if all is well."""
    n = cells.groupBy("source").agg(F.count("value").alias("found"))
    return header.select("source", (F.col("nx") * F.col("ny") * F.col("nz")).cast("long").alias("expected")).join(n, "source", "left").where("found is null or found <> expected")


def cube_lines(cells: DataFrame) -> DataFrame:
    """(source, ix, iy, line_no, value): text lines of six values of each z column, as the cube format wants them."""
    columns = cells.groupBy("source", "ix", "iy", F.floor(F.col("iz") / 6).cast("int").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("iz", "value"))).alias("v"))
    return columns.select("source", "ix", "iy", "line_no", F.concat_ws(" ", F.transform("v", lambda x: F.format_string("%13.5E", x["value"]))).alias("value"))
