"""The driver's generic tables read as the engine's long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES, CELL = 10, 10.0
SPECIES = ("H", "O", "Pt", "Na", "Cl", "K", "Au", "Li", "Cs", "Cu")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as atoms of a cubic cell: frame = id modulo 10, element by label, position from the first three components."""
    symbols = F.array(*(F.lit(s) for s in SPECIES))
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: (F.element_at("embedding", i).cast("double") * CELL + CELL / 2)
    return e.select(
        (F.col("vec_id") % FRAMES).cast("long").alias("frame_index"), F.col("vec_id").alias("atom_index"), F.element_at(symbols, (F.col("label") % len(SPECIES)) + 1).alias("element"),
        F.concat(F.element_at(symbols, (F.col("label") % len(SPECIES)) + 1), F.when(F.col("vec_id") % 3 == 0, "1").otherwise("")).alias("raw_species"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), (F.col("vec_id") % 7 == 0).alias("is_fixed"),
    )


_NAMES = "[" + ", ".join(f"'{s}'" for s in SPECIES) + "]"
#: The same in SQL, as a common table expression.
ATOMS_SQL = f"""atoms AS (
  SELECT vec_id % {FRAMES} AS frame_index, vec_id AS atom_index, {_NAMES}[(label % {len(SPECIES)}) + 1] AS element,
         {_NAMES}[(label % {len(SPECIES)}) + 1] || CASE WHEN vec_id % 3 = 0 THEN '1' ELSE '' END AS raw_species,
         embedding[1]::DOUBLE * {CELL} + {CELL / 2} AS x, embedding[2]::DOUBLE * {CELL} + {CELL / 2} AS y, embedding[3]::DOUBLE * {CELL} + {CELL / 2} AS z,
         vec_id % 7 = 0 AS is_fixed
  FROM embeddings)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as series: id = user, time in seconds, value in whole hundredths."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("cents"), "value", "props")


SERIES_SQL = "series AS (SELECT event_id, user_id AS id, epoch_us(ts) AS t_us, event_type AS kind, round(value * 100)::BIGINT AS cents, value, props FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as weighted samples: x = price, weight = quantity in whole units, group = return flag."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").cast("long").alias("w"),
        F.round(F.col("l_discount") * 100).cast("long").alias("d"), F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("side"),
    )


SAMPLES_SQL = """samples AS (
  SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x, l_quantity::BIGINT AS w,
         round(l_discount * 100)::BIGINT AS d, l_returnflag AS g, l_linestatus AS side
  FROM lineitem)"""


def synthetic_trajectory(spark: SparkSession, frames: int = 1024) -> DataFrame:
    """Atoms of invented frames, 604 each: four platinum layers, 150 waters and ten ions in a cell of 12 by 12 by 40."""
    from .operators.pairs import masses

    a = spark.range(frames * 604).select((F.col("id") / 604).cast("long").alias("frame_index"), (F.col("id") % 604).alias("atom_index"))
    water = F.col("atom_index").between(144, 593)
    a = a.withColumn("w", F.when(water, ((F.col("atom_index") - 144) / 3).cast("int"))).withColumn("k", F.when(water, (F.col("atom_index") - 144) % 3))
    own = F.coalesce("w", F.col("atom_index") + 1000)
    place = lambda seed, length: F.pmod(F.xxhash64("frame_index", own, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0 * length
    arm = F.when(F.col("k") == 1, 0.8).when(F.col("k") == 2, -0.8).otherwise(0.0)
    element = F.when(F.col("atom_index") < 144, "Pt").when(F.col("k") == 0, "O").when(water, "H").otherwise("Na")
    z = F.when(F.col("atom_index") < 144, (F.col("atom_index") % 4) * 2.0).otherwise(10 + place(3, 28.0) + F.when(F.col("k") >= 1, 0.5).otherwise(0.0))
    a = a.select("frame_index", "atom_index", element.alias("element"), (place(1, 12.0) + arm).alias("x"), place(2, 12.0).alias("y"), z.alias("z"))
    return a.withColumn("mass_amu", F.element_at(masses(), F.col("element")))
