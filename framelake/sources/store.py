"""Result collections as Parquet: a small catalogue and long tables, read by profile and by quantity; text tables; registry."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import missing, number
from ..operators.tables import NUMERIC_SHARE, normalised_header
from ..schema import VERSIONS

CODECS = {"fast": "lz4", "balanced": "zstd", "none": "uncompressed"}
DELIMITERS = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|", "space": " "}
#: Units and default labels of each analysis; register_analysis adds to it.
ANALYSES: dict[str, dict] = {k: {"version": v, "units": {}} for k, v in VERSIONS.items()}
FORMATS: dict[str, tuple[Callable, Callable]] = {}


def profile_uid(**key: object) -> str:
    """The same for the same key, in any run."""
    return hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:32]


def register_analysis(name: str, version: int, units: dict[str, str] | None = None) -> None:
    ANALYSES[name] = {"version": version, "units": units or {}}


def analysis(name: str) -> dict:
    """The registered schema, or version 1 without units; spreads have the units of their quantity."""
    found = ANALYSES.get(name, {"version": 1, "units": {}})
    return found | {"units": found["units"] | {f"{k}_{s}": u for k, u in found["units"].items() for s in ("std", "sem")}}


def register_format(name: str, read: Callable, write: Callable) -> None:
    FORMATS[name] = (read, write)


def convert(spark: SparkSession, source: str, target: str, read_as: str, write_as: str) -> None:
    """From one registered format to another."""
    FORMATS[write_as][1](FORMATS[read_as][0](spark, source), target)


for _name in ("parquet", "csv", "json", "orc"):
    register_format(_name, lambda s, p, n=_name: s.read.format(n).options(**({"header": True} if n == "csv" else {})).load(p), lambda d, p, n=_name: d.write.mode("overwrite").format(n).options(**({"header": True} if n == "csv" else {})).save(p))


def write_profiles(profiles: DataFrame, bins: DataFrame, path: str, *, mode: str = "append", compression: str = "balanced") -> None:
    """A catalogue row for each profile and its bins, stored by analysis quantity; profiles that are stored are left out."""
    spark = profiles.sparkSession
    if mode == "append" and exists(spark, f"{path}/profiles"):
        old = spark.read.parquet(f"{path}/profiles").select("profile_uid")
        profiles = profiles.join(old, "profile_uid", "left_anti")
        bins = bins.join(old, "profile_uid", "left_anti")
    # The catalogue comes last: a profile counts once it is listed.
    bins.write.mode(mode).option("compression", CODECS[compression]).partitionBy("quantity").parquet(f"{path}/bins")
    profiles.write.mode(mode).option("compression", CODECS[compression]).parquet(f"{path}/profiles")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_catalogue(spark: SparkSession, path: str, analysis_name: str | None = None, **where: str) -> DataFrame:
    """Headers only; another version than the registered one is an error that asks for recomputation."""
    out = spark.read.parquet(f"{path}/profiles")
    if analysis_name:
        out = out.where(F.col("analysis") == analysis_name)
        wrong = out.where(F.col("schema_version") != analysis(analysis_name)["version"]).limit(1).count()
        if wrong:
            raise ValueError(f"{path} holds another version of {analysis_name}; compute it again")
    for k, v in where.items():
        out = out.where(F.col(k) == v)
    return out


def read_pair(spark: SparkSession, path: str, analysis_name: str, a: str, b: str, *, ordered: bool) -> DataFrame:
    """Profiles of a pair of species, in either order unless ordered."""
    c = read_catalogue(spark, path, analysis_name)
    same = (F.col("species_a") == a) & (F.col("species_b") == b)
    return c.where(same if ordered else same | ((F.col("species_a") == b) & (F.col("species_b") == a)))


def read_bins(spark: SparkSession, path: str, uids: DataFrame, quantities: list[str] | None = None) -> DataFrame:
    """Bins of some profiles; quantities prune folders."""
    out = spark.read.parquet(f"{path}/bins")
    if quantities:
        out = out.where(F.col("quantity").isin(quantities))
    return out.join(uids.select("profile_uid"), "profile_uid", "left_semi")


def read_table(spark: SparkSession, path: str, delimiter: str = "auto", encoding: str = "UTF-8") -> DataFrame:
    """A text table: header with repeated names numbered, missing tokens null, columns of 95 % numbers as doubles."""
    if delimiter == "auto":
        first = spark.read.text(path).first()
        line = first[0] if first else ""
        delimiter = max(DELIMITERS.values(), key=lambda d: (line.count(d), -len(d)))
    sep = DELIMITERS.get(delimiter, delimiter)
    raw = spark.read.csv(path, sep=sep, header=False, encoding=encoding)
    head = spark.read.csv(path, sep=sep, header=True, encoding=encoding)
    names = normalised_header([str(x) if x is not None else "" for x in (raw.first() or [])])
    df = head.toDF(*names) if len(names) == len(head.columns) else raw
    df = df.select(*(F.when(~missing(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) for c in df.columns))
    shares = df.agg(*(F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)), *(F.count(number(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(df.columns))).first()
    numeric = [shares[f"n{i}"] > 0 and shares[f"m{i}"] >= NUMERIC_SHARE * shares[f"n{i}"] for i in range(len(df.columns))]
    return df.select(*(number(F.col(f"`{c}`")).alias(c) if n else F.col(f"`{c}`") for c, n in zip(df.columns, numeric)))


def write_table(df: DataFrame, path: str, delimiter: str = "comma") -> None:
    df.write.mode("overwrite").csv(path, sep=DELIMITERS.get(delimiter, delimiter), header=True)


def discover(spark: SparkSession, path: str, include: str = "*", exclude: str | None = None) -> DataFrame:
    """(path, length, kind) of the files below a folder, by ending; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", include).load(path).select("path", "length")
    kind = F.when(F.col("path").rlike(r"\.(xyz|extxyz|lammpstrj|dump)$"), "trajectory").when(F.col("path").rlike(r"\.cube$"), "cube").when(F.col("path").rlike(r"\.(inp|lmp)$"), "input").when(F.col("path").rlike(r"\.(out|log)$"), "log").when(F.col("path").rlike(r"\.(csv|tsv|temp|tregion)$"), "table").otherwise("other")
    return (files.where(~F.col("path").rlike(exclude)) if exclude else files).withColumn("kind", kind)


def unique_input(files: DataFrame) -> str:
    """The one simulation input of a folder; none or several are an error."""
    found = [r["path"] for r in files.where("kind = 'input'").limit(3).collect()]
    if len(found) != 1:
        raise ValueError(f"expected one simulation input, found {len(found)}")
    return found[0]


def pack(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Several tables under one root with a manifest of their rows."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, spark.read.parquet(f"{path}/{name}").count(), ",".join(df.columns)))
    manifest = spark.createDataFrame(rows, "component string, n_rows long, columns string")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


def component(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def read_members(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The tables of some components behind one another with their place as profile_index; columns that one lacks are null."""
    each = [component(spark, path, n).select(F.lit(i).alias("profile_index"), "*") for i, n in enumerate(names)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def read_records(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A record table, whose columns must have these types; an error if they don't."""
    out = spark.read.parquet(path)
    have = dict(out.dtypes)
    if wrong := [c for c, t in columns.items() if have.get(c) != t]:
        raise ValueError(f"{path} lacks {', '.join(wrong)} as expected; compute it again")
    return out.select(*columns)


def typed(df: DataFrame) -> DataFrame:
    """Text columns of 95 % numbers as doubles; all others as they are. One aggregate."""
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df
    shares = df.agg(*(F.count(F.when(~missing(F.col(c)), 1)).alias(f"n{i}") for i, c in enumerate(text)), *(F.count(number(F.col(c))).alias(f"m{i}") for i, c in enumerate(text))).first()
    numeric = {c for i, c in enumerate(text) if shares[f"n{i}"] > 0 and shares[f"m{i}"] >= NUMERIC_SHARE * shares[f"n{i}"]}
    return df.select(*(number(F.col(c)).alias(c) if c in numeric else F.col(c) for c in df.columns))


def merge_pairs(stored: DataFrame, stored_bins: DataFrame, new: DataFrame, new_bins: DataFrame, rtol: float = 1e-6, atol: float = 1e-8) -> DataFrame:
    """(species_a, species_b, profile_uid, verdict) of new pair profiles: new, same as the stored one of the pair in either order, or different from it."""
    pair = lambda d, uid: d.select(F.least("species_a", "species_b").alias("p"), F.greatest("species_a", "species_b").alias("q"), F.col("profile_uid").alias(uid))
    both = pair(new, "new_uid").join(pair(stored, "old_uid"), ["p", "q"], "left")
    n, o = (b.select(F.col("profile_uid").alias(u), "bin", "quantity", F.col("value").alias(v)) for b, u, v in ((new_bins, "new_uid", "nv"), (stored_bins, "old_uid", "ov")))
    seen = both.where("old_uid is not null")
    left = seen.join(n, "new_uid")
    right = seen.join(o, "old_uid")
    off = F.coalesce(F.abs(F.col("nv") - F.col("ov")) > atol + rtol * F.abs(F.col("ov")), F.lit(True))
    far = left.join(right, ["p", "q", "new_uid", "old_uid", "bin", "quantity"], "full").groupBy("new_uid").agg(F.max(off).alias("differs"))
    verdict = F.when(F.col("old_uid").isNull(), "new").when(F.col("differs"), "different").otherwise("same")
    return both.join(far, "new_uid", "left").select(F.col("p").alias("species_a"), F.col("q").alias("species_b"), F.col("new_uid").alias("profile_uid"), verdict.alias("verdict"))
