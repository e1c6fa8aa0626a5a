"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints that differ in at most 2 bits have a segment in which they
differ in at most 1, so each fingerprint looks up its own segments and all segments one bit away in the tables of the
other fingerprints, and the full distance of what it finds is verified inside the join. Lookups are made once for each
distinct fingerprint, whatever the number of copies.

A segment value that very many distinct fingerprints share would make the lookups quadratic. The fingerprints that look
into such a bucket are linked through pivots instead: every 64-bit value within 1 bit of a fingerprint is a pivot, two
fingerprints within 2 bits share one, and two that share one are within 2 bits. That is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, fresh, reused, row_and_text, row_struct
from .components import components

SHINGLE, DISTANCE, SEGMENTS, SEED = 3, 2, 2, 42
#: Buckets with more distinct fingerprints than this are linked through pivots.
BUCKET = 64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; zero for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for a in range(0, n, 1 << 16):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + (1 << 16)], ends[a : a + (1 << 16)])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def majority(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fingerprints of sets of 64-bit hashes that stand behind one another: a bit is 1 if it is in over half of the set."""
    out = np.zeros(len(begin), np.uint64)
    for i in range(64):
        ones = np.add.reduceat((h >> np.uint64(i)) & np.uint64(1), begin)
        out |= (2 * ones.astype(np.int64) > size).astype(np.uint64) << np.uint64(i)
    return out


def fingerprints(docs: DataFrame, *, keep: list[str]) -> DataFrame:
    """The columns `keep` and the fingerprint `fp` (long). Null text: empty."""
    name = fresh("fp", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(row_and_text(batches, keep)):
            fp = pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.record_batch([b.column(0), fp], ["row", "fp"])

    inner = row_struct(docs, keep)
    out = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}, fp long")
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("fp").alias(name))


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * i).bitwiseAND(0xFFFFFFFF)


def links(fps: DataFrame, count: int) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints `fp`, about `count` of them, within DISTANCE bits."""
    fp = F.col("fp")
    rows = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), segment(fp, i).alias("value")) for i in range(SEGMENTS)))).alias("s"))
    rows = rows.select("fp", "s.seg", "s.value")
    hot = cut(rows.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("seg", "value"), count // max(BUCKET, 1))
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(32)))
    probes = rows.select(F.col("fp").alias("u"), "seg", F.explode(F.transform(ball, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    table = rows.join(hot, ["seg", "value"], "left_anti").withColumnRenamed("fp", "v")
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    p, t = probes.alias("p"), table.alias("t")
    found = p.join(t, (F.col("p.seg") == F.col("t.seg")) & (F.col("p.value") == F.col("t.value")) & (F.col("u") != F.col("v")) & (apart <= DISTANCE))
    edges = found.select("u", "v")
    if hot.isEmpty():
        return edges
    one = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    pivoted = probes.join(hot, ["seg", "value"], "left_semi").select("u").distinct()
    pivots = pivoted.select("u", F.explode(F.transform(one, lambda m: F.col("u").bitwiseXOR(m))).alias("pivot"))
    least = pivots.groupBy("pivot").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1")  # at most 65 share one
    return edges.unionByName(pivots.join(least, "pivot").where("u <> v").select("u", "v"))


def groups(fps: DataFrame) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of rows (doc_id, fp): the smallest doc_id that is reachable.

    Documents without an id take part in links but never give an id; a component of such documents alone has null.
    """
    each = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), fps.count(), each=20_000)
    n = each.count()
    of = components(links(each.select("fp"), n), 2 * n)
    named = each.join(of, each["fp"] == of["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.when(F.col("least").isNull(), F.col("fp"))).alias("nameless"))
    return named.join(ids, "root").select("fp", "least", "component_id", "nameless")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null text: no words, fingerprint zero, linked like any other. Repeated rows are in one component and all returned.
    An empty table gives an empty frame. Other columns are not read.
    """
    fps = reused(fingerprints(docs, keep=["doc_id"]))
    out = fps.join(groups(fps).select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest id (of any, where no document has one)."""
    name, mark = fresh("fp", docs.columns), fresh("id_key", docs.columns)
    rows = fingerprints(docs, keep=docs.columns)
    named = groups(reused(fingerprints(docs, keep=["doc_id"])))
    chosen = named.where((F.col("least") == F.col("component_id")) | (F.col("component_id").isNull() & (F.col("fp") == F.col("nameless"))))
    chosen = chosen.select(F.col("fp").alias(name), F.coalesce(F.col("component_id").cast("string"), F.lit("")).alias(mark))
    rows = rows.withColumn(mark, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return rows.join(chosen, [mark, name], "left_semi").dropDuplicates([mark, name]).select(*docs.columns)
