"""Generic tables: filter, sort, distinct, preview, profile, union, append."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import missing
from ..shared import cut

NUMERIC_SHARE = 0.95
COMPARE = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__"}


def numeric(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast("double")


def is_numeric(frame: DataFrame, column: str) -> bool:
    """Whether at least 95 % of the values that aren't missing are numbers; one aggregate."""
    if dict(frame.dtypes)[column] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return True
    c = F.col(column)
    some, n = frame.agg(F.count(F.when(~missing(c), 1)), F.count(F.when(~missing(c), numeric(c)))).first()
    return some > 0 and n >= NUMERIC_SHARE * some


def filter_table(frame: DataFrame, column: str, operator: str, value: str, *, case_sensitive: bool = False, invert: bool = False) -> DataFrame:
    """Rows that a comparison, a text predicate or a set predicate keeps.

    gt, ge, lt and le compare numbers, eq and ne where the column is numeric and the value a number. Missing values: ne
    and not-in keep them (ne on text read as numbers drops them), all others drop them, and invert keeps what was dropped.
    """
    c = F.col(column)
    text = c.cast("string") if case_sensitive else F.lower(c.cast("string"))
    want = value if case_sensitive else value.lower()
    stored = dict(frame.dtypes)[column] != "string"
    if operator in COMPARE:
        try:
            x: float | None = float(value)
        except ValueError:
            x = None
        if operator not in ("eq", "ne") and x is None:
            raise ValueError(f"{operator} needs a number, not {value!r}")
        if x is not None and (operator not in ("eq", "ne") or is_numeric(frame, column)):
            n = numeric(c)
            mask = getattr(n, COMPARE[operator])(x)
            mask = F.coalesce(mask, F.lit(operator == "ne" and stored))
        else:
            mask = F.coalesce(getattr(text, COMPARE[operator])(want), F.lit(operator == "ne"))
    elif operator in ("contains", "startswith", "endswith"):
        mask = F.coalesce(getattr(text, operator)(want), F.lit(False))
    elif operator == "regex":
        mask = F.coalesce(c.cast("string").rlike(value if case_sensitive else f"(?i){value}"), F.lit(False))
    elif operator in ("in", "not-in"):
        inside = F.coalesce(text.isin([v.strip() for v in want.split(",")]), F.lit(False))
        mask = inside if operator == "in" else ~inside
    else:
        raise ValueError(f"unknown operator {operator!r}")
    return frame.where(~mask if invert else mask)


def sort_keys(frame: DataFrame, columns: list[str], *, descending: bool = False, nulls: str = "last", row_id: str | None = None) -> list[Column]:
    """Order of a table: numbers for numeric columns, else text without case; ties by row_id, ascending."""
    out = []
    for c in columns:
        k = numeric(F.col(c)) if is_numeric(frame, c) else F.lower(F.col(c).cast("string"))
        out.append(getattr(k, f"{'desc' if descending else 'asc'}_nulls_{nulls}")())
    return out + ([F.col(row_id).asc()] if row_id else [])


def sort_table(frame: DataFrame, columns: list[str], **options) -> DataFrame:
    return frame.orderBy(*sort_keys(frame, columns, **options))


def preview(frame: DataFrame, n: int, row_id: str, *, tail: bool = False) -> DataFrame:
    """The first or last rows; a top-n of each partition, not a sort of the table."""
    return frame.orderBy(F.col(row_id).desc() if tail else F.col(row_id)).limit(n)


def dedupe(frame: DataFrame, subset: list[str], row_id: str, keep: str = "first") -> DataFrame:
    """One row of each key: the first, the last, or (none) only keys that stand once; combined before the shuffle."""
    one = F.min(row_id) if keep == "first" else F.max(row_id)
    keys = frame.groupBy(*subset).agg(one.alias(row_id), F.count("*").alias("_n"))
    keys = keys.where("_n = 1") if keep == "none" else keys
    on = [frame[row_id] == keys[row_id]]
    return frame.join(keys.select(row_id), on, "left_semi")


def profile(frame: DataFrame) -> DataFrame:
    """(column, rows, non_null, missing, distinct_values, numeric_ratio) of every column, in one pass."""
    aggs = []
    for i, c in enumerate(frame.columns):
        v = F.col(c)
        gone = missing(v) if dict(frame.dtypes)[c] == "string" else v.isNull()
        aggs += [F.count(F.when(~gone, 1)).alias(f"n{i}"), F.count_distinct(F.when(~gone, v)).alias(f"d{i}"), F.count(F.when(~gone, numeric(v))).alias(f"m{i}")]
    one = frame.agg(F.count("*").alias("rows"), *aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("non_null"), (F.col("rows") - F.col(f"n{i}")).alias("missing"), F.col(f"d{i}").alias("distinct_values"), F.try_divide(F.col(f"m{i}").cast("double"), F.col(f"n{i}")).alias("numeric_ratio")) for i, c in enumerate(frame.columns)))
    return one.select(F.inline(rows))


def numeric_statistics(frame: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, min, max, mean, median, std, var, sum, quartiles, 5th and 95th percentile, iqr; linear interpolation.

    Quantiles of a whole column come from the ranks of its values, which no task sees at once; those of groups from a
    state with each group's distinct values.
    """
    x = numeric(F.col(column))
    named = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
    sums = [F.count(x).alias("n"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("var"), F.sum(x).alias("total")]
    if by:
        out = frame.groupBy(*by).agg(*sums, *(F.percentile(x, F.lit(p)).alias(k) for k, p in named.items()))
    else:
        whole = frame.agg(*sums)
        ranked = numbered(frame.select(x.alias("x")).where("x is not null"), ["x"], "rank").join(F.broadcast(whole.select("n")))  # one row
        share = lambda p: F.greatest(F.lit(0.0), 1 - F.abs(F.col("rank") - (F.col("n") - 1) * p))
        near = ranked.where(reduce(lambda a, b: a | b, (share(p) > 0 for p in named.values())))
        out = whole.join(F.broadcast(near.agg(*(F.sum(F.col("x") * share(p)).alias(k) for k, p in named.items()))))  # one row
    return out.withColumn("iqr", F.col("q75") - F.col("q25"))


def top_values(frame: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The most frequent values; ties by value."""
    return frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def union_sources(frames: list[DataFrame], order: str) -> DataFrame:
    """Sources behind one another with a new frame_index and their number as source_order; columns that a source lacks are null."""
    numbered = [f.withColumn("source_order", F.lit(i)) for i, f in enumerate(frames)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    sizes = out.groupBy("source_order").agg(F.count("*").alias("_n"))  # a row for each source
    before = sizes.select("source_order", F.coalesce(F.sum("_n").over(W.orderBy("source_order").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("source_order").orderBy(order)) - 1
    return out.withColumn("_own", own).join(before, "source_order").withColumn("new_frame_index", (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before")


def numbered(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in order, without a task that sees them all: ranges are sorted side by side and counted first."""
    ranged = cut(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def append_new(stored: DataFrame, new: DataFrame, key: str, record_id: str = "record_id") -> DataFrame:
    """The rows of new sources, numbered on from the largest id stored; sources that are stored are skipped."""
    fresh = numbered(new.join(stored.select(key), key, "left_anti"), [key], "_rank")
    top = stored.agg(F.coalesce(F.max(record_id), F.lit(-1)).alias("_top"))  # one row
    return fresh.join(F.broadcast(top)).withColumn(record_id, (F.col("_top") + F.col("_rank") + 1).cast("long")).drop("_rank", "_top")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], uid: str | None = None) -> DataFrame:
    """Stored rows replaced by new ones of the same key, which keep the stored uid."""
    if uid:
        old = stored.select(*keys, F.col(uid).alias("_uid"))
        new = new.join(old, keys, "left").withColumn(uid, F.coalesce("_uid", uid)).drop("_uid")
    return stored.join(new, keys, "left_anti").unionByName(new)


def normalised_header(names: list[str]) -> list[str]:
    """Trimmed names, repeated ones with _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in (x.strip() or "column" for x in names):
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def count_repeats(frame: DataFrame, column: str) -> DataFrame:
    """Each distinct message with its count."""
    return frame.groupBy(column).agg(F.count("*").alias("n"))
