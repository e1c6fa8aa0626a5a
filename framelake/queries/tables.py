from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import tables
from . import query

SE = A.SERIES_SQL
T = A.table


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 5000")
def p11_filter_ge(spark, sf_dir):
    return tables.filter_table(T(spark, sf_dir, "customer"), "c_acctbal", "ge", "5000").select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey <> 2 OR n_regionkey IS NULL")
def p11_filter_ne(spark, sf_dir):
    return tables.filter_table(T(spark, sf_dir, "nation"), "n_regionkey", "ne", "2").select("n_nationkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'a')")
def p12_filter_contains(spark, sf_dir):
    return tables.filter_table(T(spark, sf_dir, "part"), "p_type", "contains", "A").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '(?i)brand.?[12]')")
def p12_filter_regex(spark, sf_dir):
    return tables.filter_table(T(spark, sf_dir, "part"), "p_brand", "regex", "brand.?[12]").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'B') = false")
def p13_invert(spark, sf_dir):
    return tables.filter_table(T(spark, sf_dir, "customer"), "c_mktsegment", "startswith", "B", case_sensitive=True, invert=True).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(lower(o_orderpriority) IN ('1-urgent', '2-high'), false)")
def p13_not_in(spark, sf_dir):
    return tables.filter_table(T(spark, sf_dir, "orders"), "o_orderpriority", "not-in", "1-URGENT, 2-HIGH").select("o_orderkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment) DESC NULLS FIRST, c_custkey) AS place FROM customer")
def o1_sort(spark, sf_dir):
    from pyspark.sql import Window as W

    c = T(spark, sf_dir, "customer")
    keys = tables.sort_keys(c, ["c_mktsegment"], descending=True, nulls="first", row_id="c_custkey")
    return c.select("c_custkey", F.row_number().over(W.orderBy(*keys)).cast("long").alias("place"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 12")
def o2_tail(spark, sf_dir):
    return tables.preview(T(spark, sf_dir, "orders"), 12, "o_orderkey", tail=True).select("o_orderkey", "o_custkey")


@query(f"WITH {SE} SELECT kind, count(*) AS n FROM series GROUP BY kind ORDER BY n DESC, kind LIMIT 5")
def o7_top_values(spark, sf_dir):
    return tables.top_values(A.series(spark, sf_dir), "kind")


@query("SELECT name, row_number() OVER (ORDER BY TRY_CAST(name AS BIGINT) NULLS LAST, name) AS place FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE n_nationkey::VARCHAR END AS name FROM nation)")
def o8_natural_order(spark, sf_dir):
    from pyspark.sql import Window as W

    from ..functions.text import natural_key

    n = T(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.col("n_nationkey").cast("string")).alias("name"))
    return n.select("name", F.row_number().over(W.orderBy(*natural_key(F.col("name")))).cast("long").alias("place"))


@query("SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderstatus")
def u4_dedupe_first(spark, sf_dir):
    return tables.dedupe(T(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_orderkey")


@query("SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) = 1")
def u4_dedupe_none(spark, sf_dir):
    return tables.dedupe(T(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey", "none").select("o_orderkey")


@query("SELECT 0 AS source_order, s_suppkey AS key, row_number() OVER (ORDER BY s_suppkey) - 1 AS new_frame_index FROM supplier UNION ALL SELECT 1, n_nationkey, (SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY n_nationkey) - 1 FROM nation")
def u1_union_sources(spark, sf_dir):
    a = T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    b = T(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"))
    return tables.union_sources([a, b], "key").select("source_order", "key", "new_frame_index")


@query("SELECT 'orders' AS source, o_custkey AS id, o_totalprice AS value FROM orders UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer")
def u3_profile_union(spark, sf_dir):
    a = T(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"))
    return a.unionByName(T(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")))


@query("SELECT DISTINCT sha256(o_orderstatus || ',' || o_orderpriority) AS state FROM orders")
def u6_distinct_states(spark, sf_dir):
    return T(spark, sf_dir, "orders").select(F.sha2(F.concat_ws(",", "o_orderstatus", "o_orderpriority"), 256).alias("state")).distinct()


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def u8_count_repeats(spark, sf_dir):
    return tables.count_repeats(T(spark, sf_dir, "orders"), "o_orderpriority")


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count({v}) AS non_null, count(*) - count({v}) AS missing, count(DISTINCT {v}) AS distinct_values, count(TRY_CAST({v}::VARCHAR AS DOUBLE))::DOUBLE / count({v}) AS numeric_ratio FROM customer"
    for c, v in (("c_custkey", "c_custkey"), ("c_name", "c_name"), ("c_nationkey", "c_nationkey"), ("c_acctbal", "c_acctbal"), ("c_mktsegment", "c_mktsegment"))
)


@query(_PROFILE)
def a22_profile_columns(spark, sf_dir):
    return tables.profile(T(spark, sf_dir, "customer"))


@query("""SELECT o_orderstatus, count(o_totalprice) AS n, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 3) AS std,
  round(quantile_cont(o_totalprice, 0.05), 4) AS q05, round(quantile_cont(o_totalprice, 0.95), 4) AS q95, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr FROM orders GROUP BY 1""")
def a23_numeric_statistics(spark, sf_dir):
    out = tables.numeric_statistics(T(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"])
    return out.select("o_orderstatus", "n", "min_value", "max_value", *(F.round(c, 3 if c == "std" else 4).alias(c) for c in ("mean", "median", "std", "q05", "q95", "iqr")))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def a24_categorical_statistics(spark, sf_dir):
    return tables.top_values(T(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT count(x) AS n, round(quantile_cont(x, 0.05), 6) AS q05, round(median(x), 6) AS median, round(quantile_cont(x, 0.95), 6) AS q95, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM (SELECT CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END AS x FROM lineitem)")
def a23_column_quantiles(spark, sf_dir):
    x = F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice"))
    out = tables.numeric_statistics(T(spark, sf_dir, "lineitem").select(x.alias("x")), "x")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("q05", "median", "q95", "iqr")))
