from pyspark.sql import functions as F

from .. import adapters as A
from .. import streaming as S
from ..shared import place
from . import query

T = A.table


def stream(spark, sf_dir, name):
    """A table's files read as a stream; a table that is one file is picked from its folder."""
    batch = T(spark, sf_dir, name)
    reader = spark.readStream.schema(batch.schema)
    if all(f.endswith(f"/{name}.parquet") for f in batch.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT least(greatest(floor(l_extendedprice / 5000.0)::INT, 0), 19) AS bin, sum(l_quantity::BIGINT)::BIGINT AS weight, count(*) AS n FROM lineitem GROUP BY 1")
def t4_streaming_histogram(spark, sf_dir):
    from ..operators.histogram import bin_index

    return S.drained(S.binned(stream(spark, sf_dir, "lineitem"), bin_index(F.col("l_extendedprice"), 0.0, 5000.0, 20), {"weight": F.sum(F.col("l_quantity").cast("long")), "n": F.count("*")}))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def t4_tumbling_windows(spark, sf_dir):
    w = S.windowed(stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", by=["event_type"], n=F.count("*"), cents=F.sum(F.round(F.col("value") * 100).cast("long")))
    return S.drained(w).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


@query("WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, true)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.s")
def t4_sessions(spark, sf_dir):
    w = S.sessions(stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["user_id"], n=F.count("*"))
    return S.drained(w).select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id FROM events WHERE value BETWEEN 100 AND 200")
def t3_streaming_filter(spark, sf_dir):
    return S.drained(S.spatial_filter(stream(spark, sf_dir, "events"), [("value", 100.0, 200.0)]).select("event_id"), "append")


@query("SELECT DISTINCT user_id FROM events")
def t6_incremental_append(spark, sf_dir):
    path = place(spark, "records")
    for _ in range(2):  # a restart adds nothing
        S.append_records(stream(spark, sf_dir, "events").select("user_id"), f"{path}/out", "user_id", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT event_id, user_id, event_type FROM events WHERE value > 50")
def t5_streaming_csv(spark, sf_dir):
    path = place(spark, "lines")
    rows = stream(spark, sf_dir, "events").where("value > 50").select("event_id", "user_id", "event_type")
    for _ in range(2):  # a restart writes nothing twice
        S.csv_writer(rows, f"{path}/out", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.csv(f"{path}/out", header=True, schema="event_id long, user_id long, event_type string")
