"""Implicit windows of the application code, and the batch form of stateful streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.plans.registry import query
from loomdoc.session import table
from loomdoc.streaming import limits


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def distinct_on_first(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf, "documents").withColumn("r", F.row_number().over(by)).filter("r = 1").select("source", "doc_id")


@query("""SELECT conv_id, turn, length(text) - lag(length(text)) OVER w AS step, lead(length(text)) OVER w AS next_length FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def adjacent_difference(spark: SparkSession, sf: str) -> DataFrame:
    by, n = Window.partitionBy("conv_id").orderBy("turn"), F.length("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", (n - F.lag(n).over(by)).alias("step"), F.lead(n).over(by).alias("next_length"))


@query("""SELECT conv_id, turn, string_agg(role, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS around FROM conversations""")
def sliding_window(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 2)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(by), " ").alias("around"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events""")
def running_header(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(by)
    return table(spark, sf, "events").select("user_id", "event_id", header.alias("header"))


@query("""
WITH b AS (SELECT lang, min(n_chars) AS lo, max(n_chars) AS hi FROM documents WHERE n_chars > 0 GROUP BY lang)
SELECT doc_id, round(CASE WHEN n_chars <= 0 THEN 0 WHEN hi = lo THEN 1 ELSE (n_chars - lo) / CAST(hi - lo AS DOUBLE) END, 6) AS norm FROM documents d JOIN b ON b.lang = d.lang""")
def minmax_normalise(spark: SparkSession, sf: str) -> DataFrame:
    docs, n = table(spark, sf, "documents"), F.col("n_chars")
    bounds = docs.filter("n_chars > 0").groupBy("lang").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    norm = F.when(n <= 0, 0.0).when(F.col("hi") == F.col("lo"), 1.0).otherwise((n - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return docs.join(bounds, "lang").select("doc_id", F.round(norm, 6).alias("norm"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def tumbling_window(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.date_format(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"], "yyyy-MM-dd HH:mm")
    return table(spark, sf, "events").groupBy(hour.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""
SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M') AS start, count(*) AS n
FROM events, (VALUES (0), (1)) v(o) GROUP BY 1""")
def sliding_time_window(spark: SparkSession, sf: str) -> DataFrame:
    start = F.date_format(F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes")["start"], "yyyy-MM-dd HH:mm")
    return table(spark, sf, "events").groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begin, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n")


@query(None)
def fixed_window_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Each call's window, count, and whether it is let through: 3 calls in the day that a key's first call opens."""
    return limits.batch(table(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")), "user_id", "event_id", "at", seconds=86_400, limit=3)


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY 1, 2""")
def first_seen_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
