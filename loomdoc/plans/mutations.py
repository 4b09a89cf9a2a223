"""Sinks and mutations, each shown on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import mutations as ops
from loomdoc.plans.registry import query
from loomdoc.session import table


def _cart(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_partkey partkey", "l_suppkey suppkey", "cast(l_quantity as bigint) quantity")


@query("""
SELECT k, version, label FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, label DESC) AS r FROM (
SELECT o_custkey AS k, o_orderkey AS version, o_orderstatus AS label FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1)) WHERE r = 1""")
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    old = orders.filter("o_orderkey % 2 = 0").selectExpr("o_custkey k", "o_orderkey version", "o_orderstatus label")
    return ops.upsert(old, orders.filter("o_orderkey % 2 = 1").selectExpr("o_custkey k", "o_orderkey version", "o_orderpriority label"), ["k"], "version")


@query("""
WITH a AS (SELECT l_suppkey AS s, l_partkey AS o, l_discount AS c, 'old' || l_returnflag AS x, 0 AS v FROM lineitem WHERE l_linestatus = 'F'
UNION ALL SELECT l_suppkey, l_partkey, l_discount, 'new' || l_returnflag, 1 FROM lineitem WHERE l_linestatus <> 'F')
SELECT s, o, max(c) AS confidence, (max({'v': v, 'x': x})).x AS context FROM a GROUP BY s, o""")
def upsert_max(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    side = lambda kept, word: rows.filter(kept).selectExpr("l_suppkey s", "l_partkey o", "l_discount confidence", f"concat('{word}', l_returnflag) context")
    return ops.upsert_max(side("l_linestatus = 'F'", "old"), side("l_linestatus <> 'F'", "new"), ["s", "o"], "confidence", "context")


@query("""
SELECT n_name AS name FROM nation UNION ALL
SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment NOT IN (SELECT n_name FROM nation)""")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return ops.insert_ignore(table(spark, sf, "nation").selectExpr("n_name name"), table(spark, sf, "customer").selectExpr("c_mktsegment name"), ["name"])


@query("""SELECT l_partkey AS partkey, l_suppkey AS suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2""")
def insert_or_increment(spark: SparkSession, sf: str) -> DataFrame:
    cart = _cart(spark, sf)
    return ops.increment(cart.filter("partkey % 2 = 0"), cart.filter("partkey % 2 = 1"), ["partkey", "suppkey"], "quantity")


@query("""
SELECT c_custkey AS custkey, coalesce(p.name, c_name) AS name, coalesce(p.segment, c_mktsegment) AS segment FROM customer
LEFT JOIN (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'CHANGED' END AS segment FROM supplier) p ON p.k = c_custkey""")
def partial_update(spark: SparkSession, sf: str) -> DataFrame:
    changes = table(spark, sf, "supplier").selectExpr("s_suppkey custkey", "s_name name", "if(s_nationkey % 2 = 0, 'CHANGED', null) segment")
    return ops.patch(table(spark, sf, "customer").selectExpr("c_custkey custkey", "c_name name", "c_mktsegment segment"), changes, "custkey")


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN NOT coalesce(f, false) ELSE f END AS favorite FROM (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS f FROM documents)""")
def toggle_flag(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").selectExpr("doc_id", "lang", "CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END favorite")
    return ops.toggle(docs, "favorite", F.col("lang") == "de").select("doc_id", "favorite")


@query("""
SELECT l_orderkey AS orderkey, l_linenumber AS line FROM lineitem WHERE l_orderkey NOT IN
(SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)""")
def cascade_purge(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "customer").selectExpr("*", "if(c_acctbal < 0, timestamp'2024-01-01', null) deleted_at")
    levels = (table(spark, sf, "orders"), "o_orderkey", "o_custkey"), (table(spark, sf, "lineitem"), "l_orderkey", "l_orderkey")
    return ops.purge(parents, "c_custkey", *levels)[2].selectExpr("l_orderkey orderkey", "l_linenumber line")


@query("""SELECT p_partkey AS partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 UNION SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)""")
def delete_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return ops.delete_orphans(table(spark, sf, "part").selectExpr("p_partkey partkey"), "partkey", table(spark, sf, "lineitem").filter("l_quantity = 50"), ["l_partkey", "l_suppkey"])


@query("""
WITH m AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id), n AS (SELECT doc_id % 50 AS conv_id, doc_id FROM documents)
SELECT n.conv_id, n.doc_id, coalesce(m, -1) + row_number() OVER (PARTITION BY n.conv_id ORDER BY n.doc_id) AS turn FROM n LEFT JOIN m ON m.conv_id = n.conv_id""")
def next_sequence(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "documents").selectExpr("doc_id % 50 conv_id", "doc_id")
    return ops.next_sequence(table(spark, sf, "conversations"), new, ["conv_id"], "turn", ["doc_id"])


@query("""SELECT n_name AS name, CASE n_nationkey WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 11 THEN 2 ELSE n_nationkey END AS position FROM nation""")
def ordered_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    return ops.reorder(table(spark, sf, "nation").withColumn("position", F.col("n_nationkey")), "n_nationkey", [7, 3, 11], "position").selectExpr("n_name name", "position")


@query("""SELECT user_id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS r FROM events) WHERE r = 1""")
def guarded_state(spark: SparkSession, sf: str) -> DataFrame:
    return ops.current_state(table(spark, sf, "events"), ["user_id"], "ts", "event_type").withColumnRenamed("event_type", "state")


@query("""
SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY event_type
UNION ALL SELECT 'TOTAL', count(*), CAST(sum(user_id) AS BIGINT) FROM events""")
def export_with_total(spark: SparkSession, sf: str) -> DataFrame:
    detail = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("total"))
    return ops.with_total(detail, "event_type")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kept FROM events WHERE user_id % 5 <> 0""")
def bulk_delete_and_key_removal(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").filter(~(F.col("user_id") % 5 == 0))
    data = rows.withColumn("data", F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.lit("x").alias("summary")))
    return data.withColumn("data", F.col("data").dropFields("summary")).select("event_id", F.col("data.k").alias("kept"))


@query("""SELECT c_custkey AS custkey, count(o_orderkey) AS usage_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def counter_refresh(spark: SparkSession, sf: str) -> DataFrame:
    from loomdoc.operators.relational import with_count

    return with_count(table(spark, sf, "customer").selectExpr("c_custkey custkey"), "custkey", table(spark, sf, "orders"), "o_custkey", "usage_count")
