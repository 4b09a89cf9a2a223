"""Joins, aggregations, paging and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.operators import relational as ops
from loomdoc.plans.registry import query
from loomdoc.session import table

# ---- joins


@query("""
SELECT l.l_orderkey AS orderkey, l.l_linenumber AS line, c.c_name AS customer, l.l_extendedprice AS price
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 1000 AND l.l_quantity >= 30""")
def star_join_filter(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "lineitem").filter("l_quantity >= 30")
    orders = table(spark, sf, "orders").filter("o_totalprice > 1000")
    buyers = ops.where(table(spark, sf, "customer"), c_mktsegment="BUILDING")
    star = facts.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return star.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("c_name").alias("customer"), F.col("l_extendedprice").alias("price"))


@query("""
SELECT a.n_name AS buyer_nation, b.n_name AS seller_nation, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2""")
def dim_twice_join(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    a, b = nation.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("buyer_nation")), nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("seller_nation"))
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").count()
    return rows.join(a, F.col("c_nationkey") == F.col("a")).join(b, F.col("s_nationkey") == F.col("b")).groupBy("buyer_nation", "seller_nation").agg(F.sum("count").alias("n"))


@query("""
SELECT l_orderkey AS orderkey, l_linenumber AS line, p_name AS part, s_name AS supplier, c_name AS customer, o_orderpriority AS priority
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey WHERE l_quantity = 50""")
def four_dim_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").filter("l_quantity = 50")
    for name, on in (("part", "l_partkey = p_partkey"), ("supplier", "l_suppkey = s_suppkey"), ("orders", "l_orderkey = o_orderkey"), ("customer", "o_custkey = c_custkey")):
        rows = rows.join(table(spark, sf, name), F.expr(on))
    return rows.selectExpr("l_orderkey orderkey", "l_linenumber line", "p_name part", "s_name supplier", "c_name customer", "o_orderpriority priority")


@query("""
SELECT c_custkey AS custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts
FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey""")
def left_join_distinct_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.expr("c_custkey = o_custkey"), "left").join(table(spark, sf, "lineitem"), F.expr("o_orderkey = l_orderkey"), "left")
    return rows.groupBy(F.col("c_custkey").alias("custkey")).agg(F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("""
SELECT c_custkey AS custkey, count(o_orderkey) AS open_orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey""")
def left_join_on_predicate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.expr("c_custkey = o_custkey AND o_orderstatus = 'O'"), "left")
    return rows.groupBy(F.col("c_custkey").alias("custkey")).agg(F.count("o_orderkey").alias("open_orders"))


@query("""
SELECT DISTINCT p_brand AS brand, s_name AS supplier FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size <= 5""")
def bridge_join(spark: SparkSession, sf: str) -> DataFrame:
    bridge = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    rows = table(spark, sf, "part").filter("p_size <= 5").join(bridge, F.expr("p_partkey = l_partkey")).join(table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey"))
    return rows.select(F.col("p_brand").alias("brand"), F.col("s_name").alias("supplier")).distinct()


@query("""
SELECT k.x AS node, count(*) AS touching FROM (SELECT l_partkey % 97 AS a, l_suppkey % 97 AS b FROM lineitem) e
JOIN (SELECT CAST(n_nationkey AS BIGINT) AS x FROM nation) k ON e.a = k.x OR e.b = k.x GROUP BY k.x""")
def or_join_as_union(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").selectExpr("l_partkey % 97 a", "l_suppkey % 97 b")
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return ops.join_either(edges.groupBy("a", "b").count(), nodes, "a", "b", "node").groupBy("node").agg(F.sum("count").alias("touching"))


@query("""
SELECT c_custkey AS custkey, c_name AS name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.expr("c_custkey = o_custkey"), "left_semi").selectExpr("c_custkey custkey", "c_name name")


@query("""
SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN
(SELECT o_custkey FROM orders WHERE o_totalprice > 200000 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def anti_not_in_union(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    out = orders.filter("o_totalprice > 200000").select("o_custkey").union(orders.filter("o_orderstatus = 'P'").select("o_custkey"))
    return ops.not_in(table(spark, sf, "customer").selectExpr("c_custkey custkey"), "custkey", out, "o_custkey")


@query("""
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""")
def lateral_latest_turn(spark: SparkSession, sf: str) -> DataFrame:
    return ops.latest(table(spark, sf, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", "text")


@query("""
SELECT r_name AS region, (SELECT count(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS nations,
(SELECT count(*) FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = r.r_regionkey) AS customers FROM region r""")
def correlated_counts(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    counted = ops.with_count(region, "r_regionkey", nation, "n_regionkey", "nations")
    buyers = nation.join(table(spark, sf, "customer"), F.expr("n_nationkey = c_nationkey"))
    return ops.with_count(counted, "r_regionkey", buyers, "n_regionkey", "customers").selectExpr("r_name region", "nations", "customers")


@query("""
WITH seen AS (SELECT conv_id, min(turn) AS last_read FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, count(*) FILTER (WHERE s.last_read IS NULL OR c.turn > s.last_read) AS unread FROM conversations c LEFT JOIN seen s ON s.conv_id = c.conv_id GROUP BY c.conv_id""")
def unread_counts(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    seen = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("last_read"))
    return turns.join(seen, "conv_id", "left").groupBy("conv_id").agg(F.count_if(F.col("last_read").isNull() | (F.col("turn") > F.col("last_read"))).alias("unread"))


@query("""
WITH p AS (SELECT doc_id AS k, lower(text) AS a, n_chars AS b FROM documents WHERE doc_id % 7 <> 0),
s AS (SELECT doc_id AS k, text AS a, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars END AS b FROM documents)
SELECT count(*) AS rows_parsed, count(*) FILTER (WHERE s.k IS NULL) AS missing, count(*) FILTER (WHERE s.a <> p.a) AS text_differs,
count(*) FILTER (WHERE s.b <> p.b) AS size_differs FROM p LEFT JOIN s ON p.k = s.k""")
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    parsed = docs.filter("doc_id % 7 <> 0").selectExpr("doc_id k", "lower(text) text", "n_chars size")
    stored = docs.selectExpr("doc_id k", "text", "if(doc_id % 11 = 0, 0, n_chars) size")
    return ops.reconcile(parsed, stored, "k", ["text", "size"])


@query("""
WITH m AS (SELECT conv_id, turn FROM conversations), r AS (SELECT conv_id, role, max(turn) AS last_read FROM conversations GROUP BY conv_id, role)
SELECT m.conv_id, m.turn, (SELECT count(*) FROM r WHERE r.conv_id = m.conv_id) - (SELECT count(*) FROM r WHERE r.conv_id = m.conv_id AND r.last_read >= m.turn) AS unread FROM m""")
def read_receipts(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    marks = turns.groupBy("conv_id", "role").agg(F.max("turn").alias("last_read")).groupBy("conv_id").agg(F.collect_list("last_read").alias("marks"))
    return turns.join(marks, "conv_id").select("conv_id", "turn", F.size(F.filter("marks", lambda x: x < F.col("turn"))).cast("long").alias("unread"))


@query("""
SELECT l_orderkey AS orderkey FROM lineitem GROUP BY l_orderkey
HAVING count(DISTINCT l_returnflag) = 2 AND sum(CASE WHEN l_returnflag IN ('A', 'N') THEN 0 ELSE 1 END) = 0""")
def relational_division(spark: SparkSession, sf: str) -> DataFrame:
    return ops.exactly_members(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N"]).withColumnRenamed("l_orderkey", "orderkey")


@query("""SELECT l_orderkey AS orderkey, l_linenumber AS line, p_name AS product_name, p_retailprice AS product_price FROM lineitem JOIN part ON l_partkey = p_partkey""")
def nested_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _nested(spark, sf, table(spark, sf, "lineitem"))


def _nested(spark: SparkSession, sf: str, items: DataFrame) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")).alias("product"))
    rows = items.join(parts, F.expr("l_partkey = p_partkey"))
    return rows.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("product.name").alias("product_name"), F.col("product.price").alias("product_price"))


@query("""
SELECT r_name AS region, coalesce(max(n_name), 'none') AS last_nation, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS buyers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c ON c_nationkey = n_nationkey GROUP BY r_name""")
def lookup_with_defaults(spark: SparkSession, sf: str) -> DataFrame:
    buyers = table(spark, sf, "customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf, "region").join(table(spark, sf, "nation"), F.expr("n_regionkey = r_regionkey"), "left").join(buyers, F.expr("c_nationkey = n_nationkey"), "left")
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.coalesce(F.max("n_name"), F.lit("none")).alias("last_nation"), F.coalesce(F.sum("n"), F.lit(0)).alias("buyers"))


@query("""
WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1993-01-01' GROUP BY 1),
b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate > TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS partkey, coalesce(a.n, 0) AS early, coalesce(b.n, 0) AS late FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    a = rows.filter("l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1993-01-01'").groupBy(F.col("l_partkey").alias("partkey")).agg(F.count(F.lit(1)).alias("early"))
    b = rows.filter("l_returnflag = 'A' AND l_shipdate > TIMESTAMP '1998-01-01'").groupBy(F.col("l_partkey").alias("partkey")).agg(F.count(F.lit(1)).alias("late"))
    return a.join(b, "partkey", "full_outer").fillna(0)


# ---- aggregations


@query("""
SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low,
count(DISTINCT user_id) AS users, round(coalesce(sum(value) FILTER (WHERE user_id % 2 = 0), 0), 4) AS even_value FROM events GROUP BY event_type""")
def usage_by_provider(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(v > 50).alias("high"), F.count_if(v <= 50).alias("low"), F.count_distinct("user_id").alias("users"),
        F.round(F.coalesce(F.sum(F.when(F.col("user_id") % 2 == 0, v)), F.lit(0.0)), 4).alias("even_value"),
    )


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2, 3""")
def usage_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")).orderBy(F.desc("n"), "flag", "status", "line")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_trend(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT 'today' AS period, count(*) AS n, round(coalesce(sum(value), 0), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21'
UNION ALL SELECT 'yesterday', count(*), round(coalesce(sum(value), 0), 4) FROM events WHERE ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-20'""")
def period_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return ops.compare_periods(table(spark, sf, "events"), "ts", "value", "2024-01-20")


@query("""
WITH u AS (SELECT event_type, count(*) AS used FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1),
k AS (SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 10 ELSE 100000 END AS cap FROM events)
SELECT k.event_type, coalesce(used, 0) AS used, (cap = 0 OR coalesce(used, 0) < cap) AS allowed FROM k LEFT JOIN u ON u.event_type = k.event_type""")
def daily_limit_check(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    caps = events.select("event_type").distinct().withColumn("cap", F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 10 ELSE 100000 END"))
    return ops.limit_check(events, caps, "event_type", "ts", "2024-01-20")


@query("""SELECT conv_id, CAST(to_json(list({'turn': turn, 'role': role} ORDER BY turn)) AS VARCHAR) AS turns FROM conversations GROUP BY conv_id""")
def json_array_agg(spark: SparkSession, sf: str) -> DataFrame:
    return ops.json_array(table(spark, sf, "conversations"), ["conv_id"], ["turn", "role"], "turns")


@query("""SELECT c_mktsegment AS segment, o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def type_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("""SELECT l_suppkey AS suppkey, count(*) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY l_suppkey""")
def link_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("kinds"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query("""SELECT c_custkey AS custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) = 0""")
def having_empty_parent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.expr("o_custkey = c_custkey"), "left_anti").selectExpr("c_custkey custkey")


@query("""SELECT lang, count(*) AS docs, count(*) FILTER (WHERE n_chars > 2000) AS long_docs FROM documents GROUP BY lang""")
def filtered_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n_chars") > 2000).alias("long_docs"))


@query("""SELECT count(*) AS n, round(coalesce(avg(length(text)), 400), 6) AS mean_length FROM documents""")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(F.length("text")), F.lit(400.0)), 6).alias("mean_length"))


@query("""
SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents) GROUP BY token HAVING count(DISTINCT doc_id) >= 20""")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df >= 20")


@query("""SELECT o_custkey AS custkey, count(*) AS n, round(sum(l_extendedprice * l_quantity), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def order_total(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * F.col("l_quantity")).alias("t"))
    return rows.join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).groupBy(F.col("o_custkey").alias("custkey")).agg(F.sum("n").alias("n"), F.round(F.sum("t"), 2).alias("total"))


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view,
count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def pivot_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", ["click", "view", "purchase"]).count().fillna(0)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def mode_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return ops.mode(table(spark, sf, "events"), "user_id", "event_type", "event_id").withColumnRenamed("event_type", "mode")


@query("""
SELECT event_type, round(sum(user_id * coalesce(r.i, 0) + value * coalesce(r.o, 0)) / 1000000, 8) AS cost FROM events
LEFT JOIN (VALUES ('click', 3.0, 15.0), ('view', 0.25, 1.25)) r(k, i, o) ON r.k = event_type GROUP BY event_type""")
def cost_by_model(spark: SparkSession, sf: str) -> DataFrame:
    rates = {"click": (3.0, 15.0), "view": (0.25, 1.25)}
    return ops.with_cost(table(spark, sf, "events"), "event_type", "user_id", "value", rates).groupBy("event_type").agg(F.round(F.sum("cost"), 8).alias("cost"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id""")
def ordered_concat(spark: SparkSession, sf: str) -> DataFrame:
    return ops.ordered_text(table(spark, sf, "conversations").withColumn("line", F.concat_ws(": ", "role", "text")), ["conv_id"], "turn", "line", "\n").withColumnRenamed("line", "history")


@query("""
SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, json_array_length('[' || repeat('1,', CAST(event_id % 4 AS INTEGER)) || '0]') AS n, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.json_array_length(F.concat(F.lit("["), F.expr("repeat('1,', cast(event_id % 4 as int))"), F.lit("0]"))).cast("long").alias("n"), F.get_json_object("props", "$.k").cast("long").alias("k")
    )


@query("""SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'assistant') <= 1""")
def guard_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n")).filter("n <= 1").select("conv_id")


# ---- top-k, paging, set operations


@query("""SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey orderkey", "o_totalprice price").orderBy(F.desc("price"), "orderkey").limit(50)


@query("""SELECT o_orderkey AS orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    return ops.offset_page(table(spark, sf, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], page=3, size=20).selectExpr("o_orderkey orderkey", "total")


@query("""
WITH p AS (SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC LIMIT 31)
SELECT event_id, (SELECT count(*) > 30 FROM p) AS has_more FROM (SELECT * FROM p ORDER BY ts DESC, event_id DESC LIMIT 30)""")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return ops.keyset_page(table(spark, sf, "events"), "ts", "event_id", F.lit("2024-01-15").cast("timestamp_ntz"), 30).select("event_id", "has_more")


@query("""SELECT doc_id FROM documents ORDER BY (lang = 'de') DESC, length(text) DESC, doc_id LIMIT 25""")
def computed_sort(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").orderBy(F.desc(F.col("lang") == "de"), F.desc(F.length("text")), "doc_id").limit(25).select("doc_id")


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, doc_id) AS r FROM documents) WHERE r = 1""")
def priority_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.expr("CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END")
    return ops.first_by(table(spark, sf, "documents"), ["lang"], [rank, F.col("doc_id")]).select("lang", "doc_id")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2""")
def last_n_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return ops.top_per_group(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 2).orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 3""")
def nth_of_group(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("r", F.row_number().over(by)).filter("r = 3").select("user_id", "event_id")


@query("""SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer""")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2].distinct()).distinct()


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def intersect_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_nationkey k").intersect(table(spark, sf, "supplier").selectExpr("s_nationkey k"))


@query("""SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr("n_nationkey k").subtract(table(spark, sf, "supplier").selectExpr("s_nationkey k"))
