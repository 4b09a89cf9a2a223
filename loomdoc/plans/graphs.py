"""Graph queries over every order: a customer's key is linked with a key of the order's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import graphs as ops
from loomdoc.operators.components import connected_components
from loomdoc.plans.registry import query
from loomdoc.session import table

_E = "SELECT DISTINCT o_custkey AS a, o_custkey * 7 + o_orderkey AS b FROM orders"
_BOTH = f"e AS ({_E}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_custkey a", "o_custkey * 7 + o_orderkey b").distinct()


def _starts(spark: SparkSession) -> DataFrame:
    return spark.range(5).select((F.col("id") * 11).alias("start"))


@query(f"""
WITH RECURSIVE {_BOTH}, r(start, node, depth) AS (SELECT CAST(x * 11 AS BIGINT), CAST(x * 11 AS BIGINT), 0 FROM range(5) t(x)
UNION SELECT r.start, u.b, r.depth + 1 FROM r JOIN u ON u.a = r.node WHERE r.depth < 3)
SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY start, node""")
def graph_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return ops.reach(_edges(spark, sf), _starts(spark), hops=3)


@query(f"""
WITH RECURSIVE {_BOTH}, c(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM u
UNION (SELECT p.node, min(i.component) FROM recurring.c p JOIN u ON u.a = p.node JOIN c i ON i.node = u.b WHERE i.component < p.component GROUP BY p.node))
SELECT node, component FROM c""")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    return connected_components(_edges(spark, sf))


@query(f"""
WITH RECURSIVE e AS ({_E}), p(path, node, c, depth) AS (SELECT [CAST(x * 11 AS BIGINT)], CAST(x * 11 AS BIGINT), 1.0::DOUBLE, 0 FROM range(5) t(x)
UNION ALL SELECT list_append(p.path, e.b), e.b, p.c * (0.5 + (e.b % 5) / 10.0), p.depth + 1 FROM p JOIN e ON e.a = p.node WHERE p.depth < 3 AND NOT list_contains(p.path, e.b))
SELECT array_to_string(path, '>') AS path, round(c, 6) AS confidence, CAST(depth AS INTEGER) AS depth FROM p WHERE depth > 0""")
def graph_chains(spark: SparkSession, sf: str) -> DataFrame:
    edges = _edges(spark, sf).withColumn("confidence", 0.5 + (F.col("b") % 5) / 10.0)
    found = ops.chains(edges, _starts(spark), hops=3)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.round("confidence", 6).alias("confidence"), "depth")


@query(f"""
WITH RECURSIVE e AS ({_E}), p(path, node, c, depth) AS (SELECT [CAST(x * 11 AS BIGINT)], CAST(x * 11 AS BIGINT), 1.0::DOUBLE, 0 FROM range(5) t(x)
UNION ALL SELECT list_append(p.path, e.b), e.b, p.c * (0.5 + (e.b % 5) / 10.0), p.depth + 1 FROM p JOIN e ON e.a = p.node WHERE p.depth < 3 AND NOT list_contains(p.path, e.b))
SELECT array_to_string(path, '>') AS path, CAST(depth AS INTEGER) AS depth FROM p WHERE depth > 0 ORDER BY depth DESC, round(c, 9) DESC, path LIMIT 50""")
def best_chains(spark: SparkSession, sf: str) -> DataFrame:
    edges = _edges(spark, sf).withColumn("confidence", 0.5 + (F.col("b") % 5) / 10.0)
    found = ops.surest_chains(edges, _starts(spark), 50, hops=3)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


@query(f"""WITH e AS ({_E}) SELECT a, b FROM e WHERE a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer)""")
def graph_induced(spark: SparkSession, sf: str) -> DataFrame:
    return ops.induced(_edges(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("node")))


@query(f"""WITH e AS ({_E}) SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node""")
def graph_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return ops.degrees(_edges(spark, sf))


_W = """WITH e AS (SELECT least(o_custkey, o_custkey * 7 + o_orderkey) AS a, greatest(o_custkey, o_custkey * 7 + o_orderkey) AS b, sum(0.5 + o_orderkey % 2 / 2.0) AS w FROM orders
WHERE o_custkey <> o_custkey * 7 + o_orderkey GROUP BY 1, 2), k AS (SELECT node, sum(w) AS k FROM (SELECT a AS node, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY node)"""


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("o_custkey a", "o_custkey * 7 + o_orderkey b", "0.5 + o_orderkey % 2 / 2.0D w")
    return ops.weighted_edges(rows, "a", "b", "w")


@query(f"""{_W}, c AS (SELECT node % 7 AS c, sum(k) AS k FROM k GROUP BY 1)
SELECT round((SELECT sum(w) FROM e WHERE a % 7 = b % 7) / (SELECT sum(w) FROM e) - (SELECT sum(k * k) FROM c) / (4 * (SELECT sum(w) FROM e) * (SELECT sum(w) FROM e)), 8) AS q""")
def graph_modularity(spark: SparkSession, sf: str) -> DataFrame:
    edges = _weighted(spark, sf)
    of = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node") % 7)
    return ops.modularity(edges, of).select(F.round("q", 8).alias("q"))


@query(f"""{_W} SELECT round(sum(w) / (SELECT sum(w) FROM e) - sum(2 * x.k * y.k) / (4 * (SELECT sum(w) FROM e) * (SELECT sum(w) FROM e)), 8) AS q FROM e JOIN k x ON x.node = a JOIN k y ON y.node = b WHERE a % 7 = b % 7""")
def adjacent_modularity(spark: SparkSession, sf: str) -> DataFrame:
    edges = _weighted(spark, sf)
    of = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node") % 7)
    return ops.modularity(edges, of, adjacent_only=True).select(F.round("q", 8).alias("q"))


@query(None)
def graph_shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    """From the first customer to its last order's node."""
    edges = _edges(spark, sf)
    first = edges.agg(F.min("a").alias("a")).first()["a"]
    last = edges.filter(F.col("a") == first).agg(F.max("b")).first()[0] if first is not None else None
    return ops.shortest_path(edges, first or 0, last or 0)


@query(None)
def graph_communities(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("o_orderpriority g", "o_custkey a", "o_custkey * 7 + o_orderkey b")
    edges = rows.filter("a <> b").groupBy("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return ops.communities(edges, "g")


@query("""
WITH o AS (SELECT doc_id, text AS t FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.t = n.t THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def incremental_changes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    old = docs.filter("doc_id % 10 <> 0").select("doc_id", F.xxhash64(F.col("text")).alias("h"))
    new = docs.filter("doc_id % 11 <> 0").select("doc_id", F.xxhash64(F.expr("if(doc_id % 7 = 0, concat(text, '!'), text)")).alias("h"))
    return ops.changes(old, new, "doc_id", "h")
