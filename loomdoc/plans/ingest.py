"""Web, statute and account queries over the driver's tables; markup and JSON are made of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import text as tx
from loomdoc.functions import web
from loomdoc.operators import ingest as ops
from loomdoc.operators import mutations, relational, retrieval
from loomdoc.operators.containment import without
from loomdoc.operators.search import hashed_embedding
from loomdoc.plans.registry import query
from loomdoc.session import spread, table
from loomdoc.sources import statutes

_BOARD = (
    "'<table><tbody><tr><td><a href=\"/v?nttSn=' || page_id || '\">Alpha <b>notice</b> ' || page_id || '</a></td><td>2024-01-0' || (page_id % 9 + 1) || '</td></tr>"
    "<tr onclick=\"goView(''' || page_id || ''', ''/d/list'')\"><td><span class=\"ellipsis\">beta &amp; alpha</span></td></tr><tr><td><a href=\"#\">no target</a></td></tr></tbody></table>'"
)


def _boards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").selectExpr("page_id", "'https://h' || page_id || '.example/b/index.html?x=1' AS base", f"{_BOARD} AS board")


_ROWS = """r AS (SELECT page_id, 'Alpha notice ' || page_id AS title, 'https://h' || page_id || '.example/v?nttSn=' || page_id AS url, '2024-01-0' || (page_id % 9 + 1) AS day FROM pages
UNION ALL SELECT page_id, 'beta & alpha', 'https://h' || page_id || '.example/d/list?nttSn=' || page_id, NULL FROM pages)"""


@query(f"WITH {_ROWS} SELECT * FROM r")
def board_list(spark: SparkSession, sf: str) -> DataFrame:
    return _boards(spark, sf).select("page_id", F.inline(web.board_rows(F.col("board"), F.col("base"))))


@query(f"""WITH {_ROWS}, k AS (SELECT *, 10.0 * (CASE WHEN day IS NULL THEN 1 ELSE 1 END) + 10.0 * (CASE WHEN contains(lower(title), 'notice') THEN 1 ELSE 0 END) AS s FROM r WHERE (day IS NULL OR strptime(day, '%Y-%m-%d') >= DATE '2024-01-02') AND NOT contains(url, 'h7.'))
SELECT page_id, title, url, day, s AS title_score, s * 1.5 AS total FROM k""")
def crawl_scoring(spark: SparkSession, sf: str) -> DataFrame:
    excluded = spark.createDataFrame([("h7.",), ("",)], "pattern string")
    return ops.crawl_results(_boards(spark, sf), "page_id", "base", "board", ["ALPHA", "Notice"], excluded, F.lit("2024-01-09").cast("date"), 7, F.lit(1.5))


@query("""SELECT page_id AS doc, url, count(*) OVER (PARTITION BY url) > 0 AS once FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)""")
def imported_pages(spark: SparkSession, sf: str) -> DataFrame:
    found = ops.page_import(spread(table(spark, sf, "pages")), "page_id", "url", "html", least=0)
    return found.groupBy("doc", "url").agg((F.count(F.lit(1)) > 0).alias("once"))


@query(None)
def page_sections_import(spark: SparkSession, sf: str) -> DataFrame:
    return ops.page_import(spread(table(spark, sf, "pages")), "page_id", "url", "html")


@query("""SELECT p_partkey, p_partkey AS number, CASE WHEN p_partkey <= 110 THEN 1 WHEN p_partkey <= 150 THEN 2 ELSE 3 END AS exam, CAST(p_size AS VARCHAR) AS original_number, p_name || ' asks' AS body, '1:' || p_brand || ',2:' || p_type AS choices, p_size % 4 + 1 AS answer,
CASE WHEN length(p_name) < 10 THEN '' ELSE '<p>' || p_name || '</p>' END AS explanation, 'q' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END || '.png' AS image FROM part""")
def exam_cards(spark: SparkSession, sf: str) -> DataFrame:
    html = F.expr(
        "concat('<main><div class=\"card\" id=\"q', p_partkey, '\"><div class=\"question-body\"><span class=\"qn\">', p_size, '.</span> ', p_name, '\\n   asks</div><ul data-answer=\"', p_size % 4 + 1, '\"><li data-num=\"1\"><span class=\"c-num\">①</span> ', p_brand, '</li>"
        "<li data-num=\"2\"><span class=\"c-num\">②</span>', p_type, '</li></ul><div class=\"explanation\" x><p>', p_name, '</p><div class=\"ai-controls\"></main>')"
    )
    rows = table(spark, sf, "part").select("p_partkey", F.inline(web.exam_cards(html)))
    return rows.withColumn("choices", F.array_join(F.transform("choices", lambda c: F.concat_ws(":", c["num"].cast("string"), c["text"])), ","))


_STATUTE = "'{\"법령\":{\"기본정보\":{\"법령명_한글\":\"법' || n_nationkey || '\"},\"조문\":{\"조문단위\":[{\"조문내용\":\"제1장 총칙\"},{\"조문내용\":\"제1조(목적) 제3조를 본다\",\"조문제목\":\"목적\",\"조문번호\":\"1\",\"항\":{\"항내용\":\"① 가\"}},{\"조문내용\":\"제2장  ' || n_name || '\"},{\"조문내용\":\"제3조의2\",\"조문제목\":\"벌칙\",\"조문번호\":\"3\",\"조문가지번호\":\"2\",\"항\":[{\"항내용\":\"① 제1조\",\"호\":[{\"호내용\":\"1. 나\"}]}]}]}}}'"


@query("""SELECT n_nationkey AS id, '법' || n_nationkey AS law, '제1장 총칙 > 제1조(목적)' AS label, '제1조(목적) 제3조를 본다' || chr(10) || '① 가' AS content, '제3조' AS refs, '제3조의2' AS referenced_by FROM nation
UNION ALL SELECT n_nationkey, '법' || n_nationkey, '제2장 ' || n_name || ' > 제3조의2(벌칙)', '제3조의2' || chr(10) || '① 제1조' || chr(10) || '  1. 나', '제1조', '' FROM nation""")
def statute_articles(spark: SparkSession, sf: str) -> DataFrame:
    found = statutes.articles(table(spark, sf, "nation").selectExpr("n_nationkey id", f"{_STATUTE} AS body"), "id", "body")
    rows = statutes.with_references(found, "id")
    return rows.select("id", "law", "label", "content", F.array_join("references", ",").alias("refs"), F.array_join("referenced_by", ",").alias("referenced_by"))


@query("""WITH a AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(0 AS INTEGER) AS section_index, 'full' AS section_type, t AS text FROM a""")
def whole_sections(spark: SparkSession, sf: str) -> DataFrame:
    return statutes.page_sections(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", "full")


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS section_index, 'page' AS section_type, text FROM conversations""")
def numbered_sections(spark: SparkSession, sf: str) -> DataFrame:
    return statutes.page_sections(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", "custom")


_USAGE = "SELECT ts, event_type AS provider, CAST(user_id % 3 AS INTEGER) AS model, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, value AS cost, event_id FROM events"
_RECENT = f"u AS ({_USAGE}), r AS (SELECT * FROM u WHERE CAST(ts AS DATE) > DATE '2024-01-20' - 10 AND CAST(ts AS DATE) <= DATE '2024-01-20')"
_SUMS = "count(*) AS calls, count(*) FILTER (WHERE status = 'error') AS errors, round(sum(cost), 4) AS cost"


def _dashboard(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    usage = table(spark, sf, "events").selectExpr("ts", "event_type provider", "CAST(user_id % 3 AS INT) model", "if(event_id % 7 = 0, 'error', 'success') status", "value cost", "event_id")
    return {k: v.withColumn("cost", F.round("cost", 4)) if "calls" in v.columns else v for k, v in ops.usage_dashboard(usage, "ts", "provider", "model", "status", "cost", "2024-01-20", 10).items()}


@query(f"WITH {_RECENT} SELECT provider, {_SUMS} FROM r GROUP BY provider")
def dashboard_providers(spark: SparkSession, sf: str) -> DataFrame:
    return _dashboard(spark, sf)["by_provider"]


@query(f"WITH {_RECENT} SELECT provider, model, {_SUMS} FROM r GROUP BY provider, model")
def dashboard_models(spark: SparkSession, sf: str) -> DataFrame:
    return _dashboard(spark, sf)["by_model"]


@query(f"WITH {_RECENT} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_SUMS} FROM r GROUP BY 1")
def dashboard_days(spark: SparkSession, sf: str) -> DataFrame:
    return _dashboard(spark, sf)["by_day"].withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_RECENT} SELECT event_id, provider FROM u WHERE status = 'error' ORDER BY ts DESC, provider, model LIMIT 10")
def dashboard_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _dashboard(spark, sf)["last_errors"].select("event_id", "provider")


@query("""WITH q AS (SELECT event_id, event_type AS provider, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'),
u AS (SELECT event_type AS provider, count(*) AS used FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-04' GROUP BY 1), c(provider, cap, enabled) AS (SELECT DISTINCT event_type, CASE WHEN event_type < 'd' THEN 0 ELSE 12 END, event_type <> (SELECT max(event_type) FROM events) FROM events)
SELECT event_id, coalesce(enabled AND (cap = 0 OR coalesce(used, 0) + n <= cap), false) AS allowed, CASE WHEN enabled AND (cap = 0 OR coalesce(used, 0) + n <= cap) THEN 'success' ELSE 'blocked' END AS status FROM q LEFT JOIN c USING (provider) LEFT JOIN u USING (provider)""")
def tracked_calls(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("provider"))
    last = events.agg(F.max("provider").alias("_last"))
    caps = events.select("provider").distinct().crossJoin(F.broadcast(last)).selectExpr("provider", "if(provider < 'd', 0, 12) cap", "provider <> _last enabled")  # one row
    asked = events.filter("to_date(ts) = DATE '2024-01-05'").select("event_id", "provider")
    found = ops.tracked_calls(asked, events, caps, "provider", "ts", "2024-01-04", "event_id", lambda c: F.upper(c), "provider")
    return found.select("event_id", "allowed", "status")


@query("""SELECT sha256(left(text, 1)) AS key, any_value(CASE WHEN left(text, 1) < 'm' THEN 'cached' ELSE upper(left(text, 1)) END) AS result FROM documents GROUP BY 1""")
def cached_summaries(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.left("text", F.lit(1)).alias("t"))
    cache = rows.filter("t < 'm'").select(F.sha2("t", 256).alias("key"), F.lit("cached").alias("result")).distinct()
    return ops.cached_results(rows, cache, F.sha2("t", 256), tx.simple_upper, "t")


@query("""SELECT url, sum(s) AS score, min(page_id) AS page_id FROM (SELECT url, page_id, (length(html) - length(replace(html, 'a', ''))) AS s FROM pages UNION ALL SELECT url, page_id + 1, 2 FROM pages) GROUP BY url""")
def merged_scores(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    found = pages.select("url", "page_id", (F.length("html") - F.length(F.replace("html", F.lit("a"), F.lit("")))).cast("long").alias("score"))
    found = found.unionByName(pages.select("url", (F.col("page_id") + 1).alias("page_id"), F.lit(2).cast("long").alias("score")))
    return ops.merged_scores(found, "url", ["score"], F.col("page_id"))


@query("""SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END IS NULL OR o_orderdate >= DATE '1998-01-01' - 30) AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END, FALSE) = FALSE""")
def loose_filters(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    at = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    flag = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 2 == 0)
    kept = orders.filter(ops.recent_or_unknown(at, F.lit("1998-01-01").cast("date"), 30)).filter(~F.coalesce(flag, F.lit(False)))
    return relational.with_excluded(kept, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey")


@query("""SELECT page_id FROM pages WHERE NOT (contains(url, '1') OR contains(url, 'wiki'))""")
def excluded_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return without(table(spark, sf, "pages"), "url", spark.createDataFrame([("1",), ("wiki",), ("wiki",)], "p string"), "p").select("page_id")


@query("""SELECT c_custkey, printf('%.4f', c_acctbal) AS fixed, left(trim(regexp_replace(regexp_replace('<b>' || c_name || '</b>  ' || c_mktsegment, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), 100) AS same, c_custkey % 3 = 0 AS credit, regexp_matches(lower(c_mktsegment), '^[a-z0-9_-]+$') AS user_name, c_custkey % 4 > 0 AS image FROM customer""")
def input_checks(spark: SparkSession, sf: str) -> DataFrame:
    message = F.when(F.col("c_custkey") % 3 == 0, "Error: You EXCEEDED your current quota.").otherwise("time out")
    url = F.concat(F.lit("data:image/png;base64,"), F.expr("repeat('QUJD', c_custkey % 4)"), F.lit("="))
    url = F.when(F.col("c_custkey") % 4 > 0, url).otherwise(F.lit("data:text/plain;base64,QUJD"))
    return table(spark, sf, "customer").select(
        "c_custkey", web.fixed(F.col("c_acctbal"), 4).alias("fixed"), web.compare_key(F.concat(F.lit("<b>"), "c_name", F.lit("</b>  "), "c_mktsegment")).alias("same"),
        web.is_credit_error(message).alias("credit"), web.user_name_fits(F.lower("c_mktsegment")).alias("user_name"), web.image_url_fits(url).alias("image"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 2 = 1 THEN '{"z":[' || event_id || ',{"a":"' || event_type || '"}]}' ELSE '{}' END AS props FROM events""")
def json_key_removal(spark: SparkSession, sf: str) -> DataFrame:
    more = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(',"z":['), F.col("event_id").cast("string"), F.lit(',{"a":"'), F.col("event_type"), F.lit('"}]}'))
    body = F.when(F.col("event_id") % 2 == 1, more).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", mutations.without_json_key(body, "k").alias("props"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'kept' ELSE 'open' END AS state FROM events GROUP BY user_id HAVING bool_or(event_type = 'click')""")
def guarded_states(spark: SparkSession, sf: str) -> DataFrame:
    steps = {(None, "click"): "open", ("open", "purchase"): "kept"}
    log = table(spark, sf, "events").select("user_id", F.expr("if(event_type = 'purchase', 2, 1)").alias("at"), F.col("event_type").alias("event"))
    return mutations.guarded_state(log, ["user_id"], "at", "event", steps)


@query("""SELECT s.s_suppkey AS friend, s.s_name AS name, s.s_nationkey % 2 = 0 AS is_ai FROM supplier s JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 7 AND l_returnflag <> 'R') l ON l.l_suppkey = s.s_suppkey ORDER BY is_ai, name, friend LIMIT 1000""")
def friend_list(spark: SparkSession, sf: str) -> DataFrame:
    accepted = table(spark, sf, "lineitem").filter("l_partkey = 7 and l_returnflag <> 'R'").select("l_suppkey").distinct()
    friends = table(spark, sf, "supplier").join(accepted, F.col("s_suppkey") == F.col("l_suppkey"))
    return friends.select(F.col("s_suppkey").alias("friend"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 2 == 0).alias("is_ai")).orderBy("is_ai", "name", "friend").limit(1_000)


@query("""SELECT p_partkey, lower(replace(p_name, ' ', '')) LIKE '%e%' AS has, replace(p_name, ' ', '') LIKE '%1' AS ends FROM part""")
def spaceless_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.spaceless_contains(F.lower("p_name"), F.lit(" e ")).alias("has"), F.endswith(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("1")).alias("ends"))


@query(None)
def ingest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("doc"), F.lit(0).alias("section_index"), "text", F.col("source").alias("title"))
    return ops.ingest(docs, {"the": "***"}, title="title")["chunks"].select("doc", "n", "enriched")


@query("""SELECT o_custkey AS law, count(*) AS hits, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS imported FROM orders GROUP BY o_custkey""")
def known_laws(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("law")).agg(F.count(F.lit(1)).alias("hits"))
    return statutes.known_laws(found, table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("law")), "law")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') ILIKE '%1%' AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 10""")
def json_predicate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").filter(tx.like_literal(k, "1") & (k.cast("long") > 10)).select("event_id", k.cast("long").alias("k"))


@query("""SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 DAY AND CAST(ts AS DATE) <= DATE '2024-01-20'""")
def relative_days(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").filter((F.col("ts") > as_of - F.expr("INTERVAL 5 DAYS")) & (F.to_date("ts") <= F.to_date(as_of))).select("event_id")


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' added words' ELSE text END AS t FROM documents) SELECT doc_id, len(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+')) AS n, sha256(array_to_string(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'), ' ')) AS vector FROM n""")
def derived_column(spark: SparkSession, sf: str) -> DataFrame:
    """A text vector that the write path derives again for the rows that an update changes."""
    vector = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), 0)
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(0).alias("version")).withColumn("tokens", vector("text"))
    changed = docs.filter("doc_id % 3 = 0").select("doc_id", F.concat("text", F.lit(" added words")).alias("text"), F.lit(1).alias("version"))
    rows = mutations.upsert(docs, changed.withColumn("tokens", vector("text")), ["doc_id"], "version")
    return rows.select("doc_id", F.size("tokens").alias("n").cast("long"), F.sha2(F.array_join("tokens", " "), 256).alias("vector"))


@query("""SELECT 'k' || p_size AS key, '{"v":' || max(p_partkey) || '}' AS value FROM part GROUP BY p_size""")
def settings_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.concat(F.lit("k"), F.col("p_size").cast("string")).alias("key"), F.to_json(F.struct(F.col("p_partkey").alias("v"))).alias("value"), F.col("p_partkey").alias("version"))
    old = rows.groupBy("key").agg(F.min(F.struct("version", "value")).alias("m")).select("key", "m.value", "m.version")
    return mutations.upsert(old, rows, ["key"], "version").select("key", "value")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def owner_list(spark: SparkSession, sf: str) -> DataFrame:
    orders = relational.where(table(spark, sf, "orders"), o_custkey=7, o_orderstatus=None)
    return orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000011' AND c_nationkey BETWEEN 0 AND 24""")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = relational.where(table(spark, sf, "customer"), c_name="Customer#000000011", c_nationkey=list(range(25)))
    return found.select("c_custkey", "c_name")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' asks' || chr(10) || chr(10) || '<div class="scenario"><b>' || p_type || '</b></div>' WHEN p_partkey % 3 = 1 THEN p_brand || ' says' ELSE 'old ' || p_size END AS body FROM part""")
def repaired_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of questions overwritten from their cards, where these have a scenario or a body of the other class."""
    parts = table(spark, sf, "part")
    scenario = F.expr("concat('<div class=\"question-body\"><span class=\"qn\">', p_size, '.</span> ', p_name, '\\n   asks</div><div class=\"scenario\"> <b>', p_type, '</b> </div> <ul class=\"choices\">')")
    other = F.expr("concat('<div class=\"qb\"><span class=\"q-num\">', p_size, '.</span> ', p_brand, '\\n says</div><ul class=\"choices\">')")
    plain = F.expr("concat('<div class=\"question-body\">', p_name, '</div><ul class=\"choices\">')")
    cards = parts.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, scenario).when(F.col("p_partkey") % 3 == 1, other).otherwise(plain).alias("html"))
    questions = parts.select("p_partkey", F.concat(F.lit("old "), F.col("p_size").cast("string")).alias("body"))
    return ops.repaired_questions(questions, cards, "p_partkey", "html")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 > 0 AND length(text) > 0 THEN 64 END AS dims, 'done' AS status FROM documents""")
def summary_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.left("text", F.lit(200))).otherwise(F.lit(" \n")).alias("summary")))
    found = ops.summary_vectors(docs, "summary", hashed_embedding)
    return found.select("doc_id", F.when(F.col("summary_embedding").isNotNull(), F.size("summary_embedding")).alias("dims"), F.col("embedding_status").alias("status"))


@query("""SELECT left(text, 20) AS text, source AS document_title, doc_id AS document_id, coalesce(lang, '') AS label, '' AS chapter, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id % 50 AS VARCHAR) END AS article_number, '' AS article_title, lang AS category,
printf('%.4f', (n_chars + 0.0)::DOUBLE / (n_chars + 977)) AS similarity, printf('%.4f', CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE sqrt(doc_id + 2)::DOUBLE END) AS final_score FROM documents""")
def answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    meta = F.struct(F.col("lang").alias("label"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 50).alias("article_number"))
    hits = docs.select(
        F.left("text", F.lit(20)).alias("text"), F.col("source").alias("document_title"), F.col("doc_id").alias("document_id"), F.col("lang").alias("category"), meta.alias("metadata"),
        (F.col("n_chars") / (F.col("n_chars") + 977)).alias("similarity"), F.when(F.col("doc_id") % 5 > 0, F.sqrt(F.col("doc_id") + 2)).alias("final_score"),
    )
    return retrieval.sources(hits)


@query("""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY md5('7:' || turn), turn) - 1 AS INTEGER) AS place FROM conversations""")
def shuffled_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of each conversation in a random order that the seed fixes."""
    return relational.shuffled(table(spark, sf, "conversations").select("conv_id", "turn"), "turn", ["conv_id"], 7)


@query("""SELECT event_id FROM events WHERE CAST('0x' || left(md5('3:' || event_id), 8) AS BIGINT) < CAST(0.1 * 4294967296 AS BIGINT)""")
def sampled_events(spark: SparkSession, sf: str) -> DataFrame:
    """About a tenth of the rows, for clean-up now and then."""
    return relational.sampled(table(spark, sf, "events"), "event_id", 0.1, 3).select("event_id")
