"""Text functions, HTML, chunking over the driver's pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import chunks as ch
from loomdoc.functions import text as tx
from loomdoc.plans.registry import query
from loomdoc.session import spread, table


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"))


@query(None)
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


@query("""SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS host, length(url) AS n FROM pages""")
def page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(F.lower("url"), r"^https?://([^/:?#]+)", 1).alias("host"), F.length("url").cast("long").alias("n"))


@query("""
SELECT doc_id, left(text, 80) AS head, length(text) AS n, replace(left(text, 40), ' ', '') AS tight, CAST(ceil(length(text) / 3.0) AS BIGINT) AS tokens,
sha256('m:' || text) AS key, contains(lower(text), 'ndre') AS hit, least(greatest(n_chars / 5000.0, 0.5), 1.0) AS clamped FROM documents""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.left(t, F.lit(80)).alias("head"), F.length(t).cast("long").alias("n"), F.replace(F.left(t, F.lit(40)), F.lit(" "), F.lit("")).alias("tight"), tx.token_estimate(t).alias("tokens"),
        F.sha2(F.concat(F.lit("m:"), t), 256).alias("key"), tx.like_literal(t, "NDRE").alias("hit"), F.least(F.greatest(F.col("n_chars") / 5000.0, F.lit(0.5)), F.lit(1.0)).alias("clamped"),
    )


@query("""
SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)t\\s*i\\s*o\\s*n', '[x]', 'g'), '(?i)t\\s*h\\s*e', '$1', 'g') AS redacted,
CAST(len(regexp_extract_all(text, '(?i)t\\s*i\\s*o\\s*n')) + len(regexp_extract_all(regexp_replace(text, '(?i)t\\s*i\\s*o\\s*n', '[x]', 'g'), '(?i)t\\s*h\\s*e')) AS BIGINT) AS n FROM documents""")
def redaction(spark: SparkSession, sf: str) -> DataFrame:
    text, n = tx.redacted(F.col("text"), {"the": "$1", "tion": "[x]"})
    return table(spark, sf, "documents").select("doc_id", text.alias("redacted"), n.cast("long").alias("n"))


@query("""SELECT doc_id, round(floor(n_chars / 7.0 * 100 + 0.5) / 100, 6) AS half_up, n_chars % 7 AS m, round(sqrt(n_chars), 6) AS root, round(ln(n_chars + 1), 6) AS log FROM documents""")
def math_functions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", F.round(tx.rounded(n / 7.0, 2), 6).alias("half_up"), (n % 7).alias("m"), F.round(F.sqrt(n), 6).alias("root"), F.round(F.log(n + 1), 6).alias("log"))


@query("""
SELECT conv_id, turn, array_to_string(list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))), ',') AS grams
FROM (SELECT conv_id, turn, role || turn AS w FROM conversations) WHERE len(list_distinct(string_split(w, ''))) = length(w)
UNION ALL SELECT conv_id, turn, NULL FROM (SELECT conv_id, turn, role || turn AS w FROM conversations) WHERE len(list_distinct(string_split(w, ''))) <> length(w)""")
def character_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """The grams of role and turn; null where a letter comes twice, as the SQL doesn't keep the order of distinct grams."""
    word = F.concat("role", F.col("turn").cast("string"))
    once = F.size(F.array_distinct(F.split(word, ""))) == F.length(word)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(once, F.array_join(tx.ngrams(word), ",")).alias("grams"))


@query(None)
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(ch.chunk(F.col("text"), "sentence")).alias("n", "chunk"))


@query(None)
def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(ch.chunk(F.col("text"), "recursive")).alias("n", "chunk"))


@query("""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) - 1 AS n, p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(p) > 30""")
def line_sections(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 30)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("n", "p"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'csv' WHEN event_id % 3 = 1 THEN 'pdf' ELSE 'unknown' END AS type FROM events""")
def file_types(spark: SparkSession, sf: str) -> DataFrame:
    name = F.expr("CASE event_id % 3 WHEN 0 THEN 'a.b.CSV' ELSE 'plain' END")
    mime = F.expr("CASE event_id % 3 WHEN 1 THEN 'application/pdf' ELSE 'x/y' END")
    return table(spark, sf, "events").select("event_id", tx.file_type(name, mime).alias("type"))


@query("""
SELECT event_id, strftime(CASE event_id % 3 WHEN 0 THEN make_date(2024, 1 + CAST(event_id % 12 AS INTEGER), 5) WHEN 1 THEN make_date(2026, 1 + CAST(event_id % 12 AS INTEGER), 7) END, '%Y-%m-%d') AS day FROM events""")
def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE event_id % 3 WHEN 0 THEN concat('on 2024.', 1 + event_id % 12, '.5') WHEN 1 THEN concat(1 + event_id % 12, '-7') ELSE 'none' END")
    return table(spark, sf, "events").select("event_id", F.date_format(tx.parsed_date(text, 2026), "yyyy-MM-dd").alias("day"))


@query("""
SELECT conv_id, turn, 'Q (' || role || '): ' || text || ' ' AS prompt FROM conversations""")
def template_render(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.rendered("Q ({{role}}): {{text}} {{missing}}", {"role": F.col("role"), "text": F.col("text")}).alias("prompt"))
