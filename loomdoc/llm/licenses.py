"""Operator 1: licences, by the digest of the canonical text.

A text becomes canonical by lower case, loss of its copyright lines, one spelling for
equivalent words, and words parted by single spaces without punctuation. The SHA-256 of the
whole canonical text is joined with the digests of the known licences. A licence notice
within a document is found the same way: each of its lines is an entire text, digested
and joined with the digests of the known notices. A line whose canonical length is that of no
known notice cannot match, so it is not sent on.

Result: one row for each distinct (doc_id, text_digest). Null text: as empty; the digest
is that of the empty text, and nothing matches. Repeated rows: one result row; null doc_ids of one text too. Very long texts: digested whole. Empty table: no rows. Other columns are ignored, whatever their names.
The known texts and notices are parameters, each a dict or a table (license_id, text); they are bounded and broadcast.
``query`` has those that its SQL has; ``query_all`` has all that are held here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.known_licenses import ALL_NOTICES, ALL_TEXTS, EQUIVALENT, NOTICES, TEXTS
from loomdoc.llm.text import whole
from loomdoc.session import spread, table

COPYRIGHT_LINE = r"(?m)^[^\n\p{L}\p{N}(©]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by )|\(c\)|©|all rights reserved)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """The canonical text with its line breaks."""
    x = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for spelling, word in EQUIVALENT.items():
        x = F.replace(x, F.lit(spelling), F.lit(word))
    return F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", " ")


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


Known = dict[str, list[str]] | DataFrame


def digests(spark: SparkSession, known: Known) -> DataFrame:
    """license_id, digest, length of the known texts; ids of one digest are comma-joined."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame([(k, t) for k, texts in known.items() for t in texts], "license_id string, text string")
    rows = rows.select("license_id", one_line(canonical_lines(F.col("text"))).alias("text"))
    rows = rows.filter("text <> ''").groupBy(F.sha2("text", 256).alias("digest"), F.length("text").alias("length"))
    return rows.agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("license_id")).select("license_id", "digest", "length")


def scan(docs: DataFrame, texts: Known = TEXTS, notices: Known = NOTICES) -> DataFrame:
    """doc_id, text_digest, license_id of the whole text (or null), notices found on lines (sorted, comma-joined)."""
    spark = docs.sparkSession
    whole_known = digests(spark, texts).select(F.col("digest").alias("text_digest"), "license_id")
    line_known = digests(spark, notices)
    lengths = [r["length"] for r in line_known.select("length").distinct().collect()]
    rows = docs.select("doc_id", canonical_lines(whole(F.col("text"))).alias("_lines"))
    lines = F.filter(F.transform(F.split("_lines", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(lengths))
    rows = rows.select("doc_id", F.sha2(one_line(F.col("_lines")), 256).alias("text_digest"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("_units"))
    units = rows.select("doc_id", "text_digest", F.explode_outer("_units").alias("digest"))
    found = units.join(F.broadcast(line_known.select("digest", F.col("license_id").alias("notice"))), "digest", "left")
    found = found.groupBy("doc_id", "text_digest").agg(F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notices"))
    return found.join(F.broadcast(whole_known), "text_digest", "left").select("doc_id", "text_digest", "license_id", "notices")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def query_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ALL_TEXTS, ALL_NOTICES)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    lines = "regexp_replace(lower(coalesce(text, '')), " + _quoted(COPYRIGHT_LINE) + ", '', 'g')"
    for spelling, word in EQUIVALENT.items():
        lines = f"replace({lines}, {_quoted(spelling)}, {_quoted(word)})"
    lines = f"regexp_replace({lines}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    one = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    values = lambda known: ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, ts in known.items() for t in ts)
    return f"""
WITH texts(license_id, text) AS (VALUES {values(TEXTS)}),
notices(license_id, text) AS (VALUES {values(NOTICES)}),
t AS (SELECT license_id, sha256({one(lines)}) AS digest FROM texts),
n AS (SELECT license_id, sha256({one(lines)}) AS digest FROM notices),
d AS (SELECT doc_id, {lines} AS ls FROM documents),
u AS (SELECT doc_id, sha256({one('ls')}) AS text_digest, unnest(string_split(ls, chr(10))) AS line FROM d),
f AS (SELECT u.doc_id, u.text_digest, coalesce(string_agg(DISTINCT n.license_id, ',' ORDER BY n.license_id), '') AS notices
      FROM u LEFT JOIN n ON n.digest = sha256(trim(u.line)) GROUP BY u.doc_id, u.text_digest)
SELECT f.doc_id, f.text_digest, t.license_id, f.notices FROM f LEFT JOIN t ON t.digest = f.text_digest
"""


SQL = _sql()
