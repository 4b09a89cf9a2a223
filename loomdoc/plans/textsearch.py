"""Text search queries over whole documents and names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import chunks as ch
from loomdoc.functions import text as tx
from loomdoc.operators import search as ranking
from loomdoc.operators import textsearch as ops
from loomdoc.operators.postings import StoredIndex
from loomdoc.plans.registry import query
from loomdoc.session import cut, files_key, removed, shared_folder, spread, table

_SYNONYMS = ", ".join(f"('{k}', '{s}')" for k, v in ops.SYNONYMS.items() for s in v)
_WORDS = """w AS (SELECT p_partkey AS id, unnest(string_split(q, ' ')) AS w, generate_subscripts(string_split(q, ' '), 1) - 1 AS word_no FROM (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' CCTV' WHEN 1 THEN ' 동의 pia' ELSE '' END AS q FROM part))"""
_GRAMS = "list_distinct(list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))))"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "part").select("p_partkey", "p_name")).selectExpr("p_partkey id", "concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' CCTV' WHEN 1 THEN ' 동의 pia' ELSE '' END) q")


@query(f"""WITH {_WORDS}, syn(k, s) AS (VALUES {_SYNONYMS}), x AS (SELECT id, word_no, lower(w) AS t FROM w UNION SELECT id, word_no, lower(unnest({_GRAMS})) FROM w WHERE length(w) >= 3 UNION SELECT id, word_no, unnest(string_split(lower(s), ' ')) FROM w JOIN syn ON k = lower(w))
SELECT DISTINCT id, CAST(word_no AS INTEGER) AS word_no, t AS term FROM x WHERE t <> ''""")
def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return ops.query_terms(_asked(spark, sf), "id", "q")


@query(f"""WITH {_WORDS}, syn(k, s) AS (VALUES {_SYNONYMS}), g AS (SELECT id, word_no, w, CASE WHEN length(w) >= 3 THEN {_GRAMS} ELSE [] END AS grams FROM w)
SELECT id, CAST(word_no AS INTEGER) AS word_no, w AS word, array_to_string(list_sort(grams), ',') AS grams, coalesce((SELECT count(*) FROM syn WHERE k = lower(w)), 0) AS n_synonyms FROM g""")
def query_analysis(spark: SparkSession, sf: str) -> DataFrame:
    found = ops.query_analysis(_asked(spark, sf), "id", "q")
    return found.select("id", "word_no", "word", F.array_join(F.array_sort("grams"), ",").alias("grams"), F.size("synonyms").cast("long").alias("n_synonyms"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(left(text, 60), '\\s+')) AS w FROM conversations), x AS (SELECT conv_id, turn, w AS t FROM w WHERE length(w) >= 2
UNION SELECT conv_id, turn, unnest(list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))) FROM w WHERE length(w) >= 2)
SELECT conv_id, turn, count(*) AS n, string_agg(t, ',' ORDER BY t) AS tokens FROM x GROUP BY conv_id, turn""")
def fallback_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = ops.fallback_tokens(F.left("text", F.lit(60)))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("n"), F.array_join(F.array_sort(found), ",").alias("tokens")).filter("n > 0")


_POSTINGS = """p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS token, generate_subscripts(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''), 1) - 1 AS place FROM documents)"""


def stored_index(spark: SparkSession, sf: str) -> StoredIndex:
    """The index of the documents, written by the first query that asks for it and read by all others."""
    path = f"{shared_folder(spark)}/kept/postings-{files_key(spark, sf, ['documents'])}"
    if StoredIndex.exists(spark, path):
        return StoredIndex(spark, path)
    return StoredIndex.create(spread(table(spark, sf, "documents").select("doc_id", "text")), path, "doc_id")


@query(f"""WITH {_POSTINGS} SELECT token, count(DISTINCT doc_id) AS docs, count(*) AS places, CAST(max(place) AS INTEGER) AS last FROM p GROUP BY token""")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    last = F.max(F.element_at("places", -1)["place"]).alias("last")
    postings = stored_index(spark, sf).postings(None, places=True)
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("places"), last)


_ASKED = [(1, "the tion"), (2, "and"), (3, "qqqq")]


def _terms(spark: SparkSession) -> DataFrame:
    return ops.query_terms(spark.createDataFrame(_ASKED, "qid int, q string"), "qid", "q", use_ngrams=False)


def _hits(spark: SparkSession, sf: str, terms: DataFrame, places: bool = True) -> DataFrame:
    return stored_index(spark, sf).hits(terms, "qid", places).withColumnRenamed("id", "doc_id")


@query(f"""WITH {_POSTINGS} SELECT 1 AS qid, doc_id FROM p GROUP BY doc_id HAVING bool_or(starts_with(token, 'the')) AND bool_or(starts_with(token, 'tion')) UNION ALL SELECT 2, doc_id FROM p GROUP BY doc_id HAVING bool_or(starts_with(token, 'and'))""")
def match_all_words(spark: SparkSession, sf: str) -> DataFrame:
    terms = _terms(spark)
    return ops.matches(_hits(spark, sf, terms, places=False), terms, "doc_id", "qid", all_words=True)


@query(f"""WITH {_POSTINGS} SELECT qid, doc_id, round(c / (c + 1), 6) AS rank FROM (SELECT 1 AS qid, doc_id, 0.1 * count(*) AS c FROM p WHERE starts_with(token, 'the') OR starts_with(token, 'tion') GROUP BY doc_id UNION ALL SELECT 2, doc_id, 0.1 * count(*) FROM p WHERE starts_with(token, 'and') GROUP BY doc_id)""")
def any_word_density(spark: SparkSession, sf: str) -> DataFrame:
    terms = _terms(spark)
    found = ops.cover_density(_hits(spark, sf, terms), terms, "doc_id", "qid")
    return found.select("qid", "doc_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {_POSTINGS}, h AS (SELECT doc_id, place, starts_with(token, 'the') AS a, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM p WHERE starts_with(token, 'the') OR starts_with(token, 'tion')),
b AS (SELECT *, least(max(CASE WHEN a THEN place END) OVER w, max(CASE WHEN NOT a THEN place END) OVER w) AS first, max(CASE WHEN a THEN place END) OVER w AS la, max(CASE WHEN NOT a THEN place END) OVER w AS lb FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
c AS (SELECT *, lag(CASE WHEN la IS NULL OR lb IS NULL THEN NULL ELSE first END) OVER (PARTITION BY doc_id ORDER BY place) AS earlier FROM b),
d AS (SELECT c.doc_id, c.n - x.n + 1 AS n, c.place - c.first AS wide FROM c JOIN h x ON x.doc_id = c.doc_id AND x.place = c.first WHERE la IS NOT NULL AND lb IS NOT NULL AND (earlier IS NULL OR c.first > earlier)),
e AS (SELECT doc_id, sum(0.1 / (1 + greatest(wide - (n - 1), 0))) AS c FROM d GROUP BY doc_id)
SELECT 1 AS qid, doc_id, round(CAST(c / (c + 1) AS DOUBLE), 6) AS rank FROM e""")
def all_words_density(spark: SparkSession, sf: str) -> DataFrame:
    terms = _terms(spark).filter("qid = 1")
    found = ops.cover_density(_hits(spark, sf, terms), terms, "doc_id", "qid", all_words=True)
    return found.select("qid", "doc_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {_POSTINGS}, l AS (SELECT doc_id, length(text) AS n FROM documents), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l), q(token) AS (VALUES ('the'), ('and'), ('for')), f AS (SELECT doc_id, token, count(*) AS tf FROM p JOIN q USING (token) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM f GROUP BY token)
SELECT 1 AS qid, f.doc_id, round(CAST(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS DOUBLE), 6) AS score FROM f JOIN df USING (token) JOIN l ON l.doc_id = f.doc_id, s GROUP BY f.doc_id""")
def bm25_on_postings(spark: SparkSession, sf: str) -> DataFrame:
    words = ["the", "and", "for"]
    terms = spark.createDataFrame([(1, w) for w in words], "qid int, term string")
    lengths = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    found = ops.bm25_postings(stored_index(spark, sf).postings(words).withColumnRenamed("id", "doc_id"), lengths, terms, "doc_id", "qid")
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"))


_BM25 = """l AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM {0}), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l), f AS (SELECT qid, doc_id, token, count(*) AS tf FROM p JOIN q USING (token) GROUP BY ALL), df AS (SELECT qid, token, count(*) AS df FROM f GROUP BY ALL),
m AS (SELECT qid, f.doc_id, CAST(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS DOUBLE) AS score FROM f JOIN df USING (qid, token) JOIN l ON l.doc_id = f.doc_id, s GROUP BY qid, f.doc_id)
SELECT qid, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM m) WHERE r <= 20"""
_QUESTIONS = [(1, "the"), (1, "and"), (1, "for"), (2, "tion"), (3, "ver"), (3, "und"), (4, "qqqq")]
_Q = ", ".join(f"({a}, '{b}')" for a, b in _QUESTIONS)


@query(f"""WITH {_POSTINGS}, q(qid, token) AS (VALUES {_Q}), {_BM25.format('documents')}""")
def ranked_top(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best documents of several questions in one plan; blocks that can't reach them aren't read."""
    found = stored_index(spark, sf).top(spark.createDataFrame(_QUESTIONS, "qid int, token string"), 20, "qid")
    return found.select("qid", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_EDITED = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' the und' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0"


@query(f"""WITH e AS ({_EDITED}), {_POSTINGS.replace('FROM documents', 'FROM e')}, q(qid, token) AS (VALUES {_Q}), {_BM25.format('e')}""")
def index_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """An index of documents that were there, kept up with the added, changed and removed ones; the 20 best after it."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    try:
        index = StoredIndex.create(docs.filter("doc_id % 10 <> 0"), path, "doc_id")
        index.update(docs.withColumn("text", F.expr("case when doc_id % 11 = 0 then null when doc_id % 7 = 0 then concat(text, ' the und') else text end")), "doc_id")
        found = index.top(spark.createDataFrame(_QUESTIONS, "qid int, token string"), 20, "qid")
        return cut(found.select("qid", F.col("id").alias("doc_id"), F.round("score", 6).alias("score")))
    finally:
        removed(spark, path)


@query("""WITH t AS (SELECT doc_id AS id, text AS question, repeat('c', CAST(doc_id % 40 AS INTEGER)) AS conclusion, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'success' END AS status, TIMESTAMP '2024-06-01' - to_days(CAST(doc_id % 200 AS INTEGER)) AS made FROM documents),
c AS (SELECT * FROM t WHERE status = 'success' AND length(conclusion) > 20 AND made > TIMESTAMP '2024-06-01' - to_days(90) ORDER BY made DESC, id LIMIT 100),
k AS (SELECT id, made, conclusion, lower(regexp_replace(question, '\\s+', '', 'g')) AS same, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(question, '[^\\w가-힣\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) >= 2 AND w <> 'of')) AS ks FROM c),
m AS (SELECT *, list_sum(list_transform(['the', 'tion', 'zz'], lambda x: CASE WHEN list_contains(ks, x) THEN 1.0 WHEN len(list_filter(ks, lambda y: contains(x, y) OR contains(y, x))) > 0 THEN 0.5 ELSE 0.0 END)) AS m, len(list_distinct(list_concat(ks, ['the', 'tion', 'zz']))) AS u FROM k),
s AS (SELECT *, CAST(CASE WHEN len(ks) = 0 THEN 0.0 ELSE 0.4 * m / u + 0.6 * m / 3 END AS DOUBLE) AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY score DESC, made DESC, id) AS r FROM s WHERE score >= 0.1)
SELECT id, round(score, 3) AS score, left(conclusion, 200) AS conclusion FROM r WHERE r = 1 ORDER BY r.score DESC, made DESC, id LIMIT 5""")
def similar_questions(spark: SparkSession, sf: str) -> DataFrame:
    traces = table(spark, sf, "documents").selectExpr("doc_id id", "text question", "repeat('c', CAST(doc_id % 40 AS INT)) conclusion", "source category", "if(doc_id % 5 = 0, 'error', 'success') status", "TIMESTAMP '2024-06-01' - make_interval(0, 0, 0, CAST(doc_id % 200 AS INT)) created_at")
    found = ops.past_questions(traces, F.lit("the TION, of zz"), ["of"], F.lit("2024-06-01").cast("timestamp"), candidates=100, least=0.1, k=5)
    return found.select("id", "score", "conclusion")


@query(f"""WITH {_POSTINGS}, c AS (SELECT doc_id, 0.1 * count(*) AS c FROM p WHERE regexp_matches(token, '^(th|he|ti|io|on)') GROUP BY doc_id)
SELECT doc_id AS id, round(CAST(c / (c + 1) AS DOUBLE), 6) AS score FROM c ORDER BY c / (c + 1) DESC, doc_id LIMIT 20""")
def word_search(spark: SparkSession, sf: str) -> DataFrame:
    """A question with words goes by the index, its words by their parts too."""
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return ops.text_search(docs, stored_index(spark, sf), "the tion", 20).withColumn("score", F.round("score", 6))


@query("""SELECT doc_id AS id, 0.0 AS score FROM documents WHERE contains(lower(text), 'x') ORDER BY doc_id LIMIT 20""")
def short_word_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return ops.text_search(docs, docs, "X", 20)


@query("""WITH g AS (SELECT conv_id, turn, 1.0 / (1 + turn) AS score, list_distinct(list_transform(range(1, greatest(length(left(text, 500)) - 1, 1)), lambda i: substr(lower(left(text, 500)), i, 3))) AS g, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS r FROM g),
b AS (SELECT a.*, 0.7 * a.score - 0.3 * CASE WHEN len(list_distinct(list_concat(a.g, f.g))) > 0 THEN len(list_intersect(a.g, f.g)) / len(list_distinct(list_concat(a.g, f.g))) ELSE 0 END AS v1, f.g AS g1 FROM a JOIN a f ON f.conv_id = a.conv_id AND f.r = 1 WHERE a.n > 3 AND a.r > 1),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY v1 DESC, score DESC, turn) AS r2 FROM b),
d AS (SELECT c.*, 0.7 * c.score - 0.3 * greatest((0.7 * c.score - c.v1) / 0.3, CASE WHEN len(list_distinct(list_concat(c.g, f.g))) > 0 THEN len(list_intersect(c.g, f.g)) / len(list_distinct(list_concat(c.g, f.g))) ELSE 0 END) AS v2 FROM c JOIN c f ON f.conv_id = c.conv_id AND f.r2 = 1 WHERE c.r2 > 1),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY v2 DESC, score DESC, turn) AS r3 FROM d)
SELECT conv_id, turn, CAST(r AS INTEGER) AS mmr_rank FROM a WHERE n <= 3 OR r = 1 UNION ALL SELECT conv_id, turn, 2 FROM c WHERE r2 = 1 UNION ALL SELECT conv_id, turn, 3 FROM e WHERE r3 = 1""")
def diverse_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "conversations").select("conv_id", "turn", "text", (1.0 / (1 + F.col("turn"))).alias("score"))
    return ranking.mmr(hits, "conv_id", "turn", "text", "score", 3).select("conv_id", "turn", "mmr_rank")


@query("""WITH n AS (SELECT doc_id, lang, n_chars * 1.0 AS s, length(source) * 1.0 AS r FROM documents), w AS (SELECT *, min(s) FILTER (WHERE s > 0) OVER p AS sl, max(s) FILTER (WHERE s > 0) OVER p AS sh, min(r) FILTER (WHERE r > 0) OVER p AS rl, max(r) FILTER (WHERE r > 0) OVER p AS rh FROM n WINDOW p AS (PARTITION BY lang)),
x AS (SELECT doc_id, CASE WHEN NOT s > 0 OR s IS NULL THEN 0 WHEN sh = sl THEN 1 ELSE (s - sl) / (sh - sl) END AS a, CASE WHEN NOT r > 0 OR r IS NULL THEN 0 WHEN rh = rl THEN 1 ELSE (r - rl) / (rh - rl) END AS b FROM w)
SELECT doc_id, round(CAST(CASE WHEN a > 0 OR b > 0 THEN (CASE WHEN a > 0 THEN 0.4 * a ELSE 0 END + CASE WHEN b > 0 THEN 0.3 * b ELSE 0 END) / (CASE WHEN a > 0 THEN 0.4 ELSE 0 END + CASE WHEN b > 0 THEN 0.3 ELSE 0 END) ELSE 0 END AS DOUBLE), 6) AS final_score FROM x""")
def weighted_ranking(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("similarity"), F.length("source").cast("double").alias("rrf"))
    return ranking.weighted_score(hits, {"similarity": 0.4, "rrf": 0.3}, ["lang"]).select("doc_id", F.round("final_score", 6).alias("final_score"))


@query("""WITH h AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS position, lang, left(text, 200) AS head, doc_id % 13 / 13.0 AS score FROM documents), f AS (SELECT *, min(position) OVER (PARTITION BY lang, head) AS place, row_number() OVER (PARTITION BY lang, head ORDER BY score DESC, position) AS r FROM h WHERE position <= 300)
SELECT doc_id, position FROM f WHERE r = 1 ORDER BY place LIMIT 100""")
def parent_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").selectExpr("doc_id", "lang", "text", "n_chars", "doc_id % 13 / 13.0D score").orderBy(F.desc("n_chars"), "doc_id").limit(300)
    hits = ranking.ranked(rows.withColumn("n_chars", F.col("n_chars").cast("double")), "n_chars", "doc_id", "position")
    return ranking.best_parents(hits, 100, doc="lang").select("doc_id", "position")


@query("""WITH v AS (SELECT a.vec_id, list_transform(range(1, 65), lambda i: 0.4::DOUBLE * CAST(a.embedding[i] AS DOUBLE) + 0.6::DOUBLE * CAST(b.embedding[i] AS DOUBLE)) AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(m[1] / n, 4) AS first, round(list_sum(list_transform(range(1, 65), lambda i: i * m[i])) / n, 4) AS weighed, round(list_max(m) / n, 4) AS most FROM (SELECT *, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS n FROM v)""")
def blended_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All components, each by its place; the first and the greatest one too."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id").select("vec_id", ranking.blended(F.col("e"), F.col("f")).alias("m"))
    weighed = F.aggregate(F.transform("m", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return both.select("vec_id", F.round(F.get("m", F.lit(0)), 4).alias("first"), F.round(weighed, 4).alias("weighed"), F.round(F.array_max("m"), 4).alias("most"))


@query(None)
def text_headlines(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", ops.headline(F.col("text"), ["the", "tion"]).alias("headline"))


@query(None)
def markdown_chunks(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("text"))
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(ch.chunk(text, "markdown", size=600, overlap=50)).alias("n", "chunk"))


@query(None)
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(ch.chunk(F.col("text"), "semantic", size=800)).alias("n", "chunk"))


@query(None)
def parent_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", F.inline(ch.parent_children(F.col("text"))))


@query(None)
def chunk_previews(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", ch.preview(F.col("text"), "recursive").alias("p")).select("doc_id", "p.*")


@query("""WITH k AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\\w가-힣\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) >= 2 AND NOT list_contains(['the', 'und'], w))) AS k FROM documents) SELECT doc_id, len(k) AS n, sha256(array_to_string(list_sort(k), ',')) AS digest FROM k""")
def keyword_sets(spark: SparkSession, sf: str) -> DataFrame:
    found = tx.keywords(F.col("text"), ["the", "und"])
    return spread(table(spark, sf, "documents")).select("doc_id", found.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("k"), ","), 256).alias("digest"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(left(x, 1000), '제\\d+조(?:의\\d+)?') AND regexp_matches(left(x, 1000), '(?:법|령|규칙)') THEN 'law' WHEN regexp_matches(left(x, 1000), '(?:규정|지침|고시|훈령|예규)') THEN 'regulation' WHEN regexp_matches(left(x, 1000), '(?:문제|정답|해설|보기|①|②|③)') THEN 'exam' ELSE 'default' END AS type
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '이 법 제3조 ' WHEN 1 THEN '훈령 ' WHEN 2 THEN '① ' ELSE '' END || text AS x FROM documents)""")
def document_types(spark: SparkSession, sf: str) -> DataFrame:
    head = F.expr("CASE doc_id % 4 WHEN 0 THEN '이 법 제3조 ' WHEN 1 THEN '훈령 ' WHEN 2 THEN '① ' ELSE '' END")
    return table(spark, sf, "documents").select("doc_id", ch.document_type(F.concat(head, F.col("text"))).alias("type"))
