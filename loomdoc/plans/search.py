"""Search queries over the driver's documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import tables
from loomdoc.functions import text as tx
from loomdoc.operators import search as ops
from loomdoc.operators import retrieval, vectorindex
from loomdoc.operators.postings import StoredIndex
from loomdoc.plans.registry import query
from loomdoc.session import exists, files_key, kept, shared_folder, spread, table

WORDS = ["the", "tion", "ndre"]


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    return ops.embedded_chunks(docs).withColumn("id", F.col("doc_id") * 100_000 + F.col("n"))


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunked and embedded once, as ingest does; read by every search."""
    return kept(lambda: _chunks(spark, sf), spark, f"chunks-{files_key(spark, sf, ['documents'])}")


@query(None)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    found = ops.hybrid(stored_chunks(spark, sf), "the thing that reads", 10, where=F.col("source").isNotNull(), keep=["doc_id", "lang", "source"])
    return found.select("id", "text", "headline", F.col("doc_id").alias("document"), F.col("source").alias("category"), F.round("rrf_score", 8).alias("rrf_score"), F.round("similarity", 8).alias("similarity"), "vector_rank", "fts_rank")


@query(None)
def chunk_function(spark: SparkSession, sf: str) -> DataFrame:
    """Recursive chunks by the table function."""
    tables.register(spark)
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return spark.sql("SELECT d.doc_id, c.n, c.chunk FROM {d} d, LATERAL chunk(d.text, 'recursive') c", d=docs)


def chunk_indexes(spark: SparkSession, sf: str) -> tuple[StoredIndex, vectorindex.VectorIndex]:
    """Both indexes of the chunks, written once."""
    key = files_key(spark, sf, ["documents"])
    chunks, path = stored_chunks(spark, sf), f"{shared_folder(spark)}/kept/chunk-postings-{key}"
    index = StoredIndex(spark, path) if StoredIndex.exists(spark, path) else StoredIndex.create(chunks.select("id", "text"), path, postings=False)
    held = f"{shared_folder(spark)}/kept/chunk-vectors-{key}"
    if not exists(spark, f"{held}/quantizer/_SUCCESS"):
        vectorindex.build(chunks.select("id", "embedding")).write(held, "overwrite")
    return index, vectorindex.VectorIndex.read(spark, held)


@query(None)
def question_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item's first words as a question: both lists over the chunks of documents with a source, fused, and a second hop, in one flow."""
    asked = table(spark, sf, "benchmark").filter("item_id is not null").select(F.col("item_id").alias("query"), F.substring_index("text", " ", 8).alias("text"))
    index, vectors = chunk_indexes(spark, sf)
    chunks = stored_chunks(spark, sf).select("id", "text", "source", F.col("doc_id").alias("section"), F.lit(None).cast("string").alias("title"))
    cells = vectors.quantizer.cells
    return retrieval.multi_hop(asked, index, vectors, chunks, k=5, only=chunks.filter("source is not null"), probes=max(1, cells // 4))


@query(None)
def approximate_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the cells are read in codes; 60 rows of each query are scored."""
    vectors = table(spark, sf, "embeddings")
    index = vectorindex.build(vectors, "vec_id")
    return index.search(vectors.filter("vec_id % 100 = 0"), 3, probes=-(-2 * index.quantizer.cells // 3), rerank=60)


@query("""
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) WHERE rank <= 5""")
def indexed_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The index with all cells, scoring what the errors of the codes don't rule out."""
    vectors = table(spark, sf, "embeddings")
    found = vectorindex.build(vectors, "vec_id").search(vectors.filter("vec_id % 100 = 0"), 5, exact=True)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


_TF = "(length(lower(text)) - length(replace(lower(text), '{0}', ''))) / {1}"


def _bm25_sql() -> str:
    tf = ", ".join(f"CAST({_TF.format(w, len(w))} AS BIGINT) AS t{i}" for i, w in enumerate(WORDS))
    df = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS d{i}" for i in range(len(WORDS)))
    score = " + ".join(f"ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / a))" for i in range(len(WORDS)))
    any_ = " + ".join(f"t{i}" for i in range(len(WORDS)))
    return f"""WITH r AS (SELECT doc_id AS id, length(text) AS len, {tf} FROM documents), s AS (SELECT count(*) AS n, avg(len) AS a, {df} FROM r)
SELECT id, round(CAST({score} AS DOUBLE), 6) AS score FROM r, s WHERE {any_} > 0 ORDER BY {score} DESC, id LIMIT 60"""


@query(_bm25_sql())
def bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    return ops.bm25(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), WORDS, 60).select("id", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(CAST(list_cosine_similarity(embedding, v) AS DOUBLE), 4) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding, v) DESC, vec_id LIMIT 30""")
def vector_top(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    q = [float(x) for x in vectors.filter("vec_id = 7").first()["embedding"]]
    return ops.vector_top_k(vectors, q, 30, id_="vec_id").select("vec_id", F.round("similarity", 4).alias("similarity"))


@query("""
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) WHERE rank <= 3""")
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    found = ops.knn(vectors.filter("vec_id % 100 = 0"), vectors, 3, id_="vec_id")
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH v AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, n_chars AS s FROM documents WHERE lang = 'en' ORDER BY r LIMIT 40),
t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY length(replace(text, 'e', '')) DESC, doc_id) AS r FROM documents WHERE lang = 'en' ORDER BY r LIMIT 40)
SELECT coalesce(v.id, t.id) AS id, v.r AS vector_rank, t.r AS fts_rank, round(coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + t.r), 0), 8) AS rrf_score FROM v FULL JOIN t ON v.id = t.id
ORDER BY coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + t.r), 0) DESC, v.r NULLS LAST, t.r NULLS LAST, 1 LIMIT 20""")
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("lang = 'en'").withColumnRenamed("doc_id", "id")
    best = lambda score, name: docs.select("id", score.alias(name)).orderBy(F.desc(name), "id").limit(40)
    fused = ops.rrf(best(F.col("n_chars").cast("double"), "similarity"), best(F.length(F.replace("text", F.lit("e"), F.lit(""))), "score"), 20)
    return fused.select("id", F.col("vector_rank").cast("long").alias("vector_rank"), F.col("fts_rank").cast("long").alias("fts_rank"), F.round("rrf_score", 8).alias("rrf_score"))


@query("""
(SELECT DISTINCT 'document' AS type, url AS text FROM pages WHERE lower(url) LIKE '%a%' ORDER BY text LIMIT 5)
UNION ALL (SELECT DISTINCT 'section', left(text, 80) FROM documents WHERE contains(lower(text), 'ndre') ORDER BY 2 LIMIT 5)""")
def suggest(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "pages").filter(tx.like_literal(F.col("url"), "a")).select(F.lit("document").alias("type"), F.col("url").alias("text")).distinct().orderBy("text").limit(5)
    parts = table(spark, sf, "documents").filter(tx.like_literal(F.col("text"), "ndre")).select(F.lit("section").alias("type"), F.left("text", F.lit(80)).alias("text")).distinct().orderBy("text").limit(5)
    return titles.unionByName(parts)


@query("""
SELECT doc_id, 10 * ((length(source) - length(replace(source, '1', '')))) + 3 * CAST((length(lower(text)) - length(replace(lower(text), 'and', ''))) / 3 AS BIGINT) AS score FROM documents""")
def keyword_score(spark: SparkSession, sf: str) -> DataFrame:
    score = 10 * F.regexp_count("source", F.lit("1")) + 3 * tx.count_of(F.col("text"), F.lit("and"))
    return table(spark, sf, "documents").select("doc_id", score.cast("long").alias("score"))
