"""Retrieval for many questions at once: both lists, fusion by question, and a second hop along references.

Questions are a table (query long, text). The text list comes from a stored index, the vector list from a vector index;
filters are rows that may be found (``only``) and hold inside both lists, so they never shorten a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.operators.knowledge import reference_queries
from loomdoc.operators.postings import StoredIndex, tokens_of
from loomdoc.operators.search import RRF_K, hashed_embedding
from loomdoc.operators.vectorindex import VectorIndex
from loomdoc.session import cut

#: Of the references that a question's hits name, so many are asked for, each for so many chunks.
REFERENCES, REFERENCE_HITS = 3, 3
#: Sections and chunks that stored references add to a question, from this confidence on.
LINKED, LEAST_CONFIDENCE = 5, 0.8
BROADCAST_HITS = 100_000


def _first(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "_n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def fused(vector_hits: DataFrame, text_hits: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """query, id, similarity, vector_rank, fts_rank, rrf_score: reciprocal-rank fusion of each question's two lists (query, id, similarity) and (query, id, score)."""
    v = _first(vector_hits, ["query"], [F.desc("similarity"), F.col("id")], 2 * k, "vector_rank").select("query", "id", "similarity", "vector_rank")
    t = _first(text_hits, ["query"], [F.desc("score"), F.col("id")], 2 * k, "fts_rank").select("query", "id", "fts_rank")
    share = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    both = v.join(t, ["query", "id"], "full_outer").fillna(0.0, ["similarity"]).withColumn("rrf_score", share("vector_rank") + share("fts_rank"))
    return _first(both, ["query"], [F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("fts_rank"), F.col("id")], k, "place")


def vector_list(questions: DataFrame, vectors: VectorIndex, k: int, only: DataFrame | None = None, probes: int | None = None, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """query, id, similarity of the k nearest chunks of each question."""
    index = vectors if only is None else vectors.only(only)
    asked = questions.select(F.col("query").alias(vectors.id_), embed(F.col("text")).alias(vectors.vector))
    found = index.search(asked, k, probes, same=True)
    return found.select(F.col("query_id").alias("query"), F.col(vectors.id_).alias("id"), "similarity")


def retrieve(questions: DataFrame, index: StoredIndex, vectors: VectorIndex, k: int = 5, only: DataFrame | None = None, probes: int | None = None, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """The k best chunks of each question by both lists; see ``fused``. ``only``: id of the chunks that may be found."""
    terms = questions.select("query", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("token"))
    return fused(vector_list(questions, vectors, 2 * k, only, probes, embed), index.top_of_many(terms, 2 * k, "query", only), k)


def linked_chunks(hits: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """query, id, similarity: chunks of other documents that a question's hits refer to by stored references; the similarity is the reference's confidence."""
    sections = hits.join(chunks.select("id", "section"), "id").select("query", F.col("section").alias("source_section")).distinct()
    found = refs.filter((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("source_document") != F.col("target_document"))).join(sections, "source_section")
    best = found.groupBy("query", F.col("target_section").alias("section")).agg(F.max("confidence").alias("similarity"))
    best = _first(best, ["query"], [F.desc("similarity"), F.col("section")], LINKED).drop("_n")
    return _first(chunks.select("id", "section").join(best, "section"), ["query"], [F.desc("similarity"), F.col("section"), F.col("id")], LINKED).select("query", "id", "similarity")


def multi_hop(questions: DataFrame, index: StoredIndex, vectors: VectorIndex, chunks: DataFrame, refs: DataFrame | None = None, k: int = 5, only: DataFrame | None = None, probes: int | None = None, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """query, id, similarity, hop, place: the hits of each question, those of the references that they name, and those that stored references lead to; k + 3 in all.

    ``chunks``: id, section, title, text; ``refs``: source and target section and document, confidence. A chunk found twice counts at its best. The frontier of the second hop is one more table of
    questions, at most ``REFERENCES`` for each, so the whole is a few plans whatever the number of questions.
    """
    first = cut(retrieve(questions, index, vectors, k, only, probes, embed))
    n = first.count()
    # a small table of hits goes to the chunks, so that these aren't shuffled
    hits = F.broadcast(first) if n <= BROADCAST_HITS else first
    named = cut(hits.select("query", "id", "place").join(chunks.select("id", "title", "text"), "id"))
    named = named.join(reference_queries(named.select("id", "title", "text").dropDuplicates(["id"]), "id", "text", "title").withColumnRenamed("query", "reference"), "id")
    asked = named.groupBy("query", "reference").agg(F.min("place").alias("place"))
    asked = _first(asked, ["query"], [F.col("place"), F.col("reference")], REFERENCES).select("query", "_n", F.col("reference").alias("text"))
    # each reference is a question of its own
    frontier = cut(asked.withColumn("of", F.col("query")).withColumn("query", F.xxhash64("query", "_n")))
    second = vector_list(frontier, vectors, REFERENCE_HITS, None, probes, embed).join(frontier.select("query", "of"), "query").select(F.col("of").alias("query"), "id", "similarity")
    found = first.select("query", "id", "similarity", F.lit(1).alias("hop")).unionByName(second.withColumn("hop", F.lit(2)))
    if refs is not None:
        found = found.unionByName(linked_chunks(first, chunks, refs).withColumn("hop", F.lit(2)))
    once = found.groupBy("query", "id").agg(F.max("similarity").alias("similarity"), F.min("hop").alias("hop"))
    return _first(once, ["query"], [F.desc("similarity"), F.col("id")], k + 3, "place")


def sources(hits: DataFrame) -> DataFrame:
    """Hits as an answer cites them: text, document_title, document_id, category, the section's label, chapter, article_number and article_title ('' where it has none), similarity and the scores there are with four decimals.

    ``hits``: text, document_title, document_id, category, metadata (a struct), similarity, and final_score or relevance_score if there are any. A null similarity counts 0.
    """
    held = hits.schema["metadata"].dataType.fieldNames()
    field = lambda name: (F.coalesce(F.col(f"metadata.{name}").cast("string"), F.lit("")) if name in held else F.lit("")).alias(name)
    decimals = lambda c: F.format_string("%.4f", F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
    scores = [c for c in ("final_score", "relevance_score") if c in hits.columns]
    return hits.select("text", "document_title", "document_id", "category", *map(field, ("label", "chapter", "article_number", "article_title")), decimals("similarity"), *map(decimals, scores))
