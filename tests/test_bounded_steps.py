"""Steps that must stay bounded: what a block hands on, how often a sentence is embedded, how much of a batch is held."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdoc.functions import chunks
from loomdoc.operators import knowledge, search, vectorindex

TEXTS = ["The Ring was made. It was lost in the river! Found again? Yes, twice. ΑΣ ΣΑΣ ended here.\nA new line, and the end." * 9, "", "ab cd", "één Straße İstanbul straße. " * 60, None]


def plain(text):
    """The embedding, gram by gram."""
    import re
    import zlib

    out = [0.0] * 64
    for w in re.findall(r"\w{3,}", text.lower()):
        for i in range(len(w) - 2):
            h = zlib.crc32(w[i : i + 3].encode())
            out[h % 64] += -1.0 if h & (1 << 20) else 1.0
    return out


def test_embedded_texts_are_those_gram_by_gram(monkeypatch):
    texts = [t or "" for t in TEXTS]
    monkeypatch.setattr(search, "REMEMBERED", 5)
    assert search.embed_texts(texts).tolist() == [plain(t) for t in texts]
    assert search.embed_texts([]).shape == (0, 64)


def test_semantic_embeds_a_sentence_once():
    asked = []

    def embed(texts):
        asked.extend(texts)
        return search.embed_texts(texts)

    for text in filter(None, TEXTS):
        asked.clear()
        assert chunks.semantic(text, embed, 300, sums=True) == chunks.semantic(text, lambda ts: [plain(t) for t in ts], 300)
        assert sum(map(len, asked)) <= len(text)


def test_embedded_chunks_are_chunks_and_embeddings(spark):
    docs = spark.createDataFrame([(k, "x" if k else None, t) for k, t in enumerate(TEXTS * 40)], "doc_id long, source string, text string")
    got = search.embedded_chunks(docs)
    want = docs.select("doc_id", "source", F.posexplode(chunks.chunk(F.col("text"), "sentence")).alias("n", "text")).collect()
    rows = got.collect()
    assert sorted((r["doc_id"], r["source"] or "", r["n"], r["text"]) for r in rows) == sorted((r["doc_id"], r["source"] or "", r["n"], r["text"]) for r in want)
    assert all(r["embedding"] == plain(r["text"]) for r in rows)
    assert got.collect() and search.embedded_chunks(docs.filter("doc_id < 0")).collect() == []
    # one worker of Python for a task, not one for each step
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_an_exact_search_hands_on_k_of_a_block(spark):
    """In random directions the codes rule out little; what blocks hand on must not grow with the rows."""
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(4_000, 32)))] + [(10_000 + k, [1.0] * 32) for k in range(500)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    index, queries = vectorindex.build(vectors), vectors.filter("id % 100 = 0")
    got = index.search(queries, 5, exact=True, counted=True).collect()
    want = search.knn(queries, vectors, 5).collect()
    key = lambda r: (r["query_id"], r["rank"], r["id"], round(r["similarity"], 9))
    assert sorted(map(key, got)) == sorted(map(key, want))
    blocks = max(1, min(spark.sparkContext.defaultParallelism, 4_500 // vectorindex.LEAST_BLOCK))
    assert max(r["scored"] for r in got) <= 6 * blocks


def test_equal_vectors_are_not_all_handed_on(spark, monkeypatch):
    """A product of matrices hands on k of each query, also where all rows are equally near."""
    vectors = spark.createDataFrame([(k, k % 2, [1.0, 2.0]) for k in range(600)], "id long, label int, embedding array<double>").coalesce(1)
    monkeypatch.setattr(search, "PRODUCT", 50)
    got = search.knn(vectors, vectors, 3, apart="label").collect()
    assert len(got) == 1_800 and {r["id"] for r in got if r["query_id"] == 599} == {0, 2, 4}


@pytest.mark.parametrize("share", [1, 100])
def test_sections_that_ask_are_compared_with_all(spark, share):
    rng = np.random.default_rng(5)
    rows = [(k, k % 7, 0, (rng.normal(size=8) + 3).tolist()) for k in range(300)]
    sections = spark.createDataFrame(rows, "id long, doc int, n int, v array<double>")
    every = knowledge.semantic_refs(sections, "id", "doc", "n", "v", 0.8, every_pair=True)
    got = knowledge.semantic_refs(sections, "id", "doc", "n", "v", 0.8, asks=F.col("id") % share == 0)
    key = lambda r: (r["source_section"], r["target_section"], round(r["similarity"], 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, every.filter(F.col("source_section") % share == 0).collect())) != []


def test_many_questions_are_ranked_in_one_pass(spark, tmp_path):
    """The same ranks as one by one, after an increment and with a filter; no posting is shuffled once for each question."""
    import random

    from loomdoc.operators.postings import StoredIndex

    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)]
    corpus = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 6, 30])))) for i in range(300)] + [(1_000 + i, "w1 w2 w2 w9") for i in range(20)]
    index = StoredIndex.create(spark.createDataFrame(corpus, "id long, text string").repartition(3), str(tmp_path / "index"))
    index.update(spark.createDataFrame([(3, "w1 w1 w3"), (4, None), (2_000, "w2 w3")], "id long, text string"))
    terms = spark.createDataFrame([(q, f"w{t}") for q in range(12) for t in range(q % 4 + 1, q % 4 + 4)] + [(99, "none")], "query long, token string")
    key = lambda r: (r["query"], r["id"], round(r["score"], 9))
    only = spark.range(0, 3_000, 2)
    for some in (None, only):
        got = index.top_of_many(terms, 5, only=some).collect()
        assert sorted(map(key, got)) == sorted(map(key, index.top(terms, 5, only=some).collect())) != []
    assert index.top_of_many(terms.filter("query = 99"), 5).collect() == []
