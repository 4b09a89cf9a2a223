"""Batched retrieval against single questions, table functions against columns, and the graph stream against a rebuild."""

import random

from pyspark.sql import functions as F

from loomdoc.functions import chunks, tables
from loomdoc.operators import knowledge, retrieval, search, vectorindex
from loomdoc.operators.postings import StoredIndex
from loomdoc.streaming import graph

SENTENCES = ["개인정보처리자는 정보주체의 동의를 제한한다", "과태료의 부과는 전자정부법 제3조를 준용한다", "영향평가를 위반한 자는 과징금에 처한다", "열람권리는 제2조에 의거한다", "파기는 보유기간을 정의한다"]


def rows_of(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_many_questions_equal_one_by_one(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "law", "duty", "fine", "전자정부법", "제3조"]
    data = [(i, i // 2, f"law {i % 4}", " ".join(rng.choice(words) for _ in range(12)) + (" 전자정부법 제3조" if i % 5 == 0 else ""), i % 3) for i in range(120)]
    held = spark.createDataFrame(data, "id long, section long, title string, text string, kind int").withColumn("embedding", search.hashed_embedding(F.col("text")))
    index = StoredIndex.create(held.select("id", "text"), str(tmp_path / "postings"))
    vectors = vectorindex.build(held)
    asked = [(0, "alpha beta duty"), (5, "fine law"), (7, "제3조 gamma")]
    refs = spark.createDataFrame([(i, (i * 7) % 60, i, (i * 7) % 60, 0.7 + (i % 4) / 10) for i in range(60)], "source_section long, target_section long, source_document long, target_document long, confidence double")
    only = held.filter("kind <> 1").select("id")
    frame = lambda qs: spark.createDataFrame(qs, "query long, text string")
    together = retrieval.multi_hop(frame(asked), index, vectors, held, refs, 4, only)
    got = rows_of(together, "query", "place", "id", "similarity", "hop")
    assert {r[0] for r in got} == {0, 5, 7} and any(r[4] == 2 for r in got)
    single = rows_of(retrieval.multi_hop(frame(asked[:1]), index, vectors, held, refs, 4, only), "query", "place", "id", "similarity", "hop")
    assert single == [r for r in got if r[0] == 0]
    # a filter holds inside the lists: as many hits, all allowed, and those of the single-question operator
    hits = retrieval.retrieve(frame(asked), index, vectors, 4, only).collect()
    assert len(hits) == 12 and all(r["id"] % 3 != 1 for r in hits)
    best = search.vector_top_k(held.join(only, "id", "left_semi"), search.embed_text("fine law").tolist(), 8).collect()
    near = retrieval.vector_list(frame(asked[1:2]), vectors, 8, only).collect()
    assert sorted(round(r["similarity"], 9) for r in near) == sorted(round(r["similarity"], 9) for r in best)


def test_table_functions_equal_columns(spark):
    tables.register(spark)
    texts = [(1, "One. Two! Three? " * 60), (2, None), (3, ""), (4, "# A\n\nbody"), (5, ". ".join(SENTENCES))]
    df = spark.createDataFrame(texts, "id long, text string")
    for strategy in [*chunks.STRATEGIES, "unknown"]:
        got = spark.sql("SELECT d.id, c.n, c.chunk FROM {d} d, LATERAL chunk(d.text, {s}) c", d=df, s=strategy)
        want = df.select("id", F.posexplode(chunks.chunk(F.col("text"), strategy)).alias("n", "chunk"))
        assert rows_of(got, "id", "n", "chunk") == rows_of(want, "id", "n", "chunk")
    got = spark.sql("SELECT d.id, e.* FROM {d} d, LATERAL extract_entities(d.text, '전자정부법') e", d=df)
    want = knowledge.entities(df.withColumn("own", F.lit("전자정부법")), "id", "text", "own")
    assert rows_of(got, "id", "n", "name", "type", "place") == rows_of(want, "id", "n", "name", "type", "place")


def test_graph_stream_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(8)
    source, now = str(tmp_path / "edits"), {}
    schema = "doc long, id long, version long, text string"
    store = graph.GraphStore(spark, str(tmp_path / "store"))

    def write(version):
        edits = []
        for _ in range(12):
            i = rng.randrange(20)
            text = None if rng.random() < 0.25 and now.get(i) else ". ".join(rng.sample(SENTENCES, 2)) + "."
            edits.append((i % 4, i, version * 100 + len(edits), text))
            now[i] = text
        edits += [(i % 4, i, version * 100 + 90, t) for i, t in list(now.items())[:3]]  # as they are
        spark.createDataFrame(edits, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        graph.keep_graph(stream, store, str(tmp_path / "checkpoint")).awaitTermination()

    for version in range(3):
        write(version)
        if version != 1:  # two files at once the second time, and every run restarts from the checkpoint
            run()
    sections = spark.createDataFrame([(i % 4, i, t) for i, t in now.items() if t is not None], "doc long, id long, text string")
    entities, triples = knowledge.build_graph(sections, "doc", "id", "text")
    assert rows_of(store.table("entities"), "doc", "id", "name", "type", "place") == rows_of(entities, "doc", "id", "name", "type", "place")
    got = rows_of(store.table("triples"), "doc", "id", "subject", "predicate", "object", "confidence")
    assert got == rows_of(triples, "doc", "id", "subject", "predicate", "object", "confidence") and got
    # a batch that runs again writes the same
    store.apply(spark.createDataFrame([(r["doc"], r["id"], "add", now[r["id"]]) for r in spark.read.parquet(f"{store.path}/sections").filter("batch = 2 and alive").collect()], graph.CHANGES), 99)
    assert rows_of(store.table("triples"), "doc", "id", "subject", "predicate", "object", "confidence") == got
