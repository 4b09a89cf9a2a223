"""Text search against plain restatements."""

import random

from pyspark.sql import functions as F

from loomdoc.operators import search, vectorindex
from loomdoc.operators import textsearch as ops


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokenizer_by_hand(spark):
    text = "개인정보보호법 제15조제1항에 따라 CCTV cctv 정보주체의 동의를 개인정보"
    # longest nouns first and taken out; a run of four letters or more also gives its pairs; stop words go; a token once in any case
    want = ["개인정보보호법", "개인정보", "정보주체", "CCTV", "제15조제1항", "조제", "항에", "따라", "동의를"]
    assert ops.regex_tokens_of(text) == want
    assert one(spark, ops.regex_tokens(F.lit(text))) == want
    assert ops.regex_tokens_of("처리기준서 대한") == ["처리기준서", "처리", "리기", "기준", "준서"]
    assert one(spark, ops.regex_tokens(F.lit(None).cast("string"))) == []


def test_terms_of_a_word_in_order(spark):
    assert one(spark, ops.expanded(F.lit("정통망법"))) == ["정통망법", "정통", "통망", "망법", "정통망", "통망법", "정보통신망법", "정보통신망 이용촉진", "정보통신망", "이용촉진"]
    assert one(spark, ops.expanded(F.lit("ab"), use_synonyms=False)) == ["ab"]


def test_morpheme_terms_fall_back(spark):
    asked = spark.createDataFrame([(1, "동의 gdpr"), (2, "!"), (3, "")], "id int, q string")
    got = sorted((r["id"], r["word_no"], r["term"]) for r in ops.morpheme_terms(asked, "id", "q").collect())
    assert got == sorted([(1, 0, t) for t in ("동의", "gdpr", "의사표시", "개인정보보호", "정보보호", "규정")] + [(2, 0, "!")])


def covers(places, n_words):
    """Shortest runs that hold every word, by trying all."""
    found = []
    for i, (a, _) in enumerate(places):
        for j in range(i, len(places)):
            if len({w for _, w in places[i : j + 1]}) == n_words:
                found.append((a, places[j][0], j - i + 1))
                break
    return [(a, z, n) for a, z, n in found if not any((b, y) != (a, z) and a <= b and y <= z for b, y, _ in found)]


def test_cover_density_equals_all_runs(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("a b c x y z u v".split()) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    index = ops.inverted_index(spark.createDataFrame(docs, "id int, text string"), "id", {"text": "D"})
    terms = spark.createDataFrame([(1, k, t) for k, t in enumerate("abc")], "q int, word_no int, term string")
    got = {r["id"]: r["rank"] for r in ops.cover_density(ops.hits(index, terms, "id", "q"), terms, "id", "q", all_words=True).collect()}
    want = {}
    for i, t in docs:
        places = [(k, w) for k, w in enumerate(t.split()) if w in "abc"]
        c = sum(0.1 / (1 + (z - a) - (n - 1)) for a, z, n in covers(places, 3))
        if c:
            want[i] = c / (c + 1)
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_weights_of_fields(spark):
    docs = spark.createDataFrame([(1, "alpha", "beta"), (2, "beta", "alpha")], "id int, title string, body string")
    index = ops.inverted_index(docs, "id", {"title": "A", "body": "D"})
    terms = spark.createDataFrame([(1, 0, "alph")], "q int, word_no int, term string")
    got = {r["id"]: round(r["rank"], 6) for r in ops.cover_density(ops.hits(index, terms, "id", "q"), terms, "id", "q").collect()}
    assert got == {1: 0.5, 2: round(0.1 / 1.1, 6)}


def test_headline_has_two_fragments(spark):
    text = " ".join(["w"] * 30 + ["hit"] + ["w"] * 100 + ["hitting"] + ["w"] * 50 + ["hit"])
    got = one(spark, ops.headline(F.lit(text), ["hit"], most=20, before=2))
    assert got.count(" ... ") == 1 and got.split(" ... ")[0].startswith("w w <mark>hit</mark> w") and "<mark>hitting</mark>" in got
    assert one(spark, ops.headline(F.lit("a b c"), ["zz"], most=2)) == "a b"


def test_index_finds_nine_of_ten(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in centres[i % 30]]) for i in range(1_500)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.filter("id % 100 = 0")
    pairs = lambda df: {(r["query_id"], r["id"]) for r in df.collect()}
    exact = pairs(search.knn(q, v, 10))
    index = vectorindex.build(v, sample_rows=600)
    assert index.rows.count() == 1_500 and len(exact) == 150
    assert len(exact & pairs(index.search(q, 10, probes=12))) >= 0.9 * len(exact)
    assert pairs(index.search(q, 10, exact=True)) == exact


def test_knn_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, i % 3, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(90)]
    v = spark.createDataFrame(rows, "id long, doc int, embedding array<double>")

    def like(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    monkeypatch.setattr(search, "QUERY_BLOCK", 40)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 25)
    for apart in (None, "doc"):
        got = {(r["query_id"], r["rank"]): (r["id"], round(r["similarity"], 9)) for r in search.knn(v, v, 4, apart=apart).collect()}
        for i, d, a in rows:
            near = sorted(((-round(like(a, b), 9), j) for j, e, b in rows if j != i and not (apart and e == d)))[:4]
            assert [round(got[i, k + 1][1], 6) for k in range(4)] == [round(-s, 6) for s, _ in near]


def test_hybrid_filters_below_the_lists(spark):
    rows = [(i, "alpha beta " + "word " * (i % 5), "a" if i % 2 else "b") for i in range(60)]
    chunks = spark.createDataFrame(rows, "id long, text string, kind string").withColumn("embedding", search.hashed_embedding(F.col("text")))
    got = search.hybrid(chunks, "alpha beta", 10, where=F.col("kind") == "a", keep=["kind"]).collect()
    assert len(got) == 10 and all(r["kind"] == "a" and "<mark>alpha</mark>" in r["headline"] for r in got)
    short = search.hybrid(chunks, "alpha beta", 10, post_filter=F.col("kind") == "a", keep=["kind"]).collect()
    assert len(short) <= 10 and all(r["id"] % 2 for r in short)


def test_terms_are_distinct_without_a_shuffle(spark):
    terms = lambda rows: ops.query_terms(spark.createDataFrame(rows, "id int, q string"), "id", "q")
    listed = lambda df: sorted((r["id"] or 0, r["word_no"], r["term"]) for r in df.collect())
    plain = terms([(1, "anan 동의"), (2, "동의 pia PIA")])
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    found = listed(plain)
    assert len(found) == len(set(found)) and (1, 0, "an") in found and (2, 1, "영향평가") in found
    # ids in several rows, null ones too
    again = listed(terms([(1, "anan 동의"), (1, "anan other"), (None, "pia"), (None, "pia"), (2, "동의 pia PIA")]))
    assert len(again) == len(set(again)) and set(found) < set(again)
