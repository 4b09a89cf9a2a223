"""Statute operators by hand."""

from pyspark.sql import functions as F

from loomdoc.operators import knowledge as ops


def test_entities_by_hand():
    text = "개인정보처리자는 전자정부법 제3조의2제1항에 따라 보호위원회의 의무를 진다. 동의 동의"
    got = ops.entities_of(text, "내 법")
    # a law's name reaches back over the words before it; a duty needs a letter before its word
    assert got == [
        ("개인정보처리자는 전자정부법", "law", 0), ("내 법", "law", 0), ("제3조의2제1항", "article", 15), ("전자정부", "organization", 9), ("보호위원회", "organization", 28),
        ("개인정보", "concept", 0), ("동의", "concept", 43), ("개인정보처리자", "concept", 0),
    ]
    assert not any(n == "개인정보처" for n, _, _ in got)  # part of a longer concept
    assert ops.entities_of("", None) == []


def test_triples_by_particles_and_order(spark):
    rows = [(1, "정보주체는 동의를 제한한다.\n정보주체와 동의의 제한"), (2, "동의를 정보주체는 위반하고 부과한다"), (3, "정보주체 동의"), (4, None)]
    sections = spark.createDataFrame(rows, "id long, t string")
    got = {(r["id"], r["subject"], r["predicate"], r["object"]): (r["confidence"], r["context"]) for r in ops.triples(sections, ops.entities(sections, "id", "t"), "id", "t").collect()}
    assert got[1, "정보주체", "제한", "동의"] == (1.0, "정보주체는 동의를 제한한다")
    assert got[2, "정보주체", "위반", "동의"][0] == 1.0 and got[2, "정보주체", "부과", "동의"][0] == 1.0  # the particles decide, not the order
    assert got[2, "동의", "위반", "정보주체"][0] == 0.7
    assert not any(k[0] in (3, 4) for k in got)


def test_section_hash_by_hand(spark):
    def plain(t):
        h = 0
        for c in t:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        h, digits, out = (h - 2**32 if h >= 2**31 else h), "0123456789abcdefghijklmnopqrstuvwxyz", ""
        n = abs(h)
        while n:
            n, d = divmod(n, 36)
            out = digits[d] + out
        return ("-" if h < 0 else "") + (out or "0")

    texts = ["", "a", "hello world", "제1조(목적) 이 법은", "z" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ops.section_hash(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {t: plain(t) for t in texts}


def test_update_equals_a_new_build(spark):
    old = spark.createDataFrame([(1, i, f"정보주체는 동의를 제한한다. {i}") for i in range(6)], "doc int, id long, t string")
    new = spark.createDataFrame([(1, i, f"정보주체는 동의를 제한한다. {i}" if i % 2 else f"과태료는 벌칙에 위반한다. {i}") for i in range(1, 8)], "doc int, id long, t string")
    hashes = old.select("id", ops.section_hash(F.col("t")).alias("h"))
    _, entities, triples = ops.update_graph(hashes, *ops.build_graph(old, "doc", "id", "t"), new, "doc", "id", "t")
    want = ops.build_graph(new, "doc", "id", "t")
    for got, expected in ((entities, want[0]), (triples, want[1])):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select(*got.columns).collect()))
    assert entities.count() > 0


def test_references_know_their_relation_and_skip_the_own_law():
    text = "신용정보법 제2조를 준용하고, 전자정부법 제3조제1항제2호" + "-" * 40 + " 위반 - 정보통신망법 제4조 예외 위반"
    got = [(r["law"], r["article"], r["relation"]) for r in ops.refs_of(text, "신용 정보법")]
    assert [g[1:] for g in got] == [("제3조제1항제2호", "준용"), ("제4조", "예외")]
    assert ops.refs_of("") == []


def test_filters_and_references_of_a_document(spark):
    rows = spark.createDataFrame([("law", "Alpha"), ("duty", "beta"), ("law", "Beta")], "type string, name string")
    assert ops.filtered(rows, "law", "bet").count() == 1 and ops.filtered(rows).count() == 3
    refs = spark.createDataFrame([(1, 2, 10, 20, 0.9), (3, 4, 30, 10, 1.0), (5, 6, 30, 40, 1.0)], "source_section int, target_section int, source_document int, target_document int, confidence double")
    assert [r["source_section"] for r in ops.refs_of_document(refs, 10).collect()] == [3, 1]


def test_graph_joins_stay_out_of_the_driver(spark):
    """Mentions and sentences are more than Spark expects of their sections, so no join may send them to the driver."""
    from loomdoc.operators import knowledge

    sections = spark.range(20).selectExpr("id", "id % 3 doc", "'과태료는 보호위원회에 위임한다. 영향평가를 위반한 자는 과징금에 처한다.' txt")
    for made in knowledge.build_graph(sections, "doc", "id", "txt"):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
