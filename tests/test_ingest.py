"""Web, statute and account jobs by hand."""

import datetime

from pyspark.sql import functions as F

from loomdoc.functions import web
from loomdoc.operators import ingest, mutations, relational
from loomdoc.sources import statutes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_board_without_rows_gives_links(spark):
    html = '<a href="/a?seq=1">An article here</a><a href="#view">An article there</a><a href="javascript:view()">Some script link</a><a href="view.do?x=2">abc</a>'
    got = one(spark, web.board_rows(F.lit(html), F.lit("https://h.example/b/list.do")))
    assert [(r["title"], r["url"], r["day"]) for r in got] == [("An article here", "https://h.example/a?seq=1", None), ("An article there", "https://h.example/b/#view", None)]


def test_addresses_on_a_page(spark):
    base = "https://h.example/b/list.do?p=1"
    want = {"http://x/y": "http://x/y", "//c.example/z": "https://c.example/z", "/r": "https://h.example/r", "?p=2": "https://h.example/b/list.do?p=2", "s.do": "https://h.example/b/s.do"}
    assert {h: one(spark, web.resolved_url(F.lit(h), F.lit(base))) for h in want} == want
    assert one(spark, web.resolved_url(F.lit("x"), F.lit("https://h.example"))) == "https://h.example/x"


def test_paragraphs_of_a_crawl(spark):
    text = "short\n\n" + "a  b " * 10 + "\n\n\n" + "c" * 30
    assert one(spark, web.crawl_paragraphs(F.lit(text))) == [" ".join(["a b"] * 10), "c" * 30]
    assert one(spark, web.crawl_paragraphs(F.lit("tiny"))) == []
    assert one(spark, web.crawl_paragraphs(F.lit("w " * 8 + "\n\n" + "v " * 8))) == [" ".join(["w"] * 8 + ["v"] * 8)]


def test_answers_of_a_model(spark):
    got = one(spark, web.parsed_answer(F.lit('```json\n{"결론": "yes", "caveats": "none", "evidenceChain": [{"sourceIndex": 1}, {"step": 9}]}\n```')))
    assert (got["format"], got["conclusion"], got["caveats"], got["evidence"]) == ("json", "yes", "none", [1, 9])
    assert [tuple(r) for r in one(spark, web.verified(F.lit([1, 9]), F.lit(3)))] == [(1, True), (9, False)]
    got = one(spark, web.parsed_answer(F.lit("## 결론\nyes [근거 2]\n## 주의사항\ncare")))
    assert (got["format"], got["conclusion"], got["caveats"], got["evidence"]) == ("markdown", "yes [근거 2]", "care", [2])
    assert one(spark, web.parsed_answer(F.lit("just text")))["conclusion"] == "just text"


def test_rules_and_ordinances():
    rows = statutes.rule_articles(["제1장 총칙", "제1조(목적) 이 규칙은", "이어서", "제2조의3 본문", "제2장 벌칙", "제3조(벌) 끝"])
    assert [(r["label"], r["content"]) for r in rows] == [("제1장 총칙 > 제1조(목적)", "이 규칙은\n이어서"), ("제1장 총칙 > 제2조의3", "본문"), ("제2장 벌칙 > 제3조(벌)", "끝")]
    assert statutes.rule_articles(["머리"])[0]["label"] == "본문 1"
    assert [r["number"] for r in statutes.ordinance_articles([{"조내용": "x", "조문번호": ["000300"]}, {"조내용": "", "조문번호": "1"}])] == ["3"]
    assert statutes.parsed("no json") == ("", []) and statutes.parsed(None) == ("", [])
    name, found = statutes.parsed('{"AdmRulService": {"행정규칙기본정보": {"행정규칙명": "R"}, "조문내용": {"10": "제2조(나) b", "9": "제1조(가) a", "x": "z"}}}')
    assert name == "R" and [r["number"] for r in found] == ["1", "2"]
    law = statutes.law_articles([{"조문내용": "제1편 가"}, {"조문내용": "제1장 나"}, {"조문내용": "제1절 다"}, {"조문내용": "제2장 라"}, {"조문내용": "t", "조문제목": "q", "조문번호": "7"}])
    assert law[0]["label"] == "제1편 가 > 제2장 라 > 제7조(q)"


def test_custom_page_sections(spark):
    pages = spark.createDataFrame([(1, 1, "head 제1조 a"), (1, 2, "b 제2조 c")], "doc int, page int, text string")
    got = statutes.page_sections(pages, "doc", "page", "text", "custom", r"제\d+조").orderBy("section_index").collect()
    assert [r["text"] for r in got] == ["head", "제1조 a\n\nb", "제2조 c"]


def test_ingest_gives_all_tables(spark):
    rows = [(1, 0, "정보주체는 동의를 제한한다. secret here.", "내 법"), (1, 1, None, "내 법"), (2, 0, "", None)]
    out = ingest.ingest(spark.createDataFrame(rows, "doc int, section_index int, text string, title string"), {"secret": "x"}, title="title")
    chunks = out["chunks"].collect()
    assert [r["text"] for r in chunks] == ["정보주체는 동의를 제한한다. x here."] and chunks[0]["enriched"].startswith("문서: 내 법\n")
    assert out["triples"].count() == 1 and out["entities"].filter("type = 'law'").count() == 1 and out["index"].count() == 5
    assert sorted(r["redactions"] or 0 for r in out["sections"].collect()) == [0, 0, 1]


def test_statuses_caps_and_caches(spark):
    at = datetime.datetime(2024, 1, 2)
    usage = spark.createDataFrame([("p", at)] * 2, "provider string, ts timestamp")
    caps = spark.createDataFrame([("p", 3, True), ("q", 0, True), ("r", 0, False)], "provider string, cap int, enabled boolean")
    asked = spark.createDataFrame([(i, p) for i, p in enumerate("ppqqrz")], "id int, provider string")
    got = {r["id"]: (r["allowed"], r["result"]) for r in ingest.tracked_calls(asked, usage, caps, "provider", "ts", "2024-01-02", "id", F.upper, "provider").collect()}
    assert got == {0: (True, "P"), 1: (False, None), 2: (True, "Q"), 3: (True, "Q"), 4: (False, None), 5: (False, None)}
    assert {r["provider"]: r["allowed"] for r in relational.limit_check(usage, caps, "provider", "ts", "2024-01-02").collect()} == {"p": True, "q": True, "r": False}


def test_vectors_of_another_length_go(spark):
    chunks = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "doc int, embedding array<double>")
    documents = spark.createDataFrame([(1, "done"), (2, "done")], "doc int, embedding_status string")
    kept, status = ingest.reset_vectors(chunks, documents, 3)
    assert {r["doc"]: r["embedding"] for r in kept.collect()} == {1: None, 2: [1.0, 2.0, 3.0]}
    assert {r["doc"]: r["embedding_status"] for r in status.collect()} == {1: "pending", 2: "done"}


def test_accounts_and_states(spark):
    users, gone = spark.createDataFrame([(1,), (2,)], "u int"), spark.createDataFrame([(2,)], "u int")
    messages, pairs, notes = spark.createDataFrame([(1, 1), (2, 2)], "m int, who int"), spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), spark.createDataFrame([(2, "bye"), (1, "x")], "who int, reason string")
    left, owned, friends, named = mutations.account_removed(users, "u", gone, [(messages, "who")], pairs, ("a", "b"), notes, "who")
    assert [r["u"] for r in left.collect()] == [1] and [r["m"] for r in owned[0].collect()] == [1] and [tuple(r) for r in friends.collect()] == [(1, 3)]
    assert sorted(((r["who"], r["reason"]) for r in named.collect()), key=str) == [(1, "x"), (None, "bye")]
    assert mutations.both_ways_gone(pairs, spark.createDataFrame([(2, 1)], "a int, b int"), "a", "b").count() == 1
    log = spark.createDataFrame([("x", 1, "add"), ("x", 2, "block"), ("x", 3, "add"), ("y", 1, "block"), ("z", 1, "add"), ("z", 2, "drop")], "k string, at int, e string")
    steps = {(None, "add"): "friend", ("friend", "block"): "blocked", ("friend", "drop"): None}
    assert {r["k"]: r["state"] for r in mutations.guarded_state(log, ["k"], "at", "e", steps).collect()} == {"x": "blocked"}
    assert [r["u"] for r in mutations.deleted(users, "u", 1).collect()] == [2]
    assert sorted(r["u"] for r in mutations.updated(users, "u", 1, u=9).collect()) == [2, 9]


def test_prompts_number_their_sources(spark):
    hits = spark.createDataFrame([(1, f"t{i}", float(i)) for i in range(4)], "q int, text string, score double")
    asked = spark.createDataFrame([(1, "why"), (2, "what")], "q int, question string")
    got = {r["q"]: r["prompt"] for r in ingest.answer_prompts(asked, hits, "q", "question", "{{question}}?\n{{sources}}", 2).collect()}
    assert got == {1: "why?\n[1] t3\n[2] t2", 2: "what?\n"}


def test_null_differs_from_a_value(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, None)], "k int, v string"), spark.createDataFrame([(1, None), (2, None), (4, "z")], "k int, v string")
    assert tuple(relational.reconcile(a, b, "k", ["v"]).first()) == (4, 1, 2)
