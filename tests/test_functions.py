"""Chunkers, text functions and small operators against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import chunks as ch
from loomdoc.functions import text as tx
from loomdoc.operators import graphs, mutations, relational, search
from loomdoc.operators.components import connected_components
from loomdoc.streaming import limits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "   ", "x" * 2000, "a... b!", "One. Two? Three! " * 80, "no end", "\U0001f600. " * 300])
def test_chunks_are_not_blank_and_fit(text):
    for split in ch.STRATEGIES.values():
        assert all(p.strip() for p in split(text))
    assert all(len(c) <= 500 for c in ch.recursive(text, 500, 0))


def test_sentences_by_hand():
    assert ch.sentence("aaaa. bbbb. cccc.", 11, 0) == ["aaaa.", "bbbb. cccc."]  # a sentence counts with the space after it
    assert ch.sentence("aaaa. bbbb. cccc.", 12, 0) == ["aaaa. bbbb.", "cccc."]
    assert ch.sentence("aaaa. bbbb. cccc.", 12, 3) == ["aaaa. bbbb.", "b. cccc."]
    assert ch.sentence("aaaa. bbbb. cccc.", 12, 40) == ["aaaa. bbbb.", "cccc."]  # too little to overlap
    assert ch.sentence("a... b!") == ["a. b!"]  # of a run of marks the first stays
    assert ch.sentence("...") == ["..."] and ch.sentence(" \n") == []


def test_recursive_by_hand():
    assert [len(c) for c in ch.recursive("x" * 900, 500, 100)] == [500, 500]
    assert [len(c) for c in ch.recursive("x" * 901, 500, 100)] == [500, 500, 101]
    assert ch.recursive("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert ch.recursive("abcdefghij", 4, 9) == ["abcd", "efgh", "ij"]
    assert ch.recursive("aaaa\n\nbbbb\n\ncccc", 10, 0) == ["aaaa\n\nbbbb", "cccc"]
    # overlap is kept where it makes a chunk too long; a long piece goes on with the next separators and carries none
    assert ch.recursive("aaaa\n\nbbbb\n\ncccc", 10, 5) == ["aaaa\n\nbbbb", "\nbbbb\n\ncccc".strip()]
    assert ch.recursive("aa\n\nbbbbbb cccccc\n\ndd", 8, 3) == ["aa", "bbbbbb", "bbb cccccc", "dd"]


def test_articles_by_hand():
    assert ch.article("제1조(목적) 이 법은. 제2조(정의) ① 가나다. ② 라마바.", 800) == ["제1조(목적) 이 법은.", "제2조(정의) ① 가나다. ② 라마바."]
    long = "제1조(목적) 머리. 제2조(정의) " + "".join(f"{c} {'가' * 5}. " for c in "①②③")
    assert ch.article(long, 23) == ["제1조(목적) 머리.", "제2조(정의)\n제2조(정의)", "제2조(정의)\n① 가가가가가.", "제2조(정의)\n② 가가가가가.", "제2조(정의)\n③ 가가가가가."]
    assert ch.article("없음 " * 3, 6) == ch.recursive("없음 " * 3, 6, 0)


def test_parents_children_preview_and_types(spark):
    rows = ch.parents_and_children("aaaa. bbbb. cccc. dddd.", 12, 6, 0)
    assert rows == [(0, "aaaa. bbbb.", 0, "aaaa."), (0, "aaaa. bbbb.", 1, "bbbb."), (1, "cccc. dddd.", 0, "cccc."), (1, "cccc. dddd.", 1, "dddd.")]
    assert ch.parents_and_children("aa. bb.", 50, 4, 0) == [(0, "aa. bb.", 0, "aa."), (0, "aa. bb.", 1, "bb.")]
    got = one(spark, ch.preview(F.lit("x" * 900), "recursive", size=500, overlap=100))
    assert (got["total"], [len(c) for c in got["first"]], got["least"], got["most"], got["mean"]) == (2, [203, 203], 500, 500, 500)
    texts = {"개인정보 보호법 제1조": "law", "제1조 only": "default", "운영 지침": "regulation", "정답 ①": "exam", "plain": "default"}
    assert [one(spark, ch.document_type(F.lit(t))) for t in texts] == list(texts.values())


def test_markdown_paths():
    parts = ch.markdown("intro\n# A\nx\n## B\ny\n### C\nz\n# D\nw")
    assert parts == ["intro", "[A]\nx", "[A > B]\ny", "[A > B > C]\nz", "[D]\nw"]


def test_few_splits_are_spread(spark):
    from loomdoc.session import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(10, numPartitions=cores + 3)).rdd.getNumPartitions() == cores + 3


def test_breaks():
    d = [0.1, 0.9, 0.2, 0.3, 0.1]
    assert ch.breaks(d) == [1] and ch.breaks([]) == []
    assert ch.breaks(d, "stddev", 80) == [1]
    assert ch.breaks(d, "gradient", 80) == [1]  # the steps are 0.8, -0.7, 0.1, -0.2; the fourth in order is 0.8
    assert ch.breaks(d, "gradient", 50) == [1, 3]


def test_redaction_is_literal_and_longest_first(spark):
    text, n = tx.redacted(F.lit("S e crets, secret and SECRET"), {"secret": "$1\\x", "secrets": None})
    row = spark.range(1).select(text.alias("t"), n.alias("n")).first()
    assert (row["t"], row["n"]) == ("***, $1\\x and $1\\x", 3)


def test_html(spark):
    html = "<html><head><title> A <b>x</b></title><script>bad()</script></head><body><nav>n</nav><p>One&amp;two. Three</p></body></html>"
    assert one(spark, tx.html_title(F.lit(html))) == "A x"
    assert one(spark, tx.html_text(F.lit(html))) == "A x One&two.\nThree"


def test_urls_and_names(spark):
    checks = {"http://a.com/x": True, "https://10.0.0.1/": False, "ftp://a.com": False, "http://localhost:80": False, "http://172.20.1.1": False, "http://[::1]/": False}
    assert [one(spark, tx.public_url(F.lit(u))) for u in checks] == list(checks.values())
    assert one(spark, tx.file_name(F.lit("a/b\\c.txt"))) == "c.txt"
    assert one(spark, tx.file_name(F.lit(""))) == "untitled"
    assert one(spark, tx.rounded(F.lit(-2.5), 0)) == -2.0


def test_not_in_is_null_aware(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    ask = lambda values: sorted(r[0] for r in relational.not_in(df, "x", spark.createDataFrame(values, "k long"), "k").collect() if r[0] is not None)
    assert ask([(1,)]) == [2]
    assert ask([(1,), (None,)]) == []
    assert relational.not_in(df, "x", spark.createDataFrame([], "k long"), "k").count() == 3


def test_upsert_keeps_null_keys(spark):
    old = spark.createDataFrame([("a", None, 1, "x"), ("b", 1, 1, "y")], "url string, org int, v int, t string")
    new = spark.createDataFrame([("a", None, 2, "z"), ("b", 1, 2, "w")], "url string, org int, v int, t string")
    got = sorted((r["url"], r["t"]) for r in mutations.upsert(old, new, ["url", "org"], "v").collect())
    assert got == [("a", "x"), ("a", "z"), ("b", "w")]


def test_rate_limit_fold(spark):
    events = spark.createDataFrame([("k", i, t) for i, t in enumerate([0, 10, 59, 60, 61, 130])], "key string, id long, at long")
    got = [(r["window_start"], r["count"], r["allowed"]) for r in limits.batch(events, "key", "id", "at", 60, 2).orderBy("id").collect()]
    assert got == [(0, 1, True), (0, 2, True), (0, 3, False), (60, 1, True), (60, 2, True), (130, 1, True)]


def test_components_and_paths(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 20_000):
        got = {r["node"]: r["component"] for r in connected_components(df, few_edges=few).collect()}
        assert got == {x: find(x) for x in list(root)}
    path = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(0, 5)], "a long, b long")
    assert graphs.shortest_path(path, 0, 6).first()["path"] == [0, 5, 6]
    assert graphs.shortest_path(path, 6, 0).count() == 0


def test_communities_split_cliques(spark):
    clique = lambda base: [("d", base + i, base + j, 1.0) for i in range(4) for j in range(i)]
    edges = spark.createDataFrame([(g, min(a, b), max(a, b), w) for g, a, b, w in clique(0) + clique(10) + [("d", 0, 10, 0.1)]], "g string, a long, b long, w double")
    for method in ("louvain", "leiden"):
        of = {r["node"]: r["community"] for r in graphs.communities(edges, "g", method).collect()}
        assert len({of[i] for i in range(4)}) == 1 and of[0] != of[10] and sorted(set(of.values())) == [0, 1]


def test_communities_have_a_good_modularity(spark):
    rng = random.Random(8)
    rows = [("d", a, b, 1.0) for a in range(120) for b in range(a + 1, 120) if rng.random() < (0.5 if a % 6 == b % 6 else 0.02)]
    edges = spark.createDataFrame(rows, "g string, a long, b long, w double")
    of = graphs.communities(edges, "g")
    planted = spark.range(120).selectExpr("id node", "id % 6 community")
    q = lambda of: graphs.modularity(edges.drop("g"), of.select("node", "community")).first()["q"]
    assert q(of) > 0.9 * q(planted)


def test_mmr_with_full_trade_is_top_k(spark):
    hits = spark.createDataFrame([("q", i, "text number %d" % (i % 3), 1.0 / (i + 1)) for i in range(8)], "q string, id long, text string, score double")
    got = [r["id"] for r in search.mmr(hits, "q", "id", "text", "score", 3, trade=1.0).orderBy("mmr_rank").collect()]
    assert got == [0, 1, 2]
    diverse = [r["id"] for r in search.mmr(hits, "q", "id", "text", "score", 3, trade=0.1).orderBy("mmr_rank").collect()]
    assert len({i % 3 for i in diverse}) == 3


def test_knn_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "id long, embedding array<double>")
    got = [(r["id"], round(r["similarity"], 6)) for r in search.knn(v.filter("id = 1"), v, 3).orderBy("rank").collect()]
    assert got == [(2, 0.0), (3, 0.0), (4, -1.0)]


def test_capitals_are_those_of_the_sql(spark):
    import duckdb

    letters = [c for first, last in ((1, 0x600), (0x1E00, 0x2200), (0x2C00, 0x2D30), (0xFB00, 0xFB20), (0x10400, 0x10500)) for c in map(chr, range(first, last))]
    letters = [c for c in letters if c not in "\u019b\u0264"]  # their capitals are younger than DuckDB's tables
    texts = [*letters, "straße", "ﬁn ŉ ᾳ 😀"]
    con = duckdb.connect()
    want = {t: con.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts}
    got = {r["t"]: r["u"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.simple_upper(F.col("t")).alias("u")).collect()}
    assert {t: (got[t], want[t]) for t in want if got[t] != want[t]} == {}


def test_chunks_by_slices(spark, monkeypatch):
    import pyarrow as pa

    texts, held = ["One. Two? Three! " * 80, None, "", "end", "a b " * 400], []

    def split(t):
        held.append(t)
        return ch.recursive(t) if t else []

    monkeypatch.setattr(ch, "SLICE", 2)
    kind = pa.list_(pa.string())
    assert ch._by_slices(pa.array(texts), split, kind).to_pylist() == [ch.recursive(t) if t else [] for t in texts] and held == texts
    assert ch._by_slices(pa.array([], pa.string()), split, kind).to_pylist() == []
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r["c"] for r in rows.select(ch.chunk(F.col("t"), "recursive").alias("c")).collect()] == [ch.recursive(t) if t else [] for t in texts]
    assert [[tuple(x) for x in r["c"]] for r in rows.select(ch.parent_children(F.col("t")).alias("c")).collect()] == [ch.parents_and_children(t or "") for t in texts]
