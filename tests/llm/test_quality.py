import collections

from pyspark.sql import functions as F

from llm_helpers import WORD, words
from loomdoc.llm import quality


def test_quality_counts_and_order(docs, rows):
    got = {}
    for r in quality.judge(docs, sample_rows=20).collect():
        got[str(r["doc_id"])] = r
    for r in rows:
        t = r[1] or ""
        w = words(t)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = got[str(r[0])]
        assert (g["n_words"], g["word_chars"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert g["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (g["base_failed"] and g["kept"])
    kept = {k: g["kept"] for k, g in got.items()}
    reverse = {str(r["doc_id"]): r["kept"] for r in quality.judge(docs, quality.rules()[::-1]).filter("kept or not kept").collect()}
    assert kept == reverse


def test_of_rules_that_reject_alike_the_cheap_one_runs_first(spark, docs):
    many = F.lit(False)
    for k in range(40):
        many = many | (F.regexp_count(F.col("_text"), F.lit(rf"(\\w+\\s+){{{k % 5}}}zz{k}")) > 9)
    rules = [quality.Rule("dear", many | (F.col("n_words") > 50)), quality.Rule("cheap", F.col("n_words") > 50), quality.Rule("idle", F.lit(False))]
    assert [r.name for r in quality.ordered(docs, rules, 1_000)] == ["cheap", "dear", "idle"]


def test_very_long_texts_and_clashing_columns(spark):
    text = "one two three four five six " * 40_000
    rows = [(1, text, 3, "x"), (1, text, 3, "x"), (2, "", 4, None)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words int, _text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in got) == [(1, 240_000, 240_000)] * 2 + [(2, 0, 0)]
