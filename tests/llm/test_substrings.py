import collections
import hashlib
import random

from pyspark.sql import functions as F

from llm_helpers import words
from loomdoc.llm import substrings


def test_substrings(docs, rows):
    window = 10
    starts = collections.Counter(tuple(w[i : i + window]) for r in rows for w in [words(r[1])] for i in range(len(w) - window + 1))
    got = collections.defaultdict(list)
    for r in substrings.remove_repeats(docs, window, 4).collect():
        got[str(r["doc_id"])].append((r["n_words"], r["n_removed"], r["kept_text"], r["lang"]))
    want = collections.defaultdict(list)
    for r in rows:
        w = words(r[1])
        gone = {k for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        want[str(r[0])].append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), r[2]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_kept_text_digest_is_plain_sha256(docs):
    r = substrings.remove_repeats(docs.limit(1)).select(F.sha2("kept_text", 256).alias("h"), "kept_text").first()
    assert r["h"] == hashlib.sha256(r["kept_text"].encode()).hexdigest()


def test_columns_of_any_name_come_back_as_they_were(spark):
    passage = " ".join("p%d" % i for i in range(40))
    rows = [(1, "a " + passage, 7, "x", True, 5, 6, 8, 9), (2, passage + " b", 8, "y", None, None, 1, 2, 3), (2, passage + " b", 8, "y", None, None, 1, 2, 3), (3, None, 1, "z", False, 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t long, at string, all boolean, n_words long, _t long, window long, copies long")
    out = substrings.remove_repeats(docs, 35, 8)
    assert out.columns == ["doc_id", "text", "t", "at", "all", "_t", "window", "copies", "n_words", "n_removed", "kept_text"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([(*r[:5], *r[6:], *({1: (41, 40, "a"), 2: (41, 41, ""), 3: (0, 0, "")}[r[0]])) for r in rows])


def test_hot_keys_by_broadcast_and_the_rest_by_shuffle_agree(spark, monkeypatch):
    rng = random.Random(3)
    passage = " ".join("p%d" % i for i in range(30))
    rows = [(i, " ".join("w%d" % rng.randrange(40) for _ in range(rng.randrange(50))) + " " + passage * (i % 2)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = lambda: sorted((r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(docs, 10, 4).collect())
    every = keys()
    monkeypatch.setattr(substrings, "HOT_KEYS", 3)
    monkeypatch.setattr(substrings, "BROADCAST_KEYS", 0)
    assert keys() == every
