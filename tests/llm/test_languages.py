import math
import zlib

import numpy as np
import pandas as pd

from loomdoc.llm import languages

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy_and_folds(spark):
    docs = pd.read_parquet(DATA)
    got = languages.query(spark, DATA.rsplit("/", 1)[0]).toPandas().merge(docs, on="doc_id", suffixes=("", "_doc"))
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]).all()
    out = got[got["held_out"] & got["lang"].notna()]
    assert len(out) > 150 and (out["lang_pred"] == out["lang"]).mean() > 0.98


def test_learning_sees_no_held_out_row(spark):
    docs = pd.read_parquet(DATA)
    out = [zlib.crc32(str(d).encode()) % 4 == 2 for d in docs["doc_id"]]
    changed = docs.assign(lang=[("xx" if o else v) for o, v in zip(out, docs["lang"])], text=[("zzz" if o else v) for o, v in zip(out, docs["text"])])
    a, b = (languages.learn(spark.createDataFrame(x[["doc_id", "text", "lang"]])) for x in (docs, changed))
    assert a.names == b.names and (a.trigrams == b.trigrams).all() and (a.letters == b.letters).all()


def model():
    a, b, c = "the cat sat on the mat with that other hat", "der hund und die katze schlafen auf dem boden", "el perro corre por la calle con una pelota"
    names, buckets = ["de", "en", "es"], 1 << 14
    held = np.zeros((buckets + languages.LETTER_BUCKETS, 3))
    for k, text in enumerate((b, a, c)):
        trigram, letter, _ = languages.grams(text, buckets)
        np.add.at(held[:, k], np.concatenate([trigram, buckets + letter]), 1)
    log = lambda part: np.log((part + 0.5) / (part.sum(axis=0) + 0.5 * len(part))).astype(np.float32)
    return languages.Model(names, log(held[:buckets]), (log(held[buckets:]) / 2).astype(np.float32))


def test_sets_of_languages():
    m = model()
    english, german = "the cat sat on that mat ", "der hund und die katze "
    lang, score, langs = m.judge([english * 20, german * 20, english * 20 + german * 10, "", "123 ... $$", "cat", english * 9 + "und " + english * 9])
    assert lang == ["en", "de", "en", "und", "und", "en", "en"]
    assert [x.count(":") for x in langs] == [1, 1, 2, 0, 0, 1, 1]
    shares = dict(x.split(":") for x in langs[2].split(","))
    assert abs(float(shares["en"]) - 120 / 170) < 0.05 and abs(float(shares["de"]) - 50 / 170) < 0.05
    assert score[3] == score[4] == 0 and score[5] < score[0] and 0.6 < score[2] < 0.8


def test_mixture_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    n = np.array([1, 7, 40, 3])
    likelihood = -rng.gamma(2.0, 2.0, (n.sum(), 5))
    likelihood -= likelihood.max(axis=1, keepdims=True)
    shares, chosen = languages.mixture(likelihood, n)
    for k, (end, size) in enumerate(zip(np.cumsum(n), n)):
        words = [[math.exp(v) for v in row] for row in likelihood[end - size : end]]

        def em(allowed, words=words):
            p = [1 / len(allowed) if j in allowed else 0.0 for j in range(5)]
            for _ in range(languages.ROUNDS):
                q = [0.0] * 5
                for w in words:
                    total = sum(x * y for x, y in zip(w, p))
                    for j in range(5):
                        q[j] += w[j] * p[j] / total / len(words)
                p = q
            return p, sum(math.log(sum(x * y for x, y in zip(w, p))) for w in words)

        whole = em(range(5))[0]
        assert np.allclose(shares[k], whole, atol=5e-3)
        order = sorted(range(5), key=lambda j: -shares[k][j])
        single = [sum(math.log(w[j]) for w in words) for j in range(5)]
        sets = [(max(single), [1.0 if j == int(np.argmax(single)) else 0.0 for j in range(5)])]
        for m in range(2, languages.SET + 1):
            p, reached = em(order[:m])
            sets.append((reached - (m - 1) * (languages.PENALTY + math.log(size) / 2), p))
        assert np.allclose(chosen[k], max(sets, key=lambda s: s[0])[1], atol=5e-3)


def test_slices_and_long_texts_give_the_same(spark):
    m = model()
    texts = ["the cat sat ", "la calle con una pelota ", "der hund "] * 30
    together = m.judge(texts)
    alone = [m.judge([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone], atol=2e-2)
    long_text = "the cat sat on that mat " * 60_000
    assert np.allclose(m.words(long_text), np.tile(m.words("the cat sat on that mat "), (60_000, 1)), atol=1e-4)
    assert m.judge([long_text])[0] == ["en"]


def test_odd_rows_and_columns(spark, docs, rows, empty):
    got = languages.identify(docs, languages.learn(docs)).collect()
    assert len(got) == len(rows)
    assert all((r["_lang"] == "und") == (not languages.has_letter(r["text"])) for r in got)
    assert sorted((r["doc_id"] or 0, r["node"] or "", r["size"] or "") for r in got) == sorted((r[0] or 0, r[8] or "", r[7] or "") for r in rows)
    assert languages.identify(empty, languages.learn(empty)).collect() == []
    unlearned = languages.identify(docs, languages.learn(empty)).collect()
    assert {(r["_lang"], r["_score"]) for r in unlearned} == {("und", 0.0)}
    clash = docs.select("doc_id", "text", docs["lang"].alias("_lang"), docs["lang"])
    assert languages.identify(clash, languages.learn(docs)).columns == ["doc_id", "text", "lang", "_lang", "_score", "_langs"]
