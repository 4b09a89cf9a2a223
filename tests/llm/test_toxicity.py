import random
import zlib

from loomdoc.llm import crf, toxicity


def test_crf_marginals_are_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    chain = crf.Chain(rng.normal(size=4), rng.normal(size=(2, 2)), 0.3)
    sequences = [rng.integers(0, 4, n).astype(np.int32) for n in (0, 1, 5, 7, 2)]
    for s, got in zip(sequences, chain.marginals(sequences)):
        total, p = 0.0, np.zeros(len(s))
        for y in itertools.product((0, 1), repeat=len(s)):
            if not len(s):
                break
            e = sum(chain.emit[f] for f, k in zip(s, y) if k) + sum(chain.step[a, b] for a, b in zip(y, y[1:])) + chain.first * y[0]
            total += np.exp(e)
            p += np.exp(e) * np.array(y)
        assert np.allclose(got, p / total if len(s) else [])


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    plain = ["word%d" % i for i in range(200)]
    rows, labels = [], []
    for i in range(800):
        w = [rng.choice(plain) for _ in range(rng.randrange(3, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vilestuff", "vileness", "Vileish"]))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "nasty " * 5_000, "x"), (None, "word1 word2", "x")]
    rows += [rows[7], rows[7]]
    docs = spark.createDataFrame([(*r, 1.5, "mine") for r in rows], "doc_id long, text string, score string, _score double, tokens string")
    model = toxicity.learn(docs, spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    again = toxicity.score(docs, model)
    assert again.columns == ["doc_id", "text", "score", "tokens", "_score", "_spans"]
    assert len({r["_score"] for r in again.filter("doc_id = 7").collect()}) == 1 and again.filter("doc_id = 7").count() == 3
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i]["_score"] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[900]["_score"] == got[901]["_score"] < 0.5 < got[902]["_score"]
    text = dict((r[0], r[1]) for r in rows)
    spans = [text[i][int(a) : int(z)].lower() for i in held for s in filter(None, got[i]["_spans"].split(",")) for a, z in [s.split(":")]]
    assert spans and all(any(x in s for x in ("nasty", "vile")) for s in spans)


def test_features_and_curve_by_hand(spark):
    import numpy as np

    numbers = {"vile": 1, "^vile": 2, "tuff": 3}
    f = toxicity.Features(numbers)
    assert [f[w] for w in ("vile", "vilest", "stuff", "plain", "avile")] == [1, 1, 3, 0, 1]
    x = toxicity.features([np.array([0.2, 0.9]), np.empty(0)])
    assert np.allclose(x, [[1, 0.9, np.log(2.1)], [1, 0, 0]])
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(500), rng.normal(size=(500, 2))])
    y = (rng.random(500) < 1 / (1 + np.exp(-x @ [0.3, 1.0, -2.0]))).astype(float)
    beta = toxicity._logistic(x, y, np.ones(500))
    loss = lambda b: np.sum(np.logaddexp(0, x @ b) - y * (x @ b)) + 0.05 * b @ b
    assert all(loss(beta) <= loss(beta + step) for step in rng.normal(size=(200, 3)) * 0.01)
