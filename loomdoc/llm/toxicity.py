"""Operator 4: toxic spans by a linear-chain conditional random field, and document scores.

Learning uses a bounded sample of labelled rows: up to ``TRAIN_DOCS`` of each class, those
of least hash, with texts of up to ``TRAIN_CHARS``; rows with crc32(doc_id) mod 5 = 0 are never
used. Near copies among them (texts whose long words have three least hashes in common) count once. The field's weights are fitted on
``FIT_DOCS`` of the sample, evenly from its classes, the curve on all of it. Spark counts in how many sampled texts of each class a word or a part of one
occurs; up to ``LEXICON`` that are much more frequent in the toxic class become features. Labels are of documents,
so tokens are labelled at a distance: a word with a feature in a toxic text is toxic, other tokens are not.
The field learns emissions and transitions from these, and a logistic curve
on the marginals of the sample turns a text's into its score, at the true class rates.

Scoring reads whole texts: forward and backward odds give each token's marginal. The score rises with
the most toxic token and with the expected number of toxic tokens; runs of
tokens with a marginal of 1/2 or more are the offending spans (code points).

Null or empty text: no tokens, the score of a text without toxic tokens. Repeated
rows: scored one by one. Ties in the sample's order go by doc_id. Null doc_id: held_out is null. Very long texts: scored whole, one at a time.
Empty documents: no rows; no usable labels: all scores 0. More columns are kept as they are; those named _score
or _spans are replaced by the results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.crf import Chain, fit
from loomdoc.session import cut, spread, table

#: The most rows of each class, and characters of a row, that the classifier is fitted on.
TRAIN_DOCS = 4_000
TRAIN_CHARS = 20_000
#: The most rows of the sample that the field's weights are fitted on.
FIT_DOCS = 3_000
#: The most words that become features.
LEXICON = 2_000
LEAST_TEXTS = 4
#: Texts of the sample whose marginals the driver holds at once.
SLICE = 500
#: Characters of text that are scored at once.
BATCH_CHARS = 4_000_000
#: Words whose feature a task remembers.
REMEMBERED = 400_000
TOKEN = re.compile(r"\w+")


def parts(word: str) -> list[str]:
    """The features of a word: itself, and its runs of 4 and 5 characters with marks for its ends, as words of one stem share them."""
    marked = f"^{word}$"
    return [word, *(marked[i : i + k] for k in (4, 5) for i in range(len(marked) - k + 1))]


class Features(dict):
    """word -> its strongest feature's number, 0 if it has none; remembers up to ``REMEMBERED`` words."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = min((k for x in parts(word) if (k := self.numbers.get(x))), default=0)
        return n


@dataclass(frozen=True)
class Model:
    """features: number by name, the strongest first, from 1."""

    features: Features
    chain: Chain
    curve: np.ndarray

    def encode(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall((text or "").lower())
        return np.fromiter(map(self.features.__getitem__, tokens), np.int32, len(tokens))

    def spans(self, text: str, marginals: np.ndarray) -> str:
        """start:end of runs of toxic tokens. Lower case can change lengths, so places are taken in the text as it is."""
        runs: list[list[int]] = []
        lowered = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        if len(lowered) != len(marginals):  # a letter whose lower case is two characters parts a token
            lowered = [(m.start(), m.end()) for m in TOKEN.finditer(text.lower())]
        hot = np.flatnonzero(marginals >= 0.5)
        for k in hot.tolist():
            if runs and runs[-1][2] == k - 1:
                runs[-1][1:] = [lowered[k][1], k]
            else:
                runs.append([*lowered[k], k])
        return ",".join(f"{a}:{z}" for a, z, _ in runs)

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        z = np.clip(features(marginals) @ self.curve, -30, 30)
        return 1.0 / (1.0 + np.exp(-z))


def features(marginals: list[np.ndarray]) -> np.ndarray:
    most = [m.max() if len(m) else 0.0 for m in marginals]
    return np.column_stack([np.ones(len(marginals)), most, np.log1p([m.sum() for m in marginals])])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (y - p)) - 0.1 * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, g)
    return beta


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[DataFrame, dict[int, int]]:
    """text and toxic of the sample, and how many usable labels each class has."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    rates = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    least = lambda c: usable.filter(F.col("toxic") == c).orderBy(F.xxhash64(F.lit(4), "doc_id"), "doc_id").limit(train_docs)
    ids = least(0).unionByName(least(1))
    rows = docs.select("doc_id", "text").filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(ids), "doc_id")
    # copies and near copies say the same thing over again: one text stays for each least hash of long words
    long_words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{8,}"), 0)
    hashed = lambda k: lambda w: F.xxhash64(F.lit(k), w)
    firsts = [F.array_min(F.transform(long_words, hashed(k))) for k in range(3)]
    key = F.when(F.size(long_words) > 0, F.xxhash64(*firsts)).otherwise(F.xxhash64("text"))
    first = F.min(F.struct(F.xxhash64(F.lit(4), "doc_id"), "text"))["text"]  # always the same one, so that reruns agree
    return cut(rows.groupBy("toxic", key.alias("key")).agg(first.alias("text")).select("text", "toxic")), rates


def lexicon(sample: DataFrame, size: int = LEXICON) -> list[str]:
    """Words and parts of words that occur in more sampled toxic texts than chance and the other class explain, the strongest first."""
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return []

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t, n = Counter(), Counter()
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found = {x for w in set(TOKEN.findall(text.lower())) for x in parts(w)}
                n.update(found)
                if toxic:
                    t.update(found)
            yield pd.DataFrame({"feature": list(n), "t": [t[x] for x in n], "n": list(n.values())})

    found = sample.mapInPandas(seen, "feature string, t long, n long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    p = (F.col("t") + 0.1) / (counts[1] + 1.0)
    q = (F.col("n") - F.col("t") + 0.5) / (counts[0] + 1.0)
    z = (p - q) / F.sqrt(F.greatest(p * (1 - p) / counts[1] + q * (1 - q) / counts[0], F.lit(1e-12)))
    chosen = found.withColumn("z", z).filter((F.col("t") >= LEAST_TEXTS) & (F.col("z") > 4.0) & (p > 3.0 * q))
    return [r["feature"] for r in chosen.orderBy(F.col("z").desc(), "feature").limit(size).collect()]


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, fit_docs: int = FIT_DOCS) -> Model:
    sample, rates = training_rows(docs, labels, train_docs)
    words = {w: k for k, w in enumerate(lexicon(sample), 1)}
    empty = Model(Features(words), Chain(np.full(len(words) + 1, -30.0), np.zeros((2, 2)), 0.0), np.array([-30.0, 0.0, 0.0]))
    if not words:
        return empty
    encode = empty.encode

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"f": [zlib.compress(encode(t).tobytes(), 1) for t in b["text"]], "toxic": b["toxic"]})

    # at most 2 * train_docs rows of bounded length; most tokens have no feature, so compressed they are small
    rows = sample.mapInPandas(encoded, "f binary, toxic int").toPandas()
    rows["key"] = [hashlib.blake2b(zlib.decompress(f), digest_size=8).hexdigest() for f in rows["f"]]  # any fixed order
    rows = rows.sort_values(["toxic", "key"], kind="stable")
    sequences, toxic = [np.frombuffer(zlib.decompress(f), np.int32) for f in rows["f"]], rows["toxic"].to_numpy()
    part = np.linspace(0, len(rows) - 1, min(fit_docs, len(rows))).astype(int)  # evenly spaced places
    tags = [((s > 0) & (toxic[k] == 1)).astype(np.int64) for k, s in enumerate(sequences)]
    chain = fit([sequences[k] for k in part], [tags[k] for k in part], len(words) + 1)
    weight = np.where(toxic == 1, rates[1] / max(1, (toxic == 1).sum()), rates[0] / max(1, (toxic == 0).sum()))
    seen = [features(chain.marginals(sequences[k : k + SLICE])) for k in range(0, len(sequences), SLICE)]
    return Model(Features(words), chain, _logistic(np.vstack(seen), toxic, weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text and any more columns) with _score and _spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            scores, spans = [], []
            texts = [t or "" for t in texts]
            begin = 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and (chars == 0 or chars + len(texts[end]) <= BATCH_CHARS):
                    chars += len(texts[end])
                    end += 1
                marginals = m.chain.marginals([m.encode(t) for t in texts[begin:end]])
                scores += m.scores(marginals).tolist()
                spans += [m.spans(t, p) if len(p) and p.max() >= 0.5 else "" for t, p in zip(texts[begin:end], marginals)]
                begin = end
            yield pd.DataFrame({"score": scores, "spans": spans})

    scored = F.pandas_udf(run, "score double, spans string")
    own = [c for c in docs.columns if c not in ("_score", "_spans")]
    rows = docs.select(F.struct(*own).alias("_row"), scored("text").alias("_scored"))
    return rows.select("_row.*", F.col("_scored.score").alias("_score"), F.col("_scored.spans").alias("_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_spans").alias("spans"))
