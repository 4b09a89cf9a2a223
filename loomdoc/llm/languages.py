"""Operator 12: languages of a text by a mixture of n-gram models.

Learning: letter trigrams (with word ends) and single letters of a sample of labelled rows, about ``TRAIN_DOCS`` for each
language and with texts of up to ``TRAIN_CHARS``, are counted in Spark into hashed buckets; up to ``MOST_LANGUAGES`` languages, the most frequent ones,
are learned. Rows with crc32(doc_id) mod 4 = 2, or without a doc_id, are never used.

A text is a bag of words, each drawn from one language. Expectation-maximisation estimates the shares of
the languages from the words' likelihoods: each word's responsibilities, then their mean, until the shares settle. The set of
languages is the one with the highest penalised likelihood among the k leading ones: each more language has to
gain ``PENALTY`` + log(words) / 2. The one with the largest share in that set is the prediction. The score is its share among all languages
with one word's weight spread evenly over them, so it is lower for short or mixed texts.

Null text, or one without a letter: ``und``, score 0, no languages. Also all texts if there is nothing to learn from. Repeated rows: judged one by one.
Ties between languages: the first by name. Empty table: no rows. Very long texts: whole, letters a piece at a time; the likelihoods of its words are held at once. Other columns are kept as
they are; those named _langs, _lang or _score are replaced by the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.hashing import mixed, slices
from loomdoc.llm.text import unit
from loomdoc.session import spread, table

#: Rows of each language, and characters of a row, that the models are fitted on.
TRAIN_DOCS = 3_000
TRAIN_CHARS = 20_000
MOST_LANGUAGES = 1_024
#: Numbers of all models together: buckets times languages.
NUMBERS = 1 << 22
LETTER_BUCKETS = 1 << 10
#: What a language more has to gain in log likelihood, besides half the log of the number of words.
PENALTY = 4.0
#: The most languages of one text.
SET = 4
ROUNDS = 25
#: The most that one word can speak against a language.
FLOOR = -14.0
NONE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigram's bucket and the letter's bucket of each letter of the lower-cased text, and the index of each word's first letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    trigram = mixed(codes[at - 1] << np.uint64(42) | codes[at] << np.uint64(21) | codes[at + 1])
    starts = np.flatnonzero(~letter[at - 1])
    return (trigram % np.uint64(buckets)).astype(np.int64), (mixed(codes[at]) % np.uint64(LETTER_BUCKETS)).astype(np.int64), starts


@dataclass(frozen=True)
class Model:
    """names, sorted; log likelihoods of trigram buckets and of letter buckets by language."""

    names: list[str]
    trigrams: np.ndarray
    letters: np.ndarray

    def words(self, text: str) -> np.ndarray:
        """Log likelihood of each word (rows) in each language."""
        trigram, letter, starts = grams(text, len(self.trigrams))
        if not len(starts):
            return np.empty((0, len(self.names)), np.float32)
        piece, out = max(1, (1 << 21) // len(self.names)), []
        begin = 0
        while begin < len(starts):  # letters a piece at a time
            end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + piece)))
            a, z = starts[begin], starts[end] if end < len(starts) else len(trigram)
            out.append(np.add.reduceat(self.trigrams[trigram[a:z]] + self.letters[letter[a:z]], starts[begin:end] - a))
            begin = end
        return np.concatenate(out)

    def judge(self, texts: list[str]) -> tuple[list[str], list[float], list[str]]:
        """Prediction, score, and languages with shares, of each text."""
        held = [self.words(t) if self.names and t else np.empty((0, len(self.names)), np.float32) for t in texts]
        lang, score, langs = [NONE] * len(texts), [0.0] * len(texts), [""] * len(texts)
        some = [k for k, w in enumerate(held) if len(w)]
        if not some:
            return lang, score, langs
        n = np.array([len(held[k]) for k in some])
        likelihood = np.concatenate([held[k] for k in some])
        likelihood = np.maximum(likelihood - likelihood.max(axis=1, keepdims=True), FLOOR)
        shares, chosen = mixture(likelihood, n)
        most = len(self.names)
        for k, d in enumerate(some):
            best = int(np.argmax(chosen[k]))
            lang[d] = self.names[best]
            score[d] = float((n[k] * shares[k, best] + 1 / most) / (n[k] + 1))
            held_in = sorted(np.flatnonzero(chosen[k] > 0).tolist(), key=lambda j: (-chosen[k, j], j))
            langs[d] = ",".join(f"{self.names[j]}:{chosen[k, j]:.3f}" for j in held_in)
        return lang, score, langs


def expectation_maximisation(weights: np.ndarray, starts: np.ndarray, n: np.ndarray, shares: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log likelihood of each text. ``weights``: likelihood of words by language; ``starts``: first word of each text; languages with share 0 stay out."""
    owner = np.repeat(np.arange(len(n)), n)
    for _ in range(rounds):
        joint = weights * shares[owner]
        joint /= joint.sum(axis=1, keepdims=True)
        moved = np.add.reduceat(joint, starts) / n[:, None]
        settled = np.abs(moved - shares).max() < 1e-4
        shares = moved
        if settled:
            break
    return shares, np.add.reduceat(np.log((weights * shares[owner]).sum(axis=1)), starts)


def mixture(likelihood: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares among all languages, and shares in the chosen set, of each text with ``n`` words. ``likelihood``: logs, at most 0, by word and language."""
    many = likelihood.shape[1]
    starts = np.cumsum(n) - n
    weights = np.exp(likelihood.astype(np.float64))
    alone = np.add.reduceat(likelihood.astype(np.float64), starts)
    shares, reached = expectation_maximisation(weights, starts, n, np.full((len(n), many), 1 / many))
    best = alone.argmax(axis=1)
    chosen = np.zeros_like(shares)
    chosen[np.arange(len(n)), best] = 1.0
    value = alone.max(axis=1)
    cost = PENALTY + np.log(np.maximum(n, 1)) / 2
    # all languages together reach at least what any set reaches, so few texts have to be looked at again
    again = np.flatnonzero(reached - value > cost)
    if not len(again):
        return shares, chosen
    words = np.flatnonzero(np.isin(np.repeat(np.arange(len(n)), n), again))
    weights, sizes = weights[words], n[again]
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-shares[again], axis=1, kind="stable")
    for k in range(2, min(SET, many) + 1):
        inside = np.zeros((len(again), many))
        np.put_along_axis(inside, order[:, :k], 1 / k, axis=1)
        own, reached = expectation_maximisation(weights, starts, sizes, inside)
        penalised = reached - (k - 1) * cost[again]
        better = penalised > value[again]
        value[again[better]] = penalised[better]
        chosen[again[better]] = own[better]
    return shares, chosen


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Models of the languages in the column ``lang`` of ``docs`` (doc_id, text, lang)."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= TRAIN_CHARS) & ~held_out(F.col("doc_id")))
    rows = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in rows.collect()}
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((1, 0), np.float32), np.zeros((LETTER_BUCKETS, 0), np.float32))
    buckets = 1 << min(16, (NUMBERS // len(names)).bit_length() - 1)
    share = docs.sparkSession.createDataFrame([(name, train_docs / counts[name]) for name in names], "lang string, share double")
    sample = usable.join(F.broadcast(share), "lang").filter(unit(F.lit(12), "doc_id", "text") < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                held = np.zeros(buckets + LETTER_BUCKETS, np.int64)
                for text in texts:
                    trigram, letter, _ = grams(text, buckets)
                    held += np.bincount(np.concatenate([trigram, buckets + letter]), minlength=len(held))
                found = np.flatnonzero(held)
                yield pd.DataFrame({"lang": lang, "bucket": found, "n": held[found]})

    counted = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most NUMBERS rows and some
    held = np.zeros((buckets + LETTER_BUCKETS, len(names)))
    held[counted["bucket"], np.searchsorted(names, counted["lang"])] = counted["n"]
    log = lambda part: np.log((part + 0.5) / (part.sum(axis=0) + 0.5 * len(part))).astype(np.float32)
    return Model(names, log(held[:buckets]), (log(held[buckets:]) / 2).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text and any more columns) with _lang, _score and _langs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        most = (1 << 21) // max(4, len(model.names))
        for texts in batches:
            out: tuple[list, list, list] = ([], [], [])
            texts = [t or "" for t in texts]
            for begin, end in slices(texts, most):
                for held, more in zip(out, model.judge(texts[begin:end])):
                    held += more
            yield pd.DataFrame(dict(zip(("lang", "score", "langs"), out)))

    judged = F.pandas_udf(run, "lang string, score double, langs string")
    own = [c for c in docs.columns if c not in ("_lang", "_score", "_langs")]
    rows = docs.select(F.struct(*own).alias("_row"), judged("text").alias("_judged"))
    return rows.select("_row.*", F.col("_judged.lang").alias("_lang"), F.col("_judged.score").alias("_score"), F.col("_judged.langs").alias("_langs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    judged = identify(docs.select("doc_id", "text"), learn(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_langs").alias("langs"))
