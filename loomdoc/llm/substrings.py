"""Operator 10: words of repeated passages, by Rabin-Karp hashes of fixed-length windows.

A window of ``WINDOW`` words is repeated if its words also start anywhere else. All windows
get a rolling hash, Spark counts where each occurs, and the repeated ones of a text merge
into maximal intervals, whose words go.

Only windows that can repeat are sent to be counted. Each window picks the 8 words of
least hash in it as its anchor; equal windows pick equal anchors, so a window can be
repeated only if its anchor occurs at two places. About one word in 15 begins an anchor,
so counting anchors first is a small part of the shuffle, and loses no window.

Equal texts are one text with a count. A text that occurs twice loses all its windows
at once, so a hot group of copies costs one row. Keys with many rows (a passage that
many texts share) are first reduced within each task to their first and last place. Rows
are then kept by their key: those of the few keys that hold the most rows by a broadcast of
these keys (``HOT_KEYS`` at most, as each has that share of all rows), the rest by a shuffle.

Texts are told apart by 96 bits and windows by 96 bits of two polynomials, so no chance
clash is to be expected. Anchors have 64 bits; a clash there is only a candidate more.

Null or empty text, or fewer than ``WINDOW`` words: nothing is removed. Repeated rows are
copies of one another, so their windows repeat. Very long texts: one text's word hashes are
held at a time. Empty table: no rows. More columns are kept as they are; those named
n_words, n_removed or kept_text are replaced by the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.hashing import SECOND_BASE, joined, rolling, slices
from loomdoc.llm.text import identity
from loomdoc.session import cut, stored, table

WINDOW = 35
ANCHOR = 8
#: Keys of texts, 12 bytes each, that may be broadcast; more go through a shuffle.
BROADCAST_KEYS = 200_000
#: A key with this share of all rows or more is a hot one, so there are at most so many.
HOT_KEYS = 20_000
TEXT = ["_t", "_u"]
RESULTS = ["n_words", "n_removed", "kept_text"]


def _anchors(starts: np.ndarray, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: index of its text, hash, first and last window (within the text) that picked it."""
    n = len(hashes) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    grams = rolling(hashes, anchor)
    least = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1).argmin(axis=1) + np.arange(n)
    at = np.flatnonzero(text_of[:n] == text_of[window - 1 :])
    if not len(at):
        return none, none, none, none
    first = np.flatnonzero(np.diff(least[at], prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    of = text_of[at[first]]
    return of, grams[least[at[first]]].view(np.int64), at[first] - starts[of], at[last] - starts[of]


def _texts(batch: pd.DataFrame) -> list[bytes]:
    return [(t or "").encode() for t in batch["text"]]


def _once(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes], np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts' bytes, word hashes and bounds; a task takes equal texts once."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        new = [k not in seen and not seen.add(k) for k in zip(batch["_t"].tolist(), batch["_u"].tolist())]
        batch = batch[new].reset_index(drop=True)
        texts = _texts(batch)
        for begin, end in slices(texts):
            yield batch.iloc[begin:end], *joined(texts[begin:end])


def _at_two_places(found: DataFrame, key: list[str], place: Column) -> DataFrame:
    """The rows of ``found``, a stored table, whose key has two places at least. Rows of equal place are copies."""
    many = max(2, found.count() // HOT_KEYS)
    by_key = found.groupBy(*key).agg(F.min(place).alias("_a"), F.max(place).alias("_z"), F.count(F.lit(1)).alias("_n"))
    twice = cut(by_key.filter("_a != _z").select(*key, (F.col("_n") >= many).alias("_hot")))
    hot, rest = F.broadcast(twice.filter("_hot").select(*key)), twice.filter("not _hot").select(*key)
    return found.join(hot, key, "left_semi").unionByName(found.join(hot, key, "left_anti").join(rest, key, "left_semi"))


def repeated_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """_t, _u, ranges: the windows of a text, as [first, last] pairs, whose anchor occurs at two places of distinct texts or of one."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, hashes, starts in _once(batches):
            of, gram, first, last = _anchors(starts, hashes, window, anchor)
            yield pd.DataFrame({"_t": rows["_t"].to_numpy()[of], "_u": rows["_u"].to_numpy()[of], "gram": gram, "first": first, "last": last})

    with stored(docs.select(*TEXT, "text").mapInPandas(find, "_t long, _u int, gram long, first int, last int")) as found:
        kept = _at_two_places(found, ["gram"], F.xxhash64(*TEXT, "first"))
        return cut(kept.groupBy(*TEXT).agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("ranges")))


def repeated_windows(candidates: DataFrame, window: int) -> DataFrame:
    """_t, _u, at: the starts of the windows of a text that occur at two places. ``candidates``: _t, _u, text, ranges."""

    def hash_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, hashes, starts in _once(batches):
            inside = [np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges]) for ranges in rows["ranges"]]
            sizes, at = [len(x) for x in inside], np.concatenate(inside)
            places = np.repeat(starts[:-1], sizes) + at
            check = (rolling(hashes, window, SECOND_BASE)[places] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            of = {c: np.repeat(rows[c].to_numpy(), sizes) for c in TEXT}
            yield pd.DataFrame(of | {"window": rolling(hashes, window)[places].view(np.int64), "check": check, "at": at})

    with stored(candidates.select(*TEXT, "text", "ranges").mapInPandas(hash_all, "_t long, _u int, window long, check int, at int")) as found:
        kept = _at_two_places(found, ["window", "check"], F.xxhash64(*TEXT, "at"))
        return cut(kept.groupBy(*TEXT).agg(F.sort_array(F.collect_set("at")).alias("at")))


def intervals(at: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [begin, end) of words that the windows starting ``at`` (sorted) cover."""
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.append(0, gap + 1)].tolist(), (at[np.append(gap, len(at) - 1)] + window).tolist()))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` (doc_id, text and any more columns) with n_words, n_removed and kept_text."""
    own = [c for c in docs.columns if c not in RESULTS]
    keyed = docs.select(F.struct(*own).alias("_row"), "doc_id", "text", *identity(F.col("text")))
    texts = cut(keyed.groupBy(*TEXT).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("one")))
    ranges = repeated_anchors(keyed, window, anchor)
    keys = ranges.select(*TEXT).join(texts, TEXT).select(*[F.col(c).alias(f"{c}1") for c in TEXT], "one")
    if ranges.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    same = keyed["doc_id"].eqNullSafe(keys["one"]) & (keyed["_t"] == keys["_t1"]) & (keyed["_u"] == keys["_u1"])
    candidates = keyed.join(keys, same, "left_semi").select(*TEXT, "text").join(ranges, TEXT)
    found = repeated_windows(candidates, window)
    facts = texts.filter("copies > 1").select(*TEXT, F.lit(True).alias("all")).join(found, TEXT, "full_outer")

    def rest(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, every, at in batches:
            rows = []
            for words, all_, starts in zip((bytes.split((t or "").encode()) for t in text), every, at):
                n = len(words)
                if all_ and n >= window:
                    words = []
                elif starts is not None and len(starts):
                    out, begin = [], 0
                    for a, z in intervals(np.asarray(starts), window):
                        out += words[begin:a]
                        begin = z
                    words = out + words[begin:]
                rows.append((n, n - len(words), b" ".join(words).decode()))
            yield pd.DataFrame(rows, columns=RESULTS)

    cut_out = F.pandas_udf(rest, "n_words long, n_removed long, kept_text string")
    facts = cut(facts)
    if facts.count() <= BROADCAST_KEYS:  # texts that lose nothing need not move
        hit = F.broadcast(facts.select(*TEXT))
        none = keyed.join(hit, TEXT, "left_anti").withColumn("all", F.lit(None).cast("boolean")).withColumn("at", F.lit(None).cast("array<int>"))
        known = keyed.join(hit, TEXT, "left_semi").join(facts, TEXT).unionByName(none)
    else:
        known = keyed.join(facts, TEXT, "left")
    return known.withColumn("_r", cut_out("text", F.coalesce("all", F.lit(False)), "at")).select("_row.*", "_r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
