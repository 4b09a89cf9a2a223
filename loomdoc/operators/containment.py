"""Containment join: which texts hold which patterns, without comparing every text with every pattern.

Up to ``AUTOMATON`` letters of patterns, one Aho-Corasick automaton finds all of them in one pass over each text. Beyond, each pattern
asks for one of its grams (the rarest in the texts), texts offer their grams, and what meets by gram is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.session import cut

#: Letters of all patterns that an automaton is made of: about 100 bytes of each task's memory a letter.
AUTOMATON = 2_000_000
GRAM = 3
BROADCAST_GRAMS = 500_000


def _automaton(patterns: list[str]):
    import ahocorasick

    if not patterns:
        return None
    found = ahocorasick.Automaton()
    for p in patterns:
        found.add_word(p, p)
    found.make_automaton()
    return found


def _few(patterns: DataFrame, pattern: str, most: int | None) -> list[str] | None:
    """The distinct patterns if they are few enough for an automaton."""
    listed = patterns.select(F.col(pattern).alias("_p")).filter("_p <> ''").distinct()
    letters = listed.agg(F.coalesce(F.sum(F.length("_p")), F.lit(0))).first()[0]
    return [r[0] for r in listed.collect()] if letters <= (AUTOMATON if most is None else most) else None


def contained(texts: DataFrame, id_: str, text: str, patterns: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """id, pattern: each pattern that a row's text holds, once. Null texts and patterns, and empty patterns, hold and are held by nothing. ``most``: letters of an automaton."""
    few = _few(patterns, pattern, most)
    rows = texts.select(id_, F.col(text).alias("_text")).filter("_text is not null")
    kind = dict(texts.dtypes)[id_]
    if few is not None:
        held = texts.sparkSession.sparkContext.broadcast(few)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(held.value)
            for batch in batches:
                ids, out = [], []
                for i, t in zip(batch[id_], batch["_text"]):
                    found = {p for _, p in automaton.iter(t)} if held.value else ()
                    ids += [i] * len(found)
                    out += found
                yield pd.DataFrame({id_: pd.Series(ids, dtype=batch[id_].dtype), pattern: pd.Series(out, dtype=object)})

        return rows.mapInPandas(run, f"{id_} {kind}, {pattern} string")
    asked = patterns.select(F.col(pattern).alias("_p")).filter("_p <> ''").distinct()
    sizes = [r[0] for r in asked.select(F.least(F.length("_p"), F.lit(GRAM))).distinct().collect()]
    runs = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = F.array_distinct(F.concat(*[runs(F.col("_text"), n) for n in sizes]))
    offered = rows.select(id_, "_text", F.explode(grams).alias("_g"))
    own = asked.select("_p", F.explode(F.array_distinct(F.when(F.length("_p") < GRAM, F.array("_p")).otherwise(runs(F.col("_p"), GRAM)))).alias("_g"))
    wanted = cut(own.select("_g").distinct())
    count = offered.join(wanted, "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    # a gram that no text has rules its patterns out
    rarest = own.join(count, "_g", "left").groupBy("_p").agg(F.min(F.struct(F.coalesce("_n", F.lit(0).cast("long")).alias("n"), "_g")).alias("_r"))
    rarest = cut(rarest.filter("_r.n > 0").select("_p", F.col("_r._g").alias("_g")))
    known = F.broadcast(rarest) if rarest.count() <= BROADCAST_GRAMS else rarest
    return offered.join(known, "_g").filter(F.contains("_text", F.col("_p"))).select(id_, F.col("_p").alias(pattern))


def holds_any(text: Column, patterns: list[str]) -> Column:
    """Whether a text holds one of the patterns; false for null."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        automaton = _automaton(patterns)
        return texts.map(lambda t: next(automaton.iter(t), None) is not None if t else False).astype(bool)

    return run(text) if patterns else F.lit(False)


def without(rows: DataFrame, column: str, patterns: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """Rows whose text holds none of the patterns."""
    few = _few(patterns, pattern, most)
    if few is not None:
        return rows.filter(~holds_any(F.col(column), few))
    texts = rows.select(F.col(column).alias("_text")).distinct().withColumn("_key", F.col("_text"))
    hit = contained(texts, "_key", "_text", patterns, pattern, most).select(F.col("_key").alias(column)).distinct()
    return rows.join(hit, column, "left_anti").select(*rows.columns)
