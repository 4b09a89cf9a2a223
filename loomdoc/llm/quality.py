"""Operator 9: quality rules as a short-circuit cascade.

The base rules reject a document with fewer than ``MIN_WORDS`` words, or with over
``MAX_REPEAT_PERCENT`` % of its words in 5-word windows that the text holds twice or more.
What passes goes through the cascade: each further rule's cost and selectivity
(share rejected) is estimated on a sample, and the rules run as one CASE in the order of
rejections for a second's work, so a row stops at its first failure. A rule's cost is the time of
``COPIES`` evaluations a row less that of the same job without the rule, so scheduling and reading don't count. The order changes
the work, never the verdict, which is that no rule rejects.

Null or empty text: no words, so rejected by the base. Repeated rows: judged one by one.
Empty table: no rows, the rules keep their listed order. Windows are compared by
64-bit hashes of their words, within one text only; very long texts are one array of longs. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.text import SPACES, whole, words
from loomdoc.session import cut, spread, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rows on which cost and selectivity are estimated; they decide the order of rules only.
SAMPLE_ROWS = 2_000
COPIES = 8


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``rejects`` is true. It may use _text and what ``counts`` gives."""

    name: str
    rejects: Column


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def rules() -> list[Rule]:
    text, n_words, word_chars = F.col("_text"), F.col("n_words"), F.col("word_chars")
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n_words),
        Rule("word_length", (word_chars < 2.5 * n_words) | (word_chars > 15 * n_words)),
        Rule("same_lines", F.col("n_dup_lines") * 2 > F.regexp_count(text, F.lit(r"(?m)^[^\n]*[^\x20\x09-\x0D]"))),
        Rule("capitals", F.regexp_count(text, F.lit(r"\p{Lu}")) * 10 > letters * 3),
        Rule("few_letters", letters * 2 < word_chars),
        Rule("no_varied_words", F.size(F.array_distinct("_words")) * 20 < F.col("n_words")),
    ]


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, _text, _words and the base counts of each text."""
    rows = docs.select(*keep, whole(F.col("text")).alias("_text")).withColumn("_words", words(F.col("_text")))
    w = F.col("_words")
    n = F.size(w)
    windows = F.transform(
        F.slice(w, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])
    )
    rows = rows.withColumn("_windows", windows)
    g = F.col("_windows")
    # only texts with a repeated window need the sort
    paired = F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_paired", paired).drop("_windows")
    p = F.col("_paired")
    twice = F.transform(p, lambda x, k: F.when((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"]))
    rows = rows.withColumn("_starts", F.sort_array(F.array_compact(twice))).drop("_paired")
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    # always 0; without it a later filter on a count would be copied, with all it is made of, into the lambdas
    held = F.floor(F.rand(0))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = rows.withColumn("_lines", lines)
    return rows.select(
        *keep,
        "_text",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        _without(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        (F.coalesce(covered, F.lit(0)) + held).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def costs(sample: DataFrame, listed: list[Rule], copies: int = COPIES) -> dict[str, tuple[int, float]]:
    """Rows of the sample that each rule rejects, and the seconds that it takes for them ``copies`` times."""
    rows = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def run(rejects: Column) -> tuple[int, float]:
        began = time.perf_counter()
        n = rows.agg(F.sum(rejects.cast("int"))).first()[0] or 0
        return n // copies, time.perf_counter() - began

    run(F.lit(False))  # the first job reads and compiles
    empty = run(F.lit(False))[1]
    found = {rule.name: run(rule.rejects) for rule in listed}
    return {name: (n, max(seconds - empty, 1e-3)) for name, (n, seconds) in found.items()}


def ordered(docs: DataFrame, listed: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections for a second's work on a sample of about ``sample_rows`` rows."""
    n = docs.count()
    if not n:
        return listed
    sample = cut(counts(docs.sample(min(1.0, sample_rows / n), seed=9), [])).filter(~base_failed())
    found = costs(sample, listed)
    return sorted(listed, key=lambda r: -found[r.name][0] / found[r.name][1])


def judge(docs: DataFrame, listed: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and failed_rule (null where kept) of each row of ``docs`` (doc_id, text)."""
    chain = F.when(base_failed(), "base")
    for rule in ordered(docs, rules() if listed is None else listed, sample_rows):
        chain = chain.when(rule.rejects, rule.name)
    out = counts(docs, ["doc_id"]).withColumn("failed_rule", chain)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *names, base_failed().alias("base_failed"), F.col("failed_rule").isNull().alias("kept"), "failed_rule")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("failed_rule")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS txt,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM t WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS w FROM starts),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM g) WHERE n > 1),
gaps AS (SELECT doc_id, least(5, i - lag(i, 1, -5) OVER (PARTITION BY doc_id ORDER BY i)) AS step FROM twice),
covered AS (SELECT doc_id, sum(step) AS n FROM gaps GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(txt, chr(10))) AS l FROM t),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, ws,
         CAST(length(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(txt, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n - lines.d, 0) AS BIGINT) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(txt, '[^\p{L}]', '', 'g')) AS letters,
         length(regexp_replace(txt, '[^\p{Lu}]', '', 'g')) AS capitals
  FROM t LEFT JOIN lines ON lines.doc_id = t.doc_id LEFT JOIN covered ON covered.doc_id = t.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2.5 * n_words OR word_chars > 15 * n_words
            OR n_dup_lines * 2 > n_lines OR capitals * 10 > letters * 3 OR letters * 2 < word_chars
            OR len(list_distinct(ws)) * 20 < n_words) AS kept
FROM b
"""
