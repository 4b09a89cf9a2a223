"""Operator 3: token counts by heap-and-linked-list byte-pair merging.

The vocabulary file fixes the text rules: NFC, runs of white space as one space, lower
case, a split into words, bytes as symbols with an end-of-word mark on the last. A word's
symbols form a linked list; a heap holds the adjacent pairs by rank, and the lowest is
merged until none is left. Its tokens are its symbols minus its merges; no identifiers are
made. The count of a word is remembered within a task, up to ``REMEMBERED`` words.

Special strings inside a text count as one token each, the library's default.

Null or empty text: no tokens. Repeated rows: counted one by one. Empty table: no rows.
Very long texts are split a piece at a time, so only one text's words are held. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.text import n_bytes
from loomdoc.session import spread, table

LIMIT = 2_048
#: Words whose counts a task remembers, about 100 bytes each; then it starts anew.
REMEMBERED = 400_000
_SPACES = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 ones as they are, the rest from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def load(path: str) -> dict:
    """What counting needs of a vocabulary file; as large as the file, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    return {
        "ranks": {(a, b): i for i, (a, b) in enumerate(model["merges"])},
        "end": model.get("end_of_word_suffix") or "",
        "pattern": next(p["pattern"]["Regex"] for p in pre if p["type"] == "Split"),
        "special": sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True),
    }


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The number of symbols left after all merges, lowest rank first, leftmost among equals."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if symbols[i] is not None else n
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = a + b, None
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], a + b))
    return n - merges


class Counter(dict):
    """word -> tokens, counted on demand."""

    def __init__(self, vocabulary: dict, remembered: int = REMEMBERED):
        super().__init__()
        self.ranks, self.end, self.remembered = vocabulary["ranks"], vocabulary["end"], remembered
        self.words = regex.compile(vocabulary["pattern"]).findall
        self.special = re.compile("|".join(map(re.escape, vocabulary["special"])) or r"(?!)")
        self.symbols = byte_symbols()

    def __missing__(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.end
        if len(self) >= self.remembered:
            self.clear()
        self[word] = n = merged_count(symbols, self.ranks)
        return n

    def text(self, text: str) -> int:
        pieces = self.special.split(text)
        total = len(pieces) - 1
        for piece in pieces:
            clean = _SPACES.sub(" ", unicodedata.normalize("NFC", piece)).replace("Σ", "σ").lower()  # no final sigma: letters are lowered one by one
            total += sum(map(self.__getitem__, self.words(clean)))
        return total


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs`` (doc_id, text)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(vocabulary_path))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(vocabulary.value)
        for texts in batches:
            yield pd.Series([counter.text(t) if t else 0 for t in texts], dtype="int64")

    tokens = F.pandas_udf(count, "long")
    return docs.select("doc_id", n_bytes(F.col("text")).alias("n_bytes"), tokens("text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"))
