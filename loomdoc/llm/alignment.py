"""Operator 11: alignment of two tokenizers over the same bytes.

Both tokenizers take a space and the text. A slice of an Arrow batch is laid end to end, so one
running sum of token lengths gives the byte offset at which each token ends, for A and for B. The ends are
counted by offset once (``bincount``); where both tokenizers end, a group ends. Differences
of running sums at the documents' own offsets give each document's tokens, groups and links: group k with
a tokens of A and b of B holds a * b links.

The distinct id pairs of each document go to a stored table, with their links. Spark counts the
documents of each pair and the highest count of each A id (at most one row for each id of the vocabulary).
The most frequent pairs, at most ``HOT_PAIRS`` of them, are broadcast; the others, each
in few documents, meet their counts in a join by pair. So no pair is a hot key.

Texts that are null or empty, or whose tokens don't spell out the space and the text again (such as one
with U+2581): no tokens, zeros and ''. Repeated rows and null doc_ids: rows like any other, each counted as a document.
Very long texts are aligned whole, one at a time; the pairs of one document are written in parts. Ties between counts: all are best.
Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomdoc.llm.hashing import slices
from loomdoc.llm.token_counts import byte_symbols
from loomdoc.session import cut, spread, stored, table

#: Pairs whose counts are broadcast, about 40 bytes each.
HOT_PAIRS = 1_000_000
#: Links of a group that are listed one by one; a larger group is counted by its distinct ids first.
LISTED = 1 << 16
#: Pairs of one document in one row of the stored table.
PART = 1 << 18
#: Bytes of text that are aligned at once.
SLICE = 1 << 20
#: A pair is one number below 2**31: A id times the size of B's vocabulary, plus B id; its links stand above.
PAIR_BITS = 31
#: The split that a byte-level vocabulary file asks for with ``use_regex``.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(spec: dict) -> bool:
    """Whether ids rise with the merges and nothing but the byte-level split is done to a text: then the ids are ranks, and merging by rank, which is faster, gives the same tokens."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    ids = [model["vocab"][x + y] for x, y in model["merges"]]
    plain = not spec["normalizer"] and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    return plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and all(x < y for x, y in zip(ids, ids[1:]))


class Aligner:
    """The two tokenizers and their tokens' bytes; as large as the vocabulary files, whatever the corpus."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        a = Tokenizer.from_str(a_file.decode())
        a.encode_special_tokens = True
        self.encode_a = lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        symbol = {c: b for b, c in enumerate(byte_symbols())}
        spec = json.loads(a_file)
        vocabulary = spec["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in symbol for c in token):
                self.a_bytes[i] = bytes(symbol[c] for c in token)
        if _ranked(spec):
            special = {t["id"] for t in spec["added_tokens"]}
            ranks = {x: i for i, x in enumerate(self.a_bytes) if x and i not in special}
            encode = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.encode_a = lambda texts: list(map(encode, texts))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) * len(self.b_bytes) >= 1 << PAIR_BITS:
            raise ValueError("the vocabularies have too many pairs")
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        # how a token is written, inside its group and at the end of it
        self.labels = [f"{i}{mark}".encode() for i in range(len(self.a_bytes)) for mark in ",|"] + [f"{i}{mark}".encode() for i in range(len(self.b_bytes)) for mark in ",;"]

    def tokens(self, texts: list[str]) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """Places in ``texts`` of those that both tokenizers spell out, and the ids of these."""
        encoded_a = self.encode_a([" " + t for t in texts])
        encoded_b = self.b.encode(texts, num_threads=1)
        spelt = lambda ids, tokens: b"".join(map(tokens.__getitem__, ids))
        right = [k for k, t in enumerate(texts) if t and spelt(encoded_a[k], self.a_bytes) == (s := b" " + t.encode()) and spelt(encoded_b[k], self.b_bytes) == s]
        return right, [encoded_a[k] for k in right], [encoded_b[k] for k in right]

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers by name and digests of each text; and by (place of the text, pair) the links."""
        right, tokens_a, tokens_b = self.tokens(texts)
        out = {name: np.zeros(len(texts), np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        digests = [""] * len(texts)
        if not right:
            return out, digests, *[np.empty(0, np.int64)] * 3
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (tokens_a, tokens_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((tokens_a, n_a), (tokens_b, n_b)))
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        both = (np.bincount(ends_a) > 0) & (np.bincount(ends_b) > 0)
        ended = np.cumsum(both)  # groups that end up to each byte
        group_a, group_b = ended[ends_a] - both[ends_a], ended[ends_b] - both[ends_b]
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b)
        links = in_a * in_b
        # running sums, read at the last byte of each text
        last = ended[ends_a[np.cumsum(n_a) - 1]]
        of_text = lambda running: np.diff(running, prepend=0)
        n_groups = of_text(last)
        for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", of_text(np.cumsum(links)[last - 1]))):
            out[name][right] = values
        # the tokens of each group, A before B, as they are written
        label = np.empty(len(a) + len(b), np.int64)
        label[np.arange(len(a)) + (before_b - in_b)[group_a]] = 2 * a + both[ends_a]
        label[np.arange(len(b)) + before_a[group_b]] = 2 * (len(self.a_bytes) + b) + both[ends_b]
        bounds = [0, *np.cumsum(n_a + n_b).tolist()]
        for k, begin, end in zip(right, bounds, bounds[1:]):
            digests[k] = hashlib.sha256(b"".join(map(self.labels.__getitem__, label[begin:end].tolist()))[:-1]).hexdigest()
        place = np.repeat(np.array(right, np.int64), n_groups)
        return out, digests, *self._pairs(a, b, in_a, in_b, before_a - in_a, before_b - in_b, links, place)

    def _pairs(self, a, b, in_a, in_b, from_a, from_b, links, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the text, pair, links), one for each pair of a text, in order."""
        size = len(self.b_bytes)
        listed = np.where(links <= LISTED, links, 0)
        g = np.repeat(np.arange(len(links)), listed)
        nth = np.arange(len(g)) - np.repeat(np.cumsum(listed) - listed, listed)
        keys, counts = np.unique(place[g] << PAIR_BITS | (a[from_a[g] + nth // in_b[g]] * size + b[from_b[g] + nth % in_b[g]]), return_counts=True)
        large = np.flatnonzero(links > LISTED)
        if len(large):
            more, weights = [keys], [counts]
            for k in large.tolist():
                ids_a, times_a = np.unique(a[from_a[k] : from_a[k] + in_a[k]], return_counts=True)
                ids_b, times_b = np.unique(b[from_b[k] : from_b[k] + in_b[k]], return_counts=True)
                more.append((place[k] << PAIR_BITS | (ids_a[:, None] * size + ids_b)).ravel())
                weights.append((times_a[:, None] * times_b).ravel())
            keys, at = np.unique(np.concatenate(more), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, at, np.concatenate(weights))
        return keys >> PAIR_BITS, keys & ((1 << PAIR_BITS) - 1), counts


@lru_cache(maxsize=1)
def _aligner(a_file: bytes, b_file: bytes) -> Aligner:
    return Aligner(a_file, b_file)


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _read(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """_row, part, doc_id, counts, digest and packed pairs; a document with many pairs has more parts, which hold pairs alone."""
    files = docs.sparkSession.sparkContext.broadcast((_file(a_path), _file(b_path)))
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = StructType(
        [StructField("_row", LongType()), StructField("part", LongType()), StructField("doc_id", docs.schema["doc_id"].dataType), *[StructField(c, LongType()) for c in counts], StructField("groups_sha256", StringType())]
    ).simpleString()[7:-1].replace(":", " ") + ", pairs array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in slices([t.encode() for t in texts], SLICE):
                numbers, digests, place, pair, links = aligner.align(texts[begin:end])
                packed, bounds = pair | links << PAIR_BITS, np.searchsorted(place, np.arange(end - begin + 1))
                starts, owners, parts = [], [], []
                for k in range(end - begin):
                    for part, at in enumerate(range(int(bounds[k]), max(int(bounds[k]) + 1, int(bounds[k + 1])), PART)):
                        starts.append(min(at, int(bounds[k + 1])))
                        owners.append(k)
                        parts.append(part)
                rows = batch.slice(begin, end - begin).take(pa.array(owners, pa.int64()))
                columns = [rows.column("_row"), pa.array(parts, pa.int64()), rows.column("doc_id")]
                columns += [pa.array(numbers[c][owners], pa.int64()) for c in counts] + [pa.array([digests[k] for k in owners], pa.string())]
                columns.append(pa.ListArray.from_arrays(pa.array([*starts, len(packed)], pa.int32()), pa.array(packed, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["_row", "part", "doc_id", *counts, "groups_sha256", "pairs"])

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")).mapInArrow(run, schema)


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` pairs have it or more."""
    step = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least"), F.max("n").alias("top")).orderBy(F.desc("step")).collect()
    held, threshold = 0, (steps[0]["top"] + 1) if steps else 1
    for r in steps:  # a few hundred at most, as a step is an eighth of an octave
        held += r["pairs"]
        if held > most:
            break
        threshold = r["least"]
    return threshold


def align(docs: DataFrame, a_path: str, b_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs`` (doc_id, text)."""
    b_size = len(_aligner(_file(a_path), _file(b_path)).b_bytes)
    with stored(_read(docs, a_path, b_path)) as aligned:
        pairs = aligned.select("_row", F.explode("pairs").alias("packed")).select("_row", F.col("packed").bitwiseAND((1 << PAIR_BITS) - 1).alias("pair"), F.shiftright("packed", PAIR_BITS).alias("links"))
        counts = cut(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
        a_id = F.floor(F.col("pair") / b_size)
        top = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))  # one row for each id of the vocabulary at most
        counts = counts.withColumn("a", a_id).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
        threshold = _frequent_from(counts, hot_pairs)
        frequent = F.broadcast(counts.filter(F.col("n") >= threshold))
        sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")]
        parts = pairs.join(frequent, "pair").groupBy("_row").agg(*sums)
        rare = counts.filter(F.col("n") < threshold)
        if not rare.isEmpty():
            parts = parts.unionByName(pairs.join(frequent, "pair", "left_anti").join(rare, "pair").groupBy("_row").agg(*sums))
        of_row = parts.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        none = F.lit(0).cast("long")
        rows = aligned.filter("part = 0").drop("part", "pairs").join(of_row, "_row", "left")
        return cut(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
