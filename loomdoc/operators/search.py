"""Ranking: BM25, exact and approximate vector similarity, fusion, diversity, and the hybrid of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions.chunks import SLICE, STRATEGIES
from loomdoc.functions.text import count_of, highlighted, ngrams
from loomdoc.session import cut

K1, B = 1.2, 0.75
RRF_K = 60
#: Queries and vectors of one task of an exact search, at most, and the queries of one product of matrices in it.
QUERY_BLOCK, VECTOR_BLOCK, PRODUCT = 16_384, 16_384, 64
#: Small inputs are dealt into blocks of so many rows, as long as there are cores without one.
LEAST_BLOCK = 1_024
#: Letters whose trigrams' places a task holds at a time.
REMEMBERED = 1_000_000


def query_words(q: str) -> list[str]:
    return list(dict.fromkeys(w for w in q.lower().split() if len(w) >= 2))


def bm25(corpus: DataFrame, words: list[str], k: int | None = None, id_: str = "id", text: str = "text") -> DataFrame:
    """id, score of the rows with a word, best first. The texts are read once, into a narrow table of counts; it gives N, the mean length and each word's df, in one row."""
    tf = [count_of(F.col(text), F.lit(w)) for w in words]
    rows = cut(corpus.select(id_, F.length(text).alias("_len"), *[t.alias(f"_t{i}") for i, t in enumerate(tf)]))
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.avg("_len"), F.lit(400.0)).alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        t, d = F.col(f"_t{i}"), F.col(f"_d{i}")
        idf = F.log((F.col("_n") - d + 0.5) / (d + 0.5) + 1)
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    hit = F.greatest(*[F.col(f"_t{i}") for i in range(len(words))], F.lit(0)) > 0
    out = rows.filter(hit).crossJoin(F.broadcast(stats)).select(id_, score.alias("score"))  # one row
    return out.orderBy(F.desc("score"), id_).limit(k) if k else out


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vector_top_k(vectors: DataFrame, q: list[float], k: int, id_: str = "id", vector: str = "embedding", least: float | None = None) -> DataFrame:
    """id, similarity: exact scan; only k rows of each task meet."""
    scored = vectors.filter(F.col(vector).isNotNull()).select(id_, cosine(F.col(vector), F.lit(q)).alias("similarity"))
    scored = scored if least is None else scored.filter(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), id_).limit(k)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of unit length; those without length stay zero."""
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def knn(queries: DataFrame, vectors: DataFrame, k: int, id_: str = "id", vector: str = "embedding", least: float = -1.0, same: bool = False, apart: str | None = None) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest rows of each query, exactly; ``apart`` names a column in which the two must differ.

    Both sides are dealt into blocks, each pair of blocks is one task's product of two matrices, and a block hands on its k best of each query.
    A task holds the product for ``PRODUCT`` queries at a time and their k best, however many rows are equal.
    """
    more = [apart] if apart else []
    q = queries.filter(F.col(vector).isNotNull()).select(id_, vector, *more)
    v = vectors.filter(F.col(vector).isNotNull()).select(id_, vector, *more)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    q_blocks, v_blocks = (max(1, -(-n // size), min(cores, n // LEAST_BLOCK)) for n, size in ((q.count(), QUERY_BLOCK), (v.count(), VECTOR_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64(id_), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumn("_q", block(q_blocks)).withColumn("_v", every(v_blocks))
    v = v.withColumn("_v", block(v_blocks)).withColumn("_q", every(q_blocks))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            a, b = a.sort_values(id_, ignore_index=True), b.sort_values(id_, ignore_index=True)  # ties go by id
            own, m = b[id_].to_numpy(), _matrix(b[vector])
            for begin in range(0, len(a), PRODUCT):
                part = a.iloc[begin : begin + PRODUCT]
                s = np.round(_matrix(part[vector]) @ m.T, 12)  # equal vectors are as near at any place of the product
                if not same:
                    s[part[id_].to_numpy()[:, None] == own] = -2.0
                if apart:
                    s[part[apart].to_numpy()[:, None] == b[apart].to_numpy()] = -2.0
                if len(own) > k:
                    bound = np.partition(s, len(own) - k, axis=1)[:, len(own) - k, None]
                else:
                    bound = np.full((len(part), 1), -2.0)
                rows, columns = np.nonzero((s >= bound) & (s >= least))
                found = pd.DataFrame({"query_id": part[id_].to_numpy()[rows], id_: own[columns], "similarity": s[rows, columns]})
                out.append(found.sort_values(["query_id", "similarity", id_], ascending=[True, False, True]).groupby("query_id").head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], id_: [], "similarity": []})

    kind = dict(vectors.dtypes)[id_]
    found = q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInPandas(run, f"query_id {kind}, {id_} {kind}, similarity double")
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_)
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def blended(a: Column, b: Column, share: float = 0.4) -> Column:
    """share of a and the rest of b, scaled to unit length; a alone where b is null."""
    mixed = F.zip_with(a, b, lambda x, y: x * share + y * (1 - share))
    norm = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(b.isNull(), a.cast("array<double>")).when(norm > 0, F.transform(mixed, lambda x: x / norm)).otherwise(mixed)


def ranked(df: DataFrame, score: str, id_: str, name: str) -> DataFrame:
    """Ranks of a top-k list: a bounded table, so one window is fine."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy().orderBy(F.desc(score), id_)))


def rrf(vector_hits: DataFrame, text_hits: DataFrame, k: int, id_: str = "id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two top-k lists (id, similarity) and (id, score)."""
    v = ranked(vector_hits, "similarity", id_, "vector_rank").select(id_, "similarity", "vector_rank")
    t = ranked(text_hits, "score", id_, "fts_rank").select(id_, F.col("score").alias("fts_score"), "fts_rank")
    both = v.join(t, id_, "full_outer").fillna(0.0, ["similarity"])
    share = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", share("vector_rank") + share("fts_rank"))
    return both.orderBy(F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("fts_rank"), id_).limit(k)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
#: Of each letter: whether it counts to a word as ``\w`` says, 2 where that wasn't asked yet.
_IN_WORDS = np.full(0x110000, 2, np.uint8)


def _in_words(letters: np.ndarray) -> np.ndarray:
    found = _IN_WORDS[letters]
    if (new := found == 2).any():
        for c in np.unique(letters[new]).tolist():
            _IN_WORDS[c] = chr(c).isalnum() or c == 0x5F
        found = _IN_WORDS[letters]
    return found == 1


def _crc(crc: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """CRC-32 (before its last inversion) after one more letter each, in UTF-8."""
    byte = lambda crc, b: _CRC[(crc ^ b) & 0xFF] ^ (crc >> 8)
    out, wide = byte(crc, letters), np.flatnonzero(letters >= 0x80)
    for least, n, lead in ((0x80, 2, 0xC0), (0x800, 3, 0xE0), (0x10000, 4, 0xF0)):
        wide = wide[letters[wide] >= least]  # the last that holds counts
        if len(wide):
            c = letters[wide]
            found = byte(crc[wide], (c >> (6 * (n - 1))) | np.uint32(lead))
            for k in range(n - 2, -1, -1):
                found = byte(found, ((c >> (6 * k)) & 0x3F) | np.uint32(0x80))
            out[wide] = found
    return out


def embed_texts(texts: Sequence[str], dims: int = 64) -> np.ndarray:
    """A row for each text. The offline default: each trigram of each word adds 1 or -1 to a place that its hash (CRC-32) names; so many letters at a time."""
    lowered = [t.lower() for t in texts]
    letters = np.frombuffer("\n".join(lowered).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(lowered)), [len(t) + 1 for t in lowered])
    counts = np.zeros(len(lowered) * 2 * dims, np.int64)
    for begin in range(0, len(letters) - 2, REMEMBERED):
        part = letters[begin : begin + REMEMBERED + 2]
        word = _in_words(part)
        at = np.flatnonzero(word[:-2] & word[1:-1] & word[2:])
        if len(at):
            crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
            for k in range(3):
                crc = _crc(crc, part[at + k])
            text, first = of[begin + at], of[begin]
            found = np.bincount((text - first) * 2 * dims + (~crc % np.uint32(dims)) + np.where(~crc & np.uint32(1 << 20), dims, 0))
            counts[first * 2 * dims :][: len(found)] += found
    counts = counts.reshape(-1, 2, dims)
    return (counts[:, 0] - counts[:, 1]).astype(float)


def embed_text(text: str, dims: int = 64) -> np.ndarray:
    return embed_texts([text], dims)[0]


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([v for i in range(0, len(texts), SLICE) for v in embed_texts([t or "" for t in texts[i : i + SLICE]], dims)], dtype=object)

    return run(text)


def embedded_chunks(docs: DataFrame, strategy: str = "sentence", text: str = "text", dims: int = 64, **options: int) -> DataFrame:
    """The columns of ``docs`` with n, a chunk in place of the text, and its embedding, one row for each chunk.

    One pass of Python makes both and hands on what ``SLICE`` texts give, so a task holds no more chunks than that.
    """
    split = STRATEGIES[strategy]
    own = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                found = [split(t, **options) if t else [] for t in part.column(text).to_pylist()]
                chunks = [c for f in found for c in f]
                if not chunks:
                    continue
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                number = pa.array(np.concatenate([np.arange(len(f), dtype=np.int32) for f in found]))
                vectors = pa.ListArray.from_arrays(np.arange(len(chunks) + 1, dtype=np.int32) * dims, embed_texts(chunks, dims).ravel())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in own), number, pa.array(chunks, pa.string()), vectors], [*own, "n", text, "embedding"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in own), "n int", f"`{text}` string", "embedding array<double>"]))


def jaccard3(a: Column, b: Column) -> Column:
    """Similarity of the trigram sets of the first 500 characters."""
    grams = lambda x: ngrams(F.lower(F.left(x, F.lit(500))), 3, 3)
    union = F.size(F.array_union(grams(a), grams(b)))
    return F.when(union > 0, F.size(F.array_intersect(grams(a), grams(b))) / union).otherwise(0.0)


def mmr(hits: DataFrame, query: str, id_: str, text: str, score: str, limit: int, trade: float = 0.7) -> DataFrame:
    """Each query's hits re-ranked: the best first, then, round by round, the best of score less likeness to those taken. Up to ``limit`` hits keep their order.

    A round compares the hits with the one taken last and keeps each hit's greatest likeness, so no query is gathered in one place.
    """
    by = Window.partitionBy(query).orderBy(F.desc(score), id_)
    n = hits.groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    grams = ngrams(F.lower(F.left(text, F.lit(500))), 3, 3)
    rows = hits.join(n, query)
    few = rows.filter(F.col("_n") <= limit).withColumn("mmr_rank", F.row_number().over(by))
    left = cut(rows.filter(F.col("_n") > limit).withColumn("_grams", grams).withColumn("_like", F.lit(0.0)))
    taken = []
    for rank in range(1, limit + 1):
        value = F.col(score) if rank == 1 else trade * F.col(score) - (1 - trade) * F.col("_like")
        # of equal ones the first in the given order: the greatest score, then the least id
        best = left.groupBy(query).agg(F.min(F.struct((-value).alias("v"), (-F.col(score)).alias("s"), F.col(id_).alias("_id"))).alias("_b"))
        best = best.select(query, F.col("_b._id").alias("_id"))
        marked = left.join(best, query).withColumn("_new", F.col(id_) == F.col("_id")).drop("_id")
        taken.append(cut(marked.filter("_new").drop("_new").withColumn("mmr_rank", F.lit(rank))))
        if rank == limit:
            break
        last = taken[-1].select(query, F.col("_grams").alias("_last"))
        union = F.size(F.array_union("_grams", "_last"))
        like = F.when(union > 0, F.size(F.array_intersect("_grams", "_last")) / union).otherwise(0.0)
        left = cut(marked.filter("not _new").drop("_new").join(last, query).withColumn("_like", F.greatest("_like", like)).drop("_last"))
    out = few.select(*hits.columns, "mmr_rank")
    for part in taken:
        out = out.unionByName(part.select(*hits.columns, "mmr_rank"))
    return out


def weighted_score(hits: DataFrame, weights: dict[str, float], by: list[str]) -> DataFrame:
    """Min-max norms of the positive scores, weighed over the norms above 0."""
    w = Window.partitionBy(*by)
    total, used = F.lit(0.0), F.lit(0.0)
    for c, weight in weights.items():
        x = F.when(F.col(c) > 0, F.col(c))
        low, high = F.min(x).over(w), F.max(x).over(w)
        norm = F.when(x.isNull(), 0.0).when(high == low, 1.0).otherwise((x - low) / (high - low))
        total, used = total + F.when(norm > 0, weight * norm).otherwise(0.0), used + F.when(norm > 0, weight).otherwise(0.0)
    return hits.withColumn("final_score", F.when(used > 0, total / used).otherwise(0.0))


def dedupe_first(hits: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    return hits.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter("_r = 1").drop("_k", "_r")


def best_parents(hits: DataFrame, limit: int, doc: str = "doc_id", text: str = "text", score: str = "score", order: str = "position") -> DataFrame:
    """Hits with one document and the same first 200 characters become one: the best one, at the place of the first. ``hits`` is a top-k list."""
    same = Window.partitionBy(doc, F.left(text, F.lit(200)))
    first = hits.withColumn("_place", F.min(order).over(same)).withColumn("_r", F.row_number().over(same.orderBy(F.desc(score), order)))
    return first.filter("_r = 1").orderBy("_place").limit(limit).drop("_place", "_r")


def hybrid(chunks: DataFrame, q: str, k: int = 10, where: Column | None = None, post_filter: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Both lists of 2k, fused; ``chunks``: id, text, embedding (or null: text only), and the columns ``keep`` that come with the hits, as a headline does.

    ``where`` is applied below the lists; ``post_filter`` to the fused list, which it can shorten. Where ``chunks`` is costly, store it first: it is read thrice.
    """
    words = query_words(q)
    rows = chunks if where is None else chunks.filter(where)
    fused = rrf(vector_top_k(rows, embed_text(q).tolist(), 2 * k), bm25(rows, words, 2 * k), 2 * k)
    out = rows.select("id", "text", *keep).join(F.broadcast(fused), "id")  # 2k rows
    out = out if post_filter is None else out.filter(post_filter)
    out = out.withColumn("headline", highlighted(F.col("text"), words))
    return out.orderBy(F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("fts_rank"), "id").limit(k)
