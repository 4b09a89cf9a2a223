"""Similarity join of vectors: bands of random hyperplanes bring candidates together, their cosines decide.

A band is the signs of a vector on a few hyperplanes; vectors at an angle t agree on a sign with probability 1 - t / pi, so
``plan`` finds how many bands of how many signs meet the wanted share of all pairs at the least similarity (closer pairs meet more often).
Only vectors of one bucket (band and signs) are compared, in blocks of bounded size.

Equal vectors are one class. Of a class only as many rows are compared as could be among anyone's k nearest, so a
vector that holds a third of all rows costs as much as any other; every row gets the neighbours of its class. Near but unequal vectors in one bucket are compared
block by block, which grows with the square of such a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.operators.search import _matrix
from loomdoc.session import cut

#: Rows of a bucket that the number of signs aims at.
BUCKET = 64
MOST_BANDS = 256
#: Rows of a bucket that one task compares with as many others.
BLOCK = 2_048
#: A class is hot from this share of the rows on, so at most so many are.
HOT_CLASSES = 1_000
BROADCAST_BUCKETS = 200_000


def plan(rows: int, least: float, recall: float = 0.97) -> tuple[int, int]:
    """Bands, and signs of each."""
    agree = 1.0 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    for signs in range(min(30, max(1, math.ceil(math.log2(max(rows, 2) / BUCKET)))), 0, -1):
        met = agree**signs
        bands = 1 if met >= 1.0 else math.ceil(math.log(1.0 - recall) / math.log1p(-met))
        if bands <= MOST_BANDS:
            break
    return bands, signs


def _signed(vectors: DataFrame, bands: int, signs: int, vector: str, seed: int) -> DataFrame:
    """``vectors`` with _bands, an array with the signs of each band as one number."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = None
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            m = _matrix(batch)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(m.shape[1], bands * signs))
            above = ((m @ planes) > 0).reshape(len(m), bands, signs)
            yield pd.Series(list((above @ (1 << np.arange(signs, dtype=np.int64))).astype(np.int32)))

    return vectors.withColumn("_bands", F.pandas_udf(run, "array<int>")(F.col(vector)))


def _pairs_of(bucket: pd.DataFrame, id_: str, vector: str, k: int, least: float) -> pd.DataFrame:
    """_class, target and its row's columns: for each class that leads here, its best rows of the other side of the bucket."""
    bucket = bucket.sort_values(id_, ignore_index=True)
    m, side = _matrix(bucket[vector]), bucket["_side"].to_numpy()
    ids, apart, classes = bucket[id_].to_numpy(), pd.factorize(bucket["_apart"], use_na_sentinel=False)[0], bucket["_class"].to_numpy()
    one_sided = (bucket["_i"] == bucket["_j"]).all()
    leads = np.flatnonzero(bucket["_lead"].to_numpy())
    out = []
    for begin in range(0, len(leads), 256):
        part = leads[begin : begin + 256]
        s = m[part] @ m.T
        meets = s >= least - 1e-12
        if not one_sided:
            meets &= side[part][:, None] != side
        rows, columns = np.nonzero(meets)
        found = pd.DataFrame({"_class": classes[part[rows]], id_: ids[columns], "_at": columns, "_apart": apart[columns], "similarity": s[rows, columns]})
        found = found.sort_values(["_class", "similarity", id_], ascending=[True, False, True], kind="stable")
        found = found[found.groupby(["_class", "_apart"]).cumcount() < k]
        out.append(found[found.groupby("_class").cumcount() < 2 * k])
    found = pd.concat(out) if out else pd.DataFrame({"_class": [], id_: [], "_at": [], "similarity": []})
    kept = found["_at"].to_numpy().astype(int)
    return pd.DataFrame({"_class": found["_class"], id_: found[id_], "_apart": bucket["_apart"].to_numpy()[kept], "similarity": found["similarity"]})


def neighbours(vectors: DataFrame, k: int, id_: str = "id", vector: str = "embedding", least: float = 0.85, apart: str | None = None, recall: float = 0.97, seed: int = 11) -> DataFrame:
    """query_id, id, similarity, rank: for each row the k nearest others with at least that similarity, and another value of ``apart``.

    Null vectors, and those without length, have no neighbours. A pair may be missed with probability 1 - ``recall`` at ``least`` itself, less above.
    """
    apart_column = F.col(apart) if apart else F.col(id_)
    rows = vectors.filter(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).select(id_, apart_column.alias("_apart"), F.col(vector).alias("_v"))
    rows = cut(rows.withColumn("_class", F.xxhash64("_v")).withColumn("_class2", F.hash("_v")))
    same = ["_class", "_class2"]
    # at most 2k rows of a class, and k of one apart value: whoever asks, k of them are of another one, if the class has them
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*same, "_apart").orderBy(id_))).filter(F.col("_n") <= k).drop("_n")
    targets = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(id_))).filter(F.col("_n") <= 2 * k)
    targets = cut(targets.withColumn("_lead", F.col("_n") == 1).withColumn("_class", F.struct(*same)).drop("_n", "_class2"))
    bands, signs = plan(targets.count(), least, recall)
    placed = _signed(targets, bands, signs, "_v", seed).select("*", F.posexplode("_bands").alias("_band", "_value")).drop("_bands")
    sizes = placed.groupBy("_band", "_value").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > BLOCK)
    sizes = cut(sizes.select("_band", "_value", F.ceil(F.col("_size") / BLOCK).alias("_blocks")))
    known = F.broadcast(sizes) if sizes.count() <= BROADCAST_BUCKETS else sizes
    placed = placed.join(known, ["_band", "_value"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long")))
    # a row of block b goes to the pairs of blocks (b, j)
    placed = placed.withColumn("_side", F.pmod(F.xxhash64(F.lit(3), id_), F.col("_blocks"))).withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    placed = placed.withColumn("_i", F.least("_side", "_to")).withColumn("_j", F.greatest("_side", "_to")).drop("_to", "_blocks")
    kinds = dict(targets.dtypes)
    flat = placed.withColumn("_class2", F.col("_class._class2")).withColumn("_class", F.col("_class._class"))

    def compare(bucket: pd.DataFrame) -> pd.DataFrame:
        # both hashes name a class; inside a bucket the pair is one number of this bucket
        named = bucket.assign(_class=list(zip(bucket["_class"], bucket["_class2"])))
        codes, names = pd.factorize(named["_class"])
        found = _pairs_of(named.assign(_class=codes), id_, "_v", k, least)
        of = [names[int(c)] for c in found["_class"]]
        return found.assign(_class=[x[0] for x in of], _class2=[x[1] for x in of])[["_class", "_class2", id_, "_apart", "similarity"]]

    schema = f"_class long, _class2 int, {id_} {kinds[id_]}, _apart {kinds['_apart']}, similarity double"
    met = flat.groupBy("_band", "_value", "_i", "_j").applyInPandas(compare, schema)
    met = met.groupBy(*same, id_).agg(F.max("_apart").alias("_apart"), F.max("similarity").alias("similarity"))
    best = Window.partitionBy(*same).orderBy(F.desc("similarity"), id_)
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy(*same, F.col("_apart")).orderBy(F.desc("similarity"), id_))).filter(F.col("_n") <= k)
    met = met.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= 2 * k)
    lists = cut(met.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("_n", F.col(id_).alias("_id"), F.col("_apart").alias("_other"), "similarity"))).alias("_near")))  # 2k at most
    # rows of a hot class, at most HOT_CLASSES of them, take their list from a broadcast
    n = rows.count()
    hot = cut(rows.groupBy(*same).count().filter(F.col("count") * HOT_CLASSES > n).filter(F.col("count") > 1_000).drop("count"))
    asked = rows.drop("_v")
    of_hot = asked.join(F.broadcast(lists.join(F.broadcast(hot), same, "left_semi")), same)
    of_rest = asked.join(F.broadcast(hot), same, "left_anti").join(lists, same)
    near = of_hot.unionByName(of_rest)
    other = F.filter("_near", lambda t: ~t["_other"].eqNullSafe(F.col("_apart")) & (t["_id"] != F.col(id_)))
    found = near.select(F.col(id_).alias("query_id"), F.posexplode(F.slice(other, 1, k)).alias("_p", "_t"))
    return found.select("query_id", F.col("_t._id").alias(id_), F.col("_t.similarity").alias("similarity"), (F.col("_p") + 1).alias("rank"))
