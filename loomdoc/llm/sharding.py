"""Operator 2: shards by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the fractional
rank (rank - u) / rows of the source orders all rows, and that order is cut into
shards of equal row counts. u is a number of the source's own between 0 and 1, so that
sources of a few rows don't meet at one place. So each shard holds each source in proportion, within
one row or so.

No task holds a whole source: a source is ranked in slices of the hash range, and
the slices' counts, a small table, give the offsets. The global order is numbered
the same way, in slices of the fractional rank.

Null source: a stratum of its own. Null or empty text: size 16. Very long texts: only their size and
checksum go on. Repeated rows, ties of all columns among them, are placed one
by one. Empty table: no rows. Columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.llm.text import n_bytes, slice_of, unit, whole
from loomdoc.session import cut, table

SHARDS = 40
SEED = 20_240
#: Rows that one window partition gets to sort, on average; there are ``LEAST_SLICES`` at least.
SLICE_ROWS = 50_000
LEAST_SLICES = 64


def _numbered(df: DataFrame, group: list[str], part: str, order: list[str], name: str, totals: str | None = None) -> DataFrame:
    """``name``: 1, 2, ... within ``group`` by ``part`` and then ``order``. ``part`` must rise with the order."""
    counts = df.groupBy(*group, part).agg(F.count(F.lit(1)).alias("_rows"))
    within = Window.partitionBy(*group)
    counts = counts.withColumn("_before", F.sum("_rows").over(within.orderBy(part)) - F.col("_rows"))
    if totals:
        counts = counts.withColumn(totals, F.sum("_rows").over(within))
    at = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)).cast("long")
    return df.withColumn(name, at).join(counts.drop("_rows"), [*group, part]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def shard(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of each row of ``docs`` (doc_id, text, source)."""
    text = whole(F.col("text"))
    rows = docs.select(
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("is "), F.col("source"))).alias("_stratum"),
        (n_bytes(F.col("text")) + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    rows = cut(rows)
    n = rows.count()
    slices = max(LEAST_SLICES, math.ceil(n / slice_rows))
    order = ["_hash", "doc_id", "text_crc32", "size"]
    ranked = _numbered(rows.withColumn("_slice", slice_of(F.col("_hash"), slices)), ["_stratum"], "_slice", order, "_rank", "_of")
    ranked = ranked.withColumn("_at", (F.col("_rank") - unit(F.lit(seed), F.col("_stratum"))) / F.col("_of")).withColumn("_part", F.floor(F.col("_at") * slices))
    ranked = cut(ranked.select("doc_id", "source", "size", "text_crc32", "_stratum", "_hash", "_at", "_part"))
    placed = _numbered(ranked, [], "_part", ["_at", "_stratum", *order], "_place").withColumn("_place", F.col("_place") - 1)
    to = F.floor(F.col("_place") * n_shards / F.lit(max(n, 1)))
    # division in doubles may be one off near a cut, so the cut itself decides
    cut_at = lambda s: F.expr(f"({s} * {n}L + {n_shards - 1}) div {n_shards}L")
    placed = placed.withColumn("_to", to)
    placed = placed.withColumn("_to", F.when(F.col("_place") < cut_at("_to"), F.col("_to") - 1).when(F.col("_place") >= cut_at("(_to + 1)"), F.col("_to") + 1).otherwise(F.col("_to")))
    return placed.select("doc_id", "source", "size", "text_crc32", F.col("_to").cast("int").alias("shard"), (F.col("_place") - cut_at("_to")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
