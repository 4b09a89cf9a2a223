"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage works on all that its predecessor kept. STAGES can be run one by one, each result
written as Parquet and read again, or all together by ``run``.

Every stage takes: null doc_ids (rows as any other), null and empty texts (they score as texts without
toxic words, are no copies, hold no item, take no words and have size 16), null sources (a source of their own),
repeated rows (near copies: one of them stays; a later stage treats each as a row), a doc_id with several
texts (each text is judged on its own), very long texts (whole), empty tables (no rows), and more columns of any names (kept up to the last stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from loomdoc.llm.text import identity
from loomdoc.session import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates here: five-word shingles, similarity 0.8.
WIDTH, NUM, DEN = 5, 80, 100
#: Copies of one row that are made at once.
RUN = 1_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores below 1/2. The labels are those of the corpus; without usable ones all documents stay."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("_all"), "text")
    return toxicity.score(rows, model).filter(F.col("_score") < 0.5).select("_all.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the least doc_id, null last, then of the text with the least key.

    Repeated rows of this text: that of the least hash of the row. Rows without words stay.
    """
    rows = jaccard_join.grouped(docs, WIDTH, NUM, DEN).filter("component is not null")
    texts = cut(rows.groupBy("component", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies")))
    first = texts.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("_f"))
    first = first.select(F.col("_f.doc_id").alias("_id"), F.col("_f.key").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    texts = texts.join(first, same, "left").select("doc_id", "key", "copies", F.col("_key").isNotNull().alias("first"))
    out = cut(texts.filter("not first or copies > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "first"))
    few = out.count() <= jaccard_join.BROADCAST_NODES
    held = lambda df: F.broadcast(df) if few else df
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (jaccard_join.text_key(docs["text"]) == F.col("_key"))
    kept = docs.join(held(out), same, "left_anti").select(*docs.columns)
    again = out.filter("first")
    if again.isEmpty():
        return kept
    # each task hands on one row of each repeated text
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")
    one = docs.join(held(again), same).groupBy("_id", "_key").agg(row).select("_row.*")
    return kept.unionByName(one)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times. Rows that are equal in all columns share their copies; null doc_ids, texts and sources are mixed as any other."""
    keys = ["_t", "_u", "_w"]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source", *identity(F.col("text")), F.xxhash64(*docs.columns).alias("_w"))
    taken = mixing.mix(rows, keep=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_copies"))
    taken = cut(taken.filter("_copies > 0"))
    one = rows.select("_row", *keys).join(taken.filter("_rows = 1"), keys).select("_row", "_copies")
    repeated = taken.filter("_rows > 1")
    if not repeated.isEmpty():
        # one row stands for its equals, and its copies are dealt out in runs
        first = rows.select("_row", *keys).join(repeated, keys).groupBy(*keys, "_copies").agg(F.first("_row").alias("_row"))
        runs = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / RUN)), lambda k: F.least(F.lit(RUN), F.col("_copies") - k * RUN))
        one = one.unionByName(first.select("_row", F.explode(runs).alias("_copies")).repartition(spark.sparkContext.defaultParallelism))
    return one.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of each row."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", place),
]

#: Learned scores and similarity components aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
