"""Operator 7: sources mixed to target weights by pivotal dependent rounding.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ...; they share all
words, no target passes ``max_repeat`` times its source's words, and the excess is
shared again by weight (water filling: sums over the table of sources raise the level until it stands). A document then wants target / words of the source copies: the whole
part is sure, and the fraction is rounded by the pivotal method. Two fractions meet and
move mass at random until one is 0 or 1, so the sum stays and each document keeps its
own expectation.

The tree: blocks of about ``fan_in`` documents of one source and of nearly one size fold
to one fractional document each; ``fan_in`` neighbouring blocks fold again, until one is
left for each source and size, and these fold from long to short. As partners have nearly
one size, the taken words stay near the target, within about the longest document. A
hot source is only more blocks: rows learn their source's number of blocks from a broadcast
of up to ``BROADCAST_KEYS`` counts (beyond that by a join), and are then dealt by block. Random numbers are hashes of the two documents,
so reruns agree. Equal rows travel as one row with their number, and are told apart by it when they are dealt to blocks, so
many repeats are many blocks like any other rows.

Null source: a source of its own, the last. Null or empty text: size 0, takes no words. Very long
texts: only their number of words goes on. Repeated rows and ties are rounded one by one; null doc_ids
as any other. Empty table: no rows. Other columns are ignored, but for those named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.llm.text import n_words, unit
from loomdoc.session import cut, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3.0
FAN_IN = 32
SEED = 7_001
#: Documents of a block differ in size by at most this many parts of an octave.
PER_OCTAVE = 8
BROADCAST_KEYS = 100_000
#: Sources that one task numbers.
SLICE = 100_000
#: Equal rows that one task counts out at once.
RUN = 1_000


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with s: its place, from 1, in code-point order, null last; a slice of ``SLICE`` sources at a time."""
    parts = max(1, -(-sources.count() // SLICE))
    order = F.col("source").asc_nulls_last()
    dealt = cut(sources.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()))
    ahead, total = [], 0
    for r in dealt.groupBy("_p").count().orderBy("_p").collect():  # one row for each slice
        ahead.append((r["_p"], total))
        total += r["count"]
    before = F.broadcast(sources.sparkSession.createDataFrame(ahead, "_p int, _before long"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return dealt.join(before, "_p").withColumn("s", place + F.col("_before")).drop("_p", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """source, source_size -> with s (see ``_numbered``) and target. One row for each source, any number of them."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("s") - 1) % len(weights) + 1).cast("int"))
    sized = cut(_numbered(sizes).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat))))
    total = sized.agg(F.sum("source_size")).first()[0] or 0
    # the level rises while sources stop at their cap, and stands when no more do
    level, stopped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        r = sized.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)).alias("caps"), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0)).alias("w")).first()
        if r["n"] == stopped or not r["w"]:
            break
        level, stopped = max(level, (total - r["caps"]) / r["w"]), r["n"]
    target = F.when(full, F.col("_cap")).otherwise(F.lit(level) * F.col("_w"))
    return sized.withColumn("target", F.least("_cap", target)).select("source", "source_size", "s", "target")


def _counted_out(rows: DataFrame) -> DataFrame:
    """Each row of ``rows`` as often as its column _n says, with its number from 0 as ``_copy``. Many equal rows are dealt to the tasks in runs."""
    several = lambda df, a, z: df.withColumn("_copy", F.explode(F.sequence(a, z))).drop("_n", "_run")
    none = F.lit(0).cast("long")
    few = several(rows.filter(F.col("_n") <= RUN), none, F.col("_n") - 1)
    many = rows.filter(F.col("_n") > RUN)
    if many.isEmpty():
        return few
    runs = many.withColumn("_run", F.explode(F.sequence(none, F.floor((F.col("_n") - 1) / RUN)))).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return few.unionByName(several(runs, F.col("_run") * RUN, F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1))


def _meet(seed: int, depth: int):
    """One step of the fold: the carried document meets the next."""

    def step(acc: Column, x: Column) -> Column:
        a = acc["carry"]
        u = unit(F.lit(seed), F.lit(depth), a["h"], a["doc_id"], x["h"], x["doc_id"])
        p, q = a["q"], x["q"]
        total = p + q
        low = total < 1.0
        first = F.when(low, u * total < p).otherwise(u * (2.0 - total) < 1.0 - q)
        winner, loser = F.when(first, a).otherwise(x), F.when(first, x).otherwise(a)
        settled = F.when(low, loser.withField("q", F.lit(0.0))).otherwise(winner.withField("q", F.lit(1.0)))
        carry = F.when(low, winner.withField("q", total)).otherwise(loser.withField("q", total - 1.0))
        return F.when(a.isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))).otherwise(
            F.struct(carry.alias("carry"), F.concat(acc["done"], F.array(settled)).alias("done"))
        )

    return step


def _fold(rows: DataFrame, keys: list[str], seed: int, depth: int) -> DataFrame:
    """The rows of each block: all settled (q is 0 or 1) but the last, which carries the rest."""
    fields = F.struct(*[c for c in rows.columns if c not in ("s", "octave", "block")])
    item = rows.select(fields.alias("r")).schema["r"].dataType.simpleString()
    blocks = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(fields)).alias("rows"))
    start = F.struct(F.lit(None).cast(item).alias("carry"), F.array().cast(f"array<{item}>").alias("done"))
    folded = blocks.withColumn("acc", F.aggregate("rows", start, _meet(seed, depth)))
    out = folded.select(*keys, F.explode(F.concat(F.col("acc.done"), F.array(F.col("acc.carry")))).alias("r"))
    return out.select(*keys, "r.*")


def _known(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = SEED, fan_in: int = FAN_IN, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row of ``docs`` (doc_id, text, source), and its columns ``keep`` (of an ordered type)."""
    # equal rows are one row with their number: each task hands on one of them
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_crc"), *keep)
    rows = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")))
    sources = cut(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, max_repeat))
    rows = _counted_out(rows).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "_crc", "_copy"))
    wants = rows.join(_known(sources), rows["source"].eqNullSafe(sources["source"])).select(
        rows["doc_id"], "s", "size", "h", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_want"), *keep
    )
    wants = wants.withColumn("q", F.col("_want") - F.floor("_want"))
    octave = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * PER_OCTAVE).cast("int")
    wants = wants.withColumn("octave", octave).withColumn("minus_size", -F.col("size")).drop("_want")
    counts = cut(wants.groupBy("s", "octave").agg(F.ceil(F.count(F.lit(1)) / F.lit(fan_in)).alias("_blocks")))
    rest = wants.join(_known(counts), ["s", "octave"]).withColumn("block", F.pmod("h", F.col("_blocks")))
    keys = ["s", "octave", "block"]
    rest = rest.select(*keys, "minus_size", "h", "doc_id", "size", "q", *keep).repartition(*keys)  # by block, also after a join by source and size
    most = (counts.agg(F.max("_blocks")).first()[0]) or 1
    done, depth = [], 0
    while True:
        folded = cut(_fold(rest, keys, seed, depth))
        open_ = (F.col("q") > 0) & (F.col("q") < 1)
        done.append(folded.filter(~open_).select("s", "doc_id", "size", (F.col("q") == 1).cast("long").alias("one"), *keep))
        rest = folded.filter(open_)
        if len(keys) == 1:
            break
        if most > 1:
            rest, most, depth = rest.withColumn("block", F.floor(F.col("block") / fan_in)), -(-most // fan_in), depth + 1
        else:
            keys, depth = ["s"], depth + 1
            rest = rest.drop("octave", "block")
    last = F.when(unit(F.lit(seed), F.lit(depth + 1), "h", "doc_id") < F.col("q"), 1).otherwise(0).cast("long")
    done.append(rest.select("s", "doc_id", "size", last.alias("one"), *keep))
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    whole_copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        settled.join(_known(sources), "s")
        .withColumn("copies", (whole_copies + F.col("one")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
