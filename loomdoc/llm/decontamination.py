"""Operator 8: benchmark passages in documents, by SimHash over item-sized windows.

Words are lower-cased and lose ASCII punctuation; shingles are five words. A window has as
many words as an item. A window without any shingle of an item has similarity 0, so windows
are made where a word position of a text holds an item's shingle: the window that lines the
two up. A window's shingles, weighted by rarity among the items, give a 64-bit SimHash.

Candidates come from a multi-index alone. A fingerprint is cut into ``BLOCKS`` parts of 12 or 13 bits; a pair
within the radius differs in radius / BLOCKS bits at most in one of them. So the index holds
each item's parts with all flips of so many bits (one value in 14 to 22 of a part), and a window looks up its own parts as they
are: every item within the radius is found, whichever shingle made the window. These
pairs are verified by the exact weighted Jaccard similarity of their shingle sets, ``SIMILARITY`` or more.
The radius is where this can lose: a pair of similarity 0.8 differs in 9.7 bits on average with a
deviation of 2.9, so about 1 in 1,000 of the pairs at the very limit is farther apart than 19.

The result has one row for each distinct doc_id and item: the best window, the first one of equal
ones. Equal texts are searched once; texts are told apart by 96 bits. Items or documents of fewer than five
words, null or empty texts: never matched, as a shingle needs five. Items of null id are left
out; a null doc_id is reported as any other. Repeated rows, or several texts of one id: one result. Very long
texts: their shingles are one array, the windows are cut from it. Empty tables: no rows. More
columns of any name are ignored, and kept by ``clean``.
The index, the items' shingles and the candidates' keys are broadcast up to ``BROADCAST_ROWS``; beyond that Spark shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.text import identity, words
from loomdoc.session import cut, table

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 19
#: Parts of a fingerprint, of about 64 / BLOCKS bits.
BLOCKS = 5
BROADCAST_ROWS = 500_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TEXT = ["_t", "_u"]


def _words(text: Column) -> Column:
    return words(F.translate(F.lower(text), PUNCTUATION, ""))


def _shingles(w: Column) -> Column:
    """The hash of each run of five words, by place."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WIDTH - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WIDTH)]))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _weight(odds: Column) -> Column:
    """Whole numbers, so that sums don't depend on their order."""
    return F.round(1000 * F.log(odds)).cast("long")


def fingerprint(shingles: Column) -> Column:
    """The SimHash of an array of (h, w): bit b is set where the weights with bit b outweigh the rest."""
    bit = lambda b: F.aggregate(
        shingles, F.lit(0).cast("long"), lambda acc, s: acc + F.when(F.shiftright(s["h"], b).bitwiseAND(F.lit(1)) == 1, s["w"]).otherwise(-s["w"])
    )
    out = F.lit(0).cast("long")
    for b in range(64):
        out = out.bitwiseOR(F.when(bit(b) > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def parts(print_: Column, blocks: int = BLOCKS) -> Column:
    """(block, bits, value) of the parts of a fingerprint."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    cut_ = lambda lo, hi: F.shiftrightunsigned(print_, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    return F.array(*[F.struct(F.lit(k).alias("block"), F.lit(hi - lo).alias("bits"), cut_(lo, hi).alias("value")) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def flips(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The masks of the widest part that a fingerprint within the radius may differ by in one part at least."""
    return [m for m in range(1 << -(-64 // blocks)) if m.bit_count() <= radius // blocks]


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """_t, _u (of the text), item_id, at (word), similarity, distance: the best window of each text and item that is similar."""
    items = benchmark.filter("item_id is not null").select("item_id", _words(F.col("text")).alias("w")).filter(F.size("w") >= WIDTH).distinct()
    items = items.select(F.xxhash64("item_id", "w").alias("item"), "item_id", F.size("w").alias("length"), _shingles(F.col("w")).alias("shingles"))
    items = cut(items)
    n_items = items.count()
    placed = items.select("item", "length", F.posexplode("shingles").alias("offset", "h"))
    rarity = cut(placed.groupBy("h").agg(_weight(1.0 + n_items / F.count_distinct("item")).alias("w")))
    rarest = _weight(F.lit(1.0 + n_items))
    # an item's own weights by shingle, as large as the item
    own = placed.join(rarity, "h").groupBy("item").agg(F.map_from_entries(F.collect_set(F.struct("h", "w"))).alias("weights"))
    own = own.withColumn("item_print", fingerprint(F.transform(F.map_entries("weights"), lambda e: F.struct(e["key"].alias("h"), e["value"].alias("w")))))
    own = cut(own.join(items.select("item", "item_id", "length"), "item"))
    n_placed, n_shingles = placed.count(), rarity.count()

    texts = docs.select(*identity(F.col("text")), _words(F.col("text")).alias("w"))
    found = texts.select(*TEXT, F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"))).alias("pos", "h"))
    found = found.join(_small(placed.select("h", "length", "offset").distinct(), n_placed), "h")
    begin = F.greatest(F.least(F.col("pos") - F.col("offset"), F.col("n") - F.col("length")), F.lit(0))
    windows = cut(found.select(*TEXT, "length", begin.alias("at")).distinct())

    keys = windows.select(*TEXT).distinct()
    chosen = texts.join(_small(keys, keys.count()), TEXT, "left_semi").select(*TEXT, _shingles(F.col("w")).alias("shingles")).dropDuplicates(TEXT)
    weighed = chosen.select(*TEXT, F.posexplode("shingles").alias("pos", "h")).join(_small(rarity, n_shingles), "h", "left")
    weighed = weighed.groupBy(*TEXT).agg(F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("w", rarest).alias("w")))).alias("shingles"))
    run = F.slice("shingles", F.col("at") + 1, F.col("length") - (WIDTH - 1))
    pairs = windows.join(cut(weighed), TEXT).select(*TEXT, "at", "length", F.array_distinct(F.transform(run, lambda s: F.struct(s["h"].alias("h"), s["w"].alias("w")))).alias("window"))
    pairs = cut(pairs.withColumn("print", fingerprint(F.col("window"))))

    masks = F.array(*[F.lit(m) for m in flips(radius)])
    flipped = F.transform(F.filter(masks, lambda m: m < F.pow(F.lit(2), F.col("b.bits"))), lambda m: F.col("b.value").bitwiseXOR(m))
    index = own.select("item", "length", "item_print", F.explode(parts(F.col("item_print"))).alias("b"))
    index = index.select("item", F.col("length").alias("item_length"), "item_print", "b.block", F.explode(flipped).alias("value"))
    probes = pairs.select(*TEXT, "at", "length", "print", F.explode(parts(F.col("print"))).alias("b")).select(*TEXT, "at", "length", "print", "b.block", "b.value")
    near = probes.join(_small(index, n_items * BLOCKS * len(flips(radius))), ["block", "value"]).filter("length = item_length")
    near = near.withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))).filter(F.col("distance") <= radius)
    near = near.select(*TEXT, "at", "length", "item", "distance").distinct()

    total = lambda c, of: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + of(x))
    both = near.join(pairs.select(*TEXT, "at", "length", "window"), [*TEXT, "at", "length"]).join(_small(own.select("item", "item_id", "weights"), n_placed), "item")
    common = total(F.col("window"), lambda x: F.coalesce(F.element_at("weights", x["h"]), F.lit(0).cast("long")))
    union = total(F.col("window"), lambda x: x["w"]) + total(F.map_values("weights"), lambda x: x) - common
    scored = both.select(*TEXT, "item_id", "at", "distance", (common / union).alias("similarity")).filter(F.col("similarity") >= similarity)
    return _best(scored, *TEXT, "item_id")


def _best(found: DataFrame, *keys: str) -> DataFrame:
    best = F.max(F.struct("similarity", (-F.col("at")).alias("before"), (-F.col("distance")).alias("near"))).alias("_b")
    return found.groupBy(*keys).agg(best).select(*keys, (-F.col("_b.before")).alias("at"), "_b.similarity", (-F.col("_b.near")).alias("distance"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, at, similarity, distance of the documents that hold an item."""
    found = cut(matches(docs, benchmark, similarity, radius))
    ids = docs.select("doc_id", *identity(F.col("text"))).join(_small(found, found.count()), TEXT)
    return _best(ids, "doc_id", "item_id")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = cut(matches(docs, benchmark, similarity, radius).select(*TEXT).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *identity(F.col("text")))
    return rows.join(_small(found, found.count()), TEXT, "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
