"""Operator 5: n-gram Jaccard join by signature trees.

Documents are sets of word shingles; two link when their Jaccard similarity is at least
num / den. The result is each document's set size and the least document of its component.

1. Equal sets are one node, named by the hash of the set; copies cost one row each. A second hash
   tells different sets of one name apart, and all but one of them get a name of their own.
2. Cells bring together what can link, without loss. Sets of one class of sizes differ in
   at most D shingles if they link. The hash range is cut into K > D cells, so some cells
   of two such sets are equal; a cell is sent as the hash of its content. If a set has so
   many empty cells that the equal ones might all be empty, it sends these too, so the
   guarantee holds for every set. A set also sends the cells of the next classes, as far
   as its partners reach. It and its largest partner differ in d <= D shingles at most,
   so K - d of their cells are equal; a set that shares fewer with all others together
   (less its empty ones) has no link, and goes.
3. Nodes that share a cell form clusters (connected components of hub edges).
4. A cluster is joined by a signature tree: see ``signature_tree``. A cluster of more than
   a block of sets is split by size, into bands so wide that links reach the next band at
   most, and these into blocks; each block is joined with a few pivots of its band, which
   makes large groups of near copies one class, and then each pair of blocks of a band or
   of neighbouring bands that still holds two classes is joined too.
5. Components of the links, and their least document.

Null or empty text, or no words: an empty set, linked with nothing. Fewer words than a
shingle: the whole sequence is the one shingle. Null doc_id: kept, linked as any
other, and never the name of a component that has other documents. Repeated rows: copies. Very long texts:
one text's hashes are held at a time. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.hashing import LOWER, joined, mixed, rolling, slices
from loomdoc.llm.signature_tree import SignatureTree
from loomdoc.operators.components import connected_components
from loomdoc.session import cut, stored, table

WIDTH = 4
NUM, DEN = 85, 100
#: A block of a cluster: sets, and shingles of all of them.
BLOCK_SETS = 512
BLOCK_SHINGLES = 2_000_000
PIVOT_SETS = 8
#: Bits of a set's name.
NAME_BITS = 63
#: Bits of a cell's signature, most of what is shuffled; sets that share a cell by chance are told apart by the trees.
CELL_BITS = 48
#: Node ids that may be broadcast; more go through a shuffle.
BROADCAST_NODES = 500_000


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's word hashes."""
    if len(hashes) >= width:
        return np.unique(rolling(hashes, width))
    return mixed(rolling(hashes, len(hashes)) + np.uint64(len(hashes))) if len(hashes) else np.empty(0, np.uint64)


def _sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    for begin, end in slices(texts):
        hashes, starts = joined(texts[begin:end])
        for a, z in zip(starts[:-1], starts[1:]):
            yield shingles(hashes[a:z], width)


def set_name(tokens: np.ndarray, bits: int = NAME_BITS) -> tuple[int, int]:
    """A name of a set, of 63 bits as nodes are compared and stored as longs, and a check of 32 more bits that is independent of it."""
    spread = mixed(tokens + np.uint64(11))
    name = int(mixed(np.sum(spread, dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)))[0] >> np.uint64(64 - bits))
    return name, int(mixed(np.bitwise_xor.reduce(spread, keepdims=True))[0] >> np.uint64(32)) - (1 << 31)


def other_name(name, check):
    """The name of a set whose own name stands for another one. Of numbers or of columns."""
    shifted = (check + (1 << 31)) * (1 << 24) + (1 << 20)
    return name.bitwiseXOR(shifted) if isinstance(name, Column) else name ^ shifted


def size_classes(most: int) -> list[int]:
    """The largest size of each class."""
    tops = [1]
    while tops[-1] < most:
        tops.append(tops[-1] * 8 // 5 + 1)
    return tops


def cells(tokens: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The cell signatures of a set (sorted hashes), of its class of sizes and of those of larger partners;
    and how many of them it shares at least with any set that it links with."""
    n, out, need = len(tokens), [], []
    reach = n * den // num
    tops = size_classes(reach)
    for c, top in enumerate(tops):
        if top < n:
            continue
        if c and tops[c - 1] >= reach:
            break
        apart = (den - num) * 2 * top // (den + num)
        if not apart:
            continue  # only equal sets link
        spare = apart // 8 + 2
        k = apart + 1 + spare
        cell = ((tokens >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(cell, prepend=np.uint64(k)))
        content = np.add.reduceat(mixed(tokens), first)
        full = cell[first]
        name = np.uint64(c << 40)
        out.append(mixed(content ^ mixed(full + name)))
        # a partner of this class differs in so many shingles, and so many cells, at most
        own = (den - num) * (n + min(top, reach)) // (den + num)
        equal, empty = k - own, k - len(full)
        need.append(max(1, equal - empty))
        if empty >= equal:
            out.append(mixed(np.setdiff1d(np.arange(k, dtype=np.uint64), full) + name + np.uint64(1 << 60)))
    # cells only bring candidates together, so fewer bits do; equal ones of one set count once, and it needs so many fewer
    short = np.concatenate(out) >> np.uint64(64 - CELL_BITS) if out else np.empty(0, np.uint64)
    once = np.unique(short)
    return once.view(np.int64), max(1, min(need, default=1) - (len(short) - len(once)))


def text_key(text: Column) -> Column:
    """With the doc_id it names a text, also where the doc_id is null or has two texts."""
    return F.xxhash64(text)


def _lowered(batch: pd.DataFrame) -> list[bytes]:
    return [(t or "").encode().translate(LOWER) for t in batch["text"]]


def describe(docs: DataFrame, width: int, num: int, den: int, name_bits: int = NAME_BITS) -> DataFrame:
    """doc_id, key (of the text), node, check, n, need, cells of each document. A task sends the cells of equal sets once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for tokens in _sets(_lowered(batch), width):
                name = set_name(tokens, name_bits)
                found, need = (None, 1) if name in seen or not len(tokens) else cells(tokens, num, den)
                rows.append((*name, len(tokens), need, found))
                seen.add(name)
            out = pd.DataFrame(rows, columns=["node", "check", "n", "need", "cells"])
            yield out.assign(doc_id=batch["doc_id"].to_numpy(), key=batch["key"].to_numpy())[["doc_id", "key", "node", "check", "n", "need", "cells"]]

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("key")).mapInPandas(run, "doc_id long, key long, node long, check int, n int, need int, cells array<long>")


def _named_apart(described: DataFrame) -> DataFrame:
    """``described`` with nodes that stand for one set each: of the sets of one name the one of least check keeps it."""
    names = described.filter("n > 0").groupBy("node").agg(F.min("check").alias("_keeps"), F.max("check").alias("_last"))
    shared = cut(names.filter("_keeps <> _last").select("node", "_keeps"))
    if shared.isEmpty():
        return described
    few = shared.count() <= BROADCAST_NODES
    rows = described.join(F.broadcast(shared) if few else shared, "node", "left")
    own = F.when(F.col("n") == 0, F.col("node")).when(F.col("check") != F.col("_keeps"), other_name(F.col("node"), F.col("check").cast("long"))).otherwise(F.col("node"))
    return rows.withColumn("node", own).select(described.columns)


def _shared(held: DataFrame) -> DataFrame:
    """``held`` and hub: the rows whose cell two nodes have, with the least of these nodes. Rows go to their cell once, for the sum and for the join."""
    held = held.repartition("cell")
    hubs = held.groupBy("cell").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub <> other").select("cell", "hub")
    return held.join(hubs, "cell")


def _clusters(sets: DataFrame) -> DataFrame:
    """node, cluster: nodes that may link. A node that shares fewer cells than any link needs has none, and goes; so do, once more, those that needed it."""
    all_cells = sets.filter("cells is not null").select("node", "need", F.explode("cells").alias("cell"))
    with ExitStack() as tables:
        held = tables.enter_context(stored(_shared(all_cells).select("node", "need", "cell").distinct()))
        for _ in range(2):
            enough = held.groupBy("node").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("_need")).filter("shared >= _need").select("node")
            held = tables.enter_context(stored(_shared(held.select("node", "need", "cell").join(enough, "node"))))
        edges = cut(held.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    return connected_components(edges).withColumnRenamed("component", "cluster")


def _join_groups(sets: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Links a, b of each group of ``sets`` (keys, node, label, tokens)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        nodes = group["node"].to_numpy()
        tree = SignatureTree([np.asarray(t, np.int64) for t in group["tokens"]])
        found = tree.links(group["label"].to_numpy(), num, den)
        return pd.DataFrame([(nodes[a], nodes[b]) for a, b in found], columns=["a", "b"], dtype="int64")

    return sets.groupBy(*keys).applyInPandas(run, "a long, b long")


def _parts(sets: str, shingles_: str) -> Column:
    """Blocks that so many sets, with so many shingles in all, are split into."""
    return F.greatest(F.ceil(F.col(sets) / BLOCK_SETS), F.ceil(F.col(shingles_) / BLOCK_SHINGLES), F.lit(1).cast("long"))


def _banded(members: DataFrame, num: int, den: int) -> DataFrame:
    """``members`` with blocks (of the cluster), band and parts (of the band). Sets that link are of one band of sizes or of two neighbouring ones."""
    total = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sets"), F.sum("n").alias("_all"))
    blocks = total(members, "cluster").select("cluster", _parts("_sets", "_all").alias("blocks"))
    band = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * max(math.log(den / num), 1e-3)))
    banded = cut(members.join(blocks, "cluster").withColumn("band", F.when(F.col("blocks") > 1, band).otherwise(0)))
    parts = total(banded, "cluster", "band").select("cluster", "band", _parts("_sets", "_all").alias("parts"))
    return cut(banded.join(parts, ["cluster", "band"]))


def _links(docs: DataFrame, members: DataFrame, width: int, num: int, den: int, name_bits: int) -> DataFrame:
    """Links a, b within the clusters of ``members`` (node, cluster, doc_id, key, n). A task sends the shingles of repeated rows once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            tokens = list(_sets(_lowered(batch), width))
            nodes = batch["node"].tolist()
            names = [set_name(t, name_bits) for t in tokens]
            fits = [node in (name, other_name(name, check)) for (name, check), node in zip(names, nodes)]  # two texts may have one key
            own = [fit and node not in seen and not seen.add(node) for fit, node in zip(fits, nodes)]
            out = batch[["node", "cluster", "band", "parts"]].assign(tokens=[t.view(np.int64) for t in tokens])
            yield out[own]

    members = _banded(members, num, den)
    few = members.count() <= BROADCAST_NODES
    ids = members.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "node", "cluster", "band", "parts")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key"))
    text = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, same)
    tokens = text.select("node", "cluster", "band", "parts", "text").mapInPandas(run, "node long, cluster long, band long, parts long, tokens array<long>")
    with stored(tokens.withColumn("label", F.col("node"))) as tokens:
        # pivots: the nodes of least hash; a threshold picks about PIVOT_SETS of a band
        spread = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        pivot = (F.col("parts") > 1) & (spread * F.col("parts") * BLOCK_SETS < PIVOT_SETS)
        own = F.pmod(F.xxhash64("node"), F.col("parts"))
        at = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own))
        first = cut(_join_groups(tokens.withColumn("block", F.explode(at)), ["cluster", "band", "block"], num, den))
        large = members.filter("blocks > 1")
        if large.isEmpty():
            return first
        sent = _undecided(large, first)
        second = cut(_join_groups(sent.join(tokens.select("node", "tokens"), "node"), ["pair"], num, den))
    return first.unionByName(second)


def _undecided(large: DataFrame, links: DataFrame) -> DataFrame:
    """node, label, pair: the sets of each pair of blocks that may still link two classes; ``links`` has those within blocks.

    A class is what the links join. A class of many sets has blocks of its own, the others of a band share theirs.
    """
    large = cut(large.join(connected_components(links), "node", "left").select("node", "cluster", "band", "parts", "n", F.coalesce("component", "node").alias("label")))
    several = large.groupBy("cluster").agg(F.min("label").alias("_a"), F.max("label").alias("_z")).filter("_a <> _z").select("cluster")
    large = large.join(several, "cluster")
    classes = large.groupBy("cluster", "band", "label").agg(F.count(F.lit(1)).alias("_sets"), F.sum("n").alias("_all"))
    classes = cut(classes.withColumn("own_parts", _parts("_sets", "_all")).withColumn("small", F.col("_sets") * 2 <= BLOCK_SETS))
    rest = classes.filter("small").groupBy("cluster", "band").agg(F.sum("_sets").alias("_sets"), F.sum("_all").alias("_all"))
    rest = rest.select("cluster", "band", _parts("_sets", "_all").alias("bins"))
    placed = large.join(classes.select("cluster", "band", "label", "own_parts", "small"), ["cluster", "band", "label"]).join(rest, ["cluster", "band"], "left")
    class_ = F.when(F.col("small"), F.lit(-1)).otherwise(F.col("label"))
    part = F.when(F.col("small"), F.pmod(F.xxhash64("label"), F.col("bins"))).otherwise(F.pmod(F.xxhash64("node"), F.col("own_parts")))
    placed = placed.withColumn("block", F.struct("band", class_.alias("class"), part.alias("part")))
    placed = cut(placed.select("node", "cluster", "band", "label", "block", (F.col("parts") == 1).alias("decided")))
    blocks = placed.select("cluster", "band", "block", "decided").distinct()
    near = blocks.select("cluster", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("block").alias("with"))
    pairs = blocks.join(near, ["cluster", "band"]).filter("block <= with")
    pairs = pairs.filter((F.col("block.band") != F.col("with.band")) | ~F.col("decided"))
    pairs = cut(pairs.filter((F.col("block.class") != F.col("with.class")) | (F.col("block.class") == -1)))
    pair = F.struct(F.col("block").alias("x"), F.col("with").alias("y"))
    ends = pairs.select("cluster", "block", pair.alias("pair")).unionByName(pairs.filter("block <> with").select("cluster", F.col("with").alias("block"), pair.alias("pair")))
    return placed.join(ends, ["cluster", "block"]).select("node", "label", F.struct("cluster", "pair").alias("pair"))


def grouped(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, name_bits: int = NAME_BITS) -> DataFrame:
    """doc_id, key, n, component (its name among the sets; null for an empty set), least (its least doc_id) of each row of ``docs`` (doc_id, text)."""
    with stored(describe(docs, width, num, den, name_bits)) as described:
        described = _named_apart(described)
        sets = cut(described.select("doc_id", "key", "node", "n"))
        clusters = _clusters(described)
    # any one text stands for a set; rows without a doc_id stand for it where no other does
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("_first")
    nodes = sets.filter("n > 0").groupBy("node").agg(first, F.first("n").alias("n"))
    nodes = cut(nodes.select("node", F.col("_first.doc_id").alias("doc_id"), F.col("_first.key").alias("key"), "n"))
    members = cut(clusters.join(nodes, "node"))
    linked = connected_components(_links(docs, members, width, num, den, name_bits))
    of = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("least"))
    of = of.join(least, "component").select("node", "component", "least")
    none = F.lit(None).cast("long")
    empty = sets.filter("n = 0").select("doc_id", "key", "n", none.alias("component"), none.alias("least"))  # they link with nothing, so they don't meet
    return sets.filter("n > 0").join(of, "node", "left").select("doc_id", "key", "n", "component", "least").unionByName(empty)


def components(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, name_bits: int = NAME_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    out = grouped(docs, width, num, den, name_bits)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
