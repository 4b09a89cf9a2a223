"""Connected components by contraction, for edge tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.session import cut

#: So few contracted edges (16 bytes each) are finished by one task; more go on being contracted.
FEW_EDGES = 20_000


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """at, to: the root of each node of a bounded edge table."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            root[find(a)] = find(b)
    yield pd.DataFrame({"at": list(root), "to": [find(x) for x in root]}, dtype="int64")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few_edges: int = FEW_EDGES) -> DataFrame:
    """node, component (its least node) of every node of the undirected ``edges``; long ids.

    Each round points a node at its least neighbour in the order of a hash and contracts
    the edges along the pointers, which leaves a fraction of the nodes whatever the
    graph's shape, so paths and stars end in a logarithmic number of rounds. The pointers
    of all rounds are then followed by one join each.
    """
    left = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    n = left.count()
    rounds: list[DataFrame] = []
    while n > few_edges:
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("n"))
        near = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min(order("b")).alias("to"))
        points = cut(least.select(F.col("a").alias("at"), F.least(F.col("to"), order("a"))["n"].alias("to")))
        rounds.append(points)
        ends = left.join(points.select(F.col("at").alias("a"), F.col("to").alias("x")), "a").join(points.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
        left = cut(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        n = left.count()
    rounds.append(cut(left.coalesce(1).mapInPandas(_finish, "at long, to long")))
    of = rounds[0].select(F.col("at").alias("node"), F.col("to").alias("at"))
    for points in rounds[1:]:
        of = of.join(points, "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    least = of.groupBy("at").agg(F.min("node").alias("component"))
    return cut(of.join(least, "at").select("node", "component"))
