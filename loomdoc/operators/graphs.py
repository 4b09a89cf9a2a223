"""Entities, triples, traversal and communities over vertex and edge DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.operators.components import connected_components
from loomdoc.session import cut, shuffled

MOST_HOPS = 5
#: Chains, times those asked for, that the first search for the surest ones follows.
BEAM = 8
#: Links of a graph that one task takes, about 100 bytes each.
SMALL_GRAPH = 1_000_000
#: Links of the small components that one task takes together.
BIN = 100_000
#: Nodes that move to or from one community and are ordered by one task.
MOVES = 50_000
LEAST_GAIN = 1e-6
# fixed value: what an article reference looks like
ARTICLE_REF = r"제\d+조(?:의\d+)?(?:제\d+항)?(?:제\d+호)?"


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct()


def reach(edges: DataFrame, starts: DataFrame, hops: int = MOST_HOPS, a: str = "a", b: str = "b", directed: bool = False) -> DataFrame:
    """start, node, depth: the least depth of every node within ``hops`` (breadth first; one join a hop). ``starts``: column start."""
    steps = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct() if directed else both_ways(edges, a, b)
    seen = front = starts.select("start", F.col("start").alias("node")).distinct().withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        found = front.join(steps, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        front = cut(found.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start: int, goal: int, hops: int = 10, a: str = "a", b: str = "b") -> DataFrame:
    """One row: path, the first in order of nodes among the shortest directed ones; none if the goal is out of reach."""
    steps = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    spark = edges.sparkSession
    front = spark.range(1).select(F.lit(start).cast("long").alias("node"), F.array(F.lit(start).cast("long")).alias("path"))
    seen = front.select("node")
    for _ in range(hops + 1):
        hit = front.filter(F.col("node") == goal)
        if not hit.isEmpty():
            return hit.select("path")
        ahead = front.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        ahead = ahead.groupBy("node").agg(F.min("path").alias("path"))
        front = cut(ahead.join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("node"))
    return front.filter(F.lit(False)).select("path")


def chains(edges: DataFrame, starts: DataFrame, hops: int = MOST_HOPS, confidence: str = "confidence", a: str = "a", b: str = "b") -> DataFrame:
    """path, depth, confidence (the product) of the simple directed paths from each start."""
    steps = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(confidence).alias("_c"))
    front = starts.select(F.array("start").alias("path"), F.lit(1.0).alias("confidence"))
    out = None
    for depth in range(1, hops + 1):
        front = front.join(steps, F.element_at("path", -1) == F.col("_a")).filter(~F.array_contains("path", F.col("_b")))
        front = cut(front.select(F.concat("path", F.array("_b")).alias("path"), (F.col("confidence") * F.col("_c")).alias("confidence")))
        level = front.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
        if front.isEmpty():
            break
    return out


def best_chains(found: DataFrame, k: int = 50) -> DataFrame:
    """The k chains that are longest, then surest, each path once. ``found``: see ``chains``."""
    once = found.groupBy("path", "depth").agg(F.max("confidence").alias("confidence"))
    return once.orderBy(*_chain_order()).limit(k)


def _chain_order() -> list[Column]:
    return [F.desc("depth"), F.desc(F.round("confidence", 9)), F.array_join(F.transform("path", lambda x: x.cast("string")), ">")]


def surest_chains(edges: DataFrame, starts: DataFrame, k: int = 50, hops: int = MOST_HOPS, confidence: str = "confidence", a: str = "a", b: str = "b") -> DataFrame:
    """path, depth, confidence: what ``best_chains`` of all ``chains`` gives, without making all of them. Confidences are at most 1.

    How sure a walk of r more steps from a node can be at most is found backwards, one grouped join a step. A first search follows the ``BEAM`` * k
    most promising chains only, and its k-th gives a floor; the second leaves out chains that can't reach it. Depths are searched from the
    longest on, until there are k. Chains that tie with the floor are all made.
    """
    steps = cut(edges.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.max(confidence).alias("_c")))
    ahead = [None]  # ahead[r]: node, sure: the surest walk of r steps from it
    for r in range(1, hops):
        reach_ = steps if r == 1 else steps.join(ahead[-1].select(F.col("node").alias("_b"), "sure"), "_b").withColumn("_c", F.col("_c") * F.col("sure"))
        ahead.append(cut(reach_.groupBy(F.col("_a").alias("node")).agg(F.max("_c").alias("sure"))))

    def search(depth: int, floor: float | None, beam: int | None) -> DataFrame:
        front = starts.select(F.array("start").alias("path"), F.lit(1.0).alias("confidence")).distinct()
        for d in range(1, depth + 1):
            grown = front.join(steps, F.element_at("path", -1) == F.col("_a")).filter(~F.array_contains("path", F.col("_b")))
            grown = grown.select(F.concat("path", F.array("_b")).alias("path"), (F.col("confidence") * F.col("_c")).alias("confidence"), F.col("_b").alias("node"))
            if d < depth:
                grown = grown.join(ahead[depth - d], "node").withColumn("_most", F.col("confidence") * F.col("sure"))
            else:
                grown = grown.withColumn("_most", F.col("confidence"))
            if floor is not None:
                grown = grown.filter(F.col("_most") >= floor - 1e-9)
            if beam is not None:
                grown = grown.orderBy(F.desc("_most"), "path").limit(beam)
            front = cut(grown.select("path", "confidence"))
        return front.withColumn("depth", F.lit(depth))

    found, have = None, 0
    for depth in range(hops, 0, -1):
        tried = search(depth, None, BEAM * k).orderBy(F.desc("confidence")).limit(k - have).collect()  # k rows at most
        floor = tried[-1]["confidence"] if len(tried) == k - have else None
        rows = cut(search(depth, floor, None).orderBy(*_chain_order()).limit(k - have).select("path", "depth", "confidence"))
        found = rows if found is None else found.unionByName(rows)
        have += rows.count()
        if have >= k:
            break
    return found.orderBy(*_chain_order())


def induced(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges with both ends in ``nodes`` (column node)."""
    keep = nodes.select("node").distinct()
    return edges.join(keep, edges[a] == keep["node"], "left_semi").join(keep, edges[b] == keep["node"], "left_semi")


def weighted_edges(triples: DataFrame, a: str, b: str, weight: str, least: float = 0.5) -> DataFrame:
    """a < b, w: undirected edges; parallel ones add up, loops go."""
    kept = triples.filter((F.col(weight) >= least) & (F.col(a) != F.col(b)))
    return kept.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(weight).alias("w"))


def degrees(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def modularity(edges: DataFrame, of: DataFrame, adjacent_only: bool = False) -> DataFrame:
    """One row, q. ``edges``: a < b, w; ``of``: node, community. ``adjacent_only`` sums over linked pairs alone, as some tools do."""
    ends = edges.join(of.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    k = edges.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k"))
    total = edges.agg(F.sum("w").alias("m"))
    inside = ends.filter("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inside"))
    if adjacent_only:
        pairs = ends.filter("ca = cb").join(k.withColumnRenamed("node", "a").withColumnRenamed("k", "ka"), "a").join(k.withColumnRenamed("node", "b").withColumnRenamed("k", "kb"), "b")
        minus = pairs.agg(F.coalesce(F.sum(2 * F.col("ka") * F.col("kb")), F.lit(0.0)).alias("kk"))
    else:
        minus = k.join(of, "node").groupBy("community").agg(F.sum("k").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0)).alias("kk"))
    row = total.crossJoin(inside).crossJoin(minus)  # three single rows
    return row.select((F.col("inside") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("q"))


def colours(links: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """keys, node, colour: nodes of one colour have no link. ``links``: keys, node, other, both ways. Each round colours the nodes whose hash is above those of all their neighbours left."""
    rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c), F.col(c))
    left, out, colour = links.select(*keys, "node", "other"), [], 0
    nodes = links.select(*keys, "node").distinct()
    while not nodes.isEmpty():
        near = left.groupBy(*keys, "node").agg(F.max(rank("other")).alias("_most"))
        ranked = nodes.join(near, [*keys, "node"], "left")
        split = cut(ranked.select(*keys, "node", (F.col("_most").isNull() | (rank("node") > F.col("_most"))).alias("_top")))
        top = split.filter("_top").select(*keys, "node")
        out.append(top.withColumn("colour", F.lit(colour)))
        nodes = split.filter("not _top").select(*keys, "node")
        left = cut(left.join(nodes, [*keys, "node"], "left_semi").join(nodes.withColumnRenamed("node", "other"), [*keys, "other"], "left_semi"))
        colour += 1
    found = out[0] if out else nodes.withColumn("colour", F.lit(0))
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _before(moves: DataFrame, keys: list[str], side: str, name: str) -> DataFrame:
    """``moves`` with the k of those before each at the same community ``side``: first those of earlier parts, then the better ones of its own part of bounded size."""
    at = [*keys, side]
    parts = moves.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / MOVES).alias("_parts"))
    dealt = moves.join(parts, at).withColumn("_part", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("_parts"))).drop("_parts")
    sums = dealt.groupBy(*at, "_part").agg(F.sum("k").alias("_k"))
    earlier = sums.withColumn("_earlier", F.coalesce(F.sum("_k").over(Window.partitionBy(*at).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_k")
    own = F.coalesce(F.sum("k").over(Window.partitionBy(*at, "_part").orderBy(F.desc("gain"), "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return dealt.withColumn("_own", own).join(earlier, [*at, "_part"]).withColumn(name, F.col("_own") + F.col("_earlier")).drop("_own", "_earlier", "_part")


def _moved(links: DataFrame, of: DataFrame, keys: list[str], colour: DataFrame, number: int, resolution: float) -> tuple[DataFrame, int]:
    """``of`` (keys, node, community, k, m2) after the nodes of one colour have moved, and how many did.

    Their links are exact, as none of them are neighbours. Those that join or leave one community are taken in an order, and each
    counts those before it, as if they moved one by one; so the modularity doesn't fall.
    """
    turn = of.join(colour.filter(F.col("colour") == number).select(*keys, "node"), [*keys, "node"])
    near = links.join(turn.select(*keys, "node"), [*keys, "node"], "left_semi")
    near = near.join(of.select(*keys, F.col("node").alias("other"), F.col("community").alias("to")), [*keys, "other"]).groupBy(*keys, "node", "to").agg(F.sum("w").alias("links"))
    near = near.unionByName(turn.select(*keys, "node", F.col("community").alias("to"), F.lit(0.0).alias("links"))).groupBy(*keys, "node", "to").agg(F.sum("links").alias("links"))
    total = of.groupBy(*keys, F.col("community").alias("to")).agg(F.sum("k").alias("total"))
    near = near.join(total, [*keys, "to"]).join(turn, [*keys, "node"])
    rest = F.col("total") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)
    near = near.withColumn("gain", F.col("links") - resolution * F.col("k") * rest / F.col("m2"))
    best = F.min(F.struct((-F.col("gain")).alias("loss"), "to")).alias("best")
    stays = F.max(F.when(F.col("to") == F.col("community"), F.col("gain"))).alias("stays")
    chosen = near.groupBy(*keys, "node", "community", "k", "m2").agg(best, stays)
    moves = chosen.withColumn("gain", -F.col("best.loss") - F.col("stays")).filter(F.col("gain") > LEAST_GAIN)
    moves = cut(moves.select(*keys, "node", "community", F.col("best.to").alias("to"), "k", "m2", "gain"))
    if moves.isEmpty():
        return of, 0
    both = _before(_before(moves, keys, "to", "_into"), keys, "community", "_out")
    kept = cut(both.filter(F.col("gain") - resolution * F.col("k") * (F.col("_into") + F.col("_out")) / F.col("m2") > LEAST_GAIN).select(*keys, "node", F.col("to").alias("_to")))
    n = kept.count()
    return cut(of.join(kept, [*keys, "node"], "left").withColumn("community", F.coalesce("_to", "community")).drop("_to")), n


def _by_colour(links: DataFrame, of: DataFrame, keys: list[str], sweeps: int, resolution: float) -> DataFrame:
    colour = cut(colours(links, keys))
    many = (colour.agg(F.max("colour")).first()[0] or 0) + 1
    for _ in range(sweeps):
        moved = 0
        for number in range(many):
            of, n = _moved(links, of, keys, colour, number, resolution)
            moved += n
        if not moved:
            break
    return of


def _one_by_one(part: pd.DataFrame, sweeps: int, resolution: float, levels: int, m2: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, and the community of each (a number), of a small graph, or of components of a graph whose links weigh ``m2``: each node in turn, in the order of ``part``, moves to the neighbouring community of greatest gain; then, for more levels, communities become nodes."""
    nodes, at = np.unique(part["node"].to_numpy(), return_inverse=True)
    other = np.searchsorted(nodes, part["other"].to_numpy())
    weight = part["w"].to_numpy(float)
    own = np.arange(len(nodes))
    m2 = weight.sum() if m2 is None else m2
    k = np.bincount(at, weight, len(nodes)).tolist()
    for _ in range(levels):
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(len(k) + 1)).tolist()
        others, weights = other[order].tolist(), weight[order].tolist()
        of, total = list(range(len(k))), list(k)
        # a fixed order that has nothing to do with the ids
        turns = np.random.default_rng(len(k)).permutation(len(k)).tolist()
        for _ in range(sweeps):
            moved = 0
            for i in turns:
                near: dict[int, float] = {}
                for j in range(bounds[i], bounds[i + 1]):
                    c = of[others[j]]
                    near[c] = near.get(c, 0.0) + weights[j]
                home, ki = of[i], k[i]
                total[home] -= ki
                stays = near.get(home, 0.0) - resolution * ki * total[home] / m2
                best, gain = home, stays + LEAST_GAIN
                for c, links in near.items():
                    g = links - resolution * ki * total[c] / m2
                    if g > gain or (g == gain and c < best):
                        best, gain = c, g
                total[best] += ki
                of[i] = best
                moved += best != home
            if not moved:
                break
        names, place = np.unique(of, return_inverse=True)
        own = place[own]
        if len(names) == len(k):
            break
        # contraction: a community is a node, its inner links are gone, its k is whole
        joined = place[at].astype(np.int64) * len(names) + place[other]
        pairs, of_pair = np.unique(joined, return_inverse=True)
        weight = np.bincount(of_pair, weight)
        at, other = pairs // len(names), pairs % len(names)
        weight, at, other = weight[at != other], at[at != other], other[at != other]
        k = np.bincount(place, k, len(names)).tolist()
    return nodes, own


def communities(edges: DataFrame, by: str, method: str = "louvain", sweeps: int = 10, resolution: float = 1.0, split: float = 0.3, levels: int = 1, small: int | None = None) -> DataFrame:
    """by, node, community: moves to the neighbouring community of greatest gain, for each document's graph. ``edges``: by, a < b, w.

    Graphs of up to ``small`` (``SMALL_GRAPH``) links are a task's each, their nodes move one by one. In larger ones so do those of a component of up to that many links, as no move looks beyond
    a component but for the graph's weight. In larger components a sweep goes by colours: nodes of one colour have no link, so they move together as if one by one. ``levels`` > 1: communities become nodes, and it goes on with them.
    ``leiden`` then takes out, from communities of more than two, nodes with less than ``split`` of their weight inside, and parts communities that hang together no more.
    Communities are numbered from the largest; equal ones by their least node.
    """
    small = SMALL_GRAPH if small is None else small
    links = cut(edges.select(by, F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(edges.select(by, F.col("b").alias("node"), F.col("a").alias("other"), "w")))
    sizes = cut(links.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.sum("w").alias("m2")))
    few = sizes.filter(F.col("_n") <= 2 * small)
    kinds = dict(links.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["node", "other"], ignore_index=True)
        nodes, own = _one_by_one(part, sweeps, resolution, levels, float(part["m2"].iloc[0]) if "m2" in part else None)
        first = np.full(own.max() + 1, len(nodes))
        np.minimum.at(first, own, np.arange(len(nodes)))
        return pd.DataFrame({by: part[by].iloc[0], "node": nodes, "community": nodes[first[own]]})

    made = f"{by} {kinds[by]}, node {kinds['node']}, community {kinds['node']}"
    of = links.join(few.select(by), by, "left_semi").groupBy(by).applyInPandas(run, made)
    graphs = sizes.filter(F.col("_n") > 2 * small)
    if not graphs.isEmpty():
        held = _with_components(links.join(graphs.select(by, "m2"), by), by)
        parts = cut(held.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n")))
        within = parts.filter(F.col("_n") <= 2 * small)
        # components, dealt into bins of about ``BIN`` links
        bins = within.groupBy(by).agg(F.ceil(F.sum("_n") / BIN).alias("_bins"))
        dealt = shuffled(held).join(within.select(by, "_part"), [by, "_part"]).join(bins, by).withColumn("_bin", F.pmod(F.xxhash64(F.lit(9), "_part"), F.col("_bins")))
        of = of.unionByName(dealt.select(by, "_bin", "node", "other", "w", "m2").groupBy(by, "_bin").applyInPandas(run, made))
        whole = parts.filter(F.col("_n") > 2 * small)
        if not whole.isEmpty():
            of = of.unionByName(_large(held.join(whole.select(by, "_part"), [by, "_part"]).select(by, "node", "other", "w"), graphs, by, sweeps, resolution, levels))
    of = cut(of)
    if method == "leiden":
        of = _refined(links, of, by, resolution, split)
    sizes = of.groupBy(by, "community").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    order = Window.partitionBy(by).orderBy(F.desc("size"), "first")
    named = sizes.select(by, "community", (F.row_number().over(order) - 1).cast("long").alias("number"))
    return of.join(named, [by, "community"]).select(by, "node", F.col("number").alias("community"))


def _with_components(links: DataFrame, by: str) -> DataFrame:
    """``links`` with _part, the component that they are of. Nodes go by names of 64 bits; two of one name would only join their components."""
    named = links.withColumn("_x", F.xxhash64(by, "node"))
    ends = links.filter("node < other").select(F.xxhash64(by, "node").alias("_x"), F.xxhash64(by, "other").alias("_y"))
    parts = connected_components(ends, "_x", "_y").select(F.col("node").alias("_x"), F.col("component").alias("_part"))
    return cut(shuffled(named).join(parts, "_x").drop("_x"))


def _large(links: DataFrame, graphs: DataFrame, by: str, sweeps: int, resolution: float, levels: int) -> DataFrame:
    """by, node, community of the graphs in ``graphs`` (by, m2), by colours and, for more levels, contraction."""
    held = cut(links.join(graphs.select(by), by, "left_semi"))
    now = held.groupBy(by, "node").agg(F.sum("w").alias("k")).join(graphs.select(by, "m2"), by)
    now = cut(now.select(by, "node", F.col("node").alias("community"), "k", "m2"))
    whole = None
    for level in range(levels):
        now = _by_colour(held, now, [by], sweeps, resolution)
        step = now.select(by, F.col("node").alias("_at"), F.col("community").alias("_to"))
        whole = now.select(by, "node", "community") if whole is None else cut(whole.join(step, [F.col("community") == F.col("_at"), whole[by] == step[by]]).select(whole[by], "node", F.col("_to").alias("community")))
        if level + 1 == levels:
            break
        place = lambda c, name: now.select(by, F.col("node").alias(c), F.col("community").alias(name))
        joined = held.join(place("node", "_x"), [by, "node"]).join(place("other", "_y"), [by, "other"]).filter("_x <> _y")
        held = cut(joined.groupBy(by, F.col("_x").alias("node"), F.col("_y").alias("other")).agg(F.sum("w").alias("w")))
        now = cut(now.groupBy(by, F.col("community").alias("node"), "m2").agg(F.sum("k").alias("k")).select(by, "node", F.col("node").alias("community"), "k", "m2"))
    return whole


def _refined(links: DataFrame, of: DataFrame, by: str, resolution: float, split: float) -> DataFrame:
    """Weakly held nodes stand alone; then each connected part of a community is one."""
    at = of.select(by, F.col("node").alias("other"), F.col("community").alias("_theirs"))
    held = links.join(at, [by, "other"]).join(of, [by, "node"])
    inside = held.groupBy(by, "node", "community").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("community") == F.col("_theirs"), F.col("w")).otherwise(0.0)).alias("inside"))
    sizes = of.groupBy(by, "community").agg(F.count(F.lit(1)).alias("size"))
    weak = (F.col("size") > 2) & (F.col("inside") < split * resolution * F.col("k"))
    kept = cut(inside.join(sizes, [by, "community"]).select(by, "node", "community", weak.alias("weak"), F.xxhash64(by, "node").alias("_name")))
    # nodes of all graphs together, by names of 64 bits
    end = lambda c, name: kept.filter("not weak").select(by, F.col("node").alias(c), F.col("community").alias(f"_of_{name}"), F.col("_name").alias(name))
    tied = links.filter("node < other").join(end("node", "_x"), [by, "node"]).join(end("other", "_y"), [by, "other"]).filter("_of__x = _of__y")
    parts = connected_components(tied, "_x", "_y").withColumnRenamed("node", "_name").withColumnRenamed("component", "_part")
    return cut(kept.join(parts, "_name", "left").select(by, "node", F.coalesce("_part", "_name").alias("community")))


def changes(old: DataFrame, new: DataFrame, key: str, hashed: str) -> DataFrame:
    """key, state: added, changed, removed or unchanged, by hash."""
    both = old.select(key, F.col(hashed).alias("_o")).join(new.select(key, F.col(hashed).alias("_n")), key, "full_outer")
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed")
    return both.select(key, state.alias("state"))


def article_refs(text: Column, own: Column | None = None) -> Column:
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(ARTICLE_REF), 0))
    return refs if own is None else F.array_remove(refs, own)
