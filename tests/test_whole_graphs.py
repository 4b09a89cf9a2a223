"""The graph queries against brute force over every order."""

import collections

import pytest

from loomdoc.plans import registry

DATA = "/root/testdata/sf0.001"
STARTS = [0, 11, 22, 33, 44]


@pytest.fixture(scope="module")
def edges(spark):
    rows = spark.read.parquet(f"{DATA}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    return {(r[0], r[0] * 7 + r[1]) for r in rows}


@pytest.fixture(scope="module")
def near(edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def depths(near, start, hops):
    seen, front = {start: 0}, [start]
    for d in range(1, hops + 1):
        front = [y for x in front for y in near.get(x, ()) if y not in seen and not seen.update({y: d})]
    return seen


def test_bfs(spark, near):
    got = {tuple(r) for r in registry.QUERIES["graph_bfs"](spark, DATA).select("start", "node", "depth").collect()}
    assert got == {(s, n, d) for s in STARTS for n, d in depths(near, s, 3).items()}
    assert len(got) > len(STARTS)


def test_components(spark, near):
    got = {r["node"]: r["component"] for r in registry.QUERIES["graph_components"](spark, DATA).collect()}
    want = {}
    for n in sorted(near):
        if n not in want:
            want.update(dict.fromkeys(depths(near, n, len(near)), n))
    assert got == want


def test_chains(spark, edges):
    ahead = collections.defaultdict(list)
    for a, b in edges:
        ahead[a].append(b)
    want, front = [], [((s,), 1.0) for s in STARTS]
    for _ in range(3):
        front = [((*p, b), c * (0.5 + b % 5 / 10)) for p, c in front for b in ahead[p[-1]] if b not in p]
        want += [(">".join(map(str, p)), round(c, 4), len(p) - 1) for p, c in front]
    got = [(r["path"], round(r["confidence"], 4), r["depth"]) for r in registry.QUERIES["graph_chains"](spark, DATA).collect()]
    assert sorted(got) == sorted(want) and got


def test_degrees_count_every_order(spark, edges):
    got = registry.QUERIES["graph_degrees"](spark, DATA).agg({"degree": "sum"}).first()[0]
    assert got == 2 * len(edges)
