"""Communities by colours and one by one, the surest chains, and containment joins, against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import containment, graphs


def random_graph(seed, n=90, groups=6, hub=0, of=(1, 2)):
    rng = random.Random(seed)
    w = collections.Counter()
    for _ in range(4 * n):
        a = rng.randrange(n)
        b = a % groups + groups * rng.randrange(n // groups) if rng.random() < 0.8 else rng.randrange(n)
        if a != b:
            w[min(a, b), max(a, b)] += rng.choice([0.5, 1.0])
    if hub:
        w.update({(0, i): 0.1 for i in range(n, n + hub)})
    return [(g, a, b, float(x)) for g in of for (a, b), x in w.items()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, a long, b long, w double")


def modularity(rows, of, g=1):
    m = sum(w for h, _, _, w in rows if h == g)
    k, inside = collections.Counter(), 0.0
    for h, a, b, w in rows:
        if h == g:
            k[a] += w
            k[b] += w
            inside += w if of[a] == of[b] else 0.0
    total = collections.Counter()
    for n, x in k.items():
        total[of[n]] += x
    return inside / m - sum(x * x for x in total.values()) / (4 * m * m)


def found(df, g=1):
    return {r["node"]: r["community"] for r in df.collect() if r["g"] == g}


def test_no_move_of_a_colour_lowers_the_modularity(spark, monkeypatch):
    monkeypatch.setattr(graphs, "MOVES", 5)
    rows = random_graph(1, n=30, hub=12, of=(1,))
    seen = []

    def watched(links, of, keys, colour, number, resolution, real=graphs._moved):
        out, n = real(links, of, keys, colour, number, resolution)
        seen.append((modularity(rows, found(of)), modularity(rows, found(out)), n))
        return out, n

    monkeypatch.setattr(graphs, "_moved", watched)
    of = found(graphs.communities(frame(spark, rows), "g", sweeps=1, small=0))
    assert seen and all(after >= before - 1e-9 for before, after, _ in seen) and any(n > 1 for *_, n in seen)
    assert modularity(rows, of) > 0.1


def test_colours_are_independent_sets(spark):
    rows = random_graph(2, n=40)
    edges = frame(spark, rows)
    links = edges.selectExpr("g", "a node", "b other").unionByName(edges.selectExpr("g", "b node", "a other"))
    of = {(r["g"], r["node"]): r["colour"] for r in graphs.colours(links, ["g"]).collect()}
    assert set(of) == {(g, n) for g, a, b, _ in rows for n in (a, b)}
    assert all(of[g, a] != of[g, b] for g, a, b, _ in rows)


def test_both_forms_find_planted_groups(spark):
    rows = random_graph(3, n=36, of=(1,))
    planted = modularity(rows, {n: n % 6 for n in range(36)})
    one = modularity(rows, found(graphs.communities(frame(spark, rows), "g")))
    two = modularity(rows, found(graphs.communities(frame(spark, rows), "g", levels=3)))
    assert two >= one - 1e-9 and two > 0.85 * planted
    few = random_graph(3, n=12, groups=3, of=(1,))
    coloured = found(graphs.communities(frame(spark, few), "g", small=0, sweeps=1, levels=2))
    assert modularity(few, coloured) > modularity(few, {n: n for n in range(12)})


def test_leiden_communities_hang_together(spark):
    for seed in (4, 5):
        rows = random_graph(seed, n=120, groups=12)
        of = found(graphs.communities(frame(spark, rows), "g", method="leiden", levels=2))
        near = collections.defaultdict(set)
        for g, a, b, _ in rows:
            if g == 1 and of[a] == of[b]:
                near[a].add(b)
                near[b].add(a)
        members = collections.defaultdict(set)
        for n, c in of.items():
            members[c].add(n)
        for nodes in members.values():
            seen, front = set(), [next(iter(nodes))]
            while front:
                x = front.pop()
                if x not in seen:
                    seen.add(x)
                    front += near[x]
            assert seen == nodes
        assert sorted(members, key=lambda c: (-len(members[c]), min(members[c]))) == list(range(len(members)))


def test_surest_chains_are_those_of_all_chains(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(25), rng.randrange(25), rng.randrange(50, 100) / 100) for _ in range(110)] + [(100, 101, 0.9), (101, 102, 0.5)]
    edges = spark.createDataFrame(rows, "a long, b long, confidence double")
    for starts, k, hops in (([0, 1, 2], 15, 4), ([100], 5, 4), ([7], 400, 3), ([999], 3, 3)):
        begin = spark.createDataFrame([(s,) for s in starts], "start long")
        want = graphs.best_chains(graphs.chains(edges, begin, hops=hops), k).collect()
        got = graphs.surest_chains(edges, begin, k, hops=hops).collect()
        assert [(r["path"], r["depth"], round(r["confidence"], 9)) for r in got] == [(r["path"], r["depth"], round(r["confidence"], 9)) for r in want]


@pytest.mark.parametrize("most", [None, 0])
def test_containment_equals_brute_force(spark, most):
    rng = random.Random(6)
    letters = "abcd 가나"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(30)))) for i in range(80)] + [(90, None), (91, ""), (90, "abc")]
    patterns = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 3, 4, 5]))) for _ in range(40)] + ["", None, "ab", "ab", "zzzz"]
    t, p = spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame([(x,) for x in patterns], "name string")
    want = sorted((i, x) for i, body in texts for x in {x for x in patterns if x} if body and x in body)
    assert sorted((r["id"], r["name"]) for r in containment.contained(t, "id", "body", p, "name", most).collect()) == want
    rest = containment.without(t.filter("body is not null"), "body", p.filter("length(name) > 2"), "name", most)
    assert sorted(r["id"] for r in rest.collect()) == sorted(i for i, body in texts if body is not None and not any(x in body for x in patterns if x and len(x) > 2))
    none = p.filter("name = 'no'")
    assert containment.contained(t, "id", "body", none, "name", most).collect() == [] and containment.without(t, "body", none, "name", most).count() == 83


def test_small_components_of_a_large_graph_move_one_by_one(spark, monkeypatch):
    """A large graph of small components needs no sweeps by colour, whose many plans filled the driver."""
    monkeypatch.setattr(graphs, "_by_colour", lambda *a: pytest.fail("a component of few links went by colours"))
    monkeypatch.setattr(graphs, "BIN", 40)
    rows = [(g, 10 * c + i, 10 * c + j, 1.0 + (i * j) % 3) for g in "xy" for c in range(30) for i in range(8) for j in range(i + 1, 8) if (i < 4) == (j < 4) or (i, j) == (3, 4)]
    edges = spark.createDataFrame(rows, "g string, a long, b long, w double")
    of = {(r["g"], r["node"]): r["community"] for r in graphs.communities(edges, "g", small=30).collect()}
    whole = {(r["g"], r["node"]): r["community"] for r in graphs.communities(edges, "g").collect()}
    # two halves of each component, held together by one link
    assert of == whole and len(set(of.values())) == 60 and len(of) == 480
