import random

import pytest

from llm_helpers import SCHEMA, sets_of
from loomdoc.llm import jaccard_join, signature_tree


@pytest.mark.parametrize(("width", "num", "block", "bits"), [(4, 85, 512, 63), (4, 85, 4, 3), (5, 80, 6, 63)])
def test_jaccard_join(spark, rows, width, num, block, bits, monkeypatch):
    """Also where many sets share a name, as with 3 bits."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    base = [("k%d " % i) for i in range(200)]
    rng = random.Random(num + block)
    near = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(200)] = "z%d " % rng.randrange(5)
        near.append((1_000 + i, "".join(w), "en", "a", 1, 1, 1, "", ""))
    rows = [r for r in rows if r[0] is not None] + near
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(spark.createDataFrame(rows, SCHEMA), width, num, 100, bits).collect()}
    sets = {r[0]: sets_of(r[1], width) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_signature_tree_finds_all_classes():
    import numpy as np

    rng = np.random.default_rng(4)
    for bits in (1 << 15, 64):
        signature_tree.MOST_BITS = bits
        base = [rng.integers(0, 10_000, 120) for _ in range(6)]
        sets = []
        for k in range(70):
            s = np.concatenate([base[k % 6][: 120 - k // 6], rng.integers(20_000, 90_000, k // 6)])
            sets.append(np.unique(s))
        tree = signature_tree.SignatureTree(sets)
        root = list(range(70))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        want = list(range(70))

        def find_want(x, want=want):
            while want[x] != x:
                x = want[x]
            return x

        for a, b in tree.links(np.arange(70), 85, 100):
            x, y = sets[a], sets[b]
            assert 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
            root[max(find(a), find(b))] = min(find(a), find(b))
        for i in range(70):
            for j in range(i):
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
                    want[max(find_want(i), find_want(j))] = min(find_want(i), find_want(j))
        assert [find(i) for i in range(70)] == [find_want(i) for i in range(70)]
    signature_tree.MOST_BITS = 1 << 15
