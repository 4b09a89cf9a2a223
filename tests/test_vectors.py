"""The approximate index and the banded join, against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdoc.operators import search, similarity, vectorindex

DATA = "/root/testdata/sf0.1"


def pairs(df, id_="vec_id"):
    return {(r["query_id"], r[id_]) for r in df.collect()}


@pytest.fixture(scope="module")
def given(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    return vectors, vectors.filter("vec_id % 100 = 0"), vectorindex.build(vectors, "vec_id")


def test_recall_on_the_given_vectors(given):
    vectors, queries, index = given
    exact = pairs(search.knn(queries, vectors, 3, id_="vec_id"))
    got = index.search(queries, 3, probes=32, rerank=60, counted=True).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in got} & exact) >= 0.9 * len(exact)
    scored = {r["query_id"]: r["scored"] for r in got}
    assert sum(scored.values()) < 0.15 * len(scored) * vectors.count()
    assert index.quantizer.cells > 40  # grows with the rows


def test_exact_search_of_all_cells(given):
    vectors, queries, index = given
    want = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["similarity"], 9)) for r in search.knn(queries, vectors, 3, id_="vec_id").collect())
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["similarity"], 9)) for r in index.search(queries, 3, exact=True).collect()) == want


def test_small_blocks_find_the_same(given, monkeypatch):
    _, queries, index = given
    want = pairs(index.search(queries, 4, probes=20, rerank=30))
    monkeypatch.setattr(vectorindex, "ROW_BLOCK", 7)
    monkeypatch.setattr(vectorindex, "QUERY_BLOCK", 2)
    assert pairs(index.search(queries, 4, probes=20, rerank=30)) == want


def test_write_read_and_append(spark, given, tmp_path):
    vectors, queries, _ = given
    index = vectorindex.build(vectors.filter("vec_id % 3 <> 0"), "vec_id")
    index.write(str(tmp_path / "index"))
    back = vectorindex.VectorIndex.read(spark, str(tmp_path / "index"), "vec_id")
    assert pairs(back.search(queries, 3, 30)) == pairs(index.search(queries, 3, 30))
    whole = back.append(vectors.filter("vec_id % 3 = 0"))
    exact = pairs(search.knn(queries, vectors, 3, id_="vec_id"))
    assert len(pairs(whole.search(queries, 3, 36)) & exact) >= 0.9 * len(exact)


def test_probes_reach_the_wanted_share(given):
    vectors, queries, index = given
    probes = vectorindex.probes_for(index, queries, 3, 0.9)
    assert 1 <= probes <= index.quantizer.cells
    exact = pairs(index.search(queries, 3))
    assert len(pairs(index.search(queries, 3, probes)) & exact) >= 0.9 * len(exact)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), *[(k, [0.0, 1.0, 0.0]) for k in range(4, 40)]]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = vectorindex.build(vectors).search(vectors.filter("id in (1, 3, 4)"), 2).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got if r["query_id"] == 4) == [(4, 1, 5), (4, 2, 6)]
    assert {r["query_id"] for r in got} == {1, 4}
    none = vectors.filter("id < 0")
    assert vectorindex.build(none).search(none, 2).collect() == []


def test_multi_index_finds_the_nearest_cells():
    rng = np.random.default_rng(2)
    q = vectorindex.Quantizer([rng.normal(size=(9, 3)), rng.normal(size=(7, 4))], [])
    m = rng.normal(size=(20, 7))
    centroids = q._centroids(np.arange(63))
    want = np.argsort(((m[:, None] - centroids) ** 2).sum(axis=2), axis=1)
    for probes in (1, 5, 20, 63):
        assert (np.sort(q.nearest(m, probes), axis=1) == np.sort(want[:, :probes], axis=1)).all()


def test_bands_find_the_neighbours_of_the_given_vectors(spark, given):
    vectors = given[0]
    want = pairs(search.knn(vectors, vectors, 3, id_="vec_id", least=0.4, apart="label"))
    got = similarity.neighbours(vectors, 3, "vec_id", least=0.4, apart="label")
    assert len(pairs(got) & want) >= 0.9 * len(want) > 100
    bands, signs = similarity.plan(10**9, 0.85)
    assert bands <= similarity.MOST_BANDS and bands * 10**9 / 2**signs < 10**5  # candidates of a row at scale


@pytest.mark.parametrize("block", [2_048, 60])
def test_copies_and_near_copies_lose_no_neighbour(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    rows = [(k, int(rng.integers(0, 9)), (base[k % 12] + (0 if k % 5 else 0.04) * rng.normal(size=16)).tolist()) for k in range(400)]
    rows += [(1_000 + k, k % 3, base[0].tolist()) for k in range(600)] + [(5_000, 1, None), (5_001, 1, [0.0] * 16), (5_002, None, base[1].tolist())]
    vectors = spark.createDataFrame(rows, "id long, doc int, embedding array<double>").repartition(6)
    m = np.array([r[2] if r[2] else [0.0] * 16 for r in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    s = (m / np.where(norm > 0, norm, 1)) @ (m / np.where(norm > 0, norm, 1)).T
    for apart in (None, "doc"):
        want = []
        for i, (a, doc, v) in enumerate(rows):
            near = sorted((-round(s[i, j], 9), b) for j, (b, other, w) in enumerate(rows) if b != a and v and w and any(v) and any(w) and s[i, j] >= 0.9 and (apart is None or other != doc))
            want += [(a, n + 1, b) for n, (_, b) in enumerate(near[:3])]
        got = similarity.neighbours(vectors, 3, least=0.9, apart=apart, recall=0.999_999).withColumn("similarity", F.round("similarity", 9))
        # among rows of one similarity up to rounding the order is free
        assert len(got.collect()) == len(want)
        found = {(r["query_id"], r["rank"]): r["similarity"] for r in got.collect()}
        at = {r[0]: i for i, r in enumerate(rows)}
        assert all(abs(found[a, n] - s[at[a], at[b]]) < 1e-6 for a, n, b in want)


def test_a_sample_is_not_handed_over_by_every_task(spark):
    """The rows of least hash, of which the tasks together hand on few more; equal ids, whose hashes aren't even, too."""
    rows = spark.range(20_000).select("id", F.array(F.sin("id"), F.cos("id")).alias("embedding")).repartition(8)
    by = F.xxhash64(F.lit(5), "id")
    want = [r["id"] for r in rows.orderBy(by, "id").limit(500).collect()]
    got = vectorindex._least(rows, "id", 20_000, 500)
    assert [r["id"] for r in got.collect()] == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Filter") == 1
    assert rows.filter(by <= F.lit(int((500 + 8 * 500**0.5 + 8) / 20_000 * 2**64) - 2**63)).count() < 900
    same = rows.withColumn("id", F.lit(7).cast("long"))
    assert vectorindex.build(same, sample_rows=500).rows.count() == 20_000
