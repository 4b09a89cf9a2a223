import collections
import zlib

from pyspark.sql import functions as F

from loomdoc.llm import sharding


def brute(spark, docs, n_shards, seed=sharding.SEED):
    """(doc_id, text_crc32) -> shard and slot, by plain sorting of the interleaved strata."""
    hashed = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).alias("h"))
    strata = collections.defaultdict(list)
    for r in hashed.collect():
        strata["null" if r["source"] is None else "is " + r["source"]].append((r["h"], r["doc_id"], zlib.crc32((r["text"] or "").encode())))
    names = spark.createDataFrame([(s,) for s in strata], "s string")
    offset = {r["s"]: r["u"] for r in names.select("s", (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "s"), 11) / F.lit(float(2**53))).alias("u")).collect()}
    rows = []
    for s, members in strata.items():
        for rank, (h, doc_id, crc) in enumerate(sorted(members, key=lambda x: (x[0], x[1] is not None, x[1] or 0)), 1):
            rows.append(((rank - offset[s]) / len(members), s, h, doc_id, crc))
    rows.sort(key=lambda r: r[:3])
    begin = [-(-k * len(rows) // n_shards) for k in range(n_shards + 1)]
    out = collections.Counter()
    for k in range(n_shards):
        for slot, r in enumerate(rows[begin[k] : begin[k + 1]]):
            out[r[3], r[4], k, slot] += 1
    return out


def test_order_equals_a_plain_sort(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_SLICES", 1)
    for slice_rows in (10, 50_000):
        got = collections.Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(docs, 7, slice_rows=slice_rows).collect())
        assert got == brute(spark, docs, 7) and sum(got.values()) == len(rows)


def test_shards_hold_the_mixture(docs, rows):
    got = sharding.shard(docs, 7, slice_rows=10).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 7
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    for source in ("a", "b", None):
        n = [sum(r["source"] == source for r in rs) for rs in by.values()]
        assert max(n) - min(n) <= 2
    again = {(r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.shard(docs.repartition(5), 7, slice_rows=10).collect()}
    assert again == {(r["doc_id"], r["text_crc32"], r["shard"]) for r in got}


def test_many_sources_of_one_row_are_spread(spark):
    docs = spark.range(800).selectExpr("id AS doc_id", "'x' AS text", "concat('s', if(id < 400, cast(id AS string), 'big')) AS source")
    got = sharding.shard(docs, 4).collect()
    small = [sum(r["shard"] == k and r["source"] != "sbig" for r in got) for k in range(4)]
    assert min(small) >= 70
