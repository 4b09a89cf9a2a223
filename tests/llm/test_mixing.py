import collections
import math
import random
import time
import zlib

import xxhash
from pyspark.sql import functions as F

from llm_helpers import words
from loomdoc.llm import mixing


def test_mixing_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60))), rng.choice("abcccc")) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 3_000 and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {s: [r for r in got if r["source"] == s] for s in "abc"}
    assert abs(sum(rs[0]["target"] for rs in by.values()) - total) < 1e-6 * total
    for rs in by.values():
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 60
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_mixing_targets_fill_water(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1_000), ("c", 1_000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0
    assert abs(got["b"] - (2_010 - 30) * 2 / 3) < 1e-6 and abs(got["c"] - (2_010 - 30) / 3) < 1e-6


def test_mixing_takes_odd_rows(docs, rows):
    assert mixing.mix(docs, fan_in=3).count() == len(rows)


def hashed(*values):
    """Spark's xxhash64 of ints (as int), (int,) tuples (as long) and None, unsigned."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest((v[0] & (2**64 - 1)).to_bytes(8, "little") if isinstance(v, tuple) else v.to_bytes(4, "little"), h)
    return h


def long(x):
    return None if x is None else (x,)


def plain_mix(rows, target, fan_in, seed=mixing.SEED):
    """(doc_id, size) -> copies, in order, by folding lists; rows: doc_id, text, source. ``target``: copies that a row of a source wants."""
    groups, out, copies = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for d, t, s in rows:
        copy = copies[d, t or "", s]
        copies[d, t or "", s] += 1
        size = len(words(t))
        h = hashed(seed, long(d), (zlib.crc32((t or "").encode()),), (copy,))
        h = h - 2**64 if h >= 2**63 else h
        want = target[s]
        groups[s, math.floor(math.log2(max(size, 1)) * mixing.PER_OCTAVE)].append((-size, h, d, size, want - math.floor(want)))
    nulls_first = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4])
    unit = lambda *v: (hashed(*v) >> 11) / 2**53

    def settle(s, r, q):
        out[s, r[2], r[3], math.floor(target[s]) + int(q)] += 1

    def fold(s, block, depth):
        carry = None
        for r in sorted(block, key=nulls_first):
            if carry is None:
                carry = r
                continue
            u, p, q = unit(seed, depth, (carry[1],), long(carry[2]), (r[1],), long(r[2])), carry[4], r[4]
            if p + q < 1:
                winner, loser = (carry, r) if u * (p + q) < p else (r, carry)
                settle(s, loser, 0)
                carry = (*winner[:4], p + q)
            else:
                winner, loser = (carry, r) if u * (2 - p - q) < 1 - q else (r, carry)
                settle(s, winner, 1)
                carry = (*loser[:4], p + q - 1)
        if carry is None or 0 < carry[4] < 1:
            return [carry] if carry else []
        settle(s, carry, carry[4])
        return []

    blocks = {k: -(-len(v) // fan_in) for k, v in groups.items()}
    most, depth = max(blocks.values()), 0
    now = collections.defaultdict(list)
    for (s, o), members in groups.items():
        for r in members:
            now[s, o, r[1] % blocks[s, o]].append(r)
    while True:
        ahead = collections.defaultdict(list)
        for key, block in now.items():
            for r in fold(key[0], block, depth):
                ahead[key].append(r)
        if len(next(iter(now))) == 1:
            break
        depth += 1
        now = collections.defaultdict(list)
        for key, rest in ahead.items():
            now[(*key[:2], key[2] // fan_in) if most > 1 else key[:1]] += rest
        if not now:
            break
        most = -(-most // fan_in) if most > 1 else 0
    for (s,), rest in ahead.items():
        for r in rest:
            settle(s, r, unit(seed, depth + 1, (r[1],), long(r[2])) < r[4])
    return out


def test_rounding_equals_plain_folding(spark):
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(900)]), " ".join("w" * rng.randrange(1, 40)), rng.choice(["a", "b", "b", "b", None])) for _ in range(700)]
    rows += [rows[5]] * 40 + [(1, None, "a"), (2, "", None), (3, "w " * 30_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (0, mixing.BROADCAST_KEYS):
        mixing.BROADCAST_KEYS, before = limit, mixing.BROADCAST_KEYS
        try:
            got = mixing.mix(docs, fan_in=5).collect()
        finally:
            mixing.BROADCAST_KEYS = before
        target = {r["source"]: r["target"] / r["source_size"] for r in got}
        assert collections.Counter((r["source"], r["doc_id"], r["size"], r["copies"]) for r in got) == plain_mix(rows, target, 5)


def test_kept_columns_come_through(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5, "q"), (1, "a b", "x", 6, None)], "doc_id long, text string, source string, n int, octave string")
    assert sorted((r["doc_id"], r["n"]) for r in mixing.mix(docs, keep=["n"]).collect()) == [(1, 5), (1, 6)]


def test_many_repeated_rows_are_linear(spark):
    base = spark.createDataFrame([(None, "", "a"), (1, "one two three", "a"), (2, "four five", "b")], "doc_id long, text string, source string")
    repeats = base.withColumn("n", F.expr("explode(sequence(1, case when doc_id is null then 120000 when doc_id = 1 then 80000 else 30 end))")).drop("n")
    singles = spark.range(10, 2_010).selectExpr("id as doc_id", "repeat('w ', cast(id % 40 as int)) as text", "'b' as source")
    docs = repeats.unionByName(singles).repartition(6)
    began = time.monotonic()
    got = mixing.mix(docs)
    sums = {r["source"]: r for r in got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()}
    assert time.monotonic() - began < 120
    assert sums["a"]["n"] == 200_000 and sums["b"]["n"] == 2_030
    assert all(abs(r["taken"] - r["target"]) <= 45 and r["most"] <= 3 for r in sums.values())
    of = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "copies").count().collect() if r["doc_id"] is not None)
    assert of(got) == of(mixing.mix(docs.repartition(3)))


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 3_000)
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 7 as int)) as text", "concat('host', id % 10000) as source")
    got = mixing.targets(docs.groupBy("source").agg(F.sum(F.expr("1 + doc_id % 7")).alias("source_size"))).collect()
    assert [r["s"] for r in sorted(got, key=lambda r: r["source"])] == list(range(1, 10_001))
    total = sum(r["source_size"] for r in got)
    assert abs(sum(r["target"] for r in got) - total) < 1e-6 * total
    free = [r["target"] / (5, 2, 1)[(r["s"] - 1) % 3] for r in got if r["target"] < 3 * r["source_size"] - 1e-9]
    assert max(free) - min(free) < 1e-9 * max(free)
    assert all(3 * r["source_size"] <= max(free) * (5, 2, 1)[(r["s"] - 1) % 3] + 1e-6 for r in got if r["target"] >= 3 * r["source_size"] - 1e-9)
