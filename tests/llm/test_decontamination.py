import collections
import math
import random

import pytest
import xxhash

from llm_helpers import words
from loomdoc.llm import decontamination


def low(t):
    return words((t or "").lower().translate(str.maketrans("", "", decontamination.PUNCTUATION)))


def shingles(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def simhash(weights):
    bits = [0] * 64
    for gram, weight in weights.items():
        h = 42
        for word in gram:
            h = xxhash.xxh64_intdigest(word.encode(), h)
        for b in range(64):
            bits[b] += weight if h >> b & 1 else -weight
    return sum(1 << b for b in range(64) if bits[b] > 0)


def brute(docs, items, radius=decontamination.RADIUS):
    """{(doc_id, item_id): {(at, similarity, distance)}} of the best windows within the radius, and the pairs beyond it."""
    n, df, sets = 0, collections.Counter(), {}
    for i, t in items:
        w = low(t)
        if i is not None and len(w) >= 5:
            n += 1
            sets[i] = (len(w), set(shingles(w)))
            df.update(sets[i][1])
    weight = lambda g: round(1000 * math.log(1 + n / df[g]) if g in df else 1000 * math.log(1 + n))
    best, beyond = {}, set()
    for d, t in docs:
        w = low(t)
        for i, (length, s) in sets.items():
            own = simhash({g: weight(g) for g in s})
            for a in range(max(1, len(w) - length + 1)):
                x = set(shingles(w[a : a + length]))
                if not x & s:
                    continue
                similarity = sum(map(weight, x & s)) / sum(map(weight, x | s))
                if similarity >= decontamination.SIMILARITY:
                    distance = (simhash({g: weight(g) for g in x}) ^ own).bit_count()
                    if distance <= radius:
                        best.setdefault((d, i), set()).add((a, round(similarity, 9), distance))
                    else:
                        beyond.add((d, i))
    return {k: {x for x in found if x[1] == max(y[1] for y in found)} for k, found in best.items()}, beyond - set(best)


@pytest.fixture(scope="module")
def bench(rows):
    rng = random.Random(6)
    items = [(i, " ".join("b%d" % rng.randrange(400) for _ in range(rng.choice([3, 15, 40])))) for i in range(12)] + [(None, "b1 b2 b3 b4 b5 b6"), (99, None)]
    items += [(50, items[1][1] + " " + items[4][1])]  # shares shingles with others
    docs = [(r[0], r[1]) for r in rows if r[0] is not None and r[0] < 60]
    for k, (i, t) in enumerate(items[:12]):
        w = t.split()
        if k % 3 == 0:
            w[-1] = "changed"
        docs[k] = (docs[k][0], (docs[k][1] or "") + " " + " ".join(w).upper() + ". " + "tail " * (k % 4))
    docs += [(None, "x " + items[4][1]), (None, items[4][1]), (12, "long " * 30_000 + items[4][1] + " end" * 20_000), (12, "another text"), (13, None), (14, "")]
    docs += [docs[1], docs[1]]
    return items, docs


def frames(spark, items, docs):
    more = ("lang string", "w long", "_t long", "item_id string", "at long", "_row string")
    docs = spark.createDataFrame([(*r, "x", 1, 2, "i", 3, "r") for r in docs], "doc_id long, text string, " + ", ".join(more))
    return docs, spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, length long")


def test_windows_equal_brute_force(spark, bench):
    items, docs = bench
    want, beyond = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]): (r["at"], round(r["similarity"], 9), r["distance"]) for r in decontamination.contaminated(*frames(spark, items, docs)).collect()}
    assert set(got) == set(want) and len(want) > 8 and len(beyond) <= len(want) // 10
    assert all(got[k] in want[k] for k in got)


def test_clean_keeps_all_columns_and_other_rows(spark, bench):
    items, docs = bench
    want = {d for d, _ in brute(docs, items)[0]}
    frame, benchmark = frames(spark, items, docs)
    out = decontamination.clean(frame, benchmark)
    assert out.columns == frame.columns
    leaky = {(d, t) for d, t in docs if any((d, t) == x for x in docs) and brute([(d, t)], items)[0]}
    assert {d for d, _ in leaky} == want
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted((x for x in docs if x not in leaky), key=str)


def test_the_hamming_index_finds_nine_of_ten_edited_passages(spark):
    rng = random.Random(11)
    items = [(i, " ".join("v%d" % rng.randrange(3_000) for _ in range(rng.choice([30, 60, 90])))) for i in range(60)]
    docs = []
    for i, t in items:
        w = t.split()
        for k in range(len(w) // 60 + 1):
            w[rng.choice([0, 1, len(w) - 1, len(w) - 2, len(w) // 2 if len(w) >= 90 else 0])] = "edit%d" % k
        docs.append((i, "some words before it " * 3 + " ".join(w) + " and some after it" * 2))
    within, beyond = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(*frames(spark, items, docs)).collect()}
    assert got == set(within) and len(within) >= 0.9 * len(set(within) | beyond) and len(within) >= 40
