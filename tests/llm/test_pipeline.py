import collections
import random

from llm_helpers import corpus, sets_of
from loomdoc.llm import jaccard_join


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rows = corpus(50, 3)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    leak = next(r[1] for r in rows if r[1] and len(r[1].split()) == 120)
    spark.createDataFrame([(1, " ".join(leak.split()[:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for k, (name, stage) in enumerate(p.STAGES):
        out = str(tmp_path / f"stage{k}")
        stage(spark, at, str(tmp_path)).write.parquet(out)
        before, at = at, spark.read.parquet(out)
        if k < len(p.STAGES) - 1:
            assert at.columns == docs.columns
        if name == "near copies":
            texts = [r["text"] for r in at.collect() if r["doc_id"] is not None and r["text"]]
            sets = [sets_of(t, 5) for t in dict.fromkeys(texts)]
            assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
        if name == "benchmark decontamination":
            gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in at.collect()}
            assert all(" ".join(leak.split()[5:25]) in next(r[1] for r in rows if r[0] == d) for d in gone)
    assert at.count() == before.count() and "shard" in at.columns
    assert p.run(spark, str(tmp_path)).count() == at.count()


def test_one_row_of_each_group_of_near_copies_stays(spark):
    import corpus_pipeline as p

    rng = random.Random(4)
    text = lambda k=80: " ".join("w%d" % rng.randrange(5000) for _ in range(k))
    hot, alone, twin, chain = text(), text(), text(), text().split()
    near = " ".join([*hot.split()[:-1], "edited"])
    bridge, far = " ".join([*chain[6:], *["x%d" % i for i in range(6)]]), " ".join([*chain[12:], *["x%d" % i for i in range(12)]])
    rows = [(7, hot, "en")] * 20 + [(7, hot, "de")] * 3  # repeated rows of one doc_id
    rows += [(3, alone, "en"), (9, near, "en"), (9, text(), "en")]  # a doc_id with a near copy and a clean text
    rows += [(None, twin, "en")] * 4 + [(None, twin.upper(), "en")]  # copies without a doc_id
    rows += [(20, " ".join(chain), "en"), (None, bridge, "en"), (21, far, "en")]  # linked through a row without a doc_id only
    rows += [(None, None, "en"), (None, "", "en"), (30, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = [tuple(r) for r in p.drop_near_copies(spark, docs, "").collect()]
    link = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    sets = [sets_of(r[1], 5) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and link(a, sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    assert not link(sets[rows.index((20, " ".join(chain), "en"))], sets_of(far, 5)) and len(groups) == 8
    assert len(kept) == len(groups)
    for group in groups.values():
        here = [r for r in kept if r in group]
        best = min((r[0] is None, r[0] or 0) for r in group)
        assert group[0][1] in (None, "") or len(here) == 1 and (here[0][0] is None, here[0][0] or 0) == best
    linked = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(docs, 5, 80, 100).collect() if r["doc_id"] in (20, 21)}
    assert linked == {20: 20, 21: 20}


def test_equal_rows_share_their_copies(spark, monkeypatch):
    import corpus_pipeline as p
    from loomdoc.llm import mixing

    monkeypatch.setattr(p, "RUN", 3)
    rows = [(1, "a b c", "en", "x", 5)] * 9 + [(1, "a b c", "de", "x", 5), (1, "other text", "en", "x", 5), (None, "d e", "en", "y", 1), (None, "d e", "fr", "y", 1), (None, None, None, None, None)]
    rows += [(i, "w " * (i % 9 + 1), "en", "z", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _t long").repartition(3)
    got = p.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    count = collections.Counter(tuple(r) for r in got.collect())
    assert set(count) <= set(rows)
    want = collections.Counter()
    for r in mixing.mix(docs, keep=["lang"]).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    by = collections.Counter()
    for r, n in count.items():
        by[r[0], r[3], len((r[1] or "").split())] += n
    assert by == +want and count[rows[0]] > 3
    assert collections.Counter(tuple(r) for r in p.mix_sources(spark, docs.repartition(5), "").collect()) == count


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as p

    names = "_t long, _u int, _score double, _row string, node long, n long, item_id long, s int, block long, size string"
    rows = [(i, f"some words of text number {i} and more of them " * 3, "en", "ab"[i % 2], 9, 1, 2, 0.5, "r", 4, 5, 6, 7, 8, "s") for i in range(30)]
    rows += [rows[3], (None, None, None, None, None, *[None] * 10), (31, "", "en", "a", 0, *[None] * 10)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= set(rows), name
