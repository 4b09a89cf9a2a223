"""Small operators worked out by hand: writers, deletion marks, aligned limits, trigram likeness, first of equal hits, addresses."""

import datetime

from pyspark.sql import functions as F

from loomdoc.functions import text
from loomdoc.operators import mutations, search
from loomdoc.operators import relational
from loomdoc.sources import sinks
from loomdoc.streaming import limits


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_append_and_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "d string, n int")
    sinks.append(rows(("a", 1), ("b", 2)), path, ["d"])
    sinks.append(rows(("a", 3)), path, ["d"])
    assert values(spark.read.parquet(path), "d", "n") == [("a", 1), ("a", 3), ("b", 2)]
    mutations.replace_partition(spark, rows(("a", 9)), path, "d")
    assert values(spark.read.parquet(path), "d", "n") == [("a", 9), ("b", 2)]


def test_export_has_a_header_and_a_total(spark, tmp_path):
    sinks.export_csv(spark.createDataFrame([("x", 1.5), ("y", 2.0)], "name string, cost double"), str(tmp_path / "out"), "name")
    got = spark.read.csv(str(tmp_path / "out"), header=True)
    assert values(got, "name", F.col("cost").cast("double")) == [("TOTAL", 3.5), ("x", 1.5), ("y", 2.0)]


def test_deletion_marks(spark):
    at = datetime.datetime(2024, 1, 2)
    df = spark.createDataFrame([(1, None), (2, at), (3, None)], "id int, deleted_at timestamp")
    later = F.lit("2024-05-05").cast("timestamp")
    gone = mutations.soft_delete(df, F.col("id") < 3, later)
    assert {r["id"]: str(r["deleted_at"])[:10] for r in gone.collect()} == {1: "2024-05-05", 2: "2024-01-02", 3: "None"}
    assert {r["id"] for r in mutations.restore(gone, F.col("id") == 2).collect() if r["deleted_at"] is None} == {2, 3}


def test_aligned_limit(spark):
    rows = [("k", datetime.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 10, 59)] + [("k", datetime.datetime(2024, 1, 1, 0, 1, 0))]
    got = limits.aligned(spark.createDataFrame(rows, "key string, at timestamp"), "key", "at", 60, 2)
    assert values(got, "count", "blocked") == [(1, 0), (3, 1)]


def test_likeness_first_hit_and_addresses(spark):
    df = spark.createDataFrame([(1, "abcd", "bcde", "a@b.co"), (2, "", "", "a b@c.d"), (3, "ABC", "abc", "x@y")], "id int, a string, b string, mail string")
    got = {r["id"]: r for r in df.select("id", search.jaccard3(F.col("a"), F.col("b")).alias("j"), text.valid_email(F.col("mail")).alias("ok")).collect()}
    assert [round(got[i]["j"], 6) for i in (1, 2, 3)] == [round(1 / 3, 6), 0.0, 1.0] and [got[i]["ok"] for i in (1, 2, 3)] == [True, False, False]
    hits = spark.createDataFrame([(1, "x", 0.5), (2, "X", 0.9), (3, "y", 0.1)], "id int, t string, score double")
    assert values(search.dedupe_first(hits, F.lower("t"), [F.desc("score")]), "id") == [(2,), (3,)]


def test_seeded_places_samples_and_names(spark):
    rows = spark.range(2_000).withColumn("g", F.col("id") % 3)
    one, two = (values(relational.shuffled(rows.repartition(n), "id", ["g"], 5), "g", "place", "id") for n in (2, 7))
    assert one == two and [r[1] for r in one if r[0] == 1] == list(range(667)) and [r[2] for r in one if r[0] == 1] != sorted(r[2] for r in one if r[0] == 1)
    some = relational.sampled(rows, "id", 0.25, 1)
    assert 400 < some.count() < 600 and values(some, "id") == values(relational.sampled(rows.repartition(5), "id", 0.25, 1), "id")
    named = relational.with_uuid(rows)
    assert named.select("uuid").distinct().count() == 2_000
