"""Streams give in many micro-batches what the batch form gives."""

import time

from pyspark.sql import functions as F

from loomdoc.operators import knowledge, mutations
from loomdoc.streaming import jobs, limits


def test_windowed_usage_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(4).write.parquet(src)
    stream = jobs.daily_usage(jobs.file_stream(spark, src, events), "ts", ["event_type"], late="60 days")
    q = stream.writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r["day"]["start"])[:10], r["event_type"]): r["n"] for r in spark.table("usage").collect()}
    want = {(str(r["d"]), r["event_type"]): r["n"] for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_stateful_limit_over_batches(spark, tmp_path):
    """Batches fold on; a row that is later than the watermark is dropped, and an idle key's state goes."""
    rows = [[("k", 5_000), ("k", 5_010), ("j", 5_005)], [("k", 5_059), ("k", 5_060), ("j", 90_000)], [("k", 5_061), ("j", 90_001)], [("k", 100_000), ("m", 5_062)]]
    src = str(tmp_path / "in")
    for part in rows:
        frame = spark.createDataFrame(part, "key string, s long").withColumn("at", F.timestamp_seconds("s"))
        frame.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in order of their times
    rows = frame
    stream = limits.stream(jobs.file_stream(spark, src, rows).withWatermark("at", "1 hour"), "key", "at", 60, 2)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["window_start"], r["count"], r["blocked"]) for r in spark.table("limited").filter("key = 'k'").collect())
    assert got == [(5_000, 2, 0), (5_060, 1, 1), (5_060, 2, 0), (100_000, 1, 0)]
    assert spark.table("limited").filter("key = 'm'").count() == 0  # the watermark was at 86400 before this batch


def test_dedupe_within_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-01"), (2, "2024-01-02")], "url long, day string").withColumn("at", F.to_timestamp("day"))
    src = str(tmp_path / "in")
    rows.write.parquet(src)
    seen = []
    q = jobs.for_each_batch(jobs.dedupe(jobs.file_stream(spark, src, rows, 10), ["url"], "at", "2 days"), lambda df, n: seen.extend(r["url"] for r in df.collect()), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted(seen) == [1, 2]


def _files(spark, tmp_path, parts, schema):
    """A folder of one file for each part, in order, and a frame of its schema."""
    src = str(tmp_path / "in")
    for part in parts:
        frame = spark.createDataFrame(part, schema)
        frame.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    return src, frame


def test_idle_keys_leave_the_state(spark, tmp_path):
    src, like = _files(spark, tmp_path, [[("k", 1_000)], [("j", 50_000)], [("j", 50_001)], [("j", 90_000)]], "key string, s long")
    events = jobs.file_stream(spark, src, like).withColumn("at", F.timestamp_seconds("s")).withWatermark("at", "1 minute")
    q = limits.stream(events, "key", "at", 60, 5).writeStream.format("memory").queryName("idle").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) == 2 and rows[-1] == 1


def test_sessions_and_sliding_windows_end_with_the_watermark(spark, tmp_path):
    parts = [[("a", 0), ("a", 20), ("b", 5)], [("a", 100)], [("a", 10_000)], [("a", 20_000)]]
    src, like = _files(spark, tmp_path, parts, "key string, s long")
    events = jobs.file_stream(spark, src, like).withColumn("at", F.timestamp_seconds(F.col("s") + 1_000))
    run = lambda df, name: df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    run(jobs.sessions(events, "key", "at", "30 seconds", "10 minutes"), "gone")
    got = sorted((r["key"], int(r["w"]["start"].timestamp()) - 1_000, r["n"]) for r in spark.table("gone").collect())
    assert got[:3] == [("a", 0, 2), ("a", 100, 1), ("a", 10_000, 1)] and ("b", 5, 1) in got
    run(jobs.sliding_usage(events, "at", "60 seconds", "30 seconds", "10 minutes"), "slid")
    slid = {int(r["w"]["start"].timestamp()) - 1_000: r["n"] for r in spark.table("slid").collect()}
    assert sum(n for at, n in slid.items() if at < 200) == 8  # each of the four events is in two windows


def test_unread_counts_by_batch(spark, tmp_path):
    """A message feed joined with its rooms' members adds to a table of unread counts."""
    src, like = _files(spark, tmp_path, [[("r", "u1", 1)], [("r", "u2", 2), ("s", "u1", 3)]], "room string, sender string, at int")
    members = spark.createDataFrame([("r", "u1"), ("r", "u2"), ("s", "u1")], "room string, member string")
    table = {"counts": spark.createDataFrame([], "member string, unread long")}

    def add(batch, n):
        unread = jobs.with_static(batch, members, "room").filter("member <> sender").groupBy("member").agg(F.count(F.lit(1)).alias("unread"))
        rows = mutations.increment(table["counts"], unread, ["member"], "unread").collect()
        table["counts"] = spark.createDataFrame(rows, "member string, unread long")

    jobs.for_each_batch(jobs.file_stream(spark, src, like), add, str(tmp_path / "c")).awaitTermination(120)
    assert {r["member"]: r["unread"] for r in table["counts"].collect()} == {"u1": 1, "u2": 1}


def test_graph_follows_the_sections_of_a_stream(spark, tmp_path):
    schema = "doc int, id long, t string"
    parts = [[(1, 1, "정보주체는 동의를 제한한다."), (1, 2, "과태료는 벌칙에 위반한다.")], [(1, 1, "정보주체는 열람을 보호한다."), (1, 3, "없음")]]
    src, like = _files(spark, tmp_path, parts, schema)
    now, held = {}, {"tables": None}

    def follow(batch, n):
        now.update({r["id"]: tuple(r) for r in batch.collect()})
        sections = spark.createDataFrame(list(now.values()), schema)
        old = held["tables"] or (spark.createDataFrame([], "id long, h string"), *knowledge.build_graph(sections.limit(0), "doc", "id", "t"))
        new = knowledge.update_graph(*old, sections, "doc", "id", "t")
        held["tables"] = tuple(spark.createDataFrame(df.collect(), df.schema) for df in new)

    jobs.for_each_batch(jobs.file_stream(spark, src, like), follow, str(tmp_path / "c")).awaitTermination(180)
    want = knowledge.build_graph(spark.createDataFrame(list(now.values()), schema), "doc", "id", "t")
    for got, expected in zip(held["tables"][1:], want):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select(*got.columns).collect()))
