"""The folder source against the readers by type, and as a stream."""

import json
import os
import zipfile

from loomdoc.sources import datasource, files


def rows_of(df):
    return sorted((os.path.basename(r["path"]), r["section_index"], r["section_type"], r["title"], r["text"]) for r in df.collect())


def test_batch_equals_the_readers(spark, tmp_path):
    datasource.register(spark)
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.txt").write_text("one\n\ntwo\n \n\nthree")
    (folder / "deep" / "b.md").write_text("intro\n# Head\nbody\n## Sub\nmore\n")
    (folder / "c.json").write_text(json.dumps([{"t": "x", "n": 1}, {"t": "y"}]))
    (folder / "d.json").write_text(json.dumps({"k": "v", "l": {"m": 1}}))
    (folder / "e.csv").write_text("h,i\n1, two\n,\n3,\n")
    (folder / "_hidden.txt").write_text("no")
    (folder / "x.bin").write_text("no")
    (folder / "broken.docx").write_text("no archive")
    with zipfile.ZipFile(folder / "f.docx", "w") as z:
        z.writestr("word/document.xml", "<w:d xmlns:w='w'><w:p><w:r><w:t>Hello </w:t><w:t>there</w:t></w:r></w:p><w:p/></w:d>")
    read = lambda **o: spark.read.format("sections").options(path=str(folder), **o).load()
    got = rows_of(read(sections="line", field="t", partition_bytes=20))
    want = []
    for name, df in {
        "a.txt": files.read_text(spark, str(folder / "a.txt"), "line"), "b.md": files.read_markdown(spark, str(folder / "deep" / "b.md")), "c.json": files.read_json(spark, str(folder / "c.json"), "t"),
        "d.json": files.read_json(spark, str(folder / "d.json")), "f.docx": files.read_office(spark, str(folder / "f.docx"), "docx"),
    }.items():
        want += [(name, *r[1:]) for r in rows_of(df)]
    assert [r for r in got if r[0] in {w[0] for w in want}] == sorted(want)
    assert [(r[1], r[4]) for r in got if r[0] == "e.csv"] == [(0, "h: 1\ni: two"), (1, "h: 3")]
    assert [r[2] for r in got if r[0] == "broken.docx"] == ["error"] and {r[0] for r in got} == {"a.txt", "b.md", "c.json", "d.json", "e.csv", "f.docx", "broken.docx"}
    assert read(partition_bytes=20).rdd.getNumPartitions() > 3
    (tmp_path / "none").mkdir()
    assert spark.read.format("sections").load(str(tmp_path / "none")).count() == 0


def test_stream_takes_each_file_once(spark, tmp_path):
    datasource.register(spark)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("sections").load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["text"] for r in spark.read.parquet(out).collect())

    for k in range(3):
        (folder / f"{k}.txt").write_text(f"text {k}")
        os.utime(folder / f"{k}.txt", ns=(10**18 + k, 10**18 + k))
        if k:
            assert run() == [f"text {i}" for i in range(k + 1)]
    assert run() == ["text 0", "text 1", "text 2"]
