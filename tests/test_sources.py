"""Readers against small files written here."""

import datetime
import json
import zipfile

import pytest

from loomdoc.sources import files, sinks


def texts(df):
    return [(r["title"], r["text"]) for r in df.orderBy("path", "section_index").collect()]


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        (tmp_path / name).write_text(content, encoding="utf-8")
        return str(tmp_path / name)

    return write


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return str(path)


def test_text_sections(spark, put):
    path = put("a.txt", "one\ntwo\n\n \n\nthree  \n\n")
    assert texts(files.read_text(spark, path)) == [("", "one\ntwo\n\n \n\nthree")]
    assert texts(files.read_text(spark, path, "line")) == [("", "one\ntwo"), ("", "three")]
    assert texts(files.read_text(spark, path, "custom", "t(?=wo|hree)")) == [("", "one"), ("", "wo"), ("", "hree")]
    with pytest.raises(ValueError):
        files.read_text(spark, path, "custom")


def test_empty_file_has_no_sections(spark, put):
    assert texts(files.read_text(spark, put("e.txt", ""), "line")) == []
    assert texts(files.read_markdown(spark, put("e.md", " \n"))) == []


def test_markdown(spark, put):
    path = put("a.md", "intro\n# First\nbody\n## Second\n#nothing\n")
    assert texts(files.read_markdown(spark, path)) == [("", "intro"), ("First", "# First\nbody"), ("Second", "## Second\n#nothing")]


def test_csv(spark, put):
    path = put("a.csv", "name, n\n x , 1\n,\ny,\n")
    assert texts(files.read_csv(spark, path)) == [("", "name: x\nn: 1"), ("", "name: y")]
    assert texts(files.read_csv(spark, path, "name")) == [("", "x"), ("", "y")]


def test_json(spark, put):
    array = put("a.json", json.dumps([{"t": "x"}, {"t": ""}, {"u": 1}]))
    assert texts(files.read_json(spark, array, "t")) == [("", "x"), ("", '{"u":1}')]
    assert texts(files.read_json(spark, put("o.json", '{"k": "v", "l": [1, 2]}'))) == [("k", "v"), ("l", "[1,2]")]


def test_office(spark, tmp_path):
    docx = zipped(tmp_path / "a.docx", {"word/document.xml": '<w:d xmlns:w="w"><w:p><w:t>a</w:t><w:t>b</w:t></w:p><w:p/><w:p><w:t>c</w:t></w:p></w:d>'})
    assert texts(files.read_office(spark, docx, "docx")) == [("", "ab"), ("", "c")]
    part = '<s xmlns:hp="hp"><hp:p><hp:t>{}</hp:t></hp:p></s>'
    hwpx = zipped(tmp_path / "a.hwpx", {f"Contents/section{n}.xml": part.format(n) for n in (10, 2)})
    assert texts(files.read_office(spark, hwpx, "hwpx")) == [("", "2"), ("", "10")]
    sheet = '<w><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"/></row></w>'
    xlsx = zipped(tmp_path / "a.xlsx", {"xl/sharedStrings.xml": "<t><si><t>name</t></si><si><t>x</t></si></t>", "xl/worksheets/sheet1.xml": sheet})
    assert texts(files.read_office(spark, xlsx, "xlsx")) == [("", "name: x")]
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert [r["section_type"] for r in files.read_office(spark, str(tmp_path / "b.docx"), "docx").collect()] == ["error"]


def test_pages(spark):
    df = spark.createDataFrame([("p", "x" * 60 + "\f  short \f")], "path string, text string")
    assert [(r["page"], len(r["text"]), r["is_image"]) for r in files.pages(df).orderBy("page").collect()] == [(1, 60, False), (2, 5, True), (3, 0, True)]


def test_traces_are_cut_and_parted_by_day(spark, tmp_path):
    df = spark.createDataFrame([("q" * 50, datetime.datetime(2024, 1, 2))], "question string, created_at timestamp")
    sinks.append_traces(df, str(tmp_path / "t"), 10)
    sinks.append_traces(df, str(tmp_path / "t"), 10)
    assert [(r["question"], str(r["day"])) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("q" * 10, "2024-01-02")] * 2


def compound(name, body):
    """A compound file of one small stream: tables, folder, small table and small body in a sector each."""
    word = lambda *xs: b"".join(x.to_bytes(4, "little") for x in xs)
    end, free = 0xFFFFFFFE, 0xFFFFFFFF

    def entry(n, kind, start, size):
        raw = n.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + len(raw).to_bytes(2, "little") + bytes([kind]) + bytes(49) + word(start) + size.to_bytes(8, "little")

    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + (62).to_bytes(2, "little") + (3).to_bytes(2, "little") + b"\xfe\xff" + (9).to_bytes(2, "little") + (6).to_bytes(2, "little")
    head = head.ljust(44, b"\0") + word(1, 1, 0, 4096, 2, 1, end, 0) + word(0) + word(*[free] * 108)
    pad = lambda b, fill=b"\0": b.ljust(512, fill)
    n = -(-len(body) // 64)
    fat = pad(word(0xFFFFFFFD, end, end, end), b"\xff")
    folder = pad(entry("Root Entry", 5, 3, 64 * n) + entry(name, 2, 0, len(body)))
    return pad(head) + fat + folder + pad(word(*range(1, n), end), b"\xff") + pad(body)


def test_preview_text_of_hwp(spark, tmp_path):
    body = "첫 문단\r\n이어서\r\n \r\n둘째 문단\0rest".encode("utf-16-le")
    (tmp_path / "a.hwp").write_bytes(compound("PrvText", body))
    (tmp_path / "b.hwp").write_bytes(b"not a compound file")
    got = sorted((r["path"][-5:], r["section_type"], r["text"]) for r in files.read_office(spark, str(tmp_path / "*.hwp"), "hwp").collect())
    assert got == [("a.hwp", "hwp", "둘째 문단"), ("a.hwp", "hwp", "첫 문단\r\n이어서"), ("b.hwp", "error", "no compound file")]


def test_sheets_in_the_workbooks_order(spark, tmp_path):
    row = lambda *cells: "<row>" + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in zip("AB", cells)) + "</row>"
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns:r="x"><sheets><sheet r:id="r2"/><sheet r:id="r1"/></sheets></w>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>')
        z.writestr("xl/worksheets/sheet1.xml", f"<s>{row('q', 'a')}{row('one', 'x')}</s>")
        z.writestr("xl/worksheets/sheet2.xml", f"<s>{row('q', 'a')}{row('two', 'y')}{row('', '')}</s>")
    read = lambda **options: [r["text"] for r in files.read_office(spark, str(tmp_path / "w.xlsx"), "xlsx", **options).collect()]
    assert read() == ["q: two\na: y"] and read(sheet=1) == ["q: one\na: x"] and read(content="a") == ["y"] and read(sheet=5) == []
