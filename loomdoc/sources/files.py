"""Files as sections: one row per section with path, section_index, section_type, title and text.

Text formats are read by Spark's own readers and cut with column expressions. Zipped office
formats are read as binary files, one file per row, and unpacked in Arrow batches.
Files that hold nothing give no rows; blank sections are left out.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.text import trimmed

COLUMNS = ["path", "section_index", "section_type", "title", "text"]
SCHEMA = "path string, section_index int, section_type string, title string, text string"
#: A page with less text than this is an image, for a text recogniser.
LEAST_PAGE_CHARS = 50


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _exploded(files: DataFrame, parts: Column, kind: str, title: Column | None = None) -> DataFrame:
    """One row for each part that isn't blank, numbered from 0."""
    kept = F.filter(F.transform(parts, trimmed), lambda x: F.length(x) > 0)
    rows = files.select("path", F.posexplode(kept).alias("section_index", "text"))
    return rows.select("path", "section_index", F.lit(kind).alias("section_type"), (F.lit("") if title is None else title).alias("title"), "text")


def read_text(spark: SparkSession, path: str, sections: str = "full", delimiter: str | None = None) -> DataFrame:
    """``sections``: full (one for the file), line (parted by blank lines) or custom (parted by the regex ``delimiter``)."""
    if sections not in ("full", "line", "custom") or (sections == "custom") != (delimiter is not None):
        raise ValueError("sections is full, line, or custom with a delimiter")
    text = F.col("text")
    parts = {"full": lambda: F.array(text), "line": lambda: F.split(text, r"\n\s*\n"), "custom": lambda: F.split(text, delimiter)}[sections]()
    return _exploded(_whole_files(spark, path), parts, sections)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A section from each heading to the next; its heading is the title. Text before the first heading has the title ''."""
    parts = F.split(F.col("text"), r"(?m)(?=^#{1,6}\s+\S)")
    return _exploded(_whole_files(spark, path), parts, "heading", F.regexp_extract("text", r"^#{1,6}\s+([^\n]*)", 1))


def read_csv(spark: SparkSession, path: str, content: str | None = None) -> DataFrame:
    """A section for each row: the column ``content``, or lines of "column: value" of the values that are there.

    section_index is a long that grows within a file; it has gaps, as numbering rows without them would take a file through one task.
    """
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True)
    value = lambda c: F.when(F.length(F.col(f"`{c}`")) > 0, F.concat(F.lit(f"{c}: "), F.col(f"`{c}`")))
    text = F.col(f"`{content}`") if content else F.concat_ws("\n", *[value(c) for c in rows.columns])
    out = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("section_index"), F.lit("row").alias("section_type"), F.lit("").alias("title"), text.alias("text"))
    return out.filter(F.length(trimmed(F.col("text"))) > 0)


def read_json(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """An array gives a section for each item (its ``field``, or its JSON), an object one for each key, which is the title."""
    files = _whole_files(spark, path)
    is_array = F.ltrim("text").startswith("[")
    items = files.filter(is_array).select("path", F.posexplode(F.from_json("text", "array<string>")).alias("section_index", "item"))
    text = F.coalesce(F.get_json_object("item", f"$.{field}"), F.col("item")) if field else F.col("item")
    items = items.select("path", "section_index", F.lit("item").alias("section_type"), F.lit("").alias("title"), text.alias("text"))
    keys = files.filter(~is_array).select("path", F.posexplode(F.map_entries(F.from_json("text", "map<string,string>"))).alias("section_index", "e"))
    keys = keys.select("path", "section_index", F.lit("key").alias("section_type"), F.col("e.key").alias("title"), F.col("e.value").alias("text"))
    return items.unionByName(keys).filter(F.length(trimmed(F.col("text"))) > 0)


def pages(files: DataFrame) -> DataFrame:
    """path, page (from 1), text, is_image of extracted text whose pages end with form feeds (``files``: path, text)."""
    rows = files.select("path", F.posexplode(F.split("text", "\f")).alias("_n", "_text"))
    text = trimmed(F.col("_text"))
    return rows.select("path", (F.col("_n") + 1).alias("page"), text.alias("text"), (F.length(text) < LEAST_PAGE_CHARS).alias("is_image"))


def _paragraphs(archive: zipfile.ZipFile, names: list[str], paragraph: str, run: str) -> list[str]:
    """The text of each paragraph element: its run elements joined. Names are local, whatever the namespace."""
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for name in names:
        for p in ElementTree.parse(archive.open(name)).iter():
            if local(p) == paragraph:
                out.append("".join(r.text or "" for r in p.iter() if local(r) == run))
    return out


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    """The members whose whole name matches, in the order of the number in it."""
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _docx(archive: zipfile.ZipFile) -> list[str]:
    return _paragraphs(archive, ["word/document.xml"], "p", "t")


def _hwpx(archive: zipfile.ZipFile) -> list[str]:
    return _paragraphs(archive, _numbered(archive, r"Contents/section(\d+)\.xml"), "p", "t")


def _sheets(archive: zipfile.ZipFile) -> list[str]:
    """The worksheets in the workbook's order; in that of their numbers where it lists none."""
    local = lambda e: e.tag.rpartition("}")[2]
    names = set(archive.namelist())
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        return _numbered(archive, r"xl/worksheets/sheet(\d+)\.xml")
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.parse(archive.open("xl/_rels/workbook.xml.rels")).iter() if local(r) == "Relationship"}
    ids = [next((v for k, v in s.attrib.items() if k.rpartition("}")[2] == "id"), None) for s in ElementTree.parse(archive.open("xl/workbook.xml")).iter() if local(s) == "sheet"]
    paths = [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in (targets.get(i, "") for i in ids)]
    return [p for p in paths if p in names]


def _xlsx(archive: zipfile.ZipFile, content: str | None = None, sheet: int = 0) -> list[str]:
    """The rows of a sheet below its header: the column ``content``, or lines of "column: value"."""
    local = lambda e: e.tag.rpartition("}")[2]
    shared = _paragraphs(archive, ["xl/sharedStrings.xml"], "si", "t") if "xl/sharedStrings.xml" in archive.namelist() else []
    sheets = _sheets(archive)
    header: dict[str, str] = {}
    out = []
    for row in ElementTree.parse(archive.open(sheets[sheet])).iter() if sheet < len(sheets) else ():
        if local(row) != "row":
            continue
        cells = {}
        for c in row:
            value = "".join(x.text or "" for x in c.iter() if local(x) in ("v", "t"))
            cells[re.sub(r"\d", "", c.get("r", ""))] = shared[int(value)] if c.get("t") == "s" and value else value
        if not header:
            header = cells
        elif content:
            out.append("".join(v for k, v in cells.items() if header.get(k) == content))
        else:
            out.append("\n".join(f"{header.get(k) or k}: {v}" for k, v in cells.items() if v))
    return out


def compound_stream(data: bytes, name: str) -> bytes | None:
    """A stream of a compound binary file by its name, None if there is none. Chains that run in circles end."""
    word = lambda at: int.from_bytes(data[at : at + 4], "little")
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("no compound file")
    size, small = 1 << int.from_bytes(data[30:32], "little"), 1 << int.from_bytes(data[32:34], "little")
    last = 0xFFFF_FFFA  # marks of ends and free places are greater
    at = lambda k: data[size * (k + 1) : size * (k + 2)]
    words = lambda b: [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b) - 3, 4)]
    tables, more, seen = words(data[76:512]), word(68), 0
    while more < last and seen < len(data) // size:
        *entries, more = words(at(more))
        tables, seen = tables + entries, seen + 1
    places = [x for k in tables if k < last for x in words(at(k))]

    def chain(k: int, next_: list[int], piece: Callable[[int], bytes]) -> bytes:
        out = []
        while k < len(next_) and len(out) <= len(next_):
            out.append(piece(k))
            k = next_[k]
        return b"".join(out)

    folder = chain(word(48), places, at)
    entries = [folder[i : i + 128] for i in range(0, len(folder) - 127, 128)]
    begin = lambda e: int.from_bytes(e[116:120], "little")
    for e in entries:
        if e[: max(0, int.from_bytes(e[64:66], "little") - 2)].decode("utf-16-le", "replace") == name:
            length = int.from_bytes(e[120:128], "little")
            if length >= word(56):
                return chain(begin(e), places, at)[:length]
            body = chain(begin(next(r for r in entries if r[66] == 5)), places, at)
            return chain(begin(e), words(chain(word(60), places, at)), lambda k: body[small * k : small * (k + 1)])[:length]
    return None


def preview_paragraphs(data: bytes) -> list[str]:
    """The paragraphs of the preview text that a HWP file carries, up to its first NUL."""
    text = (compound_stream(data, "PrvText") or b"").decode("utf-16-le", "ignore").partition("\0")[0]
    return re.split(r"\r?\n\s*\r?\n", text.strip())


OFFICE: dict[str, Callable[..., list[str]]] = {"docx": _docx, "hwpx": _hwpx, "xlsx": _xlsx}


def read_office(spark: SparkSession, path: str, kind: str, **options: str | int) -> DataFrame:
    """``kind``: docx or hwpx (a section for each paragraph), xlsx (for each row; options content and sheet) or hwp (for each paragraph of its preview text).

    A broken file gives one section of type error.
    """

    def unpack(content: bytes) -> list[str]:
        if kind == "hwp":
            return preview_paragraphs(content)
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return OFFICE[kind](archive, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    texts, type_ = [t.strip() for t in unpack(content)], kind
                except (zipfile.BadZipFile, KeyError, ValueError, StopIteration, ElementTree.ParseError) as e:
                    texts, type_ = [str(e)], "error"
                texts = [t for t in texts if t]
                if texts:
                    yield pd.DataFrame({"path": name, "section_index": range(len(texts)), "section_type": type_, "title": "", "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
