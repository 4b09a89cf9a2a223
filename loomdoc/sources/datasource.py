"""A folder of documents as a data source: ``spark.read.format("sections")``, and as a stream of its new files.

``register(spark)`` makes it known. Options: path; sections (full, line or custom) and delimiter for text files; content (a column) for CSV and sheets;
field for JSON arrays; partition_bytes, what one task reads of small files. The type of a file is that of its extension; other files are
left out. A file is read whole by one task; a broken one gives one section of type error.

The stream's offset is the time and path of the last file taken; a file that is changed later comes again as a new one.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomdoc.sources.files import OFFICE, preview_paragraphs

SCHEMA = "path string, file_type string, section_index int, section_type string, title string, text string"
PARTITION_BYTES = 32 << 20
# fixed values: extensions of the types that are read
TYPES = {"txt": "text", "md": "markdown", "markdown": "markdown", "csv": "csv", "json": "json", "docx": "docx", "hwpx": "hwpx", "xlsx": "xlsx", "hwp": "hwp"}


def _listed(path: str) -> list[tuple[int, str, int]]:
    """(time in nanoseconds, path, size) of the files below ``path``, hidden ones left out, in order of time."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    infos = system.get_file_info([root])
    if infos[0].type == fs.FileType.Directory:
        infos = system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(root) :].split("/") if x)
    return sorted((i.mtime_ns or 0, i.path, i.size) for i in infos if i.type == fs.FileType.File and i.extension.lower() in TYPES and not hidden(i.path))


def sections_of(data: bytes, kind: str, options: dict[str, str]) -> Iterator[tuple[str, str, str]]:
    """(section type, title, text) of a file's sections, blank ones too."""
    if kind in OFFICE or kind == "hwp":
        if kind == "hwp":
            texts = preview_paragraphs(data)
        else:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                texts = OFFICE[kind](archive, **({"content": options["content"]} if kind == "xlsx" and "content" in options else {}))
        yield from ((kind, "", t) for t in texts)
        return
    text = data.decode("utf-8-sig", "replace")
    if kind == "text":
        how = options.get("sections", "full")
        parts = [text] if how == "full" else re.split(r"\n\s*\n" if how == "line" else options["delimiter"], text)
        yield from ((how, "", p) for p in parts)
    elif kind == "markdown":
        for part in re.split(r"(?m)(?=^#{1,6}\s+\S)", text):
            heading = re.match(r"#{1,6}\s+([^\n]*)", part)
            yield "heading", heading[1] if heading else "", part
    elif kind == "csv":
        for row in csv.DictReader(io.StringIO(text), skipinitialspace=True):
            content = options.get("content")
            yield "row", "", row.get(content) or "" if content else "\n".join(f"{k}: {v.strip()}" for k, v in row.items() if k and isinstance(v, str) and v.strip())
    else:
        held = json.loads(text)
        as_text = lambda x: x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        if isinstance(held, list):
            field = options.get("field")
            yield from (("item", "", as_text(x[field] if field and isinstance(x, dict) and field in x else x)) for x in held)
        elif isinstance(held, dict):
            yield from (("key", k, as_text(v)) for k, v in held.items())


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))
        self.paths = paths


class _Reading:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        if "path" not in options:
            raise ValueError("the source needs a path")

    def _packed(self, files: list[tuple[int, str, int]]) -> list[Files]:
        most, out, held = int(self.options.get("partition_bytes", PARTITION_BYTES)), [], 0
        for _, path, size in files:
            if not out or held + size > most:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out

    def read(self, partition: Files | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # no file: Spark asks for one empty partition
            return
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        for path in partition.paths:
            kind = TYPES[path.rpartition(".")[2].lower()]
            with system.open_input_file(path) as f:
                data = f.read()
            try:
                found = [(s, t, x.strip()) for s, t, x in sections_of(data, kind, self.options)]
            except (zipfile.BadZipFile, KeyError, ValueError, StopIteration, ElementTree.ParseError, csv.Error) as e:
                found = [("error", "", str(e))]
            for n, (section, title, text) in enumerate(x for x in found if x[2]):
                yield path, kind, n, section, title, text


class SectionsReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self._packed(sorted(_listed(self.options["path"]), key=lambda f: f[1]))


class SectionsStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.options["path"])
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        place = lambda o: (o["time"], o["path"])
        return self._packed([f for f in _listed(self.options["path"]) if place(start) < f[:2] <= place(end)])

    def commit(self, end: dict) -> None:
        pass


class Sections(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SectionsReader:
        return SectionsReader(self.options)

    def streamReader(self, schema) -> SectionsStreamReader:
        return SectionsStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Sections)
