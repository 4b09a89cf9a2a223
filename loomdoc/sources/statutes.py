"""Statutes from the JSON of the public law service, and sections of extracted pages."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions.text import trimmed
from loomdoc.operators.graphs import article_refs

ARTICLE = "array<struct<number:string,branch:string,title:string,content:string,part:string,chapter:string,section:string,subsection:string,label:string>>"
_LEVELS = ("part", "chapter", "section", "subsection")
# fixed values: the marks of the levels
_MARKS = ("편", "장", "절", "관")


def _list(x: object) -> list:
    return x if isinstance(x, list) else [x] if x else []


def _article(number: str, branch: str, title: str, content: str, path: dict[str, str]) -> dict[str, str]:
    name = f"제{number}조" + (f"의{branch}" if branch else "") + (f"({title})" if title else "")
    label = " > ".join([*(v for v in path.values() if v), name])
    return {"number": number, "branch": branch, "title": title, "content": content, **dict.fromkeys(_LEVELS, ""), **path, "label": label}


def _enter(path: dict[str, str], level: str, heading: str) -> None:
    """A heading sets its level and empties those below."""
    at = list(path).index(level)
    for k, name in enumerate(path):
        if k >= at:
            path[name] = heading if k == at else ""


def law_articles(units: list[dict]) -> list[dict[str, str]]:
    """Articles of a law: units without a title are headings; an article's paragraphs and items follow its text."""
    path, out = dict.fromkeys(_LEVELS, ""), []
    for unit in units:
        text = (unit.get("조문내용") or "").strip()
        title = unit.get("조문제목") or ""
        if text and not title:
            level = next((name for name, mark in zip(_LEVELS, _MARKS) if re.search(rf"제\d+{mark}", text)), None)
            if level:
                _enter(path, level, re.sub(r"\s+", " ", text))
            continue
        for paragraph in _list(unit.get("항")):
            text += "\n" + paragraph["항내용"] if paragraph.get("항내용") else ""
            text += "".join("\n  " + item["호내용"] for item in _list(paragraph.get("호")) if item.get("호내용"))
        out.append(_article(unit.get("조문번호") or "", unit.get("조문가지번호") or "", title, text.strip(), path))
    return out


def ordinance_articles(units: list[dict]) -> list[dict[str, str]]:
    """Articles of an ordinance; its numbers count hundredths."""
    out = []
    for unit in units:
        text = (unit.get("조내용") or "").strip()
        if text:
            raw = (_list(unit.get("조문번호")) or [""])[0]
            digits = re.match(r"\s*[+-]?\d+", str(raw))
            number = f"{int(digits[0]) / 100:g}" if digits else "NaN"
            out.append(_article(number, "", unit.get("조제목") or "", text, {}))
    return out


def rule_articles(texts: list[str]) -> list[dict[str, str]]:
    """Articles of an administrative rule: lines that are headings, articles with or without a title, or go on with the last article."""
    path, out = dict.fromkeys(_LEVELS[:3], ""), []
    for text in filter(None, (t.strip() for t in texts)):
        if re.match(r"제\d+장\s", text) and "조(" not in text and "조 " not in text:
            _enter(path, "chapter", text)
        elif re.match(r"제\d+절\s", text):
            _enter(path, "section", text)
        elif re.match(r"제\d+편\s", text):
            _enter(path, "part", text)
        elif m := re.match(r"제(\d+)조(?:의(\d+))?\(([^)]+)\)\s*(.*)", text, re.S):
            out.append(_article(m[1], m[2] or "", m[3], m[4].strip() or text, path))
        elif m := re.match(r"제(\d+)조(?:의(\d+))?\s+(.*)", text, re.S):
            out.append(_article(m[1], m[2] or "", "", m[3].strip(), path))
        elif out:
            out[-1]["content"] += "\n" + text
        else:
            out.append(_article("1", "", "", text, {}) | {"label": "본문 1"})
    return out


def parsed(text: str | None) -> tuple[str, list[dict[str, str]]]:
    """The name and the articles of a response of any of the three shapes; none of another."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return "", []
    if rule := data.get("AdmRulService"):
        items = rule.get("조문내용") or {}
        texts = [items[k] for k in sorted((k for k in items if k.isdigit()), key=int) if isinstance(items[k], str)]
        return (rule.get("행정규칙기본정보") or {}).get("행정규칙명") or "", rule_articles(texts)
    if ordinance := data.get("LawService"):
        units = ordinance.get("조문") or {}
        return (ordinance.get("자치법규기본정보") or {}).get("자치법규명") or "", ordinance_articles(_list(units.get("조") or units.get("조문단위")))
    law = data.get("법령") or data.get("law") or {}
    return (law.get("기본정보") or {}).get("법령명_한글") or law.get("법령명한글") or "", law_articles(_list((law.get("조문") or {}).get("조문단위")))


def articles(responses: DataFrame, id_: str, body: str) -> DataFrame:
    """id, law, n, and the article's number, branch, title, content, levels and label. A document is one row's work; its headings run on in it."""

    @F.pandas_udf(f"struct<law:string,articles:{ARTICLE}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [parsed(t) for t in texts]
        return pd.DataFrame({"law": [name for name, _ in found], "articles": [rows for _, rows in found]})

    rows = responses.select(id_, run(F.col(body)).alias("p"))
    return rows.select(id_, F.col("p.law").alias("law"), F.posexplode("p.articles").alias("n", "a")).select(id_, "law", "n", "a.*")


def with_references(found: DataFrame, id_: str) -> DataFrame:
    """Articles with the articles that they name (references) and that name them (referenced_by)."""
    name = F.concat(F.lit("제"), F.col("number"), F.lit("조"), F.when(F.col("branch") != "", F.concat(F.lit("의"), F.col("branch"))).otherwise(""))
    rows = found.withColumn("article", name).withColumn("references", article_refs(F.col("content"), name))
    back = rows.select(id_, F.col("article").alias("_by"), F.explode("references").alias("article")).groupBy(id_, "article").agg(F.array_sort(F.collect_set("_by")).alias("referenced_by"))
    return rows.join(back, [id_, "article"], "left").withColumn("referenced_by", F.coalesce("referenced_by", F.array().cast("array<string>")))


def page_sections(pages: DataFrame, id_: str, page: str, text: str, kind: str = "page", delimiter: str | None = None) -> DataFrame:
    """id, section_index, section_type, text of a document's pages: one by one, as a whole, or cut where the regex ``delimiter`` begins; without one, by page."""
    if kind == "page" or (kind == "custom" and not delimiter):
        return pages.select(id_, (F.row_number().over(Window.partitionBy(id_).orderBy(page)) - 1).alias("section_index"), F.lit("page").alias("section_type"), text)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, text))), lambda p: p[text]), "\n\n")
    whole = pages.groupBy(id_).agg(joined.alias("_all"))
    if kind == "full":
        return whole.select(id_, F.lit(0).alias("section_index"), F.lit("full").alias("section_type"), F.col("_all").alias(text))
    parts = F.filter(F.transform(F.split("_all", f"(?={delimiter})"), trimmed), lambda x: x != "")
    return whole.select(id_, F.posexplode(parts).alias("section_index", text)).select(id_, "section_index", F.lit("custom").alias("section_type"), text)


def known_laws(found: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Search results with whether their law has been imported."""
    keys = imported.select(F.col(key).alias("_k")).distinct()
    return found.join(keys, found[key] == F.col("_k"), "left").withColumn("imported", F.col("_k").isNotNull()).drop("_k")

