"""Entities, triples and references of statutes: extraction, the stored graph and its upkeep, resolution, retrieval over them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.operators.containment import contained
from loomdoc.operators.search import cosine, knn
from loomdoc.operators.similarity import neighbours
from loomdoc.session import cut, shuffled

# fixed values: what names of laws, articles, organisations and duties look like
LAW_REF = r"([가-힣]{2,20}(?:\s*[가-힣])*법)\s*(제\d+조(?:의\d+)?(?:제\d+항)?(?:제\d+호)?)"
ARTICLE = r"제(\d+)조(?:의(\d+))?(?:제(\d+)항)?"
ORGANISATION = r"[가-힣]{2,8}(?:보호)?위원회|[가-힣]{3,10}(?:부|청|원|처|실)|[가-힣]{2,10}(?:센터|기관|협회|진흥원)"
DUTY = r"[가-힣]{1,10}(?:의무|권리|책임|권한|자격)"
# fixed values: the concepts, the predicates and the words of a relation, in their order
CONCEPTS = [
    "개인정보", "정보주체", "동의", "민감정보", "고유식별정보",
    "개인정보처리자", "개인정보파일", "영상정보처리기기",
    "정보통신망", "전자문서", "전자서명", "암호화",
    "가명정보", "익명정보", "비식별화", "가명처리",
    "접근권한", "접근통제", "개인정보보호책임자",
    "영향평가", "개인정보영향평가", "유출", "침해",
    "파기", "보유기간", "제3자제공", "위탁", "수탁자",
    "이전", "국외이전", "열람", "정정", "삭제", "처리정지",
    "손해배상", "과징금", "과태료", "벌칙",
    "동의철회", "프로파일링", "자동화된결정",
    "안전성확보조치", "내부관리계획", "접속기록",
]
PREDICATES = ["준용", "적용", "예외", "의거", "위반", "정의", "위임", "관할", "소속", "근거", "제한", "부과", "보호", "고지"]
RELATIONS = ["준용", "적용", "예외", "의거", "위반"]
SUBJECT_PARTICLE = r"(?:은|는|이|가)(?:\s|$)"
OBJECT_PARTICLE = r"(?:을|를|에게|에)(?:\s|$)"
NEAR = 30
#: Rows of a table that is sent whole to every task.
BROADCAST_ROWS = 100_000


def _known(df: DataFrame) -> DataFrame:
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else shuffled(df)


def entities_of(text: str, title: str | None = None) -> list[tuple[str, str, int]]:
    """(name, type, place) of each entity, the first mention of each type and name; the text's own law stands at 0."""
    found: dict[tuple[str, str], int] = {}

    def add(name: str, kind: str, at: int) -> None:
        name = re.sub(r"\s+", " ", name).strip()
        if len(name) >= 2:
            found.setdefault((kind, name), at)

    for m in re.finditer(LAW_REF, text):
        add(m[1], "law", m.start())
    if title:
        add(title, "law", 0)
    for m in re.finditer(ARTICLE, text):
        add(m[0], "article", m.start())
    for m in re.finditer(ORGANISATION, text):
        if not any(len(c) > len(m[0]) and text.startswith(c, m.start()) for c in CONCEPTS):
            add(m[0], "organization", m.start())
    for concept in CONCEPTS:
        if concept in text:
            add(concept, "concept", text.index(concept))
    for m in re.finditer(DUTY, text):
        add(m[0], "duty", m.start())
    return [(name, kind, at) for (kind, name), at in found.items()]


def entities(sections: DataFrame, id_: str, text: str, title: str | None = None) -> DataFrame:
    """id, n (order of extraction), name, type, place. Null or empty text: none."""

    @F.pandas_udf("array<struct<name:string,type:string,place:int>>")
    def run(texts: pd.Series, titles: pd.Series) -> pd.Series:
        names = ("name", "type", "place")
        return pd.Series([[dict(zip(names, e)) for e in entities_of(t, own)] if t else [] for t, own in zip(texts, titles)])

    own = F.col(title) if title else F.lit(None).cast("string")
    return sections.select(id_, F.posexplode(run(F.col(text), own)).alias("n", "e")).select(id_, "n", "e.*")


def triples(sections: DataFrame, mentions: DataFrame, id_: str, text: str) -> DataFrame:
    """id, subject, subject_type, predicate, object, object_type, confidence, context: entities in one sentence with a predicate's word, the first such sentence of each triple.

    A subject with its particle and an object with its own: 1.0, in any order; else the earlier one is the subject at 0.7. ``mentions``: see ``entities``.
    """
    parts = sections.select(id_, F.posexplode(F.split(text, r"[.\n]+")).alias("_k", "_s")).withColumn("_s", F.trim(F.regexp_replace("_s", r"(?U)^\s+|\s+$", ""))).filter(F.length("_s") > 5)
    words = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(PREDICATES)])
    parts = parts.withColumn("_p", F.filter(words, lambda x: F.contains("_s", x["p"]))).filter(F.size("_p") > 0)
    at = F.expr("locate(name, _s)")
    after = F.substring(F.col("_s"), F.col("_at") + F.length("name"), F.lit(3))
    near = parts.join(shuffled(mentions.select(id_, "n", "name", "type")), id_).withColumn("_at", at).filter("_at > 0").withColumn("_after", after)
    one = lambda c, particle: F.struct(F.col("n"), F.col("name"), F.col("type"), F.col("_at").alias("at"), F.col("_after").rlike(particle).alias("fits")).alias(c)
    a, b = near.select(id_, "_k", "_s", "_p", one("x", SUBJECT_PARTICLE)), near.select(id_, "_k", one("y", OBJECT_PARTICLE))
    sure = F.col("x.fits") & F.col("y.fits")
    pairs = a.join(shuffled(b), [id_, "_k"]).filter((F.col("x.n") != F.col("y.n")) & (sure | (F.col("x.at") < F.col("y.at"))))
    found = pairs.select(id_, "_k", "_s", "x", "y", F.when(sure, 1.0).otherwise(0.7).alias("confidence"), F.explode("_p").alias("_p"))
    context = F.when(F.length("_s") > 100, F.concat(F.left("_s", F.lit(100)), F.lit("..."))).otherwise(F.col("_s"))
    first = F.min(F.struct("_k", "x.n", F.col("y.n").alias("m"), F.col("x.type").alias("subject_type"), F.col("y.type").alias("object_type"), "confidence", context.alias("context"))).alias("_f")
    found = found.groupBy(id_, F.col("x.name").alias("subject"), F.col("_p.p").alias("predicate"), F.col("y.name").alias("object")).agg(first)
    return found.select(id_, "subject", "_f.subject_type", "predicate", "object", "_f.object_type", "_f.confidence", "_f.context")


def build_graph(sections: DataFrame, doc: str, id_: str, text: str, title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities (doc, id, n, name, type, place) and triples (doc, id of the section, ...) of all sections."""
    own = sections.select(doc, id_)
    found = entities(sections, id_, text, title)
    return own.join(shuffled(found), id_), own.join(shuffled(triples(sections, found, id_, text)), id_)


def best_triples(found: DataFrame, doc: str) -> DataFrame:
    """One row for each document's subject, predicate and object: that of the greatest confidence."""
    best = F.max(F.struct("confidence", "context")).alias("_b")
    return found.groupBy(doc, "subject", "predicate", "object").agg(best).select(doc, "subject", "predicate", "object", "_b.confidence", "_b.context")


def graph_stats(found_entities: DataFrame, found_triples: DataFrame, doc: str) -> DataFrame:
    """doc, kind (entity or triple), name (type or predicate), n: distinct entities by type, triples by predicate."""
    count = lambda df, kind, c: df.groupBy(doc, F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count(found_entities.select(doc, "type", "name").distinct(), "entity", "type").unionByName(count(found_triples, "triple", "predicate"))


def section_hash(text: Column) -> Column:
    """h * 31 + c over the characters as a 32-bit number, in base 36. Characters beyond the first plane count as their code."""
    h = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, c: (acc * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    digits = F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))
    return F.when(text == "", "0").otherwise(F.concat(F.when(signed < 0, "-").otherwise(""), digits))


def update_graph(old_hashes: DataFrame, old_entities: DataFrame, old_triples: DataFrame, sections: DataFrame, doc: str, id_: str, text: str, title: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hashes (id, h), entities and triples after the sections have become ``sections``: those of unchanged sections stay, of changed and added ones are extracted anew, and of removed ones go.

    Entities belong to their section, so what no section mentions any more is gone with its last one.
    """
    hashes = sections.select(id_, section_hash(F.col(text)).alias("h"))
    same = hashes.join(old_hashes.select(id_, "h"), [id_, "h"], "left_semi").select(id_)
    fresh = sections.join(same, id_, "left_anti")
    new_entities, new_triples = build_graph(fresh, doc, id_, text, title)
    return hashes, old_entities.join(same, id_, "left_semi").unionByName(new_entities), old_triples.join(same, id_, "left_semi").unionByName(new_triples)


def graph_query(found_triples: DataFrame, name: str | None = None, limit: int = 200, tie: str | None = None) -> DataFrame:
    """Triples whose subject or object holds ``name`` in any case (all of them without one), the surest first."""
    kept = found_triples
    if name:
        low = F.lit(name.lower())
        kept = kept.filter(F.contains(F.lower("subject"), low) | F.contains(F.lower("object"), low))
    return kept.orderBy(F.desc("confidence"), "subject", "predicate", "object", *([tie] if tie else [])).limit(limit)


def filtered(rows: DataFrame, kind: str | None = None, name: str | None = None, kind_column: str = "type", name_columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Rows of a type, and with a part of a name in any case; None asks for nothing."""
    kept = rows if kind is None else rows.filter(F.col(kind_column) == kind)
    if name:
        hit = F.lit(False)
        for c in name_columns:
            hit = hit | F.contains(F.lower(c), F.lit(name.lower()))
        kept = kept.filter(hit)
    return kept


def triples_for_questions(questions: DataFrame, found_triples: DataFrame, id_: str, text: str, least: float = 0.5, k: int = 20) -> DataFrame:
    """id, line, confidence: for each question the k surest triples that hold one of its entities, as lines ``s —[p]→ o``, each once."""
    names = entities(questions, id_, text).select(id_, F.lower("name").alias("_name")).distinct()
    kept = found_triples.filter(F.col("confidence") >= least)
    ends = kept.select("subject", "predicate", "object", "confidence", F.explode(F.array_distinct(F.array(F.lower("subject"), F.lower("object")))).alias("_end"))
    # the distinct ends meet the distinct names once, whatever the number of triples and questions
    vocabulary = ends.select("_end", F.col("_end").alias("_text")).distinct()
    hit = contained(vocabulary, "_end", "_text", names, "_name")
    found = ends.join(hit, "_end").join(names, "_name")
    line = F.concat("subject", F.lit(" —["), "predicate", F.lit("]→ "), "object")
    found = found.groupBy(id_, line.alias("line")).agg(F.max("confidence").alias("confidence"))
    by = Window.partitionBy(id_).orderBy(F.desc("confidence"), "line")
    return found.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")


def explicit_refs(sections: DataFrame, id_: str, text: str, title: str | None = None) -> DataFrame:
    """id, n, law, article, relation, context of each reference to another law; relation: the first of the words within 30 characters of it, else explicit."""

    @F.pandas_udf("array<struct<law:string,article:string,relation:string,context:string>>")
    def run(texts: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([refs_of(t or "", own) for t, own in zip(texts, titles)])

    own = F.col(title) if title else F.lit(None).cast("string")
    return sections.select(id_, F.posexplode(run(F.col(text), own)).alias("n", "r")).select(id_, "n", "r.*")


def refs_of(text: str, title: str | None = None) -> list[dict[str, str]]:
    plain = lambda name: re.sub(r"\s+", "", name).replace("에관한", "")
    out = []
    for m in re.finditer(LAW_REF, text):
        law = re.sub(r"\s+", " ", m[1]).strip()
        if title and plain(law) == plain(title):
            continue
        around = text[max(0, m.start() - NEAR) : m.end() + NEAR]
        relation = next((word for word in RELATIONS if word in around), "explicit")
        out.append({"law": law, "article": m[2], "relation": relation, "context": around.strip()})
    return out


def resolved(refs: DataFrame, laws: DataFrame, sections: DataFrame, id_: str, doc: str, title: str, label: str) -> DataFrame:
    """source and target section and document, relation, confidence 1.0, context: the least document whose title holds the law's name, spaces apart, and its least section whose label holds the article.

    ``laws``: doc, title of statutes; ``sections``: doc, id, label.
    """
    spaceless = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    names = refs.select("law", spaceless("law").alias("_name")).distinct()
    held = contained(laws.select(doc, spaceless(title).alias("_title")), doc, "_title", names, "_name")
    to_doc = held.join(names, "_name").groupBy("law").agg(F.min(doc).alias("target_document"))
    asked = refs.join(to_doc, "law")
    labels = sections.select(F.col(doc).alias("target_document"), F.col(id_).alias("_section"), F.col(label).alias("_label"))
    pairs = asked.select("target_document", "article").distinct()
    to_section = pairs.join(labels, "target_document").filter(F.contains("_label", F.col("article"))).groupBy("target_document", "article").agg(F.min("_section").alias("target_section"))
    found = asked.join(to_section, ["target_document", "article"]).join(sections.select(id_, F.col(doc).alias("source_document")), id_)
    # one row for each source, target and relation: the last mention
    last = F.max(F.struct("n", "context")).alias("_l")
    return found.groupBy(F.col(id_).alias("source_section"), "target_section", "relation").agg(F.min("source_document").alias("source_document"), F.min("target_document").alias("target_document"), last).select(
        "source_section", "target_section", "source_document", "target_document", "relation", F.lit(1.0).alias("confidence"), F.col("_l.context").alias("context")
    )


def semantic_refs(chunks: DataFrame, section: str, doc: str, order: str, vector: str, least: float = 0.85, k: int = 3, every_pair: bool = False, asks: Column | None = None) -> DataFrame:
    """source_section, target_section, similarity: for the first chunk of every section the k most similar ones of other documents.

    Candidates meet in bands of hyperplanes; ``every_pair`` compares all sections instead. ``asks``: which sections ask, each compared with all.
    """
    by = Window.partitionBy(section).orderBy(order)
    first = chunks.filter(F.col(vector).isNotNull()).withColumn("_r", F.row_number().over(by)).filter("_r = 1").select(section, doc, vector)
    found = knn(first if asks is None else first.filter(asks), first, k, id_=section, vector=vector, least=least, apart=doc) if every_pair or asks is not None else neighbours(first, k, section, vector, least, apart=doc)
    return found.select(F.col("query_id").alias("source_section"), F.col(section).alias("target_section"), "similarity")


def refs_of_document(refs: DataFrame, document: Column | int) -> DataFrame:
    """References from or to a document, the surest first."""
    d = F.lit(document) if isinstance(document, int) else document
    return refs.filter((F.col("source_document") == d) | (F.col("target_document") == d)).orderBy(F.desc("confidence"), "source_section", "target_section")


def article_graph(sections: DataFrame, doc: str, number: str, branch: str, refs: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc, article, in_degree, out_degree) and links (doc, source, target): references between existing articles of a document, not to itself, cut to the article."""
    article = F.concat(F.lit("제"), F.col(number).cast("string"), F.lit("조"), F.coalesce(F.concat(F.lit("의"), F.col(branch).cast("string")), F.lit("")))
    nodes = sections.filter(F.col(number).isNotNull()).select(doc, article.alias("article"), F.coalesce(F.col(refs), F.array().cast("array<string>")).alias("_refs"))
    links = nodes.select(doc, F.col("article").alias("source"), F.explode("_refs").alias("_r")).withColumn("target", F.regexp_extract("_r", r"^제\d+조(?:의\d+)?", 0))
    links = links.filter("target <> source").join(nodes.select(doc, F.col("article").alias("target")).distinct(), [doc, "target"], "left_semi").select(doc, "source", "target")
    count = lambda c, name: links.groupBy(doc, F.col(c).alias("article")).agg(F.count(F.lit(1)).alias(name))
    degrees = nodes.select(doc, "article").join(count("target", "in_degree"), [doc, "article"], "left").join(count("source", "out_degree"), [doc, "article"], "left")
    return degrees.fillna(0, ["in_degree", "out_degree"]), links


def chapter_density(nodes: DataFrame, doc: str, chapter: str) -> DataFrame:
    """doc, chapter (기타 where none), articles, refs: how many references its articles make and get. ``nodes``: see ``article_graph``, with the chapter."""
    return nodes.groupBy(doc, F.coalesce(F.nullif(F.col(chapter), F.lit("")), F.lit("기타")).alias("chapter")).agg(F.count(F.lit(1)).alias("articles"), F.sum(F.col("in_degree") + F.col("out_degree")).alias("refs"))


def article_stats(nodes: DataFrame, doc: str, k: int = 5) -> DataFrame:
    """doc, most_referenced and most_referencing (k articles each, by degree, then name), isolated, articles, links, density."""
    ranks = [F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(c), "article")).alias(f"_{c}") for c in ("in_degree", "out_degree")]
    n, links = F.count(F.lit(1)), F.sum("out_degree")
    top = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(f"_{c}") <= k, F.struct(F.col(f"_{c}").alias("r"), F.col("article").alias("a"))))), lambda x: x["a"])
    return nodes.select("*", *ranks).groupBy(doc).agg(
        top("in_degree").alias("most_referenced"), top("out_degree").alias("most_referencing"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated"),
        n.alias("articles"), links.alias("links"), F.when(n > 1, links / (n * (n - 1))).otherwise(0.0).alias("density"),
    )


def inverted_refs(sections: DataFrame, doc: str, article: str, refs: str, whole: bool = True) -> DataFrame:
    """doc, article, referenced_by: which articles refer to each. ``whole`` keeps the paragraph of a reference as part of its name; else it is cut to the article."""
    to = F.col("_r") if whole else F.regexp_extract("_r", r"^제\d+조(?:의\d+)?", 0)
    found = sections.select(doc, F.col(article).alias("_by"), F.explode(refs).alias("_r")).select(doc, "_by", to.alias("article")).filter("article <> ''")
    return found.groupBy(doc, "article").agg(F.array_sort(F.collect_set("_by")).alias("referenced_by"))


def community_method(title: Column, articles: Column, sections: Column) -> Column:
    """leiden for statutes (three articles in ten sections or more, or a statute's title) and academic texts, else louvain."""
    # fixed values: how titles of statutes end, and words of academic titles
    statute = title.rlike(r"법$|법률$|시행령$|시행규칙$|규정$|조례$|훈령$")
    academic = title.rlike(r"(?i)논문|학술|연구|보고서|journal|paper")
    dense = (articles > 0) & (sections > 0) & (articles / sections >= 0.3)
    return F.when(F.coalesce(dense, F.lit(False)) | F.coalesce(statute | academic, F.lit(False)), "leiden").otherwise("louvain")


def community_context(members: DataFrame, found_triples: DataFrame, sections: DataFrame, by: str, section: str, text: str, most: int = 30, texts: int = 5) -> DataFrame:
    """community key ``by``, lines (up to ``most`` triples that touch a member, the surest first), texts (300 characters of up to ``texts`` of their sections). ``members``: by, name."""
    ends = found_triples.withColumn("_end", F.explode(F.array_distinct(F.array("subject", "object"))))
    touched = ends.join(_known(members.select(by, F.col("name").alias("_end"))), "_end").dropDuplicates([by, section, "subject", "predicate", "object"])
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("confidence"), "subject", "predicate", "object", section))
    line = F.concat("subject", F.lit(" —["), "predicate", F.lit("]→ "), "object")
    top = touched.withColumn("_r", rank).filter(F.col("_r") <= most)
    lines = top.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(section))
    parts = touched.select(by, section).distinct().withColumn("_r", place).filter(F.col("_r") <= texts)
    parts = sections.select(section, F.left(text, F.lit(300)).alias("_t")).join(_known(parts), section)
    parts = parts.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]).alias("texts"))
    return lines.join(parts, by, "left")


def global_search(communities: DataFrame, words: list[str], vector: list[float] | None, k: int = 5, by: str = "community") -> DataFrame:
    """by, score of the communities that fit a question best: words in the summary count 1, in the members' names 1/2.

    The 15 largest ones with a word, or with three members or more, also count the likeness of their vectors, as the most words of any. ``communities``: by, summary, names, size, embedding.
    """
    named = F.lower(F.array_join("names", " "))
    inside = lambda w: F.contains(F.lower("summary"), F.lit(w.lower())).cast("double") + 0.5 * F.contains(named, F.lit(w.lower())).cast("double")
    rows = communities.filter("summary <> ''").withColumn("_kw", sum((inside(w) for w in words), F.lit(0.0)))
    most = rows.agg(F.greatest(F.max("_kw"), F.lit(1.0)).alias("_most"))
    near = rows.filter((F.col("_kw") > 0) | (F.col("size") >= 3)).orderBy(F.desc("size"), by).limit(15)
    like = cosine(F.col("embedding"), F.lit(vector)) if vector else F.lit(0.0)
    near = near.crossJoin(F.broadcast(most)).select(by, (0.5 * F.col("_kw") + 0.5 * like * F.col("_most")).alias("score"))  # one row
    rest = rows.filter("_kw > 0").join(near, by, "left_anti").select(by, F.col("_kw").alias("score"))
    found = near if vector else rows.select(by, F.col("_kw").alias("score"))
    found = found.unionByName(rest) if vector else found
    return found.filter("score > 0").orderBy(F.desc("score"), by).limit(k)


def reference_queries(chunks: DataFrame, id_: str, text: str, title: str) -> DataFrame:
    """id, query: what a second hop asks for: other laws' articles as written, and the chunk's own articles after its title."""
    laws = F.regexp_extract_all(F.col(text), F.lit(r"[가-힣]{2,20}법\s*제\d+조(?:의\d+)?"), 0)
    own = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"제\d+조(?:의\d+)?(?:제\d+항)?"), 0), lambda r: F.concat_ws(" ", F.col(title), r))
    return chunks.select(id_, F.explode(F.array_distinct(F.concat(laws, F.when(F.coalesce(F.col(title), F.lit("")) != "", own).otherwise(F.array().cast("array<string>"))))).alias("query"))


def referenced_chunks(hit_sections: DataFrame, refs: DataFrame, chunks: DataFrame, section: str, least: float = 0.8, sections: int = 5, limit: int = 5) -> DataFrame:
    """chunks of other documents that the hits' sections refer to, as hits whose similarity is the reference's confidence. ``hit_sections``: section; a top-k list."""
    own = hit_sections.select(F.col(section).alias("source_section")).distinct()
    found = refs.filter((F.col("confidence") >= least) & (F.col("source_document") != F.col("target_document"))).join(F.broadcast(own), "source_section")
    best = found.groupBy(F.col("target_section").alias(section)).agg(F.max("confidence").alias("similarity")).orderBy(F.desc("similarity"), section).limit(sections)
    return chunks.join(F.broadcast(best), section).orderBy(F.desc("similarity"), section, "id").limit(limit)
