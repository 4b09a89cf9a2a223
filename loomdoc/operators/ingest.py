"""Composed jobs: files and pages to chunks and graph, crawl results, usage reports, provider calls. Each stage is a DataFrame; nothing runs before it is written."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.functions import chunks as ch
from loomdoc.functions import text as tx
from loomdoc.functions import web
from loomdoc.operators import knowledge, mutations, relational, search, textsearch
from loomdoc.operators.containment import without


def ingest(sections: DataFrame, words: dict[str, str] | None = None, strategy: str = "sentence", doc: str = "doc", index: str = "section_index", text: str = "text", title: str | None = None) -> dict[str, DataFrame]:
    """The tables of an upload: sections (redacted), chunks (with their enriched text and its vector), index, entities, triples.

    ``sections``: doc, section_index, text. A section is named by its document and place, a chunk by its section and place.
    """
    redacted, n = tx.redacted(F.col(text), words or {})
    rows = sections.select(doc, index, F.struct(doc, index).alias("section"), redacted.alias("text"), n.alias("redactions"), *([title] if title else []))
    parts = rows.select(doc, "section", *([title] if title else []), F.posexplode(ch.chunk(F.col("text"), strategy)).alias("n", "text"))
    labels = {"문서": F.col(title)} if title else {}
    parts = parts.withColumn("id", F.struct("section", "n")).withColumn("enriched", ch.enriched(F.col("text"), **labels))
    parts = parts.withColumn("embedding", search.hashed_embedding(F.col("enriched")))
    entities, triples = knowledge.build_graph(rows, doc, "section", "text", title)
    return {"sections": rows, "chunks": parts, "index": textsearch.inverted_index(parts, "id", {"text": "D"}), "entities": entities, "triples": triples}


def page_import(pages: DataFrame, id_: str, url: str, html: str, least: int = 30) -> DataFrame:
    """doc, url, title, section_index, text: each address once (its least id), its readable text cut at blank lines."""
    first = relational.first_by(pages, [url], [F.col(id_)])
    # blank lines come from the ends of blocks; white space is collapsed within the parts only
    blocks = F.regexp_replace(F.col(html), r"(?i)</(?:p|div|li|tr|h[1-6]|section|article|table|ul|ol|blockquote)\s*>|<br\s*/?>", "$0\n\n")
    gone = F.regexp_replace(blocks, r"(?is)<(script|style|noscript|iframe|object|embed|form|nav|header|footer|aside)\b[^>]*>.*?</\1\s*>", " ")
    parts = web.crawl_paragraphs(web.stripped(gone), least)
    return first.select(F.col(id_).alias("doc"), url, tx.html_title(F.col(html)).alias("title"), F.posexplode(parts).alias("section_index", "text"))


def crawl_results(pages: DataFrame, id_: str, base: str, html: str, keywords: Sequence[str], exclusions: DataFrame, as_of: Column, days: int = 7, importance: Column | None = None, k: int = 20) -> DataFrame:
    """id, title, url, day, title_score, total: a board's rows that are recent or undated and not excluded, the k best of each page by keyword scores times the site's importance.

    ``exclusions``: pattern; addresses that hold one go.
    """
    rows = pages.select(id_, (importance if importance is not None else F.lit(1.0)).alias("_importance"), F.explode(web.board_rows(F.col(html), F.col(base))).alias("r")).select(id_, "_importance", "r.*")
    at = F.try_to_date(F.regexp_replace("day", r"[./]", "-"), "y-M-d")
    rows = rows.filter(recent_or_unknown(at, as_of, days))
    rows = without(rows, "url", exclusions, "pattern")
    score = sum((web.board_score(F.col("title"), F.lit(""), F.lit(w))["title_score"] for w in keywords), F.lit(0.0))
    scored = rows.withColumn("title_score", score).withColumn("total", tx.rounded(F.col("title_score") * F.col("_importance"), 2)).drop("_importance")
    return relational.top_per_group(scored, [id_], [F.desc("total"), F.col("url"), F.col("title")], k)


def recent_or_unknown(at: Column, as_of: Column, days: int) -> Column:
    return at.isNull() | (at >= F.date_sub(as_of, days))


def merged_scores(found: DataFrame, url: str, scores: Sequence[str], order: Column) -> DataFrame:
    """One row for each address found by several keywords: its scores added up, other columns of the first."""
    rest = [c for c in found.columns if c != url and c not in scores]
    first = F.min(F.struct(order.alias("_o"), *rest)).alias("_f")
    return found.groupBy(url).agg(*[F.sum(c).alias(c) for c in scores], first).select(url, *scores, *[F.col(f"_f.{c}").alias(c) for c in rest])


def usage_dashboard(usage: DataFrame, at: str, provider: str, model: str, status: str, cost: str, day: str, days: int = 30, errors: int = 10) -> dict[str, DataFrame]:
    """The result sets of a usage page: by provider, by model, by day, the last errors, today and yesterday. ``day`` is the day it is asked on."""
    today = F.lit(day).cast("date")
    recent = usage.filter((F.to_date(at) > F.date_sub(today, days)) & (F.to_date(at) <= today))
    sums = [F.count(F.lit(1)).alias("calls"), F.count_if(F.col(status) == "error").alias("errors"), F.round(F.sum(cost), 6).alias("cost")]
    last = usage.filter(F.col(status) == "error").orderBy(F.desc(at), provider, model).limit(errors)
    return {
        "by_provider": recent.groupBy(provider).agg(*sums),
        "by_model": recent.groupBy(provider, model).agg(*sums),
        "by_day": recent.groupBy(F.to_date(at).alias("day")).agg(*sums),
        "last_errors": last,
        "periods": relational.compare_periods(usage, at, cost, day),
    }


def cached_results(rows: DataFrame, cache: DataFrame, key: Column, compute: Callable[[Column], Column], text: str) -> DataFrame:
    """key, result: what the cache (key, result) has for the rows, and what the provider ``compute`` gives for the rest, each distinct text once."""
    asked = rows.select(key.alias("key"), F.col(text).alias("_t")).dropDuplicates(["key"])
    held = cache.join(asked, "key", "left_semi").select("key", "result")
    return held.unionByName(asked.join(cache, "key", "left_anti").select("key", compute(F.col("_t")).alias("result")))


def tracked_calls(requests: DataFrame, usage: DataFrame, caps: DataFrame, key: str, at: str, day: str, order: str, call: Callable[[Column], Column], text: str) -> DataFrame:
    """Requests with allowed, result and status: those of a provider beyond its cap of the day, or of a disabled one, aren't made.

    ``caps``: key, cap (0: none), enabled. Requests count on in their order from what ``usage`` has for the day.
    """
    state = relational.limit_check(usage, caps, key, at, day).join(caps.select(key, "cap", "enabled"), key)
    rows = relational.numbered(requests, key, [order]).join(state, key, "left")
    fits = (F.col("cap") == 0) | (F.col("used") + F.col("n") <= F.col("cap"))
    allowed = F.coalesce(F.col("enabled") & fits, F.lit(False))
    result = F.when(allowed, call(F.col(text)))
    return rows.select(*requests.columns, allowed.alias("allowed"), result.alias("result"), F.when(allowed, "success").otherwise("blocked").alias("status"))


def reset_vectors(chunks: DataFrame, documents: DataFrame, dims: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """After a change of the model: vectors of another length go, and their documents wait to be embedded again."""
    stale = chunks.filter(F.size(vector) != dims).select("doc").distinct().withColumn("_stale", F.lit(True))
    kept = chunks.withColumn(vector, F.when(F.size(vector) == dims, F.col(vector)))
    status = F.when(F.col("_stale"), "pending").otherwise(F.col("embedding_status"))
    return kept, documents.join(stale, "doc", "left").withColumn("embedding_status", status).drop("_stale")


def answer_prompts(questions: DataFrame, hits: DataFrame, id_: str, question: str, template: str, most: int = 8) -> DataFrame:
    """id, prompt: a question with its numbered sources, the best ``most`` of each. ``hits``: id, text, score; ``template`` has question and sources."""
    top = relational.top_per_group(hits, [id_], [F.desc("score"), F.col("text")], most)
    lines = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "text"))), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"]))
    sources = top.groupBy(id_).agg(F.array_join(lines, "\n").alias("_sources"))
    rows = questions.join(sources, id_, "left")
    return rows.select(id_, tx.rendered(template, {"question": F.col(question), "sources": F.col("_sources")}).alias("prompt"))


def summary_vectors(documents: DataFrame, summary: str, embed: Callable[[Column], Column]) -> DataFrame:
    """``documents`` with summary_embedding, the vector of a summary that isn't blank (the one before, if there is one, where it is), and embedding_status done."""
    kept = F.col("summary_embedding") if "summary_embedding" in documents.columns else F.lit(None).cast("array<double>")
    given = tx.trimmed(F.coalesce(F.col(summary), F.lit(""))) != ""
    return documents.withColumn("summary_embedding", F.when(given, embed(F.col(summary))).otherwise(kept)).withColumn("embedding_status", F.lit("done"))


def repaired_questions(questions: DataFrame, cards: DataFrame, key: str, html: str) -> DataFrame:
    """``questions`` (key, body) with the bodies that their cards' markup gives better: a scenario follows the body, and a body of the class qb takes its place. Other questions stay."""
    found = cards.select(key, web.card_body(F.col(html)).alias("body")).filter("body is not null")
    return mutations.patch(questions, found, key)
