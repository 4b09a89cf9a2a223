"""Web pages as column expressions: tags, board lists, exam cards, addresses; and small checks of user input."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc.functions.text import collapsed, trimmed

# fixed values: what a message of a used-up account holds
CREDIT_ERRORS = ["credit balance is too low", "insufficient_quota", "rate_limit_exceeded", "billing_hard_limit_reached", "exceeded your current quota", "Resource has been exhausted"]
# fixed values: scripts that open an article of a board, and addresses that name one
BOARD_CALL = r"""(?i)onclick="[^"]*(?:\$bbs\.view|fn_detail|goView|goDetail|viewArticle)\s*\(\s*'(\d+)'\s*,\s*'([^']*)'"""
BOARD_ADDRESS = r"(?i)(?:postSeq|nttSn|boardSeq|articleId|bbsId|seq=|view)"
LARGEST_IMAGE = 2 * 1024 * 1024


def stripped(html: Column) -> Column:
    """Without tags, six entities resolved; nothing is put where a tag was."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return trimmed(x)


def resolved_url(href: Column, base: Column) -> Column:
    """An address on a page: absolute, of the same scheme, from the root, a query of the page, or beside it. Dots in a path stay."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    beside = F.when(page == origin, F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(href.rlike(r"(?i)^https?://"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(F.when(page == origin, F.concat(page, F.lit("/"))).otherwise(page), href))
        .otherwise(F.concat(beside, href))
    )


def _row(title: Column, href: Column, day: Column) -> Column:
    return F.struct(title.alias("title"), href.alias("href"), F.nullif(day, F.lit("")).alias("day"))


def board_rows(html: Column, base: Column) -> Column:
    """Array of (title, url, day) of a board's table rows; where it has none, of links to articles. Titles of less than three letters (five for links) and links without a target go."""

    def of_row(tr: Column) -> Column:
        short = F.regexp_extract(tr, r'(?i)<span[^>]*class="[^"]*ellipsis[^"]*"[^>]*>([^<]+)<', 1)
        title = F.when(short != "", stripped(short)).otherwise(stripped(F.regexp_extract(tr, r"(?is)<a[^>]*>.*?</a>", 0)))
        path = F.regexp_extract(tr, BOARD_CALL, 2)
        called = F.concat(path, F.when(F.contains(path, F.lit("?")), "&nttSn=").otherwise("?nttSn="), F.regexp_extract(tr, BOARD_CALL, 1))
        link = F.regexp_extract(tr, r'(?i)<a[^>]*href="([^"]*)"[^>]*>', 1)
        link = F.when((link == "#") | F.startswith(link, F.lit("javascript:")), "").otherwise(link)
        return _row(title, F.when(tr.rlike(BOARD_CALL), called).otherwise(link), F.regexp_extract(tr, r"\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}", 0))

    def of_link(a: Column) -> Column:
        pattern = r'(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
        href = F.regexp_extract(a, pattern, 1)
        good = href.rlike(BOARD_ADDRESS) & (href != "#") & ~F.startswith(href, F.lit("javascript:"))
        return _row(stripped(F.regexp_extract(a, pattern, 2)), F.when(good, href).otherwise(""), F.lit(""))

    body = F.regexp_extract(html, r"(?is)<tbody[^>]*>(.*?)</tbody>", 1)
    rows = F.regexp_extract_all(F.when(html.rlike(r"(?is)<tbody[^>]*>.*?</tbody>"), body).otherwise(html), F.lit(r"(?is)<tr[^>]*>.*?</tr>"), 0)
    kept = lambda least: lambda r: (F.length(r["title"]) >= least) & (r["href"] != "")
    rows = F.filter(F.transform(rows, of_row), kept(3))
    links = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<a[^>]*href="[^"]*"[^>]*>.*?</a>'), 0), of_link), kept(5))
    found = F.when(F.size(rows) > 0, rows).otherwise(links)
    return F.transform(found, lambda r: F.struct(r["title"].alias("title"), resolved_url(r["href"], base).alias("url"), r["day"].alias("day")))


def exam_cards(html: Column) -> Column:
    """Array of (number, exam, original_number, body, choices, answer, explanation, image) of a page of question cards."""
    joined = lambda x: F.trim(F.regexp_replace(x, r"\n\s+", " "))
    cards = F.regexp_extract_all(html, F.lit(r'(?s)<div class="card" id="q\d+">.*?(?=<div class="card" id="q\d+">|</main>)'), 0)

    def of_card(card: Column) -> Column:
        number = F.regexp_extract(card, r'id="q(\d+)"', 1).cast("int")
        # fixed values: the exams by number
        exam = F.when(number <= 110, 1).when(number <= 150, 2).otherwise(3)
        original = F.regexp_extract(card, r'<span class="(?:q-num|qn)">(\d+)\.', 1)
        body = F.regexp_extract(card, r'(?s)<div class="question-body">(.*?)</div>', 1)
        choice = r'(?s)<li data-num="(\d+)"><span class="c-num">[①②③④]</span>\s*(.*?)</li>'
        choices = F.transform(F.regexp_extract_all(card, F.lit(choice), 0), lambda c: F.struct(F.regexp_extract(c, choice, 1).cast("int").alias("num"), joined(F.regexp_extract(c, choice, 2)).alias("text")))
        explanation = F.trim(F.regexp_extract(card, r'(?s)<div class="explanation"[^>]*>(.*?)(?=<div class="screenshot-wrap"|<div class="ai-controls"|$)', 1))
        return F.struct(
            number.alias("number"), exam.alias("exam"), F.when(original != "", original).otherwise(number.cast("string")).alias("original_number"),
            joined(F.regexp_replace(body, r'<span class="(?:q-num|qn)">\d+\.</span>\s*', "")).alias("body"), choices.alias("choices"),
            F.coalesce(F.nullif(F.regexp_extract(card, r'data-answer="(\d+)"', 1), F.lit("")).cast("int"), F.lit(0)).alias("answer"),
            F.when(F.length(F.trim(F.regexp_replace(explanation, r"<[^>]*>", ""))) < 10, "").otherwise(explanation).alias("explanation"),
            F.format_string("q%03d.png", number).alias("image"),
        )

    return F.transform(cards, of_card)


def crawl_paragraphs(text: Column, least: int = 30) -> Column:
    """Parts between blank lines of ``least`` letters or more, each with its white space collapsed; the whole text if there is none and it is as long, else nothing."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda x: collapsed(x)), lambda x: F.length(x) >= least)
    whole = F.when(F.length(collapsed(text)) >= least, F.array(collapsed(text))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) > 0, parts).otherwise(whole)


def compare_key(text: Column, size: int = 100) -> Column:
    """What two spellings of a text are compared by: no tags, single spaces, the first ``size`` letters."""
    return F.left(trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", ""), r"\s+", " ")), F.lit(size))


def decoded_size(body: Column) -> Column:
    """Bytes that base64 text stands for, from its length and padding."""
    return (F.floor(F.length(body) * 3 / 4) - F.length(F.regexp_extract(body, r"=+$", 0))).cast("long")


def image_url_fits(url: Column, most: int = LARGEST_IMAGE) -> Column:
    """A data address of a PNG, JPEG, WebP or GIF image of up to ``most`` bytes."""
    pattern = r"(?i)^data:(image/(?:png|jpeg|jpg|webp|gif));base64,([A-Za-z0-9+/=]+)$"
    size = decoded_size(F.regexp_extract(url, pattern, 2))
    return F.coalesce(url.rlike(pattern) & (size > 0) & (size <= most), F.lit(False))


def user_name_fits(name: Column) -> Column:
    return name.rlike(r"^[a-z0-9_-]+$")


def is_credit_error(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return low.rlike("|".join(re.escape(p.lower()) for p in CREDIT_ERRORS))


def fixed(x: Column, digits: int) -> Column:
    """A number as text with so many digits; null stays."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x.cast("double")))


def board_score(title: Column, content: Column, keyword: Column, title_weight: float = 10.0, content_weight: float = 3.0) -> Column:
    """Struct of title_score, content_score and total: occurrences of the keyword's words, weighed, to two digits."""
    words = F.filter(F.split(F.lower(keyword), r"\s+"), lambda w: w != "")

    def score(text: Column, weight: float) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        n = F.aggregate(words, F.lit(0.0), lambda a, w: a + (F.length(low) - F.length(F.replace(low, w, F.lit("")))) / F.length(w))
        return F.floor(n * weight * 100 + 0.5) / 100

    t, c = score(title, title_weight), score(content, content_weight)
    return F.struct(t.alias("title_score"), c.alias("content_score"), (t + c).alias("total"))


def parsed_answer(text: Column) -> Column:
    """Struct of format (json or markdown), conclusion, caveats and evidence numbers of a model's answer; fences go, keys may be English or Korean."""
    body = trimmed(F.regexp_replace(F.regexp_replace(trimmed(text), r"^```(?:json)?\s*\n?", ""), r"\n?\s*```$", ""))
    of = lambda *keys: F.coalesce(*[F.nullif(F.get_json_object(body, f"$['{k}']"), F.lit("")) for k in keys])
    conclusion = of("conclusion", "결론")
    headed = lambda names: trimmed(F.regexp_extract(text, rf"(?ms)^#{{2,3}}\s+[^\n]*(?:{names})[^\n]*\n(.*?)(?=^#{{2,3}}\s|\z)", 1))
    plain = F.when(text.rlike(r"(?m)^#{2,3}\s+"), headed("결론|Conclusion|conclusion")).otherwise(trimmed(text))
    steps = F.coalesce(F.from_json(of("evidenceChain", "근거체인"), "array<struct<sourceIndex:int,step:int>>"), F.array().cast("array<struct<sourceIndex:int,step:int>>"))
    numbers = F.transform(steps, lambda s: F.coalesce(s["sourceIndex"], s["step"]))
    cited = F.transform(F.regexp_extract_all(text, F.lit(r"\[(?:근거|출처)\s*(\d+)\]"), 1), lambda n: n.cast("int"))
    is_json = conclusion.isNotNull()
    return F.struct(
        F.when(is_json, "json").otherwise("markdown").alias("format"), F.when(is_json, conclusion).otherwise(plain).alias("conclusion"),
        F.when(is_json, F.coalesce(of("caveats", "주의사항"), F.lit(""))).otherwise(headed("주의|Caveat|caveat")).alias("caveats"),
        F.array_distinct(F.when(is_json, numbers).otherwise(cited)).alias("evidence"),
    )


def verified(evidence: Column, sources: Column) -> Column:
    """Array of (number, verified): whether a cited source exists."""
    return F.transform(evidence, lambda n: F.struct(n.alias("number"), ((n >= 1) & (n <= sources)).alias("verified")))


# fixed values: where a card's markup has its body, the other class of bodies, its scenario, and the number before a body
CARD_PARTS = {"body": r'(?s)<div class="question-body">(.*?)</div>', "qb": r'(?s)<div class="qb">(.*?)</div>', "scenario": r'(?s)<div class="scenario">(.*?)</div>\s*<ul class="choices"'}
CARD_NUMBER = r'<span class="(?:q-num|qn)">\d+\.</span>\s*'


def card_body(card: Column) -> Column:
    """The body of a card that has a scenario (kept as markup below it) or a body of the class qb; null for others."""
    part = {name: F.regexp_extract(card, pattern, 1) for name, pattern in CARD_PARTS.items()}
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, CARD_NUMBER, ""), r"\n\s+", " "))
    scenario = F.concat(plain(part["body"]), F.lit('\n\n<div class="scenario">'), F.trim(part["scenario"]), F.lit("</div>"))
    return F.when(card.rlike(CARD_PARTS["scenario"]), scenario).when(plain(part["qb"]) != "", plain(part["qb"]))
