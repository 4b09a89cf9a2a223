"""Text functions as column expressions; sizes are in code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: suffixes that keyword extraction removes; the first that fits goes
SUFFIXES = (
    "에서는", "으로서", "에서", "으로", "에게", "한테",
    "부터", "까지", "에는", "와는", "과는",
    "이란", "란", "이라", "라고",
    "는", "은", "를", "을", "의", "에", "로", "와", "과",
    "가", "이", "도", "만", "요",
)


def simple_upper(text: Column) -> Column:
    """Upper case letter by letter, as DuckDB has it: a letter stays one letter (ß is ẞ, not SS; ŉ stays)."""
    # fixed values: letters whose capital is one letter in the simple mapping and several in the full one
    one = {0xDF: 0x1E9E, 0x1FB3: 0x1FBC, 0x1FC3: 0x1FCC, 0x1FF3: 0x1FFC} | {c: c + 8 for first in (0x1F80, 0x1F90, 0x1FA0) for c in range(first, first + 8)}
    known = F.create_map(*[F.lit(chr(c)) for pair in one.items() for c in pair])
    letter = lambda c: F.coalesce(F.try_element_at(known, c), F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    # the full mapping only makes texts longer
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(F.array_join(F.transform(F.split(text, ""), letter), ""))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|(?U)\s+$", "")


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def quoted_pattern(text: str) -> str:
    return re.escape(text)


def like_literal(column: Column, text: str) -> Column:
    """Case-insensitive containment of the text as it is, wildcards included."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def spaceless_contains(column: Column, text: Column) -> Column:
    return F.contains(F.replace(column, F.lit(" "), F.lit("")), F.replace(text, F.lit(" "), F.lit("")))


def html_text(html: Column, crawl: bool = False) -> Column:
    """Readable text of a page: no scripts, styles, frames, forms or page furniture; tags and six entities resolved."""
    gone = "script|style|noscript|iframe|object|embed|form|nav|header|footer" + ("|aside" if crawl else "")
    x = F.regexp_replace(html, rf"(?is)<({gone})\b[^>]*>.*?</\1\s*>", " ")
    if crawl:
        main = [F.nullif(F.regexp_extract(x, rf'(?is)<({tag})\b[^>]*class="[^"]*(?:content|body|view|detail|article)[^"]*"[^>]*>(.*?)</\1>', 2), F.lit("")) for tag in ("article", "div")]
        x = F.coalesce(*main, x)
    x = F.regexp_replace(x, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    if crawl:
        x = F.regexp_replace(x, r"&[#\w]+;", " ")
    return F.replace(collapsed(F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")), F.lit(". "), F.lit(".\n"))


def html_title(html: Column) -> Column:
    return collapsed(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"<[^>]*>", ""))


def paragraphs(text: Column, least: int = 30) -> Column:
    """Parts between blank lines longer than ``least``; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: trimmed(x)), lambda x: F.length(x) > least)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(trimmed(text)))


def file_type(name: Column, mime: Column) -> Column:
    """By extension, else by MIME type, else unknown."""
    # fixed values
    by_extension = {"txt": "text", "md": "markdown", "markdown": "markdown", "docx": "docx", "xlsx": "xlsx", "xls": "xlsx", "csv": "csv", "json": "json", "hwp": "hwp", "hwpx": "hwpx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image"}
    by_mime = {"text/plain": "text", "text/markdown": "markdown", "text/csv": "csv", "application/json": "json", "application/pdf": "pdf"}
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return F.coalesce(F.element_at(table(by_extension), F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)), F.element_at(table(by_mime), F.lower(mime)), F.lit("unknown"))


def ngrams(word: Column, least: int = 2, most: int = 3) -> Column:
    """Distinct character n-grams, shorter ones first, each size from the left."""

    def of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))
        return F.when(F.length(word) >= n, runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(least, most + 1)]))


def tokens(text: Column, least: int = 2) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda x: F.length(x) >= least)


def count_of(text: Column, token: Column) -> Column:
    """Non-overlapping occurrences, case folded."""
    low, tok = F.lower(text), F.lower(token)
    return ((F.length(low) - F.length(F.replace(low, tok, F.lit("")))) / F.length(tok)).cast("long")


def highlighted(text: Column, words: list[str], before: int = 60, size: int = 350) -> Column:
    """An excerpt that starts ``before`` characters before the first hit, hits in <mark>."""
    if not words:
        return F.left(text, F.lit(size))
    pattern = "(?i)(" + "|".join(quoted_pattern(w) for w in sorted(words, key=len, reverse=True)) + ")"
    first = F.regexp_instr(text, F.lit(pattern))
    return F.regexp_replace(F.substring(text, F.greatest(first - before, F.lit(1)), F.lit(size)), pattern, "<mark>$1</mark>")


def redacted(text: Column, words: dict[str, str]) -> tuple[Column, Column]:
    """The text with keywords replaced (longest first, spaces allowed between their letters, any case), and how many were."""
    n = F.lit(0).cast("long")
    for word in sorted(words, key=len, reverse=True):
        pattern = r"(?i)" + r"\s*".join(quoted_pattern(c) for c in word if not c.isspace())
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, (words[word] or "***").replace("\\", "\\\\").replace("$", "\\$"))
    return text, n


def keywords(text: Column, stopwords: list[str]) -> Column:
    """Distinct words of two letters or more, without one suffix each and without stop words. Letters are ASCII ones, digits, _ and Hangul syllables."""
    words = F.split(F.lower(F.regexp_replace(text, r"[^\w가-힣\s]", " ")), r"(?U)\s+")

    def stem(w: Column) -> Column:
        out = F.when(F.lit(False), w)
        for s in SUFFIXES:
            out = out.when(F.endswith(w, F.lit(s)) & (F.length(w) > len(s) + 1), F.left(w, F.length(w) - len(s)))
        return out.otherwise(w)

    return F.array_distinct(F.filter(F.transform(words, stem), lambda w: (F.length(w) >= 2) & ~w.isin(stopwords or [""])))


def keyword_similarity(a: Column, b: Column) -> Column:
    """a: the question's keywords. Equal words score 1, one within the other 1/2; weighed against the union and against a."""
    best = lambda x: F.when(F.array_contains(b, x), 1.0).when(F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)), 0.5).otherwise(0.0)
    m = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + best(x))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(0.4 * m / union + 0.6 * m / F.size(a))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3)


def rounded(x: Column, digits: int) -> Column:
    """Half up towards plus infinity on the binary value."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def parsed_date(text: Column, year: int) -> Column:
    """YYYY-M-D (or with . or /), else M-D of ``year``, else null."""
    full = F.regexp_extract(text, r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", 0)
    short = F.regexp_extract(text, r"(\d{1,2})[-./](\d{1,2})", 0)
    iso = lambda x: F.regexp_replace(x, r"[./]", "-")
    return F.coalesce(F.try_to_date(iso(F.nullif(full, F.lit(""))), "y-M-d"), F.when(full == "", F.try_to_date(F.concat(F.lit(f"{year}-"), iso(F.nullif(short, F.lit("")))), "y-M-d")))


def public_url(url: Column) -> Column:
    """http or https, and not a local or private host."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1))
    private = r"^(localhost|.*\.local|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|\[(::1?|f[cd].*|fe80.*)\])$"
    return (host != "") & ~host.rlike(private)


def valid_email(x: Column) -> Column:
    return x.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def rendered(template: str, values: dict[str, Column]) -> Column:
    """{{name}} -> value; null or unknown names become empty."""
    pieces = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*[(F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def file_name(name: Column, most: int = 200) -> Column:
    """The base name without NULs, cut to ``most`` with its extension kept; untitled if empty."""
    base = F.regexp_extract(F.replace(name, F.lit("\x00"), F.lit("")), r"([^/\\]*)$", 1)
    ext = F.regexp_extract(base, r"(\.[^.]{1,10})$", 1)
    short = F.when(F.length(base) > most, F.concat(F.left(base, F.lit(most) - F.length(ext)), ext)).otherwise(base)
    return F.when(trimmed(short) == "", "untitled").otherwise(short)
