"""Chunkers: text -> array of chunks. Greedy packing carries state, so these are small per-text functions behind an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what the recursive splitter tries, in order
SEPARATORS = ("\n\n", "\n", ".", "。", "!", "?", ";", ",", " ", "")
#: Texts that are Python objects, with their chunks, at one time.
SLICE = 64
ARTICLE = r"(?=제\d+조(?:의\d+)?)"  # at each mention, also within a text


def sentence(text: str, size: int = 500, overlap: int = 100) -> list[str]:
    """Pack sentences up to ``size``; a new chunk begins with the tail of the last one."""
    if not text.strip():
        return []
    out, held = [], ""
    for s in re.findall(r"[^.!?]+[.!?]?\s*", text) or [text]:
        if len(held) + len(s) > size:
            out.append(held.strip())
            held = (held[-overlap:] if overlap and len(held) > overlap else "") + s
        else:
            held += s
    return [c for c in [*out, held.strip()] if c]


def _letters(text: str, size: int, overlap: int) -> list[str]:
    """Runs of ``size`` letters, each beginning with the last ``overlap`` of the one before; none that is only overlap."""
    back = overlap if 0 < overlap < size else 0
    starts = [i for i in range(0, len(text), size - back) if i == 0 or i + back < len(text)]
    return [c for i in starts if (c := text[i : i + size].strip())]


def recursive(text: str, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the first separator present and pack; pieces that stay too long go on with the next separators.

    A new chunk begins with the tail of the last one, even where that makes it longer than ``size``.
    """
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    k = next((i for i, s in enumerate(separators) if s in text), None)
    if k is None or not separators[k]:
        return _letters(text, size, overlap)
    sep, rest = separators[k], separators[k + 1 :]
    out, held = [], ""
    for piece in text.split(sep):
        joined = held + sep + piece if held else piece
        if len(joined) <= size:
            held = joined
            continue
        out.append(held.strip())
        if len(piece) > size and rest:
            out += recursive(piece, size, overlap, rest)
            held = ""
        else:
            held = held[-overlap:] + sep + piece if overlap and len(held) > overlap else piece
    return [c for c in [*out, held.strip()] if c]


def article(text: str, size: int = 800, overlap: int = 0) -> list[str]:
    """Split a statute at its articles; a long one at its numbered paragraphs, with its title on a line before each part."""
    parts = [p.strip() for p in re.split(ARTICLE, text) if p.strip()]
    if len(parts) <= 1:
        return recursive(text, size, overlap) if parts else []
    return [c for part in parts for c in ([part] if len(part) <= size else _clauses(part, size))]


def _clauses(part: str, size: int) -> list[str]:
    title = re.match(r"(?:제\d+조(?:의\d+)?\s*(?:\([^)]*\))?)?", part)[0].strip()
    clauses = [c for c in re.split(r"(?=[①-⑳])|(?=\n\d+\.\s)", part) if c.strip()]
    if len(clauses) <= 1:
        return recursive(part, size, size // 10)
    headed = lambda c: f"{title}\n{c}" if title else c
    out, held = [], ""
    for c in clauses:
        if len(held) + len(c if held else headed(c)) <= size:
            held = f"{held}\n{c}" if held else headed(c)
        else:
            out.append(held.strip())
            held = headed(c.strip())
    return [c for c in [*out, held.strip()] if c]


def markdown(text: str, size: int = 600, overlap: int = 50) -> list[str]:
    """Sections under #..####, each with its path of headings before it."""
    path, body, sections = [""] * 4, [], []
    for line in text.split("\n"):
        if m := re.match(r"(#{1,4})\s+(.+)", line):
            sections.append((list(path), "\n".join(body).strip()))
            n = len(m[1])
            path, body = [*path[: n - 1], m[2].strip(), *[""] * (4 - n)], []
        else:
            body.append(line)
    sections.append((list(path), "\n".join(body).strip()))
    if not any(any(p) for p, _ in sections):
        return recursive(text, size, overlap)
    out = []
    for p, content in sections:
        prefix = f"[{' > '.join(h for h in p if h)}]\n" if any(p) else ""
        if content:
            fits = len(prefix) + len(content) <= size
            out += [prefix + c for c in ([content] if fits else recursive(content, max(1, size - len(prefix)), overlap))]
    return out


def sentences_of(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?。])\s+|(?<=\n)\s*", text) if s.strip()]


def breaks(distances: list[float], rule: str = "percentile", threshold: float = 80) -> list[int]:
    """The places to cut after, by distance of neighbours."""
    if not distances:
        return []
    if rule == "gradient":
        steps = [b - a for a, b in zip(distances, distances[1:])]
        k = int(len(steps) * threshold / 100)
        cutoff = sorted(steps)[k] if k < len(steps) else 0.0
        return [i for i, step in enumerate(steps, 1) if step >= cutoff]
    if rule == "stddev":
        mean = sum(distances) / len(distances)
        cutoff = mean + threshold / 100 * (sum((d - mean) ** 2 for d in distances) / len(distances)) ** 0.5
    else:
        ordered = sorted(distances)
        k = int(len(ordered) * threshold / 100)
        cutoff = ordered[k] if k < len(ordered) and ordered[k] else ordered[-1]
    return [i for i, d in enumerate(distances) if d >= cutoff]


def semantic(text: str, embed: Callable[[list[str]], list[list[float]]], size: int = 800, window: int = 3, rule: str = "percentile", threshold: float = 80, sums: bool = False) -> list[str]:
    """Cut where the embedding of neighbouring groups of sentences turns. ``sums``: a group's embedding is the sum of its sentences' (whole numbers), so each sentence is embedded once."""
    sents = sentences_of(text)
    if len(text) <= size or len(sents) <= 2:
        return [text.strip()] if text.strip() else []
    half = window // 2
    groups = [(max(0, i - half), min(len(sents), i + half + 2)) for i in range(len(sents))]
    if sums:
        own = np.asarray(embed(sents), float)
        below = np.vstack([np.zeros((1, own.shape[1])), np.cumsum(own, axis=0)])
        first, last = np.array(groups).T
        vectors = below[last] - below[first]
        products, squares = (vectors[:-1] * vectors[1:]).sum(axis=1).tolist(), (vectors * vectors).sum(axis=1).tolist()
    else:
        vectors = embed([" ".join(sents[a:b]) for a, b in groups])
        products, squares = [sum(x * y for x, y in zip(a, b)) for a, b in zip(vectors, vectors[1:])], [sum(x * x for x in a) for a in vectors]
    norms = [(a * b) ** 0.5 for a, b in zip(squares, squares[1:])]

    out, begin = [], 0
    for end in [*breaks([1 - (p / n if n else 0.0) for p, n in zip(products, norms)], rule, threshold), len(sents) - 1]:
        if piece := " ".join(sents[begin : end + 1]):
            out += [piece] if len(piece) <= size else recursive(piece, size, size // 10)
        begin = end + 1
    return out if len(out) > 1 else recursive(text, size, size // 5)


def parents_and_children(text: str, parent: int = 800, child: int = 200, overlap: int = 50) -> list[tuple[int, str, int, str]]:
    """(parent index, parent, child index, child); a text that fits is its own parent."""
    if not text.strip():
        return []
    parents = [text.strip()] if len(text) <= parent else sentence(text, parent, 0)
    return [(i, p, j, c) for i, p in enumerate(parents) for j, c in enumerate(sentence(text if len(text) <= parent else p, child, overlap))]


def _embedded(text: str, size: int = 500, overlap: int = 100) -> list[str]:
    from loomdoc.operators.search import embed_texts

    return semantic(text, embed_texts, size, sums=True)  # words don't reach over a group's blanks, so trigrams add up


#: name -> (text, size, overlap) -> chunks. ``semantic`` embeds by the offline default; ``parent-doc`` gives the children alone.
STRATEGIES: dict[str, Callable[..., list[str]]] = {
    "sentence": sentence,
    "recursive": recursive,
    "law-article": article,
    "markdown": markdown,
    "semantic": _embedded,
    "parent-doc": lambda text, size=200, overlap=50: sentence(text, size, overlap),
}


def _by_slices(texts: pa.Array, split: Callable[[str | None], list], kind: pa.DataType) -> pa.Array:
    """``split`` of each text. A batch may hold many long texts, so only a slice of it at a time is made Python objects."""
    parts = [pa.array([split(t) for t in texts.slice(i, SLICE).to_pylist()], kind) for i in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def chunk(text: Column, strategy: str = "sentence", **options: int) -> Column:
    """Array of chunks; an unknown strategy is ``sentence``, null has none. Options: size and overlap."""
    split = STRATEGIES.get(strategy, sentence)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return _by_slices(texts, lambda t: split(t, **options) if t else [], pa.list_(pa.string()))

    return run(text)


def parent_children(text: Column, parent: int = 800, child: int = 200, overlap: int = 50) -> Column:
    """Array of (parent_index, parent, child_index, child): both stores of the parent-document rule in one pass."""

    names = ("parent_index", "parent", "child_index", "child")
    kind = pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.string()) * 2))))

    @F.arrow_udf("array<struct<parent_index:int,parent:string,child_index:int,child:string>>")
    def run(texts: pa.Array) -> pa.Array:
        return _by_slices(texts, lambda t: [dict(zip(names, row)) for row in parents_and_children(t or "", parent, child, overlap)], kind)

    return run(text)


def preview(text: Column, strategy: str = "sentence", **options: int) -> Column:
    """Struct of total, the first three chunks (200 characters and ... at most), least, most and mean length. It shows what the first 5,000 characters give."""
    found = chunk(F.left(text, F.lit(5000)), strategy, **options)
    sizes = F.transform(found, lambda c: F.length(c))
    short = F.transform(F.slice(found, 1, 3), lambda c: F.concat(F.left(c, F.lit(200)), F.when(F.length(c) > 200, "...").otherwise("")))
    mean = F.floor(F.aggregate(sizes, F.lit(0.0), lambda a, n: a + n) / F.size(sizes) + 0.5)
    return F.struct(F.size(found).alias("total"), short.alias("first"), F.array_min(sizes).alias("least"), F.array_max(sizes).alias("most"), F.when(F.size(sizes) > 0, mean).alias("mean"))


def document_type(text: Column) -> Column:
    """law, regulation, exam or default, from the first 1,000 characters."""
    head = F.left(text, F.lit(1000))
    # fixed values: the patterns in their order
    law = head.rlike(r"제\d+조(?:의\d+)?") & head.rlike(r"(?:법|령|규칙)")
    return F.when(law, "law").when(head.rlike(r"(?:규정|지침|고시|훈령|예규)"), "regulation").when(head.rlike(r"(?:문제|정답|해설|보기|①|②|③)"), "exam").otherwise("default")


def enriched(chunk_text: Column, **labels: Column) -> Column:
    """Labelled lines before the chunk; blank ones are left out."""
    lines = [F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in labels.items()]
    return F.concat_ws("\n", *lines, chunk_text)
