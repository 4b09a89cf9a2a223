"""Texts with what the operators must survive: nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, t long, size string, node string"


def corpus(n=60, seed=1):
    """Random texts with exact and near copies, shared passages, nulls, empties, and columns whose names clash."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["the", "of"] * 20
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(60)
    rows = []
    for i in range(n):
        t = text(rng.choice([1, 3, 8, 60, 120, 300]))
        if rows and i % 4 == 1:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = "edit%d" % rng.randrange(9)
            t = " ".join(words)
        if i % 7 == 0:
            t = t + "\n" + passage
        rows.append((i, t, "en", rng.choice(["a", "a", "a", "b", None]), len(t), i, i, "s", "n"))
    rows += [(n, None, None, None, None, None, None, None, None), (n + 1, "", "en", "b", 0, 0, 0, "", ""), (n + 2, " \t\n", "en", "b", 3, 0, 0, "", "")]
    rows += [rows[3], rows[3], (None, rows[5][1], "en", "a", 1, 1, 1, "", ""), (n + 3, text(20_000), "en", "a", 1, 1, 1, "", "")]
    return rows


def words(t):
    return WORD.findall(t or "")


def sets_of(t, width):
    low = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    if not low:
        return frozenset()
    return frozenset(tuple(low[i : i + width]) for i in range(len(low) - width + 1)) or frozenset([tuple(low)])
