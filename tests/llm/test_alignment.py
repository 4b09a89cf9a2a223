import collections
import hashlib
import random

import pytest

from loomdoc.llm import alignment


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts, paths):
    """The contract's numbers by loops over single tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tokens = Tokenizer.from_file(paths[0])
    a_tokens.encode_special_tokens = True
    b_tokens = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    b_bytes = lambda i: bytes([int(b_tokens.id_to_piece(i)[3:5], 16)]) if b_tokens.is_byte(i) else b_tokens.id_to_piece(i).replace("▁", " ").encode()
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 400))
    byte_of = {chr(b if b in kept else next(moved)): b for b in range(256)}
    a_bytes = lambda i: bytes(byte_of[c] for c in a_tokens.id_to_token(i))
    docs = []
    for t in texts:
        a, b = a_tokens.encode(" " + (t or ""), add_special_tokens=False).ids, b_tokens.encode(t or "")
        want = b" " + (t or "").encode()
        if not t or b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
            docs.append([])
            continue
        ends = []
        for ids, of in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                at += len(of(i))
                out.append((at, i))
            ends.append(out)
        groups, begin = [], 0
        for cut in sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]}):
            groups.append(tuple([i for e, i in side if begin < e <= cut] for side in ends))
            begin = cut
        docs.append(groups)
    held = collections.Counter(p for groups in docs for p in {(a, b) for ga, gb in groups for a in ga for b in gb})
    top = collections.Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    for groups in docs:
        links = [(a, b) for ga, gb in groups for a in ga for b in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        yield (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest)


ODD = ["", None, " ", "\n", "a▁b", "<|endoftext|> <s> <unk> <0x41>", "日本語のテキスト" * 9, "\U0001f600" * 7, "é" * 40, "x" * 300, "\x00\x01", "don't  STOP 12345   ", "a‍b", "٣٤٥ ﬁ"]


def rows_of(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *list(r)[1:]) for r in df.collect())


@pytest.mark.parametrize("listed, part, hot", [(alignment.LISTED, alignment.PART, alignment.HOT_PAIRS), (3, 5, 40), (1, 1, 0)])
def test_alignment_equals_loops(spark, rows, paths, monkeypatch, listed, part, hot):
    # LISTED reaches only this process (the next test is its own); PART and the number of hot pairs go to the workers
    monkeypatch.setattr(alignment, "LISTED", listed)
    monkeypatch.setattr(alignment, "PART", part)
    rng = random.Random(7)
    texts = [r[1] for r in rows if len(r[1] or "") < 3_000] + ODD + ["".join(rng.choice(["é", "日", " the", "zq", "\t", "…", "ß"]) for _ in range(60)) for _ in range(40)]
    data = [(None if k % 17 == 3 else k, t, 1, "x", "y") for k, t in enumerate(texts)] + [(5, texts[5], 1, "x", "y")] * 3
    docs = spark.createDataFrame(data, "doc_id long, text string, _row int, pairs string, part string").repartition(5)
    got = alignment.align(docs, *paths, hot_pairs=hot)
    assert rows_of(got) == sorted((d is None, d or 0, *values) for (d, *_), values in zip(data, plain([t for _, t, *_ in data], paths)))


def test_large_groups_and_parts_lose_no_pair(paths, monkeypatch):
    aligner = alignment._aligner(*map(alignment._file, paths))
    texts = ["日本語" * 30 + "zqé" * 20, "the cat", "", "é" * 50]
    _, _, *want = aligner.align(texts)
    monkeypatch.setattr(alignment, "LISTED", 2)
    _, _, *got = aligner.align(texts)
    assert all((x == y).all() for x, y in zip(want, got))


def test_ranks_give_the_tokens_of_the_library(paths):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(paths[0])
    library.encode_special_tokens = True
    aligner = alignment._aligner(*map(alignment._file, paths))
    rng = random.Random(4)
    pieces = [t for t in ODD if t] + ["'s", "'LL", "Hello", "thing", "123", "--", "  ", "\r\n", "\x85", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(500)]
    assert aligner.encode_a(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_table(spark, empty, paths):
    assert alignment.align(empty, *paths).collect() == []
