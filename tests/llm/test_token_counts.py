import random

from loomdoc.llm import token_counts


def test_token_counts_equal_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    counter = token_counts.Counter(token_counts.load(path), remembered=50)
    rng = random.Random(5)
    pieces = ["<|endoftext|>", "'s", "'LL", "Hello", " ", "\n\t", "ΑΣ", "é", "é", "日本", "123", "--", "\U0001f600", "the", "thing", "x" * 70, "　"]
    for _ in range(400):
        s = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert counter.text(s) == len(library.encode(s, add_special_tokens=False).ids), s
    got = token_counts.count_tokens(docs, path).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_tokens"] == len(library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids) for r in got)
    assert all(r["n_bytes"] == len((text[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
