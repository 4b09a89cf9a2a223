"""Hashes of words and of windows of words, vectorised over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = np.random.default_rng(35)
_BYTE = _MIX.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd, so that they have an inverse mod 2**64. Two polynomials together tell windows apart at any size of corpus.
BASE, SECOND_BASE = 0x9E37_79B9_7F4A_7C15, 0xD1B5_4A32_D192_ED03
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that one step of hashing takes at a time.
PIECE = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58_476D_1CE4_E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D0_49BB_1331_11EB)
    return x ^ (x >> np.uint64(31))


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    in_word = ~_IS_SPACE[data]
    edge = np.diff(in_word.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = np.diff(starts, append=len(data))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    value = _BYTE[data[starts[0] :]] * powers(BASE, int(lengths.max()))[at]
    value[~in_word[starts[0] :]] = 0
    return mixed(np.add.reduceat(value, starts - starts[0]))


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of each word; pieces end at white space, so memory follows the words and not the bytes."""
    if len(data) <= PIECE:
        return _piece_hashes(np.frombuffer(data, np.uint8))
    out, begin = [], 0
    view = np.frombuffer(data, np.uint8)
    while begin < len(data):
        end = begin + PIECE
        while end < len(data) and not _IS_SPACE[view[end]]:
            end += 1
        out.append(_piece_hashes(view[begin:end]))
        begin = end
    return np.concatenate(out)


def rolling(words: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes mod 2**64 of all windows of ``width`` words, from one running sum."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(pow(base, -1, 2**64), n), out=total[1:])
    return mixed((total[width:] - total[:-width]) * powers(base, n - width + 1))


def slices(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [begin, end) of texts of about ``most`` bytes together; a longer text is a run of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, and the index of the first word of each text and of the end."""
    hashes = word_hashes(b"\n".join(texts))
    counts = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
    return hashes, np.concatenate([[0], np.cumsum(counts)])
