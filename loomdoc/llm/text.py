"""Column expressions on words and hashes that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text; a null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), SPACE_RUN), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.octet_length(whole(text)).cast("long")


def unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def identity(text: Column, of: str = "") -> list[Column]:
    """``_t<of>`` and ``_u<of>``: 96 bits of two hash families that stand for a text, so that no two texts share them at any size of corpus."""
    return [F.xxhash64(F.lit(96), whole(text)).alias(f"_t{of}"), F.hash(F.lit(96), whole(text)).alias(f"_u{of}")]


def slice_of(hashed: Column, parts: int | Column) -> Column:
    """The part, of ``parts`` equal ones, of the hash range; rises with the hash (as a signed long)."""
    top = F.shiftrightunsigned(hashed.bitwiseXOR(F.lit(-(2**63))), 33)
    return F.floor(top * parts / F.lit(float(2**31))).cast("long")
