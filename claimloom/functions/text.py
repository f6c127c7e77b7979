"""Text expressions: stripping, token sets and their similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, at both ends.
_ENDS = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"


def strip(text: Column) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(text, _ENDS, "")


def ascii_tokens(text: Column) -> Column:
    """Distinct runs of [a-zA-Z0-9] of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def word_tokens(text: Column) -> Column:
    """Distinct runs of letters and digits of any script of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def _shared(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def token_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct tokens: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_shared(a, b))


def token_overlap(a: Column, b: Column) -> Column:
    """As :func:`token_jaccard`, but 0 if any is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_shared(a, b))
