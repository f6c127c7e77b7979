"""Cutting texts: sentences as claims, paragraphs, fixed windows, and where a claim stands in a segment.

Offsets count code points. Sentences and paragraphs are found by one linear scan per text in Arrow batches,
so no text is shuffled; windows and places are JVM expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import strip

_SENTENCE = re.compile(r"[^.!?]+[.!?]?")
_GAP = re.compile(r"\n\s*\n")
SEGMENT = "seg_idx int, seg_id string, text string, start int, end int"


def _spread(df: DataFrame, key: str, text: str, cut_text: Callable[[str], list[tuple]], schema: str, empty_for_null: bool = False) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *x) for k, t in zip(batch["k"], batch["t"], strict=True) for x in cut_text(t)]
            yield pd.DataFrame(rows, columns=["k", *names])

    source = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return source.mapInPandas(run, f"k {kind}, {schema}").withColumnRenamed("k", key)


def sentence_spans(text: str) -> list[tuple[int, str, str, int, int]]:
    """(number, claim id, stripped sentence, start, end) of each sentence; the span is that of the unstripped one."""
    out = []
    for m in _SENTENCE.finditer(text):
        said = m.group().strip()
        if said:
            out.append((len(out), f"c{len(out) + 1}", said, m.start(), m.end()))
    return out


def sentence_claims(df: DataFrame, key: str, text: str) -> DataFrame:
    """One claim per sentence: (key, ord, claim_id, text, start, end). Null and blank texts give none."""
    return _spread(df, key, text, sentence_spans, "ord int, claim_id string, text string, start int, end int")


def paragraph_spans(text: str, min_chars: int = 1) -> list[tuple[int, str, str, int, int]]:
    """(number, segment id, text, start, end) of the parts between blank lines that have ``min_chars`` when stripped.

    A part begins at the start of the text or after a blank line, with a character other than a newline; so a
    text that begins with one newline loses its first part. Without any part, a text that is not blank is one.
    """
    out, at = [], 0
    for gap in [*_GAP.finditer(text), None]:
        stop = gap.start() if gap else len(text)
        begin = at
        at = gap.end() if gap else stop
        if gap is None and stop - begin > 1 and text[-1] == "\n":
            stop -= 1  # the newline that ends the text is no part of it
        part = text[begin:stop]
        if not part or part[0] == "\n" or len(part.strip()) < min_chars:
            continue
        out.append((len(out), f"seg-{len(out) + 1}", part, begin, stop))
    if not out and text.strip():
        return [(0, "seg-1", text, 0, len(text))]
    return out


def paragraphs(df: DataFrame, key: str, text: str, min_chars: int = 1) -> DataFrame:
    """(key, seg_idx, seg_id, text, start, end) of each paragraph."""
    return _spread(df, key, text, lambda t: paragraph_spans(t, min_chars), SEGMENT)


def fixed_windows(df: DataFrame, key: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """(key, seg_idx, seg_id, text, start, end) of windows of ``size`` characters that overlap by ``overlap``.

    Blank windows are left out and not counted; the first other window that reaches the end is the last.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to less than size")
    step = size - overlap
    rows = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(key), F.col(text).alias("_t"), F.length(text).alias("_n"))
    # windows that start where an earlier one has reached the end are left out: they are within it
    stop = F.greatest(F.lit(0), F.col("_n") - F.lit(overlap) - 1)
    made = F.transform(F.sequence(F.lit(0), stop, F.lit(step)), lambda s: F.struct(F.substr(F.col("_t"), s + 1, F.lit(size)).alias("text"), s.cast("int").alias("start"), F.least(s + size, F.col("_n")).cast("int").alias("end")))
    kept = F.filter(made, lambda w: F.length(strip(w["text"])) > 0)
    out = rows.select(key, F.posexplode(kept).alias("seg_idx", "w"))
    return out.select(key, "seg_idx", F.concat(F.lit("seg-"), (F.col("seg_idx") + 1).cast("string")).alias("seg_id"), "w.text", "w.start", "w.end")


def locate(claim: Column, segment: Column, start: Column) -> tuple[Column, Column]:
    """(start, end) of the first place of a claim in a segment, case ignored; nulls if it is not there."""
    at = F.position(F.lower(claim), F.lower(segment))
    begin = F.when(at > 0, start + at - 1)
    return begin, begin + F.length(claim)


def shift_spans(units: DataFrame, by: Column) -> DataFrame:
    """Units with the spans moved by the start of their segment (those of evidence stay)."""
    moved = F.transform("spans", lambda s: s.withField("start", s["start"] + by).withField("end", s["end"] + by))
    return units.withColumn("spans", moved)
