"""Lexical checks of evidence and edges by the overlap of their words."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import token_overlap, word_tokens


def evidence_verdict(overlap: Column) -> list[Column]:
    """evaluation, confidence and reasoning for the overlap of a claim and its evidence."""
    # The bounds and the reasons.
    high, low = overlap >= 0.35, overlap <= 0.05
    return [
        F.when(~high & low, "neutral").otherwise("supports").alias("evaluation"),
        F.when(high, F.least(F.lit(1.0), overlap)).when(low, 0.0).otherwise(overlap * 0.5).alias("confidence"),
        F.when(high, "High lexical overlap suggests support.").when(low, "Low lexical overlap suggests neutrality.").otherwise("Moderate overlap suggests weak support.").alias("reasoning"),
    ]


def edge_verdict(overlap: Column) -> list[Column]:
    """evaluation, confidence and reasoning for the overlap of an edge's claims; never attack."""
    # The bounds and the reasons.
    high, low = overlap >= 0.4, overlap <= 0.05
    return [
        F.when(~high & low, "neutral").otherwise("support").alias("evaluation"),
        F.when(high, F.least(F.lit(1.0), overlap)).when(low, 0.0).otherwise(overlap * 0.5).alias("confidence"),
        F.when(high, "Claims share key terms, indicating support.").when(low, "Little overlap; relation is unclear.").otherwise("Some overlap suggests weak support.").alias("reasoning"),
    ]


def python_repr(structured: Column) -> Column:
    """What Python prints for a JSON value, nested ones too; null, and text that is no JSON, stay as they are."""

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return str(json.loads(text)) if text is not None else None
            except (ValueError, RecursionError):
                return text

        return texts.map(one)

    return shown(structured)


def _named_text(data: Column) -> Column:
    """The text of a structured source, else its excerpt; empty ones count as none."""
    pick = lambda f: F.nullif(F.get_json_object(data, f"$.{f}"), F.lit(""))
    return F.coalesce(pick("text"), pick("excerpt"))


def evidence_text(item: Column, shown: Column | None = None) -> Column:
    """Text of an evidence item: that of its span, or of a structured source its text, its excerpt, or the whole source as ``shown``."""
    source = item["source"]
    named = F.coalesce(_named_text(source["structured"]), source["structured"] if shown is None else shown)
    return F.when(source["span"].isNotNull(), source["span"]["text"]).otherwise(named)


def _shown_items(units: DataFrame) -> DataFrame:
    """(graph_id, unit_id, pos, item, words): each inline item and the words of its text.

    Only sources that have neither text nor excerpt go through Python, which prints them.
    """
    rows = units.select("graph_id", "unit_id", F.posexplode("evidence").alias("pos", "item")).where("item is not null")
    data = F.col("item.source.structured")
    bare = F.when(F.col("item.source.span").isNull() & _named_text(data).isNull(), data)
    text = evidence_text(F.col("item"), F.col("_shown"))
    return rows.withColumn("_shown", python_repr(bare)).select("graph_id", "unit_id", "pos", "item", word_tokens(F.coalesce(text, F.lit(""))).alias("words"))


def evaluate_evidence(units: DataFrame) -> DataFrame:
    """(graph_id, unit_id, pos, evidence_id, evaluation, confidence, reasoning) of every inline item of every unit.

    Null items are left out; a null text has no words.
    """
    own = units.select("graph_id", "unit_id", word_tokens(F.coalesce("text", F.lit(""))).alias("_t"))
    rows = _shown_items(units).join(own, ["graph_id", "unit_id"])
    return rows.withColumn("_o", token_overlap(F.col("_t"), F.col("words"))).select("graph_id", "unit_id", "pos", F.col("item.id").alias("evidence_id"), *evidence_verdict(F.col("_o")))


def score_evidence(units: DataFrame) -> DataFrame:
    """Units whose inline items carry the verdict: strength is its confidence, stance its evaluation."""
    own = units.select("graph_id", "unit_id", word_tokens(F.coalesce("text", F.lit(""))).alias("_t"))
    rows = _shown_items(units).join(own, ["graph_id", "unit_id"]).withColumn("_o", token_overlap(F.col("_t"), F.col("words")))
    verdict = evidence_verdict(F.col("_o"))
    found = rows.select("graph_id", "unit_id", F.struct("pos", verdict[0], verdict[1]).alias("v")).groupBy("graph_id", "unit_id").agg(F.map_from_entries(F.collect_list(F.struct("v.pos", "v"))).alias("_v"))

    def judged(item: Column, i: Column) -> Column:
        v = F.try_element_at("_v", i)
        return F.when(item.isNotNull(), item.withField("strength", v["confidence"]).withField("stance", v["evaluation"]))

    return units.join(found, ["graph_id", "unit_id"], "left").withColumn("evidence", F.when(F.col("_v").isNull(), F.col("evidence")).otherwise(F.transform("evidence", judged))).select(*units.columns)


def edge_checks(units: DataFrame, relations: DataFrame) -> DataFrame:
    """(graph_id, edge_idx, src, dst, evaluation, confidence, reasoning) of edges with both ends known."""
    t = units.select("graph_id", "unit_id", word_tokens(F.coalesce("text", F.lit(""))).alias("_t"))
    rows = relations.select("graph_id", "edge_idx", "src", "dst")
    rows = rows.join(t.select("graph_id", F.col("unit_id").alias("src"), F.col("_t").alias("_a")), ["graph_id", "src"])
    rows = rows.join(t.select("graph_id", F.col("unit_id").alias("dst"), F.col("_t").alias("_b")), ["graph_id", "dst"])
    return rows.withColumn("_o", token_overlap(F.col("_a"), F.col("_b"))).select("graph_id", "edge_idx", "src", "dst", *edge_verdict(F.col("_o")))


def validate_edges(units: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with the verdict written back: confidence, rationale, and the kind where the evaluation names one."""
    v = edge_checks(units, relations).select("graph_id", "edge_idx", F.col("evaluation").alias("_e"), F.col("confidence").alias("_c"), F.col("reasoning").alias("_r"))
    out = relations.join(v, ["graph_id", "edge_idx"], "left")
    new = {"confidence": F.coalesce("_c", "confidence"), "rationale": F.coalesce("_r", "rationale"), "kind": F.when(F.col("_e").isin("support", "attack"), F.col("_e")).otherwise(F.col("kind"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in relations.columns])
