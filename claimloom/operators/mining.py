"""Mining graphs from texts: split, extract, merge, relate, with a plain miner to fall back on."""

from __future__ import annotations

import asyncio
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import model_hooks as models
from claimloom.operators.reconcile import MergePolicy, Reconciled, merge_claims, merge_equal, merge_relations, merge_units, unit_map
from claimloom.operators.segments import locate, paragraphs, sentence_claims, shift_spans
from claimloom.operators.validate import graph_errors
from claimloom.session import cut
from claimloom.sources.graph_json import decode_graphs


class Miner(Protocol):
    """Claims of texts: (key, ord, unit_id, text, type, start, end)."""

    def __call__(self, df: DataFrame, key: str, text: str) -> DataFrame: ...


class Splitter(Protocol):
    """Segments of texts: (key, seg_idx, seg_id, text, start, end)."""

    def __call__(self, df: DataFrame, key: str, text: str) -> DataFrame: ...


class Reconciler(Protocol):
    """One graph per document from those of its segments."""

    def __call__(self, segments: DataFrame, graphs: DataFrame, units: DataFrame, relations: DataFrame) -> Reconciled: ...


SEGMENTS = "array<struct<seg_id: string, text: string, start: int, end: int, metadata: string>>"


def parse_segments(raw: str | None) -> list[dict]:
    """Segments of an answer that is a JSON list of objects with a text; ids, starts, ends and metadata (as JSON) are filled in."""
    try:
        items = json.loads(raw or "")
    except ValueError:
        return []
    found = [i for i in items if isinstance(i, dict) and isinstance(i.get("text"), str)] if isinstance(items, list) else []
    return [
        {"seg_id": str(i.get("id", f"seg-{n}")), "text": i["text"], "start": int(i.get("start", 0)), "end": int(i.get("end", len(i["text"]))), "metadata": json.dumps(i.get("metadata", {}))}
        for n, i in enumerate(found, 1)
    ]


def model_splitter(client: Callable[[], models.Client] | models.Client, otherwise: Splitter = paragraphs) -> Splitter:
    """A splitter that asks a model; texts whose answer holds no segments are cut by ``otherwise``."""

    def split(df: DataFrame, key: str, text: str) -> DataFrame:
        asked = models.ask(df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), models.rendered("segments", input=F.col(text)).alias("prompt")), "prompt", client)
        # a model is asked once, whatever is read from its answers
        answers = cut(models.parsed(asked, parse_segments, SEGMENTS, "x").select(key, "_text", "x"))
        named = answers.select(key, F.posexplode("x").alias("seg_idx", "s")).select(key, "seg_idx", "s.seg_id", "s.text", "s.start", "s.end")
        rest = otherwise(answers.where("size(x) = 0 or x is null").select(key, F.col("_text").alias(text)), key, text)
        return named.unionByName(rest.select(*named.columns))

    return split


def parse_graph(raw: str | None, doc_id: str | None = None) -> tuple[dict | None, list[str]]:
    """(graph, []) of an answer that holds a valid graph, else (None, messages). A doc_id replaces that of all spans of units."""
    data = models.tolerant_json((raw or "").strip())
    if not isinstance(data, dict):
        return None, ["payload must be an object"]
    if errors := graph_errors(data):
        return None, errors
    if doc_id:
        for unit in data["units"].values():
            for span in unit.get("spans") or []:
                if isinstance(span, dict):
                    span["doc_id"] = doc_id
    return data, []


def simple_miner(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, unit_id, text, type, start, end): one claim per sentence."""
    return sentence_claims(df, key, text).select(key, "ord", F.col("claim_id").alias("unit_id"), "text", F.lit("other").alias("type"), "start", "end")


def hooked_miner(df: DataFrame, key: str, text: str, client: Callable[[], models.Client] | models.Client) -> DataFrame:
    """(key, response, graph, errors, fallback) of each text: the model's graph as JSON, or null with the messages.

    The key names the document in the spans. Texts with ``fallback`` are to be mined by :func:`simple_miner`, as
    :func:`miner_of` does; their raw answer is kept up to 500 characters.
    """
    asked = models.ask(df.select(key, models.rendered("graph", input=F.col(text)).alias("prompt")), "prompt", client)

    @F.pandas_udf("string")
    def read(raw: pd.Series, name: pd.Series) -> pd.Series:
        parsed = (parse_graph(r, n) for r, n in zip(raw, name, strict=True))
        return pd.Series([json.dumps({"graph": None if g is None else json.dumps(g), "errors": e}) for g, e in parsed], dtype=object)

    out = asked.withColumn("x", F.from_json(read("response", F.col(key).cast("string")), "graph string, errors array<string>"))
    failed = F.col("x.graph").isNull()
    return out.select(key, F.when(failed, F.substring("response", 1, 500)).alias("response"), "x.graph", "x.errors", failed.alias("fallback"))


def miner_of(client: Callable[[], models.Client] | models.Client, fallback: Miner = simple_miner) -> Miner:
    """A miner that takes the units of the model's graph, or those of ``fallback`` where its answer holds no valid one."""

    def mine(df: DataFrame, key: str, text: str) -> DataFrame:
        answers = cut(hooked_miner(df, key, text, client))
        names = decode_graphs(answers.where("not fallback"), key, "graph").units
        span = F.get("spans", F.lit(0))
        found = names.select(F.col("graph_id").alias("_k"), "ord", "unit_id", "text", "type", span["start"].alias("start"), span["end"].alias("end"))
        found = found.join(df.select(key, F.col(key).cast("string").alias("_k")).dropDuplicates(), "_k").select(key, "ord", "unit_id", "text", "type", "start", "end")
        rest = df.join(answers.where("fallback").select(key).dropDuplicates(), key, "left_semi")
        return found.unionByName(fallback(rest, key, text))

    return mine


def mine_long(df: DataFrame, key: str, text: str, splitter: Splitter = paragraphs, policy: MergePolicy = MergePolicy(), miner: Miner = simple_miner) -> DataFrame:
    """Merged claims of long texts: (doc_id, new_id, text, source_unit_ids, spans, segments): split, mine each segment, move its spans to the text, merge."""
    cut_up = splitter(df, key, text).select(F.col(key).alias("doc_id"), F.col("seg_idx").alias("seg_ord"), F.col("seg_id").alias("segment_id"), "text", F.col("start").alias("shift"))
    # the place of a segment travels as its key: what is mined needs no join to find it again
    place = cut_up.select("doc_id", "seg_ord", "segment_id", "shift").schema
    keyed = cut_up.where("doc_id is not null").select(F.to_json(F.struct(*place.names)).alias("_seg"), "text")
    mined = miner(keyed, "_seg", "text").withColumn("_p", F.from_json("_seg", place))
    units = mined.select(
        "_p.doc_id", "_p.seg_ord", "_p.segment_id", "unit_id", "ord", "text", "type", F.array().cast("array<string>").alias("evidence_ids"),
        F.lit(None).cast("double").alias("evidence_min"), F.lit(None).cast("double").alias("evidence_max"), F.array(F.struct("start", "end")).alias("spans"), F.col("_p.shift").alias("_shift"),
    )
    units = shift_spans(units, F.col("_shift")).drop("_shift")
    if policy.similarity is None:
        return merge_equal(units, policy)
    units = cut(units)
    mapping = cut(unit_map(units, policy))
    segments = mapping.groupBy("doc_id", "new_id").agg(F.count_distinct("segment_id").alias("segments"))
    return merge_units(units, mapping).join(segments, ["doc_id", "new_id"])


async def mine_long_async(df: DataFrame, key: str, text: str, **how: object) -> DataFrame:
    """As :func:`mine_long`, worked out in a thread of its own and written down, so that several can be under way at once.

    Within one, segments are mined side by side by Spark's tasks, and a client with a coroutine has a batch's prompts out at once.
    """
    return await asyncio.to_thread(lambda: cut(mine_long(df, key, text, **how)))


class Mined(NamedTuple):
    """units: (doc_id, unit_id, text, type, start, end, llm_fallback); relations: (doc_id, src, dst, kind, rationale);
    documents: (doc_id, metadata), the JSON of ``mining`` with trace, segments and merge_summary."""

    units: DataFrame
    relations: DataFrame
    documents: DataFrame


@dataclass(frozen=True)
class Pipeline:
    """Split, extract claims by a model, merge, relate by a model.

    Documents without any claim fall back to sentences, unless ``allow_fallback`` is off.
    """

    client: Callable[[], models.Client] | models.Client
    relation_client: Callable[[], models.Client] | models.Client | None = None
    splitter: Splitter = paragraphs
    threshold: float = 0.92
    allow_fallback: bool = True
    fallback: Miner = simple_miner

    def segments(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(doc_id, segment_id, seg_ord, seg_text, seg_start, claims) with the claims that the model names, null where its answer has no list."""
        rows = self.splitter(df, key, text).select(F.col(key).alias("doc_id"), F.col("seg_id").alias("segment_id"), F.col("seg_idx").alias("seg_ord"), F.col("text").alias("seg_text"), F.col("start").alias("seg_start"))
        asked = models.ask(rows.withColumn("prompt", models.rendered("claims", input=F.col("seg_text"))), "prompt", self.client)
        return models.parsed(asked, models.parse_claims, "array<struct<text: string, type: string>>", "claims").drop("prompt", "response")

    @staticmethod
    def claims(segments: DataFrame) -> DataFrame:
        """(doc_id, segment_id, seg_ord, ord, claim_id, text, type, start, end) from :meth:`segments`."""
        out = segments.select("doc_id", "segment_id", "seg_ord", "seg_text", "seg_start", F.posexplode("claims").alias("ord", "c")).select("*", "c.text", "c.type")
        start, end = locate(F.col("text"), F.col("seg_text"), F.col("seg_start"))
        return out.select("doc_id", "segment_id", "seg_ord", "ord", F.concat(F.lit("c"), (F.col("ord") + 1).cast("string")).alias("claim_id"), "text", "type", start.alias("start"), end.alias("end"))

    def run(self, df: DataFrame, key: str, text: str) -> Mined:
        # a model is asked once, whatever is read from its answers
        segments = cut(self.segments(df, key, text))
        claims = self.claims(segments)
        merged = cut(merge_claims(claims, threshold=self.threshold))
        kept = cut(claims.join(merged.where("not merged"), ["doc_id", "segment_id", "claim_id"]))
        known = F.when(F.col("type").isin("fact", "value", "policy"), F.col("type")).otherwise("other")
        units = kept.select("doc_id", F.col("new_id").alias("unit_id"), "text", known.alias("type"), "start", "end", F.lit(False).alias("llm_fallback"))
        line = F.format_string("- %s (%s) [%s]: %s", "new_id", "type", "segment_id", "text")
        w = F.regexp_extract("new_id", "([0-9]+)$", 1).cast("int")
        lists = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(w.alias("n"), line.alias("l")))), lambda x: x["l"]), "\n").alias("claims"))
        prompts = lists.select("doc_id", models.rendered("relations", claims=F.col("claims")).alias("prompt"))
        schema = "listed boolean, relations array<struct<src: string, dst: string, kind: string, rationale: string>>"
        answers = cut(models.parsed(models.ask(prompts, "prompt", self.relation_client or self.client), models.listed_relations, schema, "x").select("doc_id", "x.*"))
        found = answers.select("doc_id", F.posexplode("relations").alias("n", "r")).select("doc_id", "n", "r.*")
        for end in ("src", "dst"):
            found = found.join(units.select("doc_id", F.col("unit_id").alias(end)), ["doc_id", end], "left_semi")
        found = cut(found)
        documents = self._documents(df.select(F.col(key).alias("doc_id")).dropDuplicates(), segments, merged, answers, found)
        if self.allow_fallback:
            bare = df.withColumnRenamed(key, "doc_id").join(claims.select("doc_id").dropDuplicates(), "doc_id", "left_anti")
            units = units.unionByName(self.fallback(bare, "doc_id", text).select("doc_id", "unit_id", "text", "type", "start", "end", F.lit(True).alias("llm_fallback")))
        return Mined(units, found.select("doc_id", "src", "dst", "kind", "rationale"), documents)

    def _documents(self, ids: DataFrame, segments: DataFrame, merged: DataFrame, answers: DataFrame, found: DataFrame) -> DataFrame:
        """(doc_id, metadata): what was done with each document, as it was done."""
        said = F.concat("segment_id", F.when(F.col("claims").isNull(), ": claim parse failed").otherwise(F.concat(F.lit(": claims "), F.size("claims").cast("string"))))
        in_order = lambda rows, at: F.transform(F.array_sort(F.collect_list(F.struct(at, rows.alias("v")))), lambda x: x["v"])
        s = segments.groupBy("doc_id").agg(in_order(said, "seg_ord").alias("lines"), in_order(F.col("segment_id"), "seg_ord").alias("names"))
        # claims of segments have ids of their segment: of claims with one id, the last counts
        last = merged.join(segments.select("doc_id", "segment_id", "seg_ord"), ["doc_id", "segment_id"])
        m = last.groupBy("doc_id", "claim_id").agg(F.max_by("new_id", "seg_ord").alias("new_id"), F.count_if("merged").alias("merged"), F.count_if(~F.col("merged")).alias("kept"))
        m = m.groupBy("doc_id").agg(F.sum("merged").alias("merged"), F.sum("kept").alias("kept"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("claim_id", "new_id")))).alias("mapping"))
        r = answers.select("doc_id", "listed").join(found.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
        t = ids.join(s, "doc_id", "left").join(m, "doc_id", "left").join(r, "doc_id", "left")
        number = lambda x: F.coalesce(x, F.lit(0)).cast("string")
        none = F.array().cast("array<string>")
        head = F.concat(F.array(F.concat(F.lit("segments: "), F.coalesce(F.size("names"), F.lit(0)).cast("string"))), F.coalesce("lines", none))
        bare = F.col("mapping").isNull()
        gone = F.lit(self.allow_fallback) & bare
        more = F.concat(
            F.array(F.concat(F.lit("claims: "), number("kept"), F.lit(" (merged "), number("merged"), F.lit(")"))),
            F.when(F.coalesce("listed", F.lit(True)), none).otherwise(F.array(F.lit("relations parse failed"))), F.array(F.concat(F.lit("relations: "), number("n"))),
        )
        trace = F.concat(head, F.when(gone, F.array(F.lit("no claims from llm; fallback miner"))).otherwise(more))
        full = F.struct(trace.alias("trace"), F.coalesce("names", none).alias("segments"), F.struct(F.coalesce("merged", F.lit(0)).alias("merged"), F.coalesce("mapping", F.create_map().cast("map<string, string>")).alias("mapping")).alias("merge_summary"))
        short = F.struct(trace.alias("trace"), F.lit(True).alias("llm_fallback"))
        return t.select("doc_id", F.when(gone, F.to_json(F.struct(short.alias("mining")))).otherwise(F.to_json(F.struct(full.alias("mining")))).alias("metadata"))


def pipeline_of(client: Callable[[], models.Client] | models.Client, relation_client: Callable[[], models.Client] | models.Client | None = None, splitter: Splitter | None = None, threshold: float = 0.92) -> Pipeline:
    """A pipeline with paragraphs where no splitter is given, and one client for both questions where no second is."""
    return Pipeline(client, relation_client, splitter or paragraphs, threshold)


def mine_and_reconcile(units: DataFrame, relations: DataFrame, policy: MergePolicy = MergePolicy()) -> tuple[DataFrame, DataFrame]:
    """Merged units and relations of graphs that carry doc_id, segment_id and seg_ord."""
    mapping = unit_map(units, policy)
    return merge_units(units, mapping), merge_relations(relations, mapping, policy)
