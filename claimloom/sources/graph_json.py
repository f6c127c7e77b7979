"""Graphs as JSON: decoding into the corpus tables, encoding back, and files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.corpus import SCHEMAS, Corpus
from claimloom.operators.validate import payload_violations, require_valid

_COLLECTION = {"units": ("units", "unit_id"), "warrants": ("warrants", "warrant_id"), "evidence_cards": ("evidence_cards", "card_id"), "supporting_documents": ("supporting_documents", "doc_id"), "bundles": ("argument_bundles", "bundle_id")}
_KNOWN_FLAGS = ("gate_disabled", "gate_restricted", "gate_action", "confidence")
_SPAN_FIELDS = ("doc_id", "start", "end", "text", "page", "bbox", "modality")
PARTS = "graph_id string, part string, at int, row string"


def _json(value: object) -> str | None:
    return None if value is None else json.dumps(value)


def _span(d: dict) -> dict:
    return {f: d.get(f) for f in _SPAN_FIELDS} | {"modality": d.get("modality", "text")}


def _evidence(item: object) -> dict | None:
    """An item as read: its source is a span if tagged so or if it names a doc_id, else structured JSON."""
    if not isinstance(item, dict):
        return None
    source = item.get("source")
    tag = source.get("type") if isinstance(source, dict) else None
    value = source.get("value") if tag in ("text_span", "structured") else source
    is_span = isinstance(value, dict) and (tag == "text_span" or (tag is None and "doc_id" in value))
    made = {"kind": "text_span", "span": _span(value), "structured": None} if is_span else {"kind": "structured", "span": None, "structured": _json(value)}
    return {"id": item.get("id"), "source": made, "stance": item.get("stance"), "strength": item.get("strength"), "quality": _json(item.get("quality", {}))}


def _node(d: dict, id_name: str) -> dict:
    out = {k: d.get(k) for k in ("text", "evidence_min", "evidence_max", "score")}
    out |= {"type": d.get("type", "other"), "is_axiom": bool(d.get("is_axiom", False)), "ignore_influence": bool(d.get("ignore_influence", False))}
    out |= {"spans": [_span(s) for s in d.get("spans") or [] if isinstance(s, dict)], "evidence": [_evidence(e) for e in d.get("evidence") or []], "evidence_ids": d.get("evidence_ids") or []}
    return out | {id_name: d.get("id"), "metadata": _json(d.get("metadata", {}))}


def _relation(d: dict) -> dict:
    meta = d.get("metadata") or {}
    flags = {"gate_disabled": bool(meta.get("gate_disabled", False)), "gate_restricted": bool(meta.get("gate_restricted", False)), "gate_action": meta.get("gate_action"), "confidence": meta.get("confidence")}
    rest = {k: v for k, v in meta.items() if k not in _KNOWN_FLAGS}
    return {k: d.get(k) for k in ("src", "dst", "kind", "weight", "rationale")} | {"warrant_ids": d.get("warrant_ids") or [], "gate_mode": d.get("gate_mode", "OR"), "metadata": _json(rest)} | flags


def _plain(d: dict, id_name: str, fields: tuple[str, ...]) -> dict:
    return {f: d.get(f) for f in fields} | {id_name: d.get("id"), "metadata": _json(d.get("metadata"))}


def graph_rows(data: dict) -> Iterator[tuple[str, int, dict]]:
    """(table, place, row) of each entry of a decoded graph, with the defaults of missing fields."""
    yield "graphs", 0, {"metadata": _json(data.get("metadata") or {})}
    for table, (name, id_name) in _COLLECTION.items():
        for at, entry in enumerate((data.get(name) or {}).values()):
            if table in ("units", "warrants"):
                row = _node(entry, id_name)
            elif table == "evidence_cards":
                row = _plain(entry, id_name, ("title", "supporting_doc_id", "excerpt", "confidence"))
            elif table == "supporting_documents":
                row = _plain(entry, id_name, ("name", "type", "url", "trust", "size", "upload_date", "uploader"))
            else:
                row = _plain(entry, id_name, ()) | {"units": entry.get("units") or [], "relations": _json(entry.get("relations") or [])}
            yield table, at, row | {"ord": at}
    for at, entry in enumerate(data.get("relations") or []):
        yield "relations", at, _relation(entry) | {"edge_idx": at}
    for at, entry in enumerate(data.get("warrant_attacks") or []):
        yield "warrant_attacks", at, {"attack_idx": at, "kind": entry.get("kind", "attack"), "metadata": _json(entry.get("metadata", {}))} | {f: entry.get(f) for f in ("src", "warrant_id", "rationale")}


def decoded_parts(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(graph_id, part, at, row): the entries of all payloads that are complete JSON objects, each as JSON, with its table's name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                try:
                    data = json.loads(t)
                    rows += [(str(k), table, at, json.dumps(row)) for table, at, row in graph_rows(data)]
                except (TypeError, ValueError, AttributeError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["graph_id", "part", "at", "row"])

    return payloads.where(F.col(payload).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(payload).alias("t")).mapInPandas(run, PARTS)


def table_of(parts: DataFrame, name: str) -> DataFrame:
    """One table of the corpus from :func:`decoded_parts`."""
    rows = parts.where(F.col("part") == name).select("graph_id", F.from_json("row", SCHEMAS[name]).alias("x"))
    names = [f.name for f in parts.sparkSession.createDataFrame([], SCHEMAS[name]).schema]
    return rows.select(*[F.col("graph_id" if n == "graph_id" else f"x.{n}") for n in names])


def decode_graphs(payloads: DataFrame, key: str, payload: str, validate: bool = False) -> Corpus:
    """The corpus of all payloads that are complete JSON objects; ``key`` becomes graph_id.

    With ``validate``, any payload with a violated rule is refused (the first messages are in the error).
    """
    if validate:
        bad = [tuple(r) for r in payload_violations(payloads, key, payload).limit(10).collect()]
        if bad:
            raise ValueError("Invalid graph payload:\n" + "\n".join(f"- {k}: {m}" for k, _, m in bad))
    parts = decoded_parts(payloads, key, payload)
    return Corpus(**{name: table_of(parts, name) for name in SCHEMAS})


def read_graphs(spark: SparkSession, path: str, validate: bool = False) -> Corpus:
    """Graph files (one JSON graph each) of a path or glob; graph_id is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("graph_id"), "value")
    return decode_graphs(files, "graph_id", "value", validate)


def _variant(text: Column) -> Column:
    return F.try_parse_json(F.coalesce(text, F.lit("{}")))


def _node_struct(id_name: str, bounds: bool) -> Column:
    span = lambda s: F.struct(*[s[f].alias(f) for f in sorted(_SPAN_FIELDS)])
    tag = lambda e: F.when(e["source"]["span"].isNotNull(), F.to_variant_object(F.struct(F.lit("text_span").alias("type"), span(e["source"]["span"]).alias("value")))).otherwise(
        F.try_parse_json(F.concat(F.lit('{"type": "structured", "value": '), F.coalesce(e["source"]["structured"], F.lit("null")), F.lit("}")))
    )
    ev = F.transform("evidence", lambda e: F.struct(e["id"].alias("id"), _variant(e["quality"]).alias("quality"), tag(e).alias("source"), e["stance"].alias("stance"), e["strength"].alias("strength")))
    fields = [F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), F.coalesce("ignore_influence", F.lit(False)).alias("ignore_influence"), F.coalesce("is_axiom", F.lit(False)).alias("is_axiom")]
    more = [F.col("evidence_max"), F.col("evidence_min")] if bounds else []
    return F.struct(ev.alias("evidence"), *fields, *more, F.col(id_name).alias("id"), _variant(F.col("metadata")).alias("metadata"), F.col("score"), F.transform("spans", span).alias("spans"), F.col("text"), F.coalesce("type", F.lit("other")).alias("type"))


def relation_struct() -> Column:
    meta = F.to_json(F.struct(F.when(F.col("gate_disabled"), True).alias("gate_disabled"), F.when(F.col("gate_restricted"), True).alias("gate_restricted"), F.col("gate_action"), F.col("confidence")))
    # the promoted keys go back into the metadata
    own = F.coalesce("metadata", F.lit("{}"))
    joined = F.when(meta == "{}", own).when(own.rlike(r"^\s*\{\s*\}\s*$"), meta).otherwise(F.concat(F.regexp_replace(own, r"\}\s*$", ","), F.substr(meta, F.lit(2))))
    return F.struct("dst", F.coalesce("gate_mode", F.lit("OR")).alias("gate_mode"), "kind", _variant(joined).alias("metadata"), "rationale", "src", F.coalesce("warrant_ids", F.array().cast("array<string>")).alias("warrant_ids"), "weight")


def encode_graphs(c: Corpus) -> DataFrame:
    """(graph_id, payload): one JSON text per graph with sorted keys, fields that are null included.

    A graph is one row here and must fit in memory as such; it is what the format asks for.
    """
    text = lambda x: F.to_json(x, {"ignoreNullFields": "false"})

    def keyed(df: DataFrame, id_name: str, struct: Column, name: str) -> DataFrame:
        entry = F.concat(F.regexp_replace(F.to_json(F.array(id_name)), r"^\[|\]$", ""), F.lit(": "), text(struct))
        return df.select("graph_id", F.col(id_name).alias("_k"), entry.alias("_e")).groupBy("graph_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_e"))), lambda x: x["_e"]), ", "), F.lit("}")).alias(name))

    def listed(df: DataFrame, at: str, struct: Column, name: str) -> DataFrame:
        return df.select("graph_id", F.col(at).alias("_k"), text(struct).alias("_e")).groupBy("graph_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_e"))), lambda x: x["_e"]), ", "), F.lit("]")).alias(name))

    meta = _variant(F.col("metadata")).alias("metadata")
    inside = c.bundles.select("graph_id", "bundle_id", "ord", "metadata", "relations", "units")
    parts = [
        keyed(inside, "bundle_id", F.struct(F.col("bundle_id").alias("id"), meta, F.try_parse_json(F.coalesce("relations", F.lit("[]"))).alias("relations"), "units"), "argument_bundles"),
        keyed(c.evidence_cards, "card_id", F.struct("confidence", "excerpt", F.col("card_id").alias("id"), meta, "supporting_doc_id", "title"), "evidence_cards"),
        listed(c.relations, "edge_idx", relation_struct(), "relations"),
        keyed(c.supporting_documents, "doc_id", F.struct(F.col("doc_id").alias("id"), meta, "name", "size", "trust", "type", "upload_date", "uploader", "url"), "supporting_documents"),
        keyed(c.units, "unit_id", _node_struct("unit_id", True), "units"),
        listed(c.warrant_attacks, "attack_idx", F.struct("kind", meta, "rationale", "src", "warrant_id"), "warrant_attacks"),
        keyed(c.warrants, "warrant_id", _node_struct("warrant_id", False), "warrants"),
    ]
    out = parts[0].select("graph_id")
    for p in parts[1:]:
        out = out.unionByName(p.select("graph_id"))
    out = out.unionByName(c.graphs.select("graph_id")).dropDuplicates()
    own = c.graphs.select("graph_id", F.to_json(F.try_parse_json(F.coalesce("metadata", F.lit("{}")))).alias("_metadata"))
    for p in [*parts, own]:
        out = out.join(p, "graph_id", "left")
    empty = {"argument_bundles": "{}", "evidence_cards": "{}", "relations": "[]", "supporting_documents": "{}", "units": "{}", "warrant_attacks": "[]", "warrants": "{}"}
    fields = [F.concat(F.lit(f'"{n}": '), F.coalesce(n, F.lit(e))) for n, e in empty.items()]
    fields.insert(2, F.concat(F.lit('"metadata": '), F.coalesce("_metadata", F.lit("{}"))))
    return out.select("graph_id", F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")).alias("payload"))


def write_graphs(c: Corpus, path: str) -> None:
    """One line of JSON per graph, as text files below ``path``."""
    encode_graphs(c).select(F.col("payload").alias("value")).write.mode("overwrite").text(path)


def dumps(data: dict, indent: int = 2) -> str:
    return json.dumps(data, indent=indent, sort_keys=True)


def loads(text: str, validate: bool = False) -> dict:
    """One graph as decoded JSON, checked if asked for."""
    data = json.loads(text)
    if validate:
        require_valid(data)
    return data
