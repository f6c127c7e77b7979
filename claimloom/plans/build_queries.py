"""Queries of building up, reading, writing and checking graphs, of merging and of what models are asked, with their SQL.

What changes a corpus is applied to the current rows of the whole tables; models are stood in for by rules that SQL can follow.
"""

from __future__ import annotations

import functools
import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import corpus as building
from claimloom.operators import critique as critiques
from claimloom.operators import evaluation, mining, model_hooks, patterns, reconcile, segments, validate
from claimloom.operators.corpus import Corpus, load_corpus
from claimloom.plans.graph_queries import _A, _BLANKS, _C, _D, _FIRST, _MAP, _PAIR, _R, _U, _W, Query, _matches, _segmented, _with, r6
from claimloom.plans.graph_queries import SQL as _GRAPH_SQL
from claimloom.session import cut, scratch
from claimloom.sources import dot, graph_json
from claimloom.sources.tables import read_table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- building up


def _claim_rows(spark: SparkSession, d: str) -> DataFrame:
    """Extracted claims as claims of a hundred graphs: (graph_id, unit_id, ord, text, type)."""
    c = read_table(spark, d, "extracted_claims").groupBy("claim_id").agg(F.min("text").alias("text"), F.min("type").alias("type"))
    return c.select(F.concat(F.lit("n"), F.right("claim_id", F.lit(2))).alias("graph_id"), F.concat(F.lit("c"), F.substr("claim_id", F.lit(4))).alias("unit_id"), F.substr("claim_id", F.lit(4)).cast("int").alias("ord"), "text", "type")


@_query
def built_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims added under their ids, some again with another text, and facts added once more with ids to be allocated."""
    rows = _claim_rows(spark, d)
    c = building.add_claims(building.empty_corpus(spark), rows)
    c = building.add_claims(c, rows.where("type = 'value'").withColumn("text", F.lit("changed")))
    c = building.add_claims(c, rows.where("type = 'fact'").withColumn("unit_id", F.lit(None).cast("string")))
    return c.units.select("graph_id", "unit_id", "ord", "text", "type")


_NEW = "n AS (SELECT 'n' || right(claim_id, 2) AS graph_id, 'c' || substr(claim_id, 4) AS unit_id, CAST(substr(claim_id, 4) AS INTEGER) AS ord, min(text) AS text, min(type) AS type FROM extracted_claims GROUP BY claim_id)"
SQL["built_claims"] = _with(_NEW, "top AS (SELECT graph_id, max(CAST(substr(unit_id, 2) AS BIGINT)) AS m, count(*) AS k FROM n GROUP BY graph_id)") + """
SELECT graph_id, unit_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY ord) - 1 AS INTEGER) AS ord, CASE WHEN type = 'value' THEN 'changed' ELSE text END AS text, coalesce(type, 'other') AS type FROM n
UNION ALL SELECT n.graph_id, 'c' || (m + row_number() OVER (PARTITION BY n.graph_id ORDER BY ord)), CAST(k + row_number() OVER (PARTITION BY n.graph_id ORDER BY ord) - 1 AS INTEGER), text, type FROM n JOIN top ON n.graph_id = top.graph_id WHERE type = 'fact'"""


@_query
def built_graphs(spark: SparkSession, d: str) -> DataFrame:
    """New graphs, titled by their first claim where it has a text, with metadata."""
    rows = _claim_rows(spark, d).groupBy("graph_id").agg(F.min("unit_id").alias("first"), F.min("text").alias("title")).select("graph_id", F.when(F.right("graph_id", F.lit(1)) != "3", F.col("title")).alias("title"), F.concat(F.lit('{"first": "'), "first", F.lit('"}')).alias("metadata"))
    g = building.new_graphs(building.empty_corpus(spark), rows).graphs
    return g.select("graph_id", F.get_json_object("metadata", "$.title").alias("title"), F.get_json_object("metadata", "$.first").alias("first"))


SQL["built_graphs"] = _with(_NEW) + "SELECT graph_id, CASE WHEN right(graph_id, 1) <> '3' THEN nullif(min(text), '') END AS title, min(unit_id) AS first FROM n GROUP BY graph_id"


@_query
def built_warrants(spark: SparkSession, d: str) -> DataFrame:
    """A warrant with an allocated id for every attack."""
    c = load_corpus(spark, d)
    rows = c.warrant_attacks.select("graph_id", F.lit(None).cast("string").alias("warrant_id"), F.col("attack_idx").alias("ord"), F.coalesce("rationale", F.lit("none")).alias("text"))
    return building.add_warrants(c, rows).warrants.select("graph_id", "warrant_id", "text", F.coalesce("is_axiom", F.lit(False)).alias("is_axiom"))


SQL["built_warrants"] = _with(_W, _A) + """
SELECT graph_id, warrant_id, text, coalesce(is_axiom, FALSE) AS is_axiom FROM w UNION ALL
SELECT a.graph_id, 'w' || (coalesce(m, 0) + row_number() OVER (PARTITION BY a.graph_id ORDER BY attack_idx)), coalesce(rationale, 'none'), FALSE
FROM a LEFT JOIN (SELECT graph_id, max(TRY_CAST(substr(warrant_id, 2) AS BIGINT)) AS m FROM w WHERE regexp_full_match(warrant_id, 'w[0-9]+') GROUP BY graph_id) t ON a.graph_id = t.graph_id"""


@_query
def built_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations, and one more for every attack on a warrant, from its source to the warrant's name."""
    c = load_corpus(spark, d)
    rows = c.warrant_attacks.select("graph_id", F.col("attack_idx").alias("ord"), "src", F.col("warrant_id").alias("dst"), F.lit("undercut").alias("kind"))
    return building.add_relations(c, rows).relations.select("graph_id", "edge_idx", "src", "dst", "kind", "gate_mode")


SQL["built_relations"] = _with(_R, _A) + """SELECT graph_id, edge_idx, src, dst, kind, gate_mode FROM r UNION ALL
SELECT a.graph_id, CAST(coalesce(m + 1, 0) + row_number() OVER (PARTITION BY a.graph_id ORDER BY attack_idx) - 1 AS INTEGER), src, warrant_id, 'undercut', 'OR' FROM a LEFT JOIN (SELECT graph_id, max(edge_idx) AS m FROM r GROUP BY graph_id) t ON a.graph_id = t.graph_id"""


@_query
def built_attacks(spark: SparkSession, d: str) -> DataFrame:
    """Attacks, and those on a known warrant once more, by the warrant's own name."""
    c = load_corpus(spark, d)
    rows = c.warrant_attacks.join(c.warrants, ["graph_id", "warrant_id"], "left_semi").select("graph_id", F.col("attack_idx").alias("ord"), F.col("warrant_id").alias("src"), "warrant_id")
    return building.add_warrant_attacks(c, rows).warrant_attacks.select("graph_id", "attack_idx", "src", "warrant_id", "kind")


SQL["built_attacks"] = _with(_W, _A) + """SELECT graph_id, attack_idx, src, warrant_id, kind FROM a UNION ALL
SELECT a.graph_id, CAST(m + row_number() OVER (PARTITION BY a.graph_id ORDER BY attack_idx) AS INTEGER), a.warrant_id, a.warrant_id, 'attack' FROM a JOIN (SELECT graph_id, max(attack_idx) AS m FROM a GROUP BY graph_id) t ON a.graph_id = t.graph_id
WHERE EXISTS (SELECT 1 FROM w WHERE w.graph_id = a.graph_id AND w.warrant_id = a.warrant_id)"""


@_query
def built_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each named card once more as an inline item of its unit, each in the order of its list."""
    c = load_corpus(spark, d)
    kind = c.units.schema["evidence"].dataType.elementType
    made = F.struct(F.concat(F.lit("i"), "x").alias("id"), F.lit(None).cast(kind["source"].dataType).alias("source"), F.lit("neutral").alias("stance"), F.lit(0.5).alias("strength"), F.lit(None).cast("string").alias("quality"))
    rows = c.units.select("graph_id", "unit_id", F.posexplode("evidence_ids").alias("ord", "x")).where("x is not null").withColumn("item", made)
    u = building.attach_evidence(c, rows).units
    return u.select("graph_id", "unit_id", F.array_join(F.transform(F.coalesce("evidence", F.array().cast(u.schema["evidence"].dataType)), lambda e: F.coalesce(e["id"], F.lit("-"))), ",").alias("items"))


SQL["built_evidence"] = _with(_U) + "SELECT graph_id, unit_id, array_to_string(list_concat(list_transform(coalesce(evidence, []), lambda e: coalesce(e.id, '-')), list_transform(list_filter(coalesce(evidence_ids, []), lambda x: x IS NOT NULL), lambda x: 'i' || x)), ',') AS items FROM u"


@_query
def built_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents overwritten under another name, and copies of them under a new id."""
    c = load_corpus(spark, d)
    c = building.add_unique(c, c.supporting_documents.withColumn("name", F.upper("name")), "supporting_documents", overwrite=True)
    c = building.add_unique(c, c.supporting_documents.withColumn("doc_id", F.concat(F.lit("n"), "doc_id")), "supporting_documents")
    return c.supporting_documents.select("graph_id", "doc_id", "name", "trust")


SQL["built_documents"] = _with(_D) + "SELECT graph_id, p || doc_id AS doc_id, upper(name) AS name, trust FROM d, (SELECT unnest(['', 'n']) AS p)"


@_query
def built_cards(spark: SparkSession, d: str) -> DataFrame:
    """Units after each known card of their lists is attached as evidence against them."""
    c = load_corpus(spark, d)
    named = c.units.select("graph_id", "unit_id", F.posexplode("evidence_ids").alias("ord", "card_id")).join(c.evidence_cards, ["graph_id", "card_id"], "left_semi").withColumn("stance", F.lit("attacks"))
    u = building.attach_cards(c, named.select("graph_id", "unit_id", "card_id", "ord", "stance")).units
    item = lambda e: F.concat_ws(":", e["id"], e["stance"], F.round(e["strength"], 4).cast("string"))
    return u.select("graph_id", "unit_id", F.array_join(F.transform(F.slice("evidence", 1, 50), item), ",").alias("items"), F.array_join("evidence_ids", ",").alias("ids"))


SQL["built_cards"] = _with(_U, _C, "k AS (SELECT x.graph_id, unit_id, list(x.id || ':attacks' || coalesce(':' || CAST(round(confidence, 4) AS VARCHAR), '') ORDER BY pos) AS more FROM (SELECT graph_id, unit_id, unnest(evidence_ids) AS id, generate_subscripts(evidence_ids, 1) AS pos FROM u) x JOIN c ON x.graph_id = c.graph_id AND x.id = c.card_id GROUP BY ALL)") + """
SELECT u.graph_id, u.unit_id, array_to_string(CASE WHEN evidence IS NULL AND more IS NULL THEN NULL ELSE list_concat(list_transform(coalesce(evidence, []), lambda e: concat_ws(':', e.id, e.stance, CAST(round(e.strength, 4) AS VARCHAR))), coalesce(more, [])) END, ',') AS items, array_to_string(evidence_ids, ',') AS ids
FROM u LEFT JOIN k ON u.graph_id = k.graph_id AND u.unit_id = k.unit_id"""


# ---- reading and writing


def _decoded(spark: SparkSession, d: str) -> Corpus:
    p = read_table(spark, d, "graph_payloads")
    return graph_json.decode_graphs(p.select(F.concat_ws("@", "payload_id", F.col("loaded_at").cast("string")).alias("k"), "payload"), "k", "payload")


_OBJECTS = "p AS (SELECT payload_id, j FROM (SELECT payload_id, CAST(CASE WHEN json_valid(payload) THEN payload END AS JSON) AS j FROM graph_payloads) WHERE json_type(j) = 'OBJECT')"


def _entries(name: str, alias: str) -> str:
    return f"{alias} AS (SELECT payload_id, k, json_extract(j, '$.{name}.\"' || k || '\"') AS x FROM (SELECT payload_id, j, unnest(json_keys(j, '$.{name}')) AS k FROM p WHERE json_type(j, '$.{name}') = 'OBJECT'))"


_S = lambda f: f"json_extract_string(x, '$.{f}')"
_N = lambda f: f"CAST(json_extract_string(x, '$.{f}') AS DOUBLE)"
_B = lambda f: f"coalesce(CAST(json_extract_string(x, '$.{f}') AS BOOLEAN), FALSE)"
_LEN = lambda f: f"coalesce(CAST(json_array_length(x, '$.{f}') AS INTEGER), 0)"
_JOIN = lambda f: f"coalesce(array_to_string(CAST(json_extract(x, '$.{f}') AS VARCHAR[]), ','), '')"


def _node_columns(key: str) -> list[Column]:
    own = F.substring_index("graph_id", "@", 1).alias("payload_id")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(c)
    return [own, F.col(key).alias("key"), "text", "type", size("spans"), size("evidence"), F.array_join("evidence_ids", ",").alias("evidence_ids"), "score", "is_axiom", "ignore_influence"]


@_query
def decoded_units(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d).units.select(*_node_columns("unit_id"), "evidence_min", "evidence_max")


@_query
def decoded_warrants(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d).warrants.select(*_node_columns("warrant_id"))


_NODE = f"SELECT payload_id, {_S('id')} AS key, {_S('text')} AS text, coalesce({_S('type')}, 'other') AS type, {_LEN('spans')} AS spans, {_LEN('evidence')} AS evidence, {_JOIN('evidence_ids')} AS evidence_ids, {_N('score')} AS score, {_B('is_axiom')} AS is_axiom, {_B('ignore_influence')} AS ignore_influence"
SQL["decoded_units"] = _with(_OBJECTS, _entries("units", "e")) + _NODE + f", {_N('evidence_min')} AS evidence_min, {_N('evidence_max')} AS evidence_max FROM e"
SQL["decoded_warrants"] = _with(_OBJECTS, _entries("warrants", "e")) + _NODE + " FROM e"


@_query
def decoded_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Items of units with what their source is and names."""
    u = _decoded(spark, d).units.select(F.substring_index("graph_id", "@", 1).alias("payload_id"), "unit_id", F.posexplode("evidence").alias("pos", "e")).where("e is not null")
    return u.select("payload_id", "unit_id", "pos", F.col("e.id").alias("id"), F.col("e.stance").alias("stance"), F.col("e.strength").alias("strength"), F.col("e.source.kind").alias("kind"), F.col("e.source.span.doc_id").alias("doc_id"), F.col("e.source.span.start").alias("start"), F.col("e.source.span.modality").alias("modality"), F.get_json_object("e.source.structured", "$.evidence_card_id").alias("card"))


SQL["decoded_evidence"] = _with(_OBJECTS, _entries("units", "e"), "i AS (SELECT payload_id, k, CAST(pos AS INTEGER) AS pos, json_extract(x, '$.evidence[' || pos || ']') AS x FROM (SELECT payload_id, k, x, unnest(range(CAST(json_array_length(x, '$.evidence') AS BIGINT))) AS pos FROM e WHERE json_type(x, '$.evidence') = 'ARRAY'))", f"s AS (SELECT *, {_S('source.type')} AS tag, CASE WHEN {_S('source.type')} IN ('text_span', 'structured') THEN json_extract(x, '$.source.value') ELSE json_extract(x, '$.source') END AS v FROM i WHERE json_type(x) <> 'NULL')", "t AS (SELECT *, tag = 'text_span' OR (tag IS NULL AND json_type(v) = 'OBJECT' AND list_contains(json_keys(v), 'doc_id')) AS span FROM s)") + f"""
SELECT payload_id, k AS unit_id, pos, {_S('id')} AS id, {_S('stance')} AS stance, {_N('strength')} AS strength, CASE WHEN span THEN 'text_span' ELSE 'structured' END AS kind, CASE WHEN span THEN json_extract_string(v, '$.doc_id') END AS doc_id,
  CASE WHEN span THEN CAST(json_extract_string(v, '$.start') AS INTEGER) END AS "start", CASE WHEN span THEN coalesce(json_extract_string(v, '$.modality'), 'text') END AS modality, CASE WHEN NOT coalesce(span, FALSE) THEN json_extract_string(v, '$.evidence_card_id') END AS card FROM t"""


@_query
def decoded_bundles(spark: SparkSession, d: str) -> DataFrame:
    b = _decoded(spark, d).bundles
    return b.select(F.substring_index("graph_id", "@", 1).alias("payload_id"), "bundle_id", F.array_join("units", ",").alias("units"), F.size(F.from_json("relations", "array<struct<src: string>>")).alias("relations"))


@_query
def decoded_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What graphs say of themselves: title and number of fields."""
    g = _decoded(spark, d).graphs
    return g.select(F.substring_index("graph_id", "@", 1).alias("payload_id"), F.get_json_object("metadata", "$.title").alias("title"), F.size(F.json_object_keys("metadata")).alias("fields"))


SQL["decoded_bundles"] = _with(_OBJECTS, _entries("argument_bundles", "e")) + f"SELECT payload_id, {_S('id')} AS bundle_id, {_JOIN('units')} AS units, {_LEN('relations')} AS relations FROM e"
SQL["decoded_metadata"] = _with(_OBJECTS) + "SELECT payload_id, json_extract_string(j, '$.metadata.title') AS title, CASE WHEN json_type(j, '$.metadata') = 'OBJECT' THEN CAST(len(json_keys(j, '$.metadata')) AS INTEGER) ELSE 0 END AS fields FROM p"


@_query
def exported_graphs(spark: SparkSession, d: str) -> DataFrame:
    """How many entries each part of each graph's JSON has."""
    g = graph_json.encode_graphs(load_corpus(spark, d))
    part = lambda n: F.get_json_object("payload", f"$.{n}")
    sizes = [F.struct(F.lit(n).alias("part"), F.size(F.json_object_keys(part(n))).alias("n")) for n in ("argument_bundles", "evidence_cards", "supporting_documents", "units", "warrants")]
    sizes += [F.struct(F.lit(n).alias("part"), F.json_array_length(part(n)).alias("n")) for n in ("relations", "warrant_attacks")]
    return g.select("graph_id", F.explode(F.array(*sizes)).alias("x")).select("graph_id", "x.*")


_ALL = "al AS (SELECT graph_id FROM u UNION SELECT graph_id FROM w UNION SELECT graph_id FROM r UNION SELECT graph_id FROM a UNION SELECT graph_id FROM c UNION SELECT graph_id FROM d)"
SQL["exported_graphs"] = _with(_U, _W, _R, _A, _C, _D, _ALL) + " UNION ALL ".join(f"SELECT al.graph_id, '{n}' AS part, CAST(count(t.graph_id) AS INTEGER) AS n FROM al LEFT JOIN {t} t ON al.graph_id = t.graph_id GROUP BY al.graph_id" for n, t in (("units", "u"), ("warrants", "w"), ("relations", "r"), ("warrant_attacks", "a"), ("evidence_cards", "c"), ("supporting_documents", "d"))) + " UNION ALL SELECT graph_id, 'argument_bundles', 0 FROM al"


def _round_trip(spark: SparkSession, d: str) -> Corpus:
    return graph_json.decode_graphs(graph_json.encode_graphs(load_corpus(spark, d)), "graph_id", "payload")


@_query
def exported_units(spark: SparkSession, d: str) -> DataFrame:
    """Units after encoding and decoding."""
    u = _round_trip(spark, d).units
    span = lambda s: F.concat_ws(":", s["doc_id"], s["start"].cast("string"), s["end"].cast("string"))
    item = lambda e: F.concat_ws(":", e["id"], e["stance"], F.round(e["strength"], 4).cast("string"), e["source"]["kind"], e["source"]["span"]["doc_id"])
    return u.select("graph_id", "unit_id", "text", "type", F.array_join(F.transform("spans", span), ",").alias("spans"), F.array_join(F.transform(F.filter("evidence", lambda e: e.isNotNull()), item), ",").alias("evidence"), F.array_join("evidence_ids", ",").alias("evidence_ids"), r6("evidence_min").alias("evidence_min"), r6("evidence_max").alias("evidence_max"), r6("score").alias("score"), "is_axiom")


SQL["exported_units"] = _with(_U) + """SELECT graph_id, unit_id, text, coalesce(type, 'other') AS type, coalesce(array_to_string(list_transform(list_filter(spans, lambda s: s IS NOT NULL), lambda s: concat_ws(':', s.doc_id, s.start, s.end)), ','), '') AS spans,
  coalesce(array_to_string(list_transform(list_filter(evidence, lambda e: e IS NOT NULL), lambda e: concat_ws(':', e.id, e.stance, CAST(round(e.strength, 4) AS VARCHAR), CASE WHEN e.source.span IS NOT NULL THEN 'text_span' ELSE 'structured' END, e.source.span.doc_id)), ','), '') AS evidence,
  coalesce(array_to_string(evidence_ids, ','), '') AS evidence_ids, round(evidence_min, 6) AS evidence_min, round(evidence_max, 6) AS evidence_max, round(score, 6) AS score, coalesce(is_axiom, FALSE) AS is_axiom FROM u"""


@_query
def exported_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations after encoding and decoding, flags back out of the metadata; numbered by their place in the JSON."""
    r = _round_trip(spark, d).relations
    return r.select("graph_id", "edge_idx", "src", "dst", "kind", F.array_join("warrant_ids", ",").alias("warrant_ids"), "gate_mode", r6("weight").alias("weight"), "rationale", "gate_disabled", "gate_restricted", "gate_action", r6("confidence").alias("confidence"))


SQL["exported_relations"] = _with(_R) + "SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY edge_idx) - 1 AS INTEGER) AS edge_idx, src, dst, kind, coalesce(array_to_string(warrant_ids, ','), '') AS warrant_ids, coalesce(gate_mode, 'OR') AS gate_mode, round(weight, 6) AS weight, rationale, coalesce(gate_disabled, FALSE) AS gate_disabled, coalesce(gate_restricted, FALSE) AS gate_restricted, gate_action, round(confidence, 6) AS confidence FROM r"


@_query
def exported_cards(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d).evidence_cards.select("graph_id", "card_id", "title", "supporting_doc_id", "excerpt", r6("confidence").alias("confidence"))


SQL["exported_cards"] = _with(_C) + "SELECT graph_id, card_id, title, supporting_doc_id, excerpt, round(confidence, 6) AS confidence FROM c"


@_query
def exported_documents(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d).supporting_documents.select("graph_id", "doc_id", "name", "type", "url", r6("trust").alias("trust"), r6("size").alias("size"), "upload_date", "uploader")


@_query
def exported_attacks(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d).warrant_attacks.select("graph_id", "attack_idx", "src", "warrant_id", "kind", "rationale")


@_query
def exported_warrants(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d).warrants.select("graph_id", "warrant_id", "text", "type", F.size("evidence").alias("evidence"), F.array_join("evidence_ids", ",").alias("evidence_ids"), r6("score").alias("score"), "is_axiom", "ignore_influence")


SQL["exported_documents"] = _with(_D) + "SELECT graph_id, doc_id, name, type, url, round(trust, 6) AS trust, round(size, 6) AS size, upload_date, uploader FROM d"
SQL["exported_attacks"] = _with(_A) + "SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY attack_idx) - 1 AS INTEGER) AS attack_idx, src, warrant_id, coalesce(kind, 'attack') AS kind, rationale FROM a"
SQL["exported_warrants"] = _with(_W) + "SELECT graph_id, warrant_id, text, coalesce(type, 'other') AS type, CAST(coalesce(len(evidence), 0) AS INTEGER) AS evidence, coalesce(array_to_string(evidence_ids, ','), '') AS evidence_ids, round(score, 6) AS score, coalesce(is_axiom, FALSE) AS is_axiom, coalesce(ignore_influence, FALSE) AS ignore_influence FROM w"


@_query
def file_relations(spark: SparkSession, d: str) -> DataFrame:
    """Payloads written as files of one graph each and read again: their relations."""
    p = read_table(spark, d, "graph_payloads").where("payload is not null and payload <> ''").select(F.col("payload").alias("value"))
    path = scratch(spark)
    p.write.option("maxRecordsPerFile", 1).text(path)
    return graph_json.read_graphs(spark, path).relations.select("edge_idx", "src", "dst", "kind", r6("weight").alias("weight"))


SQL["file_relations"] = f"SELECT edge_idx, src, dst, kind, weight FROM ({_GRAPH_SQL['decoded_relations']})"


@_query
def written_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The lines that all graphs are written as, read again: how many units and relations each has."""
    path = scratch(spark)
    graph_json.write_graphs(load_corpus(spark, d), path)
    lines = spark.read.text(path)
    return lines.select(F.size(F.json_object_keys(F.get_json_object("value", "$.units"))).alias("units"), F.json_array_length(F.get_json_object("value", "$.relations")).alias("relations"))


SQL["written_graphs"] = _with(_U, _W, _R, _A, _C, _D, _ALL) + "SELECT CAST((SELECT count(*) FROM u WHERE u.graph_id = al.graph_id) AS INTEGER) AS units, CAST((SELECT count(*) FROM r WHERE r.graph_id = al.graph_id) AS INTEGER) AS relations FROM al"


@_query
def rendered_lines(spark: SparkSession, d: str) -> DataFrame:
    """The DOT text of all graphs, written and read again."""
    c, path = load_corpus(spark, d), scratch(spark)
    dot.render(c.units, c.relations, path)
    return spark.read.text(path, lineSep="\n").where("value <> ''").select(F.col("value").alias("line"))


SQL["rendered_lines"] = f"SELECT line FROM ({_GRAPH_SQL['dot_lines']})"


@_query
def pattern_bank(spark: SparkSession, d: str) -> DataFrame:
    """The built-in patterns."""
    return spark.createDataFrame(patterns.pattern_bank(), ", ".join(f"{f} string" for f in patterns._FIELDS))


SQL["pattern_bank"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in p) + ")" for p in patterns.PATTERNS) + ") t(pattern_id, name, category, kind, action, description)"


# ---- checking payloads

#: Texts that are replaced in every payload, so that each rule is broken somewhere.
BREAKS = (
    ("", ""), ('"units": {', '"units": 7, "x": {'), ('"relations": [', '"relations": {}, "x": ['), ('"warrants": {', '"warrants": [], "x": {'), ('"evidence_cards": {', '"evidence_cards": 1, "x": {'),
    ('"supporting_documents": {', '"supporting_documents": "s", "x": {'), ('"argument_bundles": {', '"argument_bundles": true, "x": {'), ('"warrant_attacks": [', '"warrant_attacks": {}, "x": ['), ('"metadata": {', '"metadata": 3, "x": {'),
    ('"id": "', '"id": "z'), ('"text": ', '"said": '), ('"title": ', '"headline": '), ('"name": ', '"called": '), ('"evidence_ids": [', '"evidence_ids": {}, "x": ['), ('"evidence": [', '"evidence": 1, "x": ['), ('"src": ', '"from": '), ('"dst": ', '"to": '),
    ('"kind": ', '"sort": '), ('"src": "', '"src": "q'), ('"dst": "', '"dst": "q'), ('"warrant_ids": [', '"warrant_ids": 3, "x": ['), ('"gate_mode": "', '"gate_mode": "X'), ('"warrant_id": ', '"w_id": '), ('"warrant_id": "', '"warrant_id": "no'),
    ('"supporting_doc_id": "', '"supporting_doc_id": "no'), ('"trust": ', '"trust": "t", "x": '), ('"units": [', '"units": ["zz"], "x": ['), ('"evidence_ids": ["', '"evidence_ids": ["no'), ('"warrant_ids": ["', '"warrant_ids": ["no'),
    ('"units": {"', '"units": {"b1": 5, "b2": {"id": "b2", "text": "t", "spans": 4, "evidence_min": "a", "evidence_max": {}, "score": [], "is_axiom": 1, "ignore_influence": "no", "metadata": []}, "'), ('"warrants": {"', '"warrants": {"b1": null, "b2": {"id": "b2", "score": "s", "is_axiom": 0, "ignore_influence": 2}, "'),
    ('"evidence_cards": {"', '"evidence_cards": {"b1": [], "'), ('"supporting_documents": {"', '"supporting_documents": {"b1": "s", "'), ('"argument_bundles": {"', '"argument_bundles": {"b1": 1, "b2": {"id": "b2", "units": 3}, "'), ('"relations": [{', '"relations": [4, {'), ('"warrant_attacks": [{', '"warrant_attacks": [null, {'),
    ("{", "["),
)


@_query
def broken_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Messages for every payload as it is and with each of ``BREAKS``, with their numbers."""
    made = F.array(*[F.struct(F.lit(i).alias("break"), (F.replace("payload", F.lit(a), F.lit(b)) if a else F.col("payload")).alias("payload")) for i, (a, b) in enumerate(BREAKS)])
    rows = read_table(spark, d, "graph_payloads").select("payload_id", F.explode(made).alias("x")).select(F.concat_ws("|", "payload_id", F.col("x.break").cast("string")).alias("k"), "x.payload")
    found = validate.payload_violations(rows, "k", "payload")
    return found.groupBy(F.substring_index("k", "|", 1).alias("payload_id"), F.substring_index("k", "|", -1).cast("int").alias("break"), "message").agg(F.count("*").alias("n"))


def _rules_sql() -> tuple[str, ...]:
    """CTE ``bad`` (payload_id, brk, message) for the CTE q (payload_id, brk, payload)."""
    given = lambda f: f"json_exists(x, '$.{f}')"
    kind = lambda f: f"json_type(x, '$.{f}')"
    q = lambda s: s.replace("'", "''")
    parts = ["SELECT payload_id, brk, 'Graph payload is not JSON.' AS message FROM q WHERE payload IS NULL OR NOT json_valid(payload)", "SELECT payload_id, brk, 'Graph payload must be a dictionary.' FROM v WHERE json_type(j) <> 'OBJECT'"]
    for name, wanted, required, message in (("units", "OBJECT", True, "units must be a dictionary of id -> unit."), ("relations", "ARRAY", True, "relations must be a list."), ("metadata", "OBJECT", False, "metadata must be an object when provided."), ("evidence_cards", "OBJECT", False, "evidence_cards must be an object when provided."), ("supporting_documents", "OBJECT", False, "supporting_documents must be an object when provided."), ("argument_bundles", "OBJECT", False, "argument_bundles must be an object when provided."), ("warrants", "OBJECT", False, "warrants must be an object when provided."), ("warrant_attacks", "ARRAY", False, "warrant_attacks must be a list when provided.")):
        absent = "TRUE" if required else "FALSE"
        null = "FALSE" if name in ("metadata", "warrant_attacks") else "TRUE"
        parts.append(f"SELECT payload_id, brk, '{message}' FROM o WHERE CASE WHEN json_type(j, '$.{name}') IS NULL THEN {absent} WHEN json_type(j, '$.{name}') = 'NULL' THEN {null} ELSE json_type(j, '$.{name}') <> '{wanted}' END")
    ctes = ["v AS (SELECT payload_id, brk, CAST(CASE WHEN json_valid(payload) THEN payload END AS JSON) AS j FROM q WHERE json_valid(payload))", "o AS (SELECT * FROM v WHERE json_type(j) = 'OBJECT')"]
    for name in ("units", "evidence_cards", "supporting_documents", "warrants", "argument_bundles"):
        ctes.append(f"e_{name} AS (SELECT payload_id, brk, j, k, json_extract(j, '$.{name}.\"' || k || '\"') AS x FROM (SELECT payload_id, brk, j, unnest(json_keys(j, '$.{name}')) AS k FROM o WHERE json_type(j, '$.{name}') = 'OBJECT'))")
    for name in ("relations", "warrant_attacks"):
        ctes.append(f"e_{name} AS (SELECT payload_id, brk, j, i, json_extract(j, '$.{name}[' || i || ']') AS x FROM (SELECT payload_id, brk, j, unnest(range(CAST(json_array_length(j, '$.{name}') AS BIGINT))) AS i FROM o WHERE json_type(j, '$.{name}') = 'ARRAY'))")
    lists = (("spans", "a list"), ("evidence", "a list"), ("evidence_ids", "a list"), ("evidence_min", "a number"), ("evidence_max", "a number"), ("score", "a number"), ("is_axiom", "a boolean"), ("ignore_influence", "a boolean"), ("metadata", "an object"))
    fits = {"a list": "{t} = 'ARRAY'", "an object": "{t} = 'OBJECT'", "a number": "{t} IN ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'BOOLEAN')", "a boolean": "{t} = 'BOOLEAN'"}
    rules = (("units", "unit", ("id", "text"), lists), ("evidence_cards", "evidence_card", ("id", "title"), ()), ("supporting_documents", "supporting_document", ("id", "name"), (("trust", "a number"),)), ("warrants", "warrant", ("id", "text"), tuple(x for x in lists if x[0] in ("evidence_ids", "score", "is_axiom", "ignore_influence"))), ("argument_bundles", "argument_bundle", (), (("units", "a list"),)))
    known = lambda table, name: f"coalesce(list_contains(json_keys(j, '$.{table}'), {name}), FALSE)"
    some = lambda table: f"json_type(j, '$.{table}') = 'OBJECT' AND len(json_keys(j, '$.{table}')) > 0"
    members = lambda e, f, at: f"(SELECT payload_id, brk, j, {at}, json_extract_string(m, '$') AS m FROM (SELECT payload_id, brk, j, {at}, unnest(CAST(json_extract(x, '$.{f}') AS JSON[])) AS m FROM {e} WHERE json_type(x, '$.{f}') = 'ARRAY'))"
    for name, label, required, types in rules:
        e, head = f"e_{name}", f"'{label} ''' || k || '''"
        parts.append(f"SELECT payload_id, brk, {head} must be an object.' FROM {e} WHERE json_type(x) <> 'OBJECT'")
        if required:
            parts.append(f"SELECT payload_id, brk, {head} must include {q(' and '.join(repr(f) for f in required))}.' FROM {e} WHERE json_type(x) = 'OBJECT' AND NOT ({' AND '.join(map(given, required))})")
        parts.append(f"SELECT payload_id, brk, {head} id field does not match its key.' FROM {e} WHERE json_type(x) = 'OBJECT' AND coalesce({_S('id')} <> k, TRUE)")
        for f, wanted in types:
            parts.append(f"SELECT payload_id, brk, {head} {f} must be {wanted}.' FROM {e} WHERE json_type(x) = 'OBJECT' AND {given(f)} AND NOT ({fits[wanted].format(t=kind(f))})")
        if name in ("units", "warrants"):
            parts.append(f"SELECT payload_id, brk, {head} evidence_id ''' || m || ''' is not a known evidence card.' FROM {members(e, 'evidence_ids', 'k')} WHERE {some('evidence_cards')} AND NOT {known('evidence_cards', 'm')}")
    parts.append(f"SELECT payload_id, brk, 'argument_bundle ''' || k || ''' references unknown unit ''' || m || '''.' FROM {members('e_argument_bundles', 'units', 'k')} WHERE {some('units')} AND NOT {known('units', 'm')}")
    parts.append(f"SELECT payload_id, brk, 'evidence_card ''' || k || ''' references unknown supporting_doc_id.' FROM e_evidence_cards WHERE json_type(x) = 'OBJECT' AND coalesce({_S('supporting_doc_id')}, '') <> '' AND NOT {known('supporting_documents', _S('supporting_doc_id'))}")
    rel = "'relation[' || i || ']"
    parts.append(f"SELECT payload_id, brk, {rel} must be an object.' FROM e_relations WHERE json_type(x) <> 'OBJECT'")
    for f in ("src", "dst", "kind"):
        parts.append(f"SELECT payload_id, brk, {rel} missing ''{f}''.' FROM e_relations WHERE json_type(x) = 'OBJECT' AND NOT {given(f)}")
    for f in ("src", "dst"):
        parts.append(f"SELECT payload_id, brk, {rel} {f} ''' || {_S(f)} || ''' is not a known unit id.' FROM e_relations WHERE {kind(f)} = 'VARCHAR' AND NOT {known('units', _S(f))}")
    parts.append(f"SELECT payload_id, brk, {rel} warrant_ids must be a list.' FROM e_relations WHERE json_type(x) = 'OBJECT' AND {given('warrant_ids')} AND {kind('warrant_ids')} <> 'ARRAY'")
    parts.append(f"SELECT payload_id, brk, {rel} warrant_id ''' || m || ''' is not a known warrant.' FROM {members('e_relations', 'warrant_ids', 'i')} WHERE {some('warrants')} AND NOT {known('warrants', 'm')}")
    parts.append(f"SELECT payload_id, brk, {rel} gate_mode must be AND or OR.' FROM e_relations WHERE {kind('gate_mode')} <> 'NULL' AND {_S('gate_mode')} NOT IN ('AND', 'OR')")
    att = "'warrant_attacks[' || i || ']"
    parts.append(f"SELECT payload_id, brk, {att} must be an object.' FROM e_warrant_attacks WHERE json_type(x) <> 'OBJECT'")
    parts.append(f"SELECT payload_id, brk, {att} missing ''src'' or ''warrant_id''.' FROM e_warrant_attacks WHERE json_type(x) = 'OBJECT' AND NOT ({given('src')} AND {given('warrant_id')})")
    for f, table, what in (("src", "units", "unit id"), ("warrant_id", "warrants", "warrant")):
        parts.append(f"SELECT payload_id, brk, {att} {f} ''' || {_S(f)} || ''' is not a known {what}.' FROM e_warrant_attacks WHERE {given('src')} AND {given('warrant_id')} AND {kind(f)} = 'VARCHAR' AND NOT {known(table, _S(f))}")
    return (*ctes, "bad AS (" + " UNION ALL ".join(parts) + ")")


_BROKEN = "q AS (" + " UNION ALL ".join(f"SELECT payload_id, {i} AS brk, " + (f"replace(payload, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')" if a else "payload") + " AS payload FROM graph_payloads" for i, (a, b) in enumerate(BREAKS)) + ")"
SQL["broken_payloads"] = _with(_BROKEN, *_rules_sql()) + "SELECT payload_id, brk AS \"break\", message, count(*) AS n FROM bad GROUP BY ALL"


@_query
def payload_violations(spark: SparkSession, d: str) -> DataFrame:
    """Messages for the payloads as they are, with their numbers."""
    found = validate.payload_violations(read_table(spark, d, "graph_payloads"), "payload_id", "payload")
    return found.groupBy("payload_id", "message").agg(F.count("*").alias("n"))


SQL["payload_violations"] = _with("q AS (SELECT payload_id, 0 AS brk, payload FROM graph_payloads)", *_rules_sql()) + "SELECT payload_id, message, count(*) AS n FROM bad GROUP BY ALL"


# ---- texts


_BREAK = f"'\\n[' || {_BLANKS} || ']*\\n'"
SQL["paragraph_segments"] = f"""
WITH s AS (SELECT doc_id, text, regexp_split_to_array(text, {_BREAK}) AS p, list_transform(regexp_extract_all(text, {_BREAK}), lambda g: length(g)) AS g FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, text, len(p) AS k, unnest(p) AS part, generate_subscripts(p, 1) AS i, unnest(list_append(g, 0)) AS gap FROM s),
y AS (SELECT *, coalesce(sum(length(part) + gap) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, CASE WHEN i = k AND length(part) > 1 AND right(text, 1) = chr(10) THEN left(part, -1) ELSE part END AS t FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM y WHERE t <> '' AND left(t, 1) <> chr(10) AND trim(t, {_BLANKS}) <> '')
SELECT doc_id, CAST(n - 1 AS INTEGER) AS seg_idx, 'seg-' || n AS seg_id, t AS text, CAST(b AS INTEGER) AS "start", CAST(b + length(t) AS INTEGER) AS "end" FROM z
UNION ALL SELECT doc_id, 0, 'seg-1', text, 0, CAST(length(text) AS INTEGER) FROM s WHERE trim(text, {_BLANKS}) <> '' AND doc_id NOT IN (SELECT doc_id FROM z)
"""


@_query
def shifted_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of units moved by their unit's place in the graph."""
    u = segments.shift_spans(load_corpus(spark, d).units, F.col("ord"))
    return u.select("graph_id", "unit_id", F.posexplode("spans").alias("pos", "s")).select("graph_id", "unit_id", "pos", "s.start", "s.end")


SQL["shifted_spans"] = _with(_U) + 'SELECT graph_id, unit_id, CAST(pos - 1 AS INTEGER) AS pos, s.start + ord AS "start", s.end + ord AS "end" FROM (SELECT graph_id, unit_id, ord, unnest(spans) AS s, generate_subscripts(spans, 1) AS pos FROM u)'


@_query
def scored_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Inline items after the verdict is written back to them."""
    u = evaluation.score_evidence(load_corpus(spark, d).units)
    return u.select("graph_id", "unit_id", F.posexplode("evidence").alias("pos", "e")).where("e is not null").select("graph_id", "unit_id", "pos", F.col("e.id").alias("evidence_id"), F.col("e.stance").alias("stance"), r6("e.strength").alias("strength"))


SQL["scored_evidence"] = f"SELECT graph_id, unit_id, pos, evidence_id, evaluation AS stance, confidence AS strength FROM ({_GRAPH_SQL['evidence_evaluation']})"


# ---- merging


def _greedy(rows: str, threshold: float, best: bool) -> tuple[str, ...]:
    """CTE ``walk`` over the CTE rows (doc_id, n from 1, key): one step a row, root (of the kept keys) and score of each."""
    sim = "CASE WHEN len(t) = 0 OR len(o.t) = 0 THEN CASE WHEN len(t) = len(o.t) THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(t, o.t)) / CAST(len(t) + len(o.t) - len(list_intersect(t, o.t)) AS DOUBLE) END"
    order = "{'s': -o.s, 'n': o.n}" if best else "{'s': CAST(0 AS DOUBLE), 'n': o.n}"
    return (
        f"tk AS (SELECT doc_id, n, key, list_distinct(regexp_extract_all(key, '[a-z0-9]+')) AS t FROM {rows})",
        f"""walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS root, CAST(NULL AS DOUBLE) AS score, CAST([] AS STRUCT(n BIGINT, key VARCHAR, t VARCHAR[])[]) AS kept FROM (SELECT DISTINCT doc_id FROM tk)
  UNION ALL SELECT doc_id, n, CASE WHEN hit IS NULL THEN key ELSE hit.key END, hit.s, CASE WHEN hit IS NULL AND NOT own THEN list_append(kept, {{'n': n, 'key': key, 't': t}}) ELSE kept END
  FROM (SELECT tk.doc_id, tk.n, tk.key, tk.t, walk.kept, list_contains(list_transform(walk.kept, lambda o: o.key), tk.key) AS own,
    CASE WHEN NOT list_contains(list_transform(walk.kept, lambda o: o.key), tk.key) THEN list_sort(list_transform(list_filter(list_transform(walk.kept, lambda o: {{'n': o.n, 'key': o.key, 's': {sim.replace('len(t)', 'len(tk.t)').replace('(t,', '(tk.t,')}}}), lambda o: o.s >= {threshold}), lambda o: {{'o': {order}, 'key': o.key, 's': o.s}}))[1] END AS hit
    FROM walk JOIN tk ON walk.doc_id = tk.doc_id AND tk.n = walk.n + 1)
)""",
    )


@_query
def merged_claims(spark: SparkSession, d: str) -> DataFrame:
    """Greedy merge of the extracted claims of each segment."""
    c = read_table(spark, d, "extracted_claims").where("segment_id is not null").groupBy("claim_id", "segment_id").agg(F.min("text").alias("text"), F.min("span_start").alias("span_start"))
    rows = c.select(F.col("segment_id").alias("doc_id"), "segment_id", F.lit(0).alias("seg_ord"), F.coalesce("span_start", F.lit(-1)).alias("ord"), "claim_id", "text")
    return reconcile.merge_claims(rows)


_CLAIMS = f"""cl AS (SELECT segment_id AS doc_id, claim_id, trim(lower(coalesce(text, '')), {_BLANKS}) AS key, row_number() OVER (PARTITION BY segment_id ORDER BY coalesce(span_start, -1), claim_id) AS n
  FROM (SELECT claim_id, segment_id, min(text) AS text, min(span_start) AS span_start FROM extracted_claims WHERE segment_id IS NOT NULL GROUP BY ALL))"""
SQL["merged_claims"] = _with(_CLAIMS, *_greedy("cl", 0.92, False), "hd AS (SELECT cl.doc_id, key, min(cl.n) AS n FROM cl JOIN walk ON cl.doc_id = walk.doc_id AND cl.n = walk.n WHERE key = root GROUP BY ALL)", "nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM hd)", recursive=True) + """
SELECT cl.doc_id, cl.doc_id AS segment_id, claim_id, 'c' || i AS new_id, cl.n <> nu.n AS merged FROM cl JOIN walk ON cl.doc_id = walk.doc_id AND cl.n = walk.n JOIN nu ON cl.doc_id = nu.doc_id AND walk.root = nu.key"""


@_query
def similar_units(spark: SparkSession, d: str) -> DataFrame:
    """Where each unit goes if keys of similarity 0.8 are merged."""
    units, *_ = _segmented(load_corpus(spark, d))
    m = reconcile.unit_map(units, reconcile.MergePolicy(similarity=reconcile.jaccard, threshold=0.8))
    return m.select("doc_id", "segment_id", "unit_id", "new_id", r6("match_score").alias("match_score"))


SQL["similar_units"] = _with(_U, _MAP, "kn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_ord, ord, unit_id) AS n FROM k)", *_greedy("kn", 0.8, True), "hd AS (SELECT kn.doc_id, key, min(kn.n) AS n FROM kn JOIN walk ON kn.doc_id = walk.doc_id AND kn.n = walk.n WHERE key = root GROUP BY ALL)", "nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM hd)", recursive=True) + """
SELECT kn.doc_id, graph_id AS segment_id, unit_id, 'c' || i AS new_id, round(score, 6) AS match_score FROM kn JOIN walk ON kn.doc_id = walk.doc_id AND kn.n = walk.n JOIN nu ON kn.doc_id = nu.doc_id AND walk.root = nu.key"""


@_query
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Cards on one supporting document within a document's segments that differ from the first of them, and documents of one name alike."""
    _, _, docs, cards = _segmented(load_corpus(spark, d))
    c = reconcile.merge_first(cards.where("supporting_doc_id <> ''").select("doc_id", "segment_id", "seg_ord", "ord", "title", "supporting_doc_id", "excerpt", "confidence"), "supporting_doc_id", "evidence_card")[1]
    n = reconcile.merge_first(docs.where("type is not null").select("doc_id", "segment_id", "seg_ord", "ord", "type", "trust", "uploader"), "type", "supporting_document")[1]
    return c.unionByName(n)


@_query
def merged_cards(spark: SparkSession, d: str) -> DataFrame:
    """The first card of each supporting document within a document's segments."""
    *_, cards = _segmented(load_corpus(spark, d))
    m = reconcile.merge_first(cards.where("supporting_doc_id <> ''").select("doc_id", "segment_id", "seg_ord", "ord", "card_id", "title", "supporting_doc_id", "excerpt", "confidence"), "supporting_doc_id", "evidence_card")[0]
    return m.select("doc_id", "supporting_doc_id", "card_id", "title", r6("confidence").alias("confidence"))


_CARDS = "cc AS (SELECT right(graph_id, 1) AS doc_id, CAST(substr(graph_id, 2) AS BIGINT) AS seg_ord, ord, card_id, title, supporting_doc_id, excerpt, confidence FROM c WHERE supporting_doc_id <> '')"
_DOCS = "dd AS (SELECT right(graph_id, 1) AS doc_id, CAST(substr(graph_id, 2) AS BIGINT) AS seg_ord, ord, type, trust, uploader FROM d WHERE type IS NOT NULL)"
_FIRST_OF = "first_value({x}) OVER (PARTITION BY doc_id, {key} ORDER BY seg_ord, ord)"
SQL["merge_conflicts"] = _with(_C, _D, _CARDS, _DOCS) + f"""
SELECT doc_id, seg_ord, 'evidence_card' AS kind, supporting_doc_id AS key FROM (SELECT *, {_FIRST_OF.format(x="{'a': title, 'b': excerpt, 'c': confidence}", key='supporting_doc_id')} AS f FROM cc) WHERE f.a IS DISTINCT FROM title OR f.b IS DISTINCT FROM excerpt OR f.c IS DISTINCT FROM confidence
UNION ALL SELECT doc_id, seg_ord, 'supporting_document', type FROM (SELECT *, {_FIRST_OF.format(x="{'a': trust, 'b': uploader}", key='type')} AS f FROM dd) WHERE f.a IS DISTINCT FROM trust OR f.b IS DISTINCT FROM uploader"""
SQL["merged_cards"] = _with(_C, _CARDS) + "SELECT doc_id, supporting_doc_id, card_id, title, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, supporting_doc_id ORDER BY seg_ord, ord) AS n FROM cc) WHERE n = 1"


def _weighted(how: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        units, relations, *_ = _segmented(load_corpus(spark, d))
        m = reconcile.merge_relations(relations, reconcile.unit_map(units), reconcile.MergePolicy(relation_aggregation=how, clamp_weights=False))
        return m.select("doc_id", "src", "dst", "kind", r6("weight").alias("weight"), "rationale", "sources")

    return run


for _how, _sql in (("mean", "avg(coalesce(weight, 1))"), ("max", "arg_min(coalesce(weight, 1), {'a': -abs(coalesce(weight, 1)), 's': p.seg_ord, 'e': edge_idx})")):
    QUERIES[f"reconciled_relations_{_how}"] = _weighted(_how)
    SQL[f"reconciled_relations_{_how}"] = _with(_U, _R, _MAP, _FIRST) + f"SELECT p.doc_id, p.new_id AS src, q.new_id AS dst, kind, round({_sql}, 6) AS weight, arg_min(struct_pack(t := rationale), {{'s': p.seg_ord, 'e': edge_idx}}).t AS rationale, count(*) AS sources FROM r JOIN m p ON r.graph_id = p.graph_id AND r.src = p.unit_id JOIN m q ON r.graph_id = q.graph_id AND r.dst = q.unit_id GROUP BY p.doc_id, p.new_id, q.new_id, kind"


def _reconciled(spark: SparkSession, d: str) -> reconcile.Reconciled:
    """All graphs whose ids end alike as the segments of one document, each as long as its units' texts."""
    c = load_corpus(spark, d)
    units, relations, *_ = _segmented(c)
    seg = units.groupBy("doc_id", "segment_id", "seg_ord").agg(F.lit(0).alias("start"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("end"))
    return reconcile.reconcile(seg, units.select("doc_id", "segment_id").dropDuplicates(), units, relations)


@_query
def reconciled_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where each merged relation comes from."""
    return _reconciled(spark, d).relation_sources


@_query
def reconciled_documents(spark: SparkSession, d: str) -> DataFrame:
    """The segments that the merged graphs name."""
    x = _reconciled(spark, d).documents.select("doc_id", F.posexplode(F.from_json(F.get_json_object("metadata", "$.segments"), "array<struct<id: string, start: bigint, end: bigint>>")).alias("pos", "s"))
    return x.select("doc_id", "pos", F.col("s.id").alias("segment_id"), "s.start", "s.end")


SQL["reconciled_sources"] = _with(_U, _R, _MAP, _FIRST) + "SELECT p.doc_id, p.new_id AS src, q.new_id AS dst, kind, r.graph_id AS segment_id, edge_idx FROM r JOIN m p ON r.graph_id = p.graph_id AND r.src = p.unit_id JOIN m q ON r.graph_id = q.graph_id AND r.dst = q.unit_id"
SQL["reconciled_documents"] = _with(_U) + "SELECT right(graph_id, 1) AS doc_id, CAST(row_number() OVER (PARTITION BY right(graph_id, 1) ORDER BY CAST(substr(graph_id, 2) AS BIGINT)) - 1 AS INTEGER) AS pos, graph_id AS segment_id, 0 AS \"start\", CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS \"end\" FROM u GROUP BY graph_id"


# ---- mining


@_query
def mined_documents(spark: SparkSession, d: str) -> DataFrame:
    """Claims of all documents, mined by paragraphs and sentences and merged."""
    m = mining.mine_long(read_table(spark, d, "documents"), "doc_id", "text")
    return m.select("doc_id", "new_id", "text", F.size("source_unit_ids").alias("sources"), "segments", F.element_at("spans", 1)["start"].alias("start"), F.element_at("spans", -1)["end"].alias("end"))


def _sentences(rows: str, out: str) -> str:
    """CTE of the sentences of rows (doc_id, seg, text, base)."""
    return f"""{out} AS (SELECT doc_id, seg, n, base, trim(piece, {_BLANKS}) AS said, CAST(stop - length(piece) AS INTEGER) AS b, CAST(stop AS INTEGER) AS e FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, seg ORDER BY pos) AS n FROM (SELECT doc_id, seg, base, pos, piece, sum(length(piece)) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS stop
      FROM (SELECT doc_id, seg, base, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, seg, base, regexp_extract_all(text, '[^.!?]+[.!?]?|[.!?]') AS p FROM {rows})))
    WHERE trim(piece, {_BLANKS}) <> '' AND NOT regexp_full_match(piece, '[.!?]')))"""


def _mined(segments_sql: str) -> str:
    """Merged sentences of the segments (doc_id, seg_idx, text, start) of a query."""
    return _with(f"sg AS (SELECT doc_id, seg_idx AS seg, text, \"start\" AS base FROM ({segments_sql}))", _sentences("sg", "st"), "sk AS (SELECT *, lower(said) AS key FROM st)", "kf AS (SELECT doc_id, key, min({'s': seg, 'n': n}) AS f FROM sk GROUP BY ALL)", "ki AS (SELECT doc_id, key, 'c' || row_number() OVER (PARTITION BY doc_id ORDER BY f) AS new_id FROM kf)") + """
SELECT sk.doc_id, new_id, arg_min(said, {'s': seg, 'n': n}) AS text, CAST(count(*) AS INTEGER) AS sources, count(DISTINCT seg) AS segments, CAST(arg_min(b + base, {'s': seg, 'n': n}) AS INTEGER) AS "start", CAST(arg_max(e + base, {'s': seg, 'n': n}) AS INTEGER) AS "end"
FROM sk JOIN ki ON sk.doc_id = ki.doc_id AND sk.key = ki.key GROUP BY sk.doc_id, new_id"""


SQL["mined_documents"] = _mined(SQL["paragraph_segments"])


def _asked(prompt: str) -> str:
    """The text that a prompt asks about."""
    return prompt.partition("Text:\n")[2].rpartition("\n\nAnswer as ")[0]


class _Halver:
    """Stands for a model that cuts texts of 40 characters or more in two, and has no answer for others."""

    def complete(self, prompt: str, *, metadata: dict | None = None) -> str:
        text = _asked(prompt)
        return json.dumps([{"id": "a", "text": text[:20], "start": 0, "end": 20}, {"text": text[20:], "start": 20, "end": len(text)}, {"text": 5}]) if len(text) >= 40 else "I cannot."


@_query
def model_segments(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut by a model, or by paragraphs where it has no answer."""
    return mining.model_splitter(_Halver)(read_table(spark, d, "documents"), "doc_id", "text")


SQL["model_segments"] = f"""
SELECT doc_id, 0 AS seg_idx, 'a' AS seg_id, left(text, 20) AS text, 0 AS "start", 20 AS "end" FROM documents WHERE length(text) >= 40
UNION ALL SELECT doc_id, 1, 'seg-2', substr(text, 21), 20, CAST(length(text) AS INTEGER) FROM documents WHERE length(text) >= 40
UNION ALL SELECT doc_id, seg_idx, seg_id, text, "start", "end" FROM ({SQL['paragraph_segments']}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) < 40)"""


@_query
def mined_halves(spark: SparkSession, d: str) -> DataFrame:
    """Claims of all documents, cut by a model."""
    m = mining.mine_long(read_table(spark, d, "documents"), "doc_id", "text", splitter=mining.model_splitter(_Halver))
    return m.select("doc_id", "new_id", "text", F.size("source_unit_ids").alias("sources"), "segments", F.element_at("spans", 1)["start"].alias("start"), F.element_at("spans", -1)["end"].alias("end"))


SQL["mined_halves"] = _mined(SQL["model_segments"])


class _Grapher:
    """Stands for a model that answers texts with an even number of characters by a graph in a fence, others by one with a broken edge, and short ones by talk."""

    def complete(self, prompt: str, *, metadata: dict | None = None) -> str:
        text = _asked(prompt)
        if len(text) < 40:
            return "Sorry. " * 200
        graph = {"units": {"c1": {"id": "c1", "text": text[:20], "type": "fact", "spans": [{"doc_id": "x", "start": 0, "end": 20, "text": text[:20]}]}}, "relations": []}
        if len(text) % 2:
            graph["relations"] = [{"src": "c1", "dst": "c9", "kind": "support"}]
        return "Here it is:\n```json\n" + json.dumps(graph) + "\n```\nDone."


@_query
def hooked_documents(spark: SparkSession, d: str) -> DataFrame:
    """What came of asking a model for each text's graph: its first span's document, or the messages and whether the answer was shortened."""
    h = mining.hooked_miner(read_table(spark, d, "documents").where("text is not null"), "doc_id", "text", _Grapher)
    return h.select("doc_id", "fallback", F.array_join("errors", "|").alias("errors"), (F.length("response") == 500).alias("shortened"), F.get_json_object("graph", "$.units.c1.spans[0].doc_id").alias("span_doc"))


SQL["hooked_documents"] = """SELECT doc_id, length(text) < 40 OR length(text) % 2 = 1 AS fallback,
  CASE WHEN length(text) < 40 THEN 'units must be a dictionary of id -> unit.|relations must be a list.' WHEN length(text) % 2 = 1 THEN 'relation[0] dst ''c9'' is not a known unit id.' ELSE '' END AS errors,
  CASE WHEN length(text) < 40 THEN TRUE WHEN length(text) % 2 = 1 THEN FALSE END AS shortened, CASE WHEN length(text) >= 40 AND length(text) % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS span_doc FROM documents WHERE text IS NOT NULL"""


@_query
def hooked_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the model's graphs, or sentences where it has none that is valid."""
    return mining.miner_of(_Grapher)(read_table(spark, d, "documents").where("text is not null"), "doc_id", "text").select("doc_id", "unit_id", "text", "type", "start", "end")


SQL["hooked_claims"] = _with("sg AS (SELECT doc_id, 0 AS seg, text, 0 AS base FROM documents WHERE length(text) < 40 OR length(text) % 2 = 1)", _sentences("sg", "st")) + """SELECT doc_id, 'c' || n AS unit_id, said AS text, 'other' AS type, b AS "start", e AS "end" FROM st
UNION ALL SELECT doc_id, 'c1', left(text, 20), 'fact', 0, 20 FROM documents WHERE length(text) >= 40 AND length(text) % 2 = 0"""


_CAPITALS = str.maketrans(string.ascii_lowercase, string.ascii_uppercase)


class _Claimer:
    """Stands for a model that names the first 30 characters of a segment, those again in capitals, and its last 10; and one relation for all."""

    def complete(self, prompt: str, *, metadata: dict | None = None) -> str:
        if "Claims:\n" in prompt:
            return '{"relations": [{"src": "c1", "dst": "c2", "kind": "ATTACK", "rationale": " r "}, {"src": "c2", "dst": "c2", "kind": "support"}, {"src": "c1", "dst": "c999999", "kind": "support"}]}'
        text = _asked(prompt)
        if len(text) < 60:
            return "none"
        return json.dumps({"claims": [{"text": text[:30], "type": "Fact"}, {"text": text[:30].translate(_CAPITALS), "type": "odd"}, {"text": text[-10:]}, {"text": "  "}]})


@_query
def pipeline_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the pipeline, from the model or, where it has none for a document, from sentences."""
    return mining.pipeline_of(_Claimer).run(read_table(spark, d, "documents").where("text is not null"), "doc_id", "text").units


@_query
def pipeline_relations(spark: SparkSession, d: str) -> DataFrame:
    return mining.pipeline_of(_Claimer).run(read_table(spark, d, "documents").where("text is not null"), "doc_id", "text").relations


@_query
def pipeline_traces(spark: SparkSession, d: str) -> DataFrame:
    """What the pipeline says it did with each document."""
    m = mining.pipeline_of(_Claimer).run(read_table(spark, d, "documents").where("text is not null"), "doc_id", "text").documents
    at = lambda f: F.get_json_object("metadata", f"$.mining.{f}")
    return m.select("doc_id", F.array_join(F.from_json(at("trace"), "array<string>"), "|").alias("trace"), F.json_array_length(at("segments")).alias("segments"), at("merge_summary.merged").cast("int").alias("merged"), at("llm_fallback").alias("llm_fallback"))


_LOW = lambda x: f"trim(lower({x}), {_BLANKS})"
_PIPE = (
    f"sg AS (SELECT doc_id, seg_idx, seg_id, text, \"start\" AS base FROM ({SQL['paragraph_segments']}))",
    f"""pc AS (SELECT doc_id, seg_idx, seg_id, base, text AS whole, unnest([{{'o': 0, 't': trim(left(text, 30), {_BLANKS}), 'y': 'fact'}}, {{'o': 1, 't': trim(translate(left(text, 30), '{string.ascii_lowercase}', '{string.ascii_uppercase}'), {_BLANKS}), 'y': 'odd'}}, {{'o': 2, 't': trim(right(text, 10), {_BLANKS}), 'y': 'other'}}]) AS c FROM sg WHERE length(text) >= 60)""",
    "pd AS (SELECT doc_id, seg_idx, seg_id, base, whole, row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY c.o) AS i, c.t AS t, c.y AS y FROM pc WHERE c.t <> '')",
    f"pk AS (SELECT *, {_LOW('t')} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx, i) AS n FROM pd)",
    *_greedy("pk", 0.92, False),
    "hd AS (SELECT pk.doc_id, key, min(pk.n) AS n FROM pk JOIN walk ON pk.doc_id = walk.doc_id AND pk.n = walk.n WHERE key = root GROUP BY ALL)",
    "nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS num FROM hd)",
)
SQL["pipeline_claims"] = _with(*_PIPE, "bare AS (SELECT doc_id, 0 AS seg, text, 0 AS base FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM pk))", _sentences("bare", "st"), recursive=True) + """
SELECT pk.doc_id, 'c' || num AS unit_id, t AS text, CASE WHEN y = 'fact' THEN 'fact' ELSE 'other' END AS type, CASE WHEN strpos(lower(whole), lower(t)) > 0 THEN CAST(base + strpos(lower(whole), lower(t)) - 1 AS INTEGER) END AS "start", CASE WHEN strpos(lower(whole), lower(t)) > 0 THEN CAST(base + strpos(lower(whole), lower(t)) - 1 + length(t) AS INTEGER) END AS "end", FALSE AS llm_fallback
FROM pk JOIN nu ON pk.doc_id = nu.doc_id AND pk.n = nu.n UNION ALL SELECT doc_id, 'c' || n, said, 'other', b, e, TRUE FROM st"""
SQL["pipeline_relations"] = _with(*_PIPE, recursive=True) + "SELECT doc_id, 'c1' AS src, 'c2' AS dst, 'attack' AS kind, 'r' AS rationale FROM nu GROUP BY doc_id HAVING count(*) > 1"
SQL["pipeline_traces"] = _with(*_PIPE, "tn AS (SELECT sg.doc_id, count(*) AS segs, string_agg(seg_id || CASE WHEN length(text) < 60 THEN ': claim parse failed' ELSE ': claims ' || (SELECT count(*) FROM pd WHERE pd.doc_id = sg.doc_id AND pd.seg_idx = sg.seg_idx) END, '|' ORDER BY seg_idx) AS lines FROM sg GROUP BY sg.doc_id)", "tm AS (SELECT doc_id, count(*) AS kept FROM nu GROUP BY doc_id)", "ta AS (SELECT doc_id, count(*) AS claims FROM pk GROUP BY doc_id)", recursive=True) + """
SELECT d.doc_id, concat_ws('|', 'segments: ' || coalesce(segs, 0), lines, CASE WHEN kept IS NULL THEN 'no claims from llm; fallback miner' ELSE 'claims: ' || kept || ' (merged ' || (claims - kept) || ')|relations: ' || CASE WHEN kept > 1 THEN 1 ELSE 0 END END) AS trace,
  CASE WHEN kept IS NOT NULL THEN CAST(segs AS INTEGER) END AS segments, CASE WHEN kept IS NOT NULL THEN CAST(claims - kept AS INTEGER) END AS merged, CASE WHEN kept IS NULL THEN 'true' END AS llm_fallback
FROM documents d LEFT JOIN tn ON d.doc_id = tn.doc_id LEFT JOIN tm ON d.doc_id = tm.doc_id LEFT JOIN ta ON d.doc_id = ta.doc_id WHERE d.text IS NOT NULL"""


@_query
def tolerant_answers(spark: SparkSession, d: str) -> DataFrame:
    """JSON found in answers that wrap it in four ways: bare, fenced, amid talk, and not at all."""
    docs = read_table(spark, d, "documents").where("text is not null")
    core = F.to_json(F.struct(F.substr("text", F.lit(1), F.lit(50)).alias("t")))
    way = F.pmod("doc_id", F.lit(4))
    said = F.when(way == 0, core).when(way == 1, F.concat(F.lit("So:\n```json\n"), core, F.lit("\n```\nend"))).when(way == 2, F.concat(F.lit("I say "), core, F.lit(" and rest"))).otherwise(F.lit("{ no"))
    out = model_hooks.parsed(docs.select("doc_id", said.alias("response")), lambda r: {"t": x.get("t") if isinstance(x := model_hooks.tolerant_json(r), dict) else None}, "t string", "x")
    return out.select("doc_id", "x.t")


SQL["tolerant_answers"] = "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN left(text, 50) END AS t FROM documents WHERE text IS NOT NULL"


# ---- models


@_query
def graph_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model is asked for each text's graph."""
    return read_table(spark, d, "documents").select("doc_id", model_hooks.rendered("graph", input=F.col("text")).alias("prompt"))


_LIT = lambda s: "'" + s.replace("'", "''") + "'"
_HEAD, _TAIL = (x.replace("{{", "{").replace("}}", "}") for x in model_hooks.PROMPTS["graph"].split("{input}"))
SQL["graph_prompts"] = f"SELECT doc_id, {_LIT(_HEAD)} || coalesce(text, '') || {_LIT(_TAIL)} AS prompt FROM documents"


class _Judge:
    """Stands for a model that judges an edge by the length of its prompt."""

    def complete(self, prompt: str, *, metadata: dict | None = None) -> str:
        n = len(prompt)
        return json.dumps({"evaluation": ("Supports", "attack", "unsure")[n % 3], "score": n % 7 - 3 if n % 5 else "?", "rationale": " so " if n % 2 else None})


@_query
def judged_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both ends known, as a model judges them."""
    return model_hooks.judge_edges(load_corpus(spark, d), _Judge)


_FIXED = len(model_hooks.PROMPTS["edge"].replace("{{", "{").replace("}}", "}").replace("{source}", "").replace("{target}", ""))
SQL["judged_edges"] = _with(_U, _R) + f"""SELECT graph_id, edge_idx, src, dst, CASE n % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'attack' ELSE 'neutral' END AS evaluation, CASE WHEN n % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), n % 7 - 3)) END AS score, CASE WHEN n % 2 = 1 THEN 'so' END AS rationale
FROM (SELECT r.graph_id, edge_idx, src, dst, {_FIXED} + length(coalesce(p.text, '')) + length(coalesce(q.text, '')) AS n {_PAIR} WHERE kind IN ('support', 'attack', 'undercut', 'rebut'))"""


class _Scorer:
    """Stands for a model that scores evidence by its id's last digit and leaves the claim to the evidence where the prompt's length is even."""

    def complete(self, prompt: str, *, metadata: dict | None = None) -> str:
        ids = [line[6:] for line in prompt.splitlines() if line.startswith("- id: ")]
        score = lambda i: (int(i[-1]) - 4) / 5 if i[-1:].isdigit() else 0.0
        out: dict = {"evidence": [{"evidence_id": i, "score": score(i), "rationale": "tangential" if i.endswith("7") else "fits"} for i in ids]}
        return json.dumps(out | ({"claim_score": 0.5} if len(ids) % 2 else {}))


@_query
def scored_claims(spark: SparkSession, d: str) -> DataFrame:
    """Credibility of facts by a model, kept in their metadata and read from there."""
    c = load_corpus(spark, d)
    s = model_hooks.score_claims(c, _Scorer, only=c.units.where("type = 'fact'").select("graph_id", "unit_id"))
    u = model_hooks.persist_scores(c.units.withColumn("metadata", F.lit(None).cast("string")), cut(s)).where("metadata is not null")
    at = lambda f: F.get_json_object("metadata", f"$.claim_credibility{f}")
    return u.select("graph_id", "unit_id", (r6(at("").cast("double")) + 0.0).alias("claim_score"), (r6(at("_weighted").cast("double")) + 0.0).alias("weighted"), at("_method").alias("method"), F.json_array_length(at("_evidence")).alias("evidence"))


_SCORED = "CASE WHEN right(ev, 1) = '7' THEN CAST(0 AS DOUBLE) WHEN regexp_full_match(right(ev, 1), '[0-9]') THEN (CAST(right(ev, 1) AS INTEGER) - 4) / CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
SQL["scored_claims"] = _with(
    _U, _C,
    "items AS (SELECT graph_id, unit_id, pos, e.id AS ev, TRUE AS inline FROM (SELECT graph_id, unit_id, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS pos FROM u WHERE type = 'fact') WHERE e IS NOT NULL AND e.id IS NOT NULL UNION ALL SELECT graph_id, unit_id, 1000000 + pos, ev, FALSE FROM (SELECT graph_id, unit_id, unnest(evidence_ids) AS ev, generate_subscripts(evidence_ids, 1) AS pos FROM u WHERE type = 'fact') WHERE ev IS NOT NULL)",
    "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, unit_id, ev ORDER BY pos) AS n FROM items) WHERE n = 1)",
    f"inp AS (SELECT f.graph_id, f.unit_id, CASE WHEN c.card_id IS NULL THEN CAST(1 AS DOUBLE) WHEN confidence IS NULL THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), confidence)) END AS trust, {_SCORED} AS v FROM firsts f LEFT JOIN c ON f.graph_id = c.graph_id AND f.ev = c.card_id WHERE inline OR c.card_id IS NOT NULL)",
    "t AS (SELECT graph_id, unit_id, count(*) AS k, CASE WHEN sum(trust) > 0 THEN greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), sum(trust * v) / sum(trust))) ELSE CAST(0 AS DOUBLE) END AS w FROM inp GROUP BY ALL)",
) + """SELECT u.graph_id, u.unit_id, round(CASE WHEN k IS NULL THEN CAST(0 AS DOUBLE) WHEN k % 2 = 0 OR abs(w) < 0.2 THEN w ELSE CAST(0.5 AS DOUBLE) END, 6) + 0.0 AS claim_score, round(coalesce(w, 0), 6) + 0.0 AS weighted, CASE WHEN k IS NULL THEN 'none' WHEN k % 2 = 0 THEN 'weighted' WHEN abs(w) < 0.2 THEN 'weighted_consistency' ELSE 'llm' END AS method, CAST(coalesce(k, 0) AS INTEGER) AS evidence
FROM u LEFT JOIN t ON u.graph_id = t.graph_id AND u.unit_id = t.unit_id WHERE u.type = 'fact'"""


@_query
def critique_report(spark: SparkSession, d: str) -> DataFrame:
    """How many findings of each part of the critique each graph has, with a client that names one assumption an edge."""
    r = critiques.critique(load_corpus(spark, d), model_hooks.OfflineClient('{"assumptions": [{"assumption": "x"}]}'))
    one = lambda df, part: df.groupBy("graph_id").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "graph_id", "n")
    return functools.reduce(DataFrame.unionByName, [one(r.missing_assumptions, "missing_assumptions"), one(r.patterns, "patterns"), one(r.warrant_fragility, "warrant_fragility")])


SQL["critique_report"] = _with(_U, _R, *_matches(), recursive=True) + f"""SELECT 'missing_assumptions' AS part, r.graph_id, count(*) AS n {_PAIR} WHERE kind IN ('support', 'attack', 'undercut', 'rebut') GROUP BY r.graph_id
UNION ALL SELECT 'patterns', graph_id, count(*) FROM m GROUP BY graph_id UNION ALL SELECT 'warrant_fragility', graph_id, count(*) FROM r WHERE len(warrant_ids) > 0 GROUP BY graph_id"""
