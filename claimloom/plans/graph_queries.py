"""Queries of the graph operators over the tables, and the SQL that gives the same rows.

Doubles are rounded on both sides (scores to six places, means of evidence to nine, where no ties are); arrays are joined to strings. All queries run over the
current rows of the whole tables: the last delivery of each key that is not deleted.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import ascii_tokens, token_jaccard
from claimloom.operators import bundles, evaluation, graphs, mining, model_hooks, patterns, reconcile, scoring, segments, validate
from claimloom.operators.corpus import Corpus, load_corpus
from claimloom.sources import dot, graph_json
from claimloom.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _scored(spark: SparkSession, d: str, cfg: scoring.ScoringConfig = scoring.CREDIBILITY) -> tuple[Corpus, scoring.Scores]:
    c = load_corpus(spark, d)
    return c, scoring.score_corpus(c, cfg)


# ---- scoring


@_query
def evidence_support(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    one = lambda nodes, key, kind: scoring.evidence_support(nodes, key, c, 0.5).select("graph_id", F.lit(kind).alias("kind"), "id", F.round("evidence", 9).alias("evidence"))
    return one(c.units, "unit_id", "claim").unionByName(one(c.warrants, "warrant_id", "warrant"))


@_query
def claim_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[1].claims.select("graph_id", "id", r6("initial").alias("initial"), r6("score").alias("score"))


@_query
def warrant_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[1].warrants.select("graph_id", "id", r6("initial").alias("initial"), r6("score").alias("score"))


@_query
def gate_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[1].gates.select("graph_id", "edge_idx", r6("gate").alias("gate"))


@_query
def claim_scores_converged(spark: SparkSession, d: str) -> DataFrame:
    """Scores by the preset's own stop rule, with the rounds each graph took."""
    return _scored(spark, d)[1].claims.select("graph_id", "id", r6("score").alias("score"), "iterations")


@_query
def engine_scores(spark: SparkSession, d: str) -> DataFrame:
    """Claims and warrants by the engine's own defaults (alpha 1, at most 50 rounds, 1e-4)."""
    s = _scored(spark, d, scoring.ScoringConfig())[1]
    one = lambda df, kind: df.select("graph_id", F.lit(kind).alias("kind"), "id", r6("initial").alias("initial"), r6("score").alias("score"), "iterations")
    return one(s.claims, "claim").unionByName(one(s.warrants, "warrant"))


@_query
def ungated_scores(spark: SparkSession, d: str) -> DataFrame:
    """Claims where edges without warrants pass everything, with beta 0.5 and a clamp of 1."""
    cfg = replace(scoring.CREDIBILITY, gate_required=False, beta=0.5, clamp_influence=1.0)
    return _scored(spark, d, cfg)[1].claims.select("graph_id", "id", r6("score").alias("score"), "iterations")


@_query
def reasoner_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The tasks of the dispatcher: scores by task, and the number of explained edges of each claim."""
    out = scoring.Reasoner(load_corpus(spark, d)).run(["Credibility", "claim_scores", "warrant_scores", "gate_scores"], explain=True)
    one = lambda df, task, key, value: df.select(F.lit(task).alias("task"), "graph_id", key.cast("string").alias("id"), r6(value).alias("score"))
    rows = [one(out["Credibility"].claims, "Credibility", F.col("id"), "score"), one(out["claim_scores"], "claim_scores", F.col("id"), "score"), one(out["warrant_scores"], "warrant_scores", F.col("id"), "score"), one(out["gate_scores"], "gate_scores", F.col("edge_idx"), "gate")]
    said = out["explanations"].groupBy("graph_id", "dst").agg(F.count("*").cast("double").alias("n"))
    return functools.reduce(DataFrame.unionByName, [*rows, one(said, "explanations", F.col("dst"), "n")])


@_query
def score_explanations(spark: SparkSession, d: str) -> DataFrame:
    e = scoring.explanations(*_scored(spark, d))
    return e.select("graph_id", "edge_id", "src", "dst", "kind", r6("gate").alias("gate"), r6("src_score").alias("src_score"), r6("influence").alias("influence"), "gate_mode")


@_query
def explanation_totals(spark: SparkSession, d: str) -> DataFrame:
    e = scoring.explanation_totals(*_scored(spark, d))
    return e.select("graph_id", "id", F.round("evidence_support", 9).alias("evidence_support"), "incoming", r6("total_influence").alias("total_influence"), r6("final_score").alias("final_score"))


@_query
def warrant_fragility(spark: SparkSession, d: str) -> DataFrame:
    f = scoring.warrant_fragility(*_scored(spark, d))
    return f.select("graph_id", "edge_id", "dst", "gate_mode", r6("gate_score").alias("gate_score"), F.array_join("critical_warrants", ",").alias("critical_warrants"))


@_query
def gated_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations after the gate actions of all patterns of the bank."""
    return _gated(load_corpus(spark, d)).relations.select("graph_id", "edge_idx", "gate_mode", F.coalesce("gate_disabled", F.lit(False)).alias("gate_disabled"), F.coalesce("gate_restricted", F.lit(False)).alias("gate_restricted"), "gate_action")


@_query
def restricted_relations(spark: SparkSession, d: str) -> DataFrame:
    """As gated_relations, with a bank that restricts edges without warrants instead of disabling them."""
    c = load_corpus(spark, d)
    return _gated(c, [(*p[:4], "restrict_edge", p[5]) if p[0] == "unstated_warrant" else p for p in patterns.pattern_bank()]).relations.select(
        "graph_id", "edge_idx", "gate_mode", F.coalesce("gate_disabled", F.lit(False)).alias("gate_disabled"), F.coalesce("gate_restricted", F.lit(False)).alias("gate_restricted"), "gate_action"
    )


def _gated(c: Corpus, bank: list[tuple[str, ...]] | None = None) -> Corpus:
    return replace(c, relations=patterns.apply_gate_actions(c.relations, patterns.detect_patterns(c.units, c.relations, bank)))


@_query
def claim_scores_after_gating(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.score_corpus(_gated(load_corpus(spark, d)))
    return s.claims.select("graph_id", "id", r6("score").alias("score"))


# ---- structure


def _edges(spark: SparkSession, d: str) -> tuple[Corpus, DataFrame]:
    c = load_corpus(spark, d)
    return c, graphs.project_edges(c.relations)


@_query
def degrees(spark: SparkSession, d: str) -> DataFrame:
    c, e = _edges(spark, d)
    return graphs.degrees(c.units, e)


@_query
def weak_components(spark: SparkSession, d: str) -> DataFrame:
    c, e = _edges(spark, d)
    return graphs.weakly_connected(c.units, e)


@_query
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    c, e = _edges(spark, d)
    return graphs.strongly_connected(c.units, e)


@_query
def reachability(spark: SparkSession, d: str) -> DataFrame:
    c, e = _edges(spark, d)
    return graphs.reachability(c.units, e)


@_query
def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that reach themselves: members of larger strong components, and ends of self loops."""
    c, e = _edges(spark, d)
    parts = graphs.strongly_connected(c.units, e)
    many = parts.groupBy("graph_id", "component").count().where("count > 1")
    return parts.join(many, ["graph_id", "component"], "left_semi").select("graph_id", "node").unionByName(e.where("src = dst").select("graph_id", F.col("src").alias("node"))).dropDuplicates()


@_query
def find_cycles(spark: SparkSession, d: str) -> DataFrame:
    c, e = _edges(spark, d)
    return graphs.cycles(c.units, e).select("graph_id", "cycle_no", F.array_join("nodes", ",").alias("nodes"))


@_query
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    out = graphs.diagnostics(c.units, c.warrants, c.relations)
    return out.withColumns({"avg_in": r6("avg_in"), "avg_out": r6("avg_out")})


@_query
def degree_summary(spark: SparkSession, d: str) -> DataFrame:
    c, e = _edges(spark, d)
    n = c.units.groupBy("graph_id").agg(F.count("*").alias("n"))
    s = graphs.degrees(c.units, e).groupBy("graph_id").agg(F.sum("in_degree").alias("i"), F.sum("out_degree").alias("o"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"))
    mean = lambda x: F.coalesce(r6(F.col(x) / F.col("n")), F.lit(0.0))
    return s.join(n, "graph_id", "left").select("graph_id", mean("i").alias("avg_in"), mean("o").alias("avg_out"), "max_in", "max_out")


@_query
def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    return c.relations.groupBy("graph_id").agg(F.count("*").alias("relation_count"), F.count_if(F.col("kind") == "support").alias("support_edges"), F.count_if(F.col("kind").isin("attack", "undercut", "rebut")).alias("attack_edges"))


@_query
def isolated_units(spark: SparkSession, d: str) -> DataFrame:
    c, e = _edges(spark, d)
    return graphs.degrees(c.units, e).where("in_degree = 0 and out_degree = 0").select("graph_id", "node")


@_query
def unsupported_claims(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    return graphs.degrees(c.units, graphs.project_edges(c.relations, ["support"])).where("in_degree = 0").select("graph_id", "node")


@_query
def axioms(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    return graphs.axiom_warnings(c.units, c.warrants)


# ---- critique


def _flat(matches: DataFrame) -> DataFrame:
    return matches.select("graph_id", F.array_join("nodes", ",").alias("nodes"), F.array_join("edges", ",").alias("edges"), "message")


@_query
def self_attack(spark: SparkSession, d: str) -> DataFrame:
    return _flat(patterns.self_attack(load_corpus(spark, d).relations))


@_query
def unstated_warrant(spark: SparkSession, d: str) -> DataFrame:
    return _flat(patterns.unstated_warrant(load_corpus(spark, d).relations))


@_query
def unsupported_conclusion(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    return _flat(patterns.unsupported_conclusion(c.units, c.relations))


@_query
def redundancy(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    return _flat(patterns.redundancy(c.units, c.relations))


@_query
def contradiction(spark: SparkSession, d: str) -> DataFrame:
    return _flat(patterns.contradiction(load_corpus(spark, d).relations))


@_query
def circular_reasoning(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    return _flat(patterns.circular_reasoning(c.units, c.relations))


@_query
def pattern_matches(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    m = patterns.detect_patterns(c.units, c.relations)
    return m.select("graph_id", "match_ord", "pattern_id", "name", "category", "kind", "action", F.array_join("nodes", ",").alias("nodes"), F.array_join("edges", ",").alias("edges"), "message")


# ---- bundles: units of a graph by the last digit of their number


def _members(c: Corpus) -> DataFrame:
    return c.units.select("graph_id", "unit_id", F.concat(F.lit("b"), F.right("unit_id", F.lit(1))).alias("bundle_id"))


def _projection(how: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = load_corpus(spark, d)
        return bundles.project_bundles(_members(c), c.relations, how).select("graph_id", "src", "dst", "kind", (r6("weight") + 0.0).alias("weight"))

    return run


for _how in bundles.AGGREGATIONS:
    QUERIES[f"bundle_projection_{_how}"] = _projection(_how)


@_query
def bundle_relations(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    return bundles.bundle_relations(_members(c), c.relations)


# ---- text


@_query
def sentence_claims(spark: SparkSession, d: str) -> DataFrame:
    return segments.sentence_claims(read_table(spark, d, "documents"), "doc_id", "text")


@_query
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return segments.fixed_windows(read_table(spark, d, "documents"), "doc_id", "text", 1000, 100)


@_query
def paragraph_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.paragraphs(read_table(spark, d, "documents"), "doc_id", "text")


@_query
def claim_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the tags and titles of documents first stand in their texts."""
    docs = read_table(spark, d, "documents").where("text is not null")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    names = docs.select("doc_id", "text", F.explode(F.array_distinct(F.concat(tags, F.array("title")))).alias("claim")).where("claim is not null and claim <> ''")
    start, end = segments.locate(F.col("claim"), F.col("text"), F.lit(0))
    return names.select("doc_id", "claim", start.alias("start"), end.alias("end")).where("start is not null")


@_query
def token_jaccard_edges(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the texts at the two ends of each edge."""
    c = load_corpus(spark, d)
    t = c.units.select("graph_id", "unit_id", ascii_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    e = c.relations.select("graph_id", "edge_idx", "src", "dst")
    e = e.join(t.select("graph_id", F.col("unit_id").alias("src"), F.col("t").alias("a")), ["graph_id", "src"]).join(t.select("graph_id", F.col("unit_id").alias("dst"), F.col("t").alias("b")), ["graph_id", "dst"])
    return e.select("graph_id", "edge_idx", r6(token_jaccard(F.col("a"), F.col("b"))).alias("similarity"))


@_query
def evidence_evaluation(spark: SparkSession, d: str) -> DataFrame:
    e = evaluation.evaluate_evidence(load_corpus(spark, d).units)
    return e.select("graph_id", "unit_id", "pos", "evidence_id", "evaluation", r6("confidence").alias("confidence"), "reasoning")


@_query
def edge_validation(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    v = evaluation.validate_edges(c.units, c.relations)
    return v.select("graph_id", "edge_idx", "kind", r6("confidence").alias("confidence"), "rationale")


# ---- reconciliation: graphs whose ids end in the same character are the segments of one document


def _segmented(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    order = F.substr("graph_id", F.lit(2)).cast("bigint")
    mark = lambda df: df.withColumns({"doc_id": F.right("graph_id", F.lit(1)), "segment_id": F.col("graph_id"), "seg_ord": order})
    doc = c.supporting_documents.withColumnRenamed("doc_id", "document_id")
    return mark(c.units), mark(c.relations), mark(doc), mark(c.evidence_cards)


@_query
def reconciled_units(spark: SparkSession, d: str) -> DataFrame:
    units, *_ = _segmented(load_corpus(spark, d))
    m = reconcile.merge_units(units, reconcile.unit_map(units))
    return m.select("doc_id", "new_id", "text", F.size("source_unit_ids").alias("sources"), r6("evidence_min").alias("evidence_min"), r6("evidence_max").alias("evidence_max"), F.array_join(F.array_sort("evidence_ids"), ",").alias("evidence_ids"))


@_query
def unit_segments(spark: SparkSession, d: str) -> DataFrame:
    units, *_ = _segmented(load_corpus(spark, d))
    return reconcile.unit_segments(reconcile.unit_map(units)).select("doc_id", "new_id", "segment_id")


@_query
def reconciled_relations(spark: SparkSession, d: str) -> DataFrame:
    units, relations, *_ = _segmented(load_corpus(spark, d))
    m = reconcile.merge_relations(relations, reconcile.unit_map(units))
    return m.select("doc_id", "src", "dst", "kind", r6("weight").alias("weight"), "sources")


# ---- JSON, DOT, models


@_query
def dot_lines(spark: SparkSession, d: str) -> DataFrame:
    c = load_corpus(spark, d)
    return dot.dot_lines(c.units, c.relations)


@_query
def decoded_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all payloads that are complete JSON objects."""
    p = read_table(spark, d, "graph_payloads")
    key = F.concat_ws("@", "payload_id", F.col("loaded_at").cast("string"))
    c = graph_json.decode_graphs(p.select(key.alias("k"), "payload"), "k", "payload")
    return c.relations.select(F.substring_index("graph_id", "@", 1).alias("payload_id"), "edge_idx", "src", "dst", "kind", r6("weight").alias("weight"), "gate_mode")


@_query
def claim_types_offline(spark: SparkSession, d: str) -> DataFrame:
    """Claim types by a client that always gives one answer."""
    client = model_hooks.OfflineClient('{"claim_type": "Factual", "confidence": 1.7, "rationale": " set "}')
    return model_hooks.classify_claims(load_corpus(spark, d).units, client)


@_query
def missing_assumptions_offline(spark: SparkSession, d: str) -> DataFrame:
    client = model_hooks.OfflineClient('{"assumptions": [{"assumption": " x ", "importance": 2}, {"assumption": ""}]}')
    out = model_hooks.missing_assumptions(load_corpus(spark, d), client)
    return out.select("graph_id", "edge_idx", "src", "dst", "kind", F.explode("assumptions").alias("a")).select("graph_id", "edge_idx", "src", "dst", "kind", "a.assumption", "a.importance")


@_query
def weighted_claim_credibility(spark: SparkSession, d: str) -> DataFrame:
    """Claim credibility from answers made by rule: an item scores by the length of its excerpt, the claim by its evidence_min."""
    c = load_corpus(spark, d)
    inputs = model_hooks.credibility_inputs(c)
    score = (F.pmod(F.length(F.coalesce("excerpt", F.lit(""))), F.lit(21)) - 10) / 10.0
    lists = inputs.groupBy("graph_id", "unit_id").agg(F.collect_list(F.struct("evidence_id", score.alias("score"), F.col("excerpt").alias("rationale"))).alias("scores"))
    answers = lists.join(c.units.select("graph_id", "unit_id", (F.col("evidence_min") * 2 - 1).alias("model_score")), ["graph_id", "unit_id"])
    out = model_hooks.credibility_scores(inputs, answers)
    return out.select("graph_id", "unit_id", (r6("claim_score") + 0.0).alias("claim_score"), (r6("weighted_score") + 0.0).alias("weighted_score"), "score_source")


# ---- the same in SQL


def _current(name: str, table: str, key: str, deleted: bool = True) -> str:
    order = "loaded_at DESC NULLS LAST" + (", deleted_at ASC NULLS FIRST" if deleted else "")
    alive = " AND deleted_at IS NULL" if deleted else ""
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, {key} ORDER BY {order}) AS rn FROM {table}) WHERE rn = 1{alive})"


_U, _W = _current("u", "units", "unit_id"), _current("w", "warrants", "warrant_id")
_R, _A = _current("r", "relations", "edge_idx", False), _current("a", "warrant_attacks", "attack_idx", False)
_C, _D = _current("c", "evidence_cards", "card_id", False), _current("d", "supporting_documents", "doc_id")
_ENDS = "e AS (SELECT graph_id, edge_idx, src, dst, kind FROM r WHERE src IS NOT NULL AND dst IS NOT NULL)"
_NODES = "n AS (SELECT graph_id, unit_id AS node FROM u UNION SELECT graph_id, src FROM e UNION SELECT graph_id, dst FROM e)"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + "\n"


_CLAMP = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {}))"
_ITEMS = f"""cs AS (
  SELECT c.graph_id, card_id, coalesce(CASE WHEN d.trust IS NULL THEN 1.0 ELSE {_CLAMP.format('d.trust')} END, 1.0)
    * coalesce(CASE WHEN confidence IS NULL THEN NULL ELSE {_CLAMP.format('confidence')} END, 0.0) AS v
  FROM c LEFT JOIN d ON c.graph_id = d.graph_id AND c.supporting_doc_id = d.doc_id
), nodes AS (
  SELECT graph_id, 'claim' AS kind, unit_id AS id, evidence, evidence_ids, score, is_axiom, ignore_influence FROM u
  UNION ALL SELECT graph_id, 'warrant', warrant_id, evidence, evidence_ids, score, is_axiom, ignore_influence FROM w
), items AS (
  SELECT graph_id, kind, id, pos, e.id AS ev_id, e.stance AS stance, e.strength AS strength, TRUE AS inline
  FROM (SELECT graph_id, kind, id, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS pos FROM nodes) WHERE e IS NOT NULL AND e.id IS NOT NULL
  UNION ALL SELECT graph_id, kind, id, 1000000 + pos, ev_id, 'supports', NULL, FALSE
  FROM (SELECT graph_id, kind, id, unnest(evidence_ids) AS ev_id, generate_subscripts(evidence_ids, 1) AS pos FROM nodes) WHERE ev_id IS NOT NULL
), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, kind, id, ev_id ORDER BY pos) AS k FROM items) WHERE k = 1)
, signed AS (
  SELECT f.graph_id, kind, id, CASE WHEN v IS NOT NULL THEN sg * v WHEN inline THEN CASE WHEN sg = 0 THEN 0.0 ELSE sg * coalesce(CASE WHEN strength IS NULL THEN NULL ELSE {_CLAMP.format('strength')} END, 1.0) END END AS s
  FROM (SELECT *, CASE stance WHEN 'supports' THEN 1.0 WHEN 'attacks' THEN -1.0 ELSE 0.0 END AS sg FROM firsts) f LEFT JOIN cs ON f.graph_id = cs.graph_id AND f.ev_id = cs.card_id
), means AS (SELECT graph_id, kind, id, avg(CAST(s AS DOUBLE)) AS m FROM signed WHERE s IS NOT NULL GROUP BY ALL)
, p AS (SELECT *, greatest(CAST(1e-6 AS DOUBLE), least(1 - CAST(1e-6 AS DOUBLE), (greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), coalesce(score, 0))) + 1) / 2)) AS q FROM nodes)
, ev AS (
  SELECT p.graph_id, p.kind, p.id, coalesce(ignore_influence, FALSE) AS skip, coalesce(is_axiom, FALSE) AS axiom, CASE WHEN coalesce(is_axiom, FALSE) THEN ln(q / (1 - q)) / 0.5 WHEN m IS NULL THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), m)) END AS evidence
  FROM p LEFT JOIN means ON p.graph_id = means.graph_id AND p.kind = means.kind AND p.id = means.id
)"""
_SEED = (_U, _W, _C, _D, _ITEMS)
SQL["evidence_support"] = _with(*_SEED) + "SELECT graph_id, kind, id, round(CAST(evidence AS DOUBLE), 9) AS evidence FROM ev"


_TRUE_OFF = "coalesce(gate_disabled, FALSE)"


def _fixpoint_sql(alpha: float = 0.5, beta: float = 1.0, rounds: int = 100, epsilon: float = 1e-6, limit: float = 4.0, required: bool = True, relations: str = "r", off: str = _TRUE_OFF) -> tuple[str, ...]:
    """CTEs ending in s, the scores of every graph after its own last round n, and g, the gates of these scores."""
    sig = "1.0 / (1.0 + exp(-({})))"
    num = lambda x: f"CAST({x} AS DOUBLE)"
    pull = f"CASE WHEN t.skip THEN {num(0)} ELSE greatest({num(-limit)}, least({num(limit)}, coalesce(i.v, 0))) END"
    new = "t.graph_id, t.kind, t.id, t.evidence, t.skip, t.initial, " + sig.format(f"{num(alpha)} * t.evidence + {num(beta)} * {pull}") + " AS score"
    evidence = f"CASE WHEN axiom THEN evidence * 0.5 / {num(alpha)} ELSE evidence END"
    gates = lambda w: (
        f"SELECT rel.graph_id, rel.edge_idx, CASE WHEN rel.off THEN {num(0)} WHEN v.lo IS NULL THEN {num(0 if required else 1)} WHEN rel.gate_mode = 'AND' THEN v.lo ELSE v.hi END AS gate FROM rel LEFT JOIN "
        f"(SELECT used.graph_id, used.edge_idx, min(coalesce(w.score, {num(0.5)})) AS lo, max(coalesce(w.score, {num(0.5)})) AS hi FROM used LEFT JOIN {w} w ON used.graph_id = w.graph_id AND used.wid = w.id GROUP BY ALL) v "
        "ON rel.graph_id = v.graph_id AND rel.edge_idx = v.edge_idx"
    )
    return (
        f"rel AS (SELECT graph_id, edge_idx, src, dst, kind, coalesce(gate_mode, 'OR') AS gate_mode, list_filter(coalesce(warrant_ids, []), lambda x: x IS NOT NULL) AS warrant_ids, {off} AS off FROM {relations})",
        "used AS (SELECT graph_id, edge_idx, unnest(warrant_ids) AS wid FROM rel)",
        f"z AS (SELECT graph_id, kind, id, {evidence} AS evidence, skip FROM ev)",
        f"""x AS (
  SELECT graph_id, kind, id, evidence, skip, {sig.format(f'{num(alpha)} * evidence')} AS initial, {sig.format(f'{num(alpha)} * evidence')} AS score, CAST('inf' AS DOUBLE) AS change, 0 AS n FROM z
  UNION ALL (
    WITH going AS (SELECT graph_id FROM x GROUP BY graph_id HAVING max(change) >= {epsilon} AND max(n) < {rounds}),
    cur AS (SELECT x.* FROM x JOIN going ON x.graph_id = going.graph_id),
    wn AS (SELECT {new}, t.score AS old, t.n FROM cur t LEFT JOIN (SELECT a.graph_id, a.warrant_id, sum(-s.score) AS v FROM a JOIN cur s ON s.kind = 'claim' AND a.graph_id = s.graph_id AND a.src = s.id GROUP BY ALL) i ON t.graph_id = i.graph_id AND t.id = i.warrant_id WHERE t.kind = 'warrant'),
    gn AS ({gates('wn')}),
    cn AS (SELECT {new}, t.score AS old, t.n FROM cur t LEFT JOIN (SELECT rel.graph_id, rel.dst, sum(CASE WHEN rel.kind = 'support' THEN 1 ELSE -1 END * s.score * gn.gate) AS v FROM rel JOIN gn ON rel.graph_id = gn.graph_id AND rel.edge_idx = gn.edge_idx JOIN cur s ON s.kind = 'claim' AND rel.graph_id = s.graph_id AND rel.src = s.id GROUP BY ALL) i ON t.graph_id = i.graph_id AND t.id = i.dst WHERE t.kind = 'claim')
    SELECT graph_id, kind, id, evidence, skip, initial, score, abs(score - old), n + 1 FROM (SELECT * FROM wn UNION ALL SELECT * FROM cn)
  )
)""",
        "s AS (SELECT x.* FROM x JOIN (SELECT graph_id, max(n) AS last FROM x GROUP BY graph_id) l ON x.graph_id = l.graph_id AND x.n = l.last)",
        f"g AS ({gates(chr(40) + 'SELECT * FROM s WHERE kind = ' + chr(39) + 'warrant' + chr(39) + chr(41))})",
    )


_RUN = _with(*_SEED, _R, _A, *_fixpoint_sql(), recursive=True)
SQL["claim_scores"] = _RUN + "SELECT graph_id, id, round(initial, 6) AS initial, round(score, 6) AS score FROM s WHERE kind = 'claim'"
SQL["claim_scores_converged"] = _RUN + "SELECT graph_id, id, round(score, 6) AS score, n AS iterations FROM s WHERE kind = 'claim'"
SQL["warrant_scores"] = _RUN + "SELECT graph_id, id, round(initial, 6) AS initial, round(score, 6) AS score FROM s WHERE kind = 'warrant'"
SQL["gate_scores"] = _RUN + "SELECT graph_id, edge_idx, round(gate, 6) AS gate FROM g"
SQL["engine_scores"] = _with(*_SEED, _R, _A, *_fixpoint_sql(1.0, 1.0, 50, 1e-4), recursive=True) + "SELECT graph_id, kind, id, round(initial, 6) AS initial, round(score, 6) AS score, n AS iterations FROM s"
SQL["ungated_scores"] = _with(*_SEED, _R, _A, *_fixpoint_sql(beta=0.5, limit=1.0, required=False), recursive=True) + "SELECT graph_id, id, round(score, 6) AS score, n AS iterations FROM s WHERE kind = 'claim'"
_CLAIM = "(SELECT * FROM s WHERE kind = 'claim')"
_EXPLAIN = f"y AS (SELECT rel.*, g.gate, coalesce(c.score, CAST(0 AS DOUBLE)) AS src_score, CASE WHEN rel.kind = 'support' THEN 1 ELSE -1 END * coalesce(c.score, 0) * g.gate AS influence FROM rel JOIN {_CLAIM} t ON rel.graph_id = t.graph_id AND rel.dst = t.id JOIN g ON rel.graph_id = g.graph_id AND rel.edge_idx = g.edge_idx LEFT JOIN {_CLAIM} c ON rel.graph_id = c.graph_id AND rel.src = c.id)"
_RUN_X = _with(*_SEED, _R, _A, *_fixpoint_sql(), _EXPLAIN, recursive=True)
SQL["score_explanations"] = _RUN_X + "SELECT graph_id, 'e' || edge_idx AS edge_id, src, dst, kind, round(gate, 6) AS gate, round(src_score, 6) AS src_score, round(influence, 6) AS influence, gate_mode FROM y"
SQL["explanation_totals"] = _RUN_X + f"SELECT t.graph_id, t.id, round(t.evidence, 9) AS evidence_support, count(y.edge_idx) AS incoming, round(coalesce(sum(y.influence), CAST(0 AS DOUBLE)), 6) AS total_influence, round(t.score, 6) AS final_score FROM {_CLAIM} t LEFT JOIN y ON t.graph_id = y.graph_id AND t.id = y.dst GROUP BY t.graph_id, t.id, t.evidence, t.score"
SQL["reasoner_tasks"] = _RUN_X + """SELECT task, graph_id, id, round(score, 6) AS score FROM (
  SELECT unnest(['Credibility', 'claim_scores']) AS task, graph_id, id, score FROM s WHERE kind = 'claim' UNION ALL SELECT 'warrant_scores', graph_id, id, score FROM s WHERE kind = 'warrant'
  UNION ALL SELECT 'gate_scores', graph_id, CAST(edge_idx AS VARCHAR), gate FROM g UNION ALL SELECT 'explanations', graph_id, dst, CAST(count(*) AS DOUBLE) FROM y GROUP BY graph_id, dst)"""
_FRAGILE = """
SELECT y.graph_id, 'e' || y.edge_idx AS edge_id, dst, gate_mode, round(g.gate, 6) AS gate_score, string_agg(wid, ',' ORDER BY pos) AS critical_warrants
FROM (SELECT v.*, coalesce(w.score, CAST(0.5 AS DOUBLE)) AS v, min(coalesce(w.score, CAST(0.5 AS DOUBLE))) OVER (PARTITION BY v.graph_id, v.edge_idx) AS lo, max(coalesce(w.score, CAST(0.5 AS DOUBLE))) OVER (PARTITION BY v.graph_id, v.edge_idx) AS hi
  FROM (SELECT graph_id, edge_idx, dst, gate_mode, unnest(warrant_ids) AS wid, generate_subscripts(warrant_ids, 1) AS pos FROM r) v LEFT JOIN (SELECT * FROM s WHERE kind = 'warrant') w ON v.graph_id = w.graph_id AND v.wid = w.id) y
JOIN g ON y.graph_id = g.graph_id AND y.edge_idx = g.edge_idx WHERE v = CASE WHEN gate_mode = 'AND' THEN lo ELSE hi END GROUP BY ALL"""
SQL["warrant_fragility"] = _RUN + _FRAGILE
_BARE = "(warrant_ids IS NULL OR len(warrant_ids) = 0)"
_SELF = "(coalesce(kind = 'attack' AND src = dst, FALSE))"

_DEG = "g AS (SELECT graph_id, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT graph_id, dst AS node, 1 AS i, 0 AS o FROM e UNION ALL SELECT graph_id, src, 0, 1 FROM e UNION ALL SELECT graph_id, unit_id, 0, 0 FROM u) GROUP BY ALL)"
SQL["degrees"] = _with(_U, _R, _ENDS, _DEG) + "SELECT * FROM g"
SQL["isolated_units"] = _with(_U, _R, _ENDS, _DEG) + "SELECT graph_id, node FROM g WHERE in_degree = 0 AND out_degree = 0"
SQL["degree_summary"] = _with(_U, _R, _ENDS, _DEG) + "SELECT g.graph_id, coalesce(round(sum(in_degree) / CAST(max(n) AS DOUBLE), 6), 0) AS avg_in, coalesce(round(sum(out_degree) / CAST(max(n) AS DOUBLE), 6), 0) AS avg_out, max(in_degree) AS max_in, max(out_degree) AS max_out FROM g LEFT JOIN (SELECT graph_id, count(*) AS n FROM u GROUP BY ALL) m ON g.graph_id = m.graph_id GROUP BY g.graph_id"
SQL["unsupported_claims"] = _with(_U, _R, "e AS (SELECT graph_id, src, dst FROM r WHERE src IS NOT NULL AND dst IS NOT NULL AND kind = 'support')", _DEG) + "SELECT graph_id, node FROM g WHERE in_degree = 0"
SQL["edge_counts"] = _with(_R) + "SELECT graph_id, count(*) AS relation_count, count(*) FILTER (kind = 'support') AS support_edges, count(*) FILTER (kind IN ('attack', 'undercut', 'rebut')) AS attack_edges FROM r GROUP BY ALL"
SQL["axioms"] = _with(_U, _W) + "SELECT graph_id, 'claim' AS kind, unit_id AS id, 'axiom claim ''' || unit_id || ''' bypasses evidence requirements.' AS warning FROM u WHERE is_axiom UNION ALL SELECT graph_id, 'warrant', warrant_id, 'axiom warrant ''' || warrant_id || ''' bypasses evidence requirements.' FROM w WHERE is_axiom"
_BOTH = "l AS (SELECT graph_id, src AS a, dst AS b FROM e UNION SELECT graph_id, dst, src FROM e)"
SQL["weak_components"] = _with(_U, _R, _ENDS, _NODES, _BOTH, "t AS (SELECT graph_id, node AS a, node AS b FROM n UNION SELECT t.graph_id, t.a, l.b FROM t JOIN l ON t.graph_id = l.graph_id AND t.b = l.a)", recursive=True) + "SELECT graph_id, a AS node, min(b) AS component FROM t GROUP BY ALL"
_CLOSE = "t AS (SELECT graph_id, src, dst FROM e UNION SELECT t.graph_id, t.src, e.dst FROM t JOIN e ON t.graph_id = e.graph_id AND t.dst = e.src)"
SQL["reachability"] = _with(_R, _ENDS, _CLOSE, recursive=True) + "SELECT graph_id, src, dst FROM t"
SQL["cycle_nodes"] = _with(_R, _ENDS, _CLOSE, recursive=True) + "SELECT graph_id, src AS node FROM t WHERE src = dst"
SQL["strong_components"] = _with(_U, _R, _ENDS, _NODES, _CLOSE, recursive=True) + "SELECT n.graph_id, n.node, least(n.node, min(x.dst)) AS component FROM n LEFT JOIN (SELECT p.graph_id, p.src, p.dst FROM t p JOIN t q ON p.graph_id = q.graph_id AND p.src = q.dst AND p.dst = q.src) x ON n.graph_id = x.graph_id AND n.node = x.src GROUP BY n.graph_id, n.node"

SQL["self_attack"] = _with(_R) + "SELECT graph_id, src AS nodes, 'e' || edge_idx AS edges, 'Attack edge targets the same claim.' AS message FROM r WHERE kind = 'attack' AND src = dst"
SQL["unstated_warrant"] = _with(_R) + f"SELECT graph_id, concat_ws(',', src, dst) AS nodes, 'e' || edge_idx AS edges, 'Edge has no explicit warrants.' AS message FROM r WHERE {_BARE}"
SQL["unsupported_conclusion"] = _with(_U, _R) + "SELECT graph_id, unit_id AS nodes, '' AS edges, 'Claim has no incoming support edges.' AS message FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.graph_id = u.graph_id AND r.dst = u.unit_id AND kind = 'support')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
_NORMAL = f"regexp_replace(trim(lower(coalesce(u.text, '')), {_BLANKS}), '[' || {_BLANKS} || ']+', ' ', 'g')"
SQL["redundancy"] = _with(_U, _R) + f"""
SELECT graph_id, array_to_string(list_sort(list_distinct(list_append(s, dst))), ',') AS nodes, '' AS edges, 'Redundant supports to ' || dst || ': ' || array_to_string(s, ', ') || '.' AS message
FROM (SELECT r.graph_id, dst, {_NORMAL} AS t, list(src ORDER BY edge_idx) AS s FROM r JOIN u ON r.graph_id = u.graph_id AND r.src = u.unit_id WHERE kind = 'support' AND dst IS NOT NULL GROUP BY ALL) WHERE len(s) > 1"""
SQL["contradiction"] = _with(_R) + """
SELECT graph_id, src || ',' || dst AS nodes, array_to_string(list_concat(s, a), ',') AS edges, 'Same source both supports and attacks the target.' AS message
FROM (SELECT graph_id, src, dst, list('e' || edge_idx ORDER BY edge_idx) FILTER (kind = 'support') AS s, list('e' || edge_idx ORDER BY edge_idx) FILTER (kind = 'attack') AS a FROM r WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL) WHERE s IS NOT NULL AND a IS NOT NULL"""
def _walk(edges: str, out: str) -> tuple[str, ...]:
    """CTEs ending in ``out`` (graph_id, nodes): the cycles of one depth-first walk per graph over the CTE ``edges``, a step of the walk per round."""
    p = out + "_"
    return (
        f"{p}n AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY a, b, c, node) AS i FROM (SELECT graph_id, node, min(a) AS a, arg_min(b, (a, b, c)) AS b, arg_min(c, (a, b, c)) AS c FROM (SELECT graph_id, unit_id AS node, 0 AS a, ord AS b, 0 AS c FROM u UNION ALL SELECT graph_id, src, 1, edge_idx, 0 FROM {edges} UNION ALL SELECT graph_id, dst, 1, edge_idx, 1 FROM {edges}) GROUP BY graph_id, node))",
        f"{p}o AS (SELECT n.graph_id, n.i, n.node, coalesce(list(m.i ORDER BY e.edge_idx) FILTER (m.i IS NOT NULL), []) AS out FROM {p}n n LEFT JOIN {edges} e ON n.graph_id = e.graph_id AND n.node = e.src LEFT JOIN {p}n m ON e.graph_id = m.graph_id AND e.dst = m.node GROUP BY ALL)",
        f"{p}g AS (SELECT graph_id, list(out ORDER BY i) AS adj, list(node ORDER BY i) AS names, count(*) AS size FROM {p}o GROUP BY graph_id)",
        f"""{p}w AS (
  SELECT graph_id, CAST(0 AS BIGINT) AS root, CAST([] AS BIGINT[]) AS stack, CAST([] AS BIGINT[]) AS ptr, list_transform(range(size), lambda x: CAST(0 AS BIGINT)) AS mark, CAST(NULL AS BIGINT[]) AS cyc FROM {p}g
  UNION ALL SELECT graph_id, CASE act WHEN 'next' THEN root + 1 ELSE root END,
    CASE act WHEN 'pop' THEN stack[:-2] WHEN 'push' THEN list_append(stack, child) WHEN 'next' THEN CASE WHEN mark[root + 1] = 0 THEN [root + 1] ELSE [] END ELSE stack END,
    CASE act WHEN 'pop' THEN ptr[:-2] WHEN 'push' THEN list_append(list_append(ptr[:-2], ptr[-1] + 1), 1) WHEN 'next' THEN CASE WHEN mark[root + 1] = 0 THEN [1] ELSE [] END ELSE list_append(ptr[:-2], ptr[-1] + 1) END,
    CASE WHEN act = 'pop' THEN list_concat(list_append(mark[:stack[-1] - 1], 2), mark[stack[-1] + 1:]) WHEN act = 'push' THEN list_concat(list_append(mark[:child - 1], 1), mark[child + 1:])
      WHEN act = 'next' AND mark[root + 1] = 0 THEN list_concat(list_append(mark[:root], 1), mark[root + 2:]) ELSE mark END,
    CASE act WHEN 'cycle' THEN stack[list_position(stack, child):] END
  FROM (SELECT *, CASE WHEN len(stack) = 0 THEN 'next' WHEN child IS NULL THEN 'pop' WHEN mark[child] = 0 THEN 'push' WHEN mark[child] = 1 THEN 'cycle' ELSE 'skip' END AS act
    FROM (SELECT w.*, CASE WHEN len(w.stack) > 0 THEN g.adj[w.stack[-1]][w.ptr[-1]] END AS child FROM {p}w w JOIN {p}g g ON w.graph_id = g.graph_id WHERE len(w.stack) > 0 OR w.root < g.size))
)""",
        f"""{out} AS (SELECT graph_id, nodes, row_number() OVER (PARTITION BY graph_id ORDER BY nodes) - 1 AS cycle_no FROM (SELECT DISTINCT graph_id, list_concat(c[list_position(c, list_min(c)):], c[:list_position(c, list_min(c)) - 1]) AS nodes
  FROM (SELECT w.graph_id, list_transform(w.cyc, lambda x: g.names[x]) AS c FROM {p}w w JOIN {p}g g ON w.graph_id = g.graph_id WHERE w.cyc IS NOT NULL)))""",
    )


_SUPPORT = "es AS (SELECT graph_id, edge_idx, src, dst FROM r WHERE src IS NOT NULL AND dst IS NOT NULL AND kind = 'support')"
SQL["find_cycles"] = _with(_U, _R, _ENDS, *_walk("e", "cy"), recursive=True) + "SELECT graph_id, CAST(cycle_no AS INTEGER) AS cycle_no, array_to_string(nodes, ',') AS nodes FROM cy"
_CIRCLES = """ci AS (SELECT q.graph_id, q.cycle_no, q.nodes, list('e' || es.edge_idx ORDER BY es.edge_idx) AS edges FROM (
  SELECT graph_id, cycle_no, nodes, unnest(nodes) AS a, unnest(list_append(nodes[2:], nodes[1])) AS b FROM cis WHERE len(nodes) > 1) q JOIN es ON q.graph_id = es.graph_id AND q.a = es.src AND q.b = es.dst GROUP BY ALL)"""
_CIRCULAR = (_SUPPORT, *_walk("es", "cis"), _CIRCLES)
SQL["circular_reasoning"] = _with(_U, _R, *_CIRCULAR, recursive=True) + "SELECT graph_id, array_to_string(nodes, ',') AS nodes, array_to_string(edges, ',') AS edges, 'Support cycle detected across ' || len(nodes) || ' claims.' AS message FROM ci"


def _matches() -> tuple[str, ...]:
    """CTE ending in m: all matches with the pattern's rank and their order, nodes and edges as lists."""
    plain = f"""m0 AS (
  SELECT graph_id, 0 AS rank, CAST(cycle_no AS BIGINT) AS o, 'circular_reasoning' AS pattern_id, nodes, edges, 'Support cycle detected across ' || len(nodes) || ' claims.' AS message FROM ci
  UNION ALL SELECT graph_id, 1, edge_idx * 2, 'self_attack', [src], ['e' || edge_idx], 'Attack edge targets the same claim.' FROM r WHERE kind = 'attack' AND src = dst
  UNION ALL SELECT graph_id, 1, edge_idx * 2 + 1, 'unstated_warrant', [src, dst], ['e' || edge_idx], 'Edge has no explicit warrants.' FROM r WHERE {_BARE}
  UNION ALL SELECT graph_id, 2, ord, 'unsupported_conclusion', [unit_id], [], 'Claim has no incoming support edges.' FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.graph_id = u.graph_id AND r.dst = u.unit_id AND kind = 'support')
  UNION ALL SELECT graph_id, 3, first, 'redundancy', list_sort(list_distinct(list_append(s, dst))), [], 'Redundant supports to ' || dst || ': ' || array_to_string(s, ', ') || '.'
    FROM (SELECT r.graph_id, dst, {_NORMAL} AS t, list(src ORDER BY edge_idx) AS s, min(edge_idx) AS first FROM r JOIN u ON r.graph_id = u.graph_id AND r.src = u.unit_id WHERE kind = 'support' AND dst IS NOT NULL GROUP BY ALL) WHERE len(s) > 1
  UNION ALL SELECT graph_id, 4, first, 'contradiction', [src, dst], list_concat(s, a), 'Same source both supports and attacks the target.'
    FROM (SELECT graph_id, src, dst, min(edge_idx) FILTER (kind IN ('support', 'attack')) AS first, list('e' || edge_idx ORDER BY edge_idx) FILTER (kind = 'support') AS s, list('e' || edge_idx ORDER BY edge_idx) FILTER (kind = 'attack') AS a FROM r WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL) WHERE s IS NOT NULL AND a IS NOT NULL)"""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    bank = "b AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(quoted, p))})" for p in patterns.PATTERNS) + ") t(pattern_id, name, category, kind, action, description))"
    return (*_CIRCULAR, plain, bank, "m AS (SELECT m0.graph_id, rank * 1000000000000 + o AS match_ord, b.*, nodes, edges, message FROM m0 JOIN b ON m0.pattern_id = b.pattern_id)")


SQL["pattern_matches"] = _with(_U, _R, *_matches(), recursive=True) + "SELECT graph_id, match_ord, pattern_id, name, category, kind, action, array_to_string(nodes, ',') AS nodes, array_to_string(edges, ',') AS edges, message FROM m"


def _acted(restrict: str = "") -> str:
    """CTE ra: the relations after the actions, edges of the pattern ``restrict`` being restricted instead of disabled."""
    return f"""ra AS (SELECT r.* REPLACE (coalesce(gate_disabled, FALSE) OR coalesce(dis, FALSE) AS gate_disabled, coalesce(gate_restricted, FALSE) OR coalesce(res, FALSE) AS gate_restricted, CASE WHEN res THEN 'AND' ELSE gate_mode END AS gate_mode, coalesce(p, gate_action) AS gate_action)
  FROM r LEFT JOIN (SELECT graph_id, e, arg_max(pattern_id, match_ord) AS p, bool_or(pattern_id <> '{restrict}') AS dis, bool_or(pattern_id = '{restrict}') AS res FROM (SELECT graph_id, match_ord, pattern_id, unnest(edges) AS e FROM m WHERE action = 'disable_edge') GROUP BY graph_id, e) q ON r.graph_id = q.graph_id AND 'e' || r.edge_idx = q.e)"""


SQL["gated_relations"] = _with(_U, _R, *_matches(), _acted(), recursive=True) + "SELECT graph_id, edge_idx, gate_mode, gate_disabled, gate_restricted, gate_action FROM ra"
SQL["restricted_relations"] = _with(_U, _R, *_matches(), _acted("unstated_warrant"), recursive=True) + "SELECT graph_id, edge_idx, gate_mode, gate_disabled, gate_restricted, gate_action FROM ra"
SQL["claim_scores_after_gating"] = _with(*_SEED, _R, _A, *_matches(), _acted(), *_fixpoint_sql(relations="ra"), recursive=True) + "SELECT graph_id, id, round(score, 6) AS score FROM s WHERE kind = 'claim'"
SQL["diagnostics"] = _with(
    _U, _R, _W, _ENDS, _SUPPORT, _NODES, *_walk("e", "cy"), _BOTH, _CLOSE,
    "wc AS (SELECT graph_id, node AS a, node AS b FROM n UNION SELECT wc.graph_id, wc.a, l.b FROM wc JOIN l ON wc.graph_id = l.graph_id AND wc.b = l.a)",
    "wk AS (SELECT graph_id, count(DISTINCT c) AS component_count FROM (SELECT graph_id, a, min(b) AS c FROM wc GROUP BY ALL) GROUP BY graph_id)",
    "sk AS (SELECT graph_id, count(DISTINCT c) AS scc_count FROM (SELECT n.graph_id, n.node, least(n.node, min(x.dst)) AS c FROM n LEFT JOIN (SELECT p.graph_id, p.src, p.dst FROM t p JOIN t q ON p.graph_id = q.graph_id AND p.src = q.dst AND p.dst = q.src) x ON n.graph_id = x.graph_id AND n.node = x.src GROUP BY n.graph_id, n.node) GROUP BY graph_id)",
    "dg AS (SELECT n.graph_id, n.node, (SELECT count(*) FROM e WHERE e.graph_id = n.graph_id AND e.dst = n.node) AS i, (SELECT count(*) FROM e WHERE e.graph_id = n.graph_id AND e.src = n.node) AS o FROM n)",
    "dd AS (SELECT graph_id, sum(i) AS ti, sum(o) AS tt, max(i) AS max_in, max(o) AS max_out, count(*) FILTER (i = 0 AND o = 0) AS isolated_units FROM dg GROUP BY graph_id)",
    "us AS (SELECT k.graph_id, count(*) AS unsupported_claims FROM (SELECT graph_id, unit_id AS node FROM u UNION SELECT graph_id, src FROM es UNION SELECT graph_id, dst FROM es) k WHERE NOT EXISTS (SELECT 1 FROM es WHERE es.graph_id = k.graph_id AND es.dst = k.node) GROUP BY k.graph_id)",
    "un AS (SELECT graph_id, count(*) AS node_count, count(*) FILTER (is_axiom) AS axiom_claims FROM u GROUP BY graph_id)",
    "rn AS (SELECT graph_id, count(*) AS relation_count, count(*) FILTER (kind = 'support') AS support_edge_count, count(*) FILTER (kind IN ('attack', 'undercut', 'rebut')) AS attack_edge_count FROM r GROUP BY graph_id)",
    "wn AS (SELECT graph_id, count(*) FILTER (is_axiom) AS axiom_warrants FROM w GROUP BY graph_id)",
    "cn AS (SELECT graph_id, count(*) AS cycle_count FROM cy GROUP BY graph_id)",
    "rc AS (SELECT graph_id, max(k) AS max_reachability FROM (SELECT graph_id, src, count(*) AS k FROM t GROUP BY ALL) GROUP BY graph_id)",
    "al AS (SELECT graph_id FROM u UNION SELECT graph_id FROM r)", recursive=True,
) + "SELECT al.graph_id, " + ", ".join(f"coalesce({x}, 0) AS {x}" for x in ("node_count", "relation_count", "attack_edge_count", "support_edge_count", "cycle_count", "component_count", "scc_count", "isolated_units", "unsupported_claims", "max_in", "max_out", "max_reachability", "axiom_claims", "axiom_warrants")) + """,
  CASE WHEN node_count > 0 THEN round(coalesce(ti, 0) / CAST(node_count AS DOUBLE), 6) ELSE 0 END AS avg_in, CASE WHEN node_count > 0 THEN round(coalesce(tt, 0) / CAST(node_count AS DOUBLE), 6) ELSE 0 END AS avg_out
FROM al LEFT JOIN un ON al.graph_id = un.graph_id LEFT JOIN rn ON al.graph_id = rn.graph_id LEFT JOIN wn ON al.graph_id = wn.graph_id LEFT JOIN dd ON al.graph_id = dd.graph_id LEFT JOIN us ON al.graph_id = us.graph_id
LEFT JOIN wk ON al.graph_id = wk.graph_id LEFT JOIN sk ON al.graph_id = sk.graph_id LEFT JOIN cn ON al.graph_id = cn.graph_id LEFT JOIN rc ON al.graph_id = rc.graph_id"""

_EXACT = "CAST(sum(CAST(CAST({} AS VARCHAR) AS DECIMAL(38, 18))) AS DOUBLE)"
_SOFT = "pow(CAST(2.718281828 AS DOUBLE), abs(w))"
_AGG = {"sum": _EXACT.format("w"), "mean": _EXACT.format("w") + " / count(w)", "max": "arg_max(w, {'m': abs(w), 'at': -edge_idx})", "softmax": _EXACT.format(f"w * {_SOFT}") + f" / sum({_SOFT})"}
for _how, _sql in _AGG.items():
    SQL[f"bundle_projection_{_how}"] = _with(_U, _R, "m AS (SELECT graph_id, unit_id, 'b' || right(unit_id, 1) AS b FROM u)") + f"""
SELECT graph_id, src, dst, CASE WHEN x >= 0 THEN 'support' ELSE 'attack' END AS kind, round(x, 6) + 0.0 AS weight FROM (
  SELECT graph_id, src, dst, greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), {_sql})) AS x FROM (
    SELECT r.graph_id, p.b AS src, q.b AS dst, edge_idx, CASE WHEN kind = 'support' THEN coalesce(weight, 1) ELSE -abs(coalesce(weight, 1)) END AS w
    FROM r JOIN m p ON r.graph_id = p.graph_id AND r.src = p.unit_id JOIN m q ON r.graph_id = q.graph_id AND r.dst = q.unit_id WHERE p.b <> q.b) GROUP BY ALL)"""
SQL["bundle_relations"] = _with(_U, _R, "m AS (SELECT graph_id, unit_id, 'b' || right(unit_id, 1) AS b FROM u)") + "SELECT r.graph_id, p.b AS bundle_id, edge_idx FROM r JOIN m p ON r.graph_id = p.graph_id AND r.src = p.unit_id JOIN m q ON r.graph_id = q.graph_id AND r.dst = q.unit_id WHERE p.b = q.b"

SQL["sentence_claims"] = f"""
SELECT doc_id, CAST(n - 1 AS INTEGER) AS ord, 'c' || n AS claim_id, said AS text, CAST(stop - length(piece) AS INTEGER) AS "start", CAST(stop AS INTEGER) AS "end" FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (
    SELECT doc_id, pos, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop, trim(piece, {_BLANKS}) AS said, regexp_full_match(piece, '[.!?]') AS stray FROM (
      SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]?|[.!?]') AS p FROM documents)))
  WHERE said <> '' AND NOT stray)"""
SQL["fixed_windows"] = f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS seg_idx, 'seg-' || row_number() OVER (PARTITION BY doc_id ORDER BY s) AS seg_id, w AS text, CAST(s AS INTEGER) AS "start", CAST(least(s + 1000, n) AS INTEGER) AS "end"
FROM (SELECT doc_id, s, n, substring(text, CAST(s + 1 AS BIGINT), 1000) AS w FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(length(text) - 101, 0) + 1, 900)) AS s FROM documents WHERE text <> '')) WHERE trim(w, {_BLANKS}) <> ''"""
SQL["claim_spans"] = """
SELECT doc_id, claim, CAST(place - 1 AS INTEGER) AS "start", CAST(place - 1 + length(claim) AS INTEGER) AS "end" FROM (
  SELECT doc_id, claim, strpos(lower(text), lower(claim)) AS place FROM (SELECT DISTINCT doc_id, text, unnest(list_append(coalesce(tags, []), title)) AS claim FROM documents WHERE text IS NOT NULL) WHERE claim IS NOT NULL AND claim <> '') WHERE place > 0"""
_TOK = lambda t, p: f"list_distinct(regexp_extract_all(lower(coalesce({t}, '')), '{p}'))"
_PAIR = "FROM r JOIN u p ON r.graph_id = p.graph_id AND r.src = p.unit_id JOIN u q ON r.graph_id = q.graph_id AND r.dst = q.unit_id"
_OVER = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST({e} AS DOUBLE) ELSE len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END"
SQL["token_jaccard_edges"] = _with(_U, _R) + f"SELECT graph_id, edge_idx, round({_OVER.format(e='CASE WHEN len(a) = len(b) THEN 1 ELSE 0 END')}, 6) AS similarity FROM (SELECT r.graph_id, edge_idx, {_TOK('p.text', '[a-z0-9]+')} AS a, {_TOK('q.text', '[a-z0-9]+')} AS b {_PAIR})"
_WORD = r"[\pL\pN]+"
SQL["edge_validation"] = _with(_U, _R, f"v AS (SELECT graph_id, edge_idx, {_OVER.format(e='0')} AS o FROM (SELECT r.graph_id, edge_idx, {_TOK('p.text', _WORD)} AS a, {_TOK('q.text', _WORD)} AS b {_PAIR}))") + """
SELECT r.graph_id, r.edge_idx, CASE WHEN o > 0.05 THEN 'support' ELSE kind END AS kind, round(CASE WHEN o IS NULL THEN confidence WHEN o >= 0.4 THEN o WHEN o <= 0.05 THEN 0 ELSE o * 0.5 END, 6) AS confidence,
  CASE WHEN o IS NULL THEN rationale WHEN o >= 0.4 THEN 'Claims share key terms, indicating support.' WHEN o <= 0.05 THEN 'Little overlap; relation is unclear.' ELSE 'Some overlap suggests weak support.' END AS rationale
FROM r LEFT JOIN v ON r.graph_id = v.graph_id AND r.edge_idx = v.edge_idx"""
_REPR = "replace(e.source.structured, '\"', '''')"
SQL["evidence_evaluation"] = _with(_U, f"""v AS (SELECT graph_id, unit_id, pos, evidence_id, {_OVER.format(e='0')} AS o FROM (
  SELECT graph_id, unit_id, pos - 1 AS pos, e.id AS evidence_id, {_TOK('text', _WORD)} AS a,
    {_TOK("CASE WHEN e.source.span IS NOT NULL THEN e.source.span.text ELSE coalesce(nullif(json_extract_string(e.source.structured, '$.text'), ''), nullif(json_extract_string(e.source.structured, '$.excerpt'), ''), " + _REPR + ") END", _WORD)} AS b
  FROM (SELECT graph_id, unit_id, text, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS pos FROM u) WHERE e IS NOT NULL))""") + """
SELECT graph_id, unit_id, CAST(pos AS INTEGER) AS pos, evidence_id, CASE WHEN o >= 0.35 OR o > 0.05 THEN 'supports' ELSE 'neutral' END AS evaluation, round(CASE WHEN o >= 0.35 THEN o WHEN o <= 0.05 THEN 0 ELSE o * 0.5 END, 6) AS confidence,
  CASE WHEN o >= 0.35 THEN 'High lexical overlap suggests support.' WHEN o <= 0.05 THEN 'Low lexical overlap suggests neutrality.' ELSE 'Moderate overlap suggests weak support.' END AS reasoning FROM v"""
_MAP = f"k AS (SELECT right(graph_id, 1) AS doc_id, graph_id, CAST(substr(graph_id, 2) AS BIGINT) AS seg_ord, ord, unit_id, text, evidence_min, evidence_max, evidence_ids, trim(lower(coalesce(text, '')), {_BLANKS}) AS key FROM u)"
_FIRST = "f AS (SELECT doc_id, key, min({'s': seg_ord, 'o': ord, 'u': unit_id}) AS first FROM k GROUP BY ALL), i AS (SELECT doc_id, key, 'c' || row_number() OVER (PARTITION BY doc_id ORDER BY first) AS new_id FROM f), m AS (SELECT k.*, new_id FROM k JOIN i ON k.doc_id = i.doc_id AND k.key = i.key)"
SQL["reconciled_units"] = _with(_U, _MAP, _FIRST) + "SELECT doc_id, new_id, arg_min(struct_pack(t := text), {'s': seg_ord, 'o': ord, 'u': unit_id}).t AS text, CAST(count(*) AS INTEGER) AS sources, round(min(evidence_min), 6) AS evidence_min, round(max(evidence_max), 6) AS evidence_max, coalesce(array_to_string(list_sort(list_distinct(flatten(list(list_filter(coalesce(evidence_ids, []), lambda x: x IS NOT NULL))))), ','), '') AS evidence_ids FROM m GROUP BY doc_id, new_id"
SQL["unit_segments"] = _with(_U, _MAP, _FIRST) + "SELECT DISTINCT doc_id, new_id, graph_id AS segment_id FROM m"
SQL["reconciled_relations"] = _with(_U, _R, _MAP, _FIRST) + "SELECT p.doc_id, p.new_id AS src, q.new_id AS dst, kind, round(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), sum(coalesce(weight, 1)))), 6) AS weight, count(*) AS sources FROM r JOIN m p ON r.graph_id = p.graph_id AND r.src = p.unit_id JOIN m q ON r.graph_id = q.graph_id AND r.dst = q.unit_id GROUP BY p.doc_id, p.new_id, q.new_id, kind"
SQL["dot_lines"] = _with(_U, _R, "g AS (SELECT graph_id FROM u UNION SELECT graph_id FROM r)") + r"""
SELECT graph_id, 0 AS part, 0 AS at, 'digraph ArgumentGraph {' AS line FROM g UNION ALL SELECT graph_id, 0, 1, '  node [shape=box];' FROM g
UNION ALL SELECT graph_id, 1, ord, '  "' || unit_id || '" [label="' || replace(replace(replace(unit_id || ': ' || coalesce(text, ''), '\', '\\'), '"', '\"'), chr(10), '\n') || '"];' FROM u
UNION ALL SELECT graph_id, 2, edge_idx, '  "' || coalesce(src, '') || '" -> "' || coalesce(dst, '') || '" [label="' || coalesce(kind, '') || '", color="' || CASE kind WHEN 'support' THEN 'green' WHEN 'attack' THEN 'red' WHEN 'undercut' THEN 'orange' WHEN 'rebut' THEN 'blue' ELSE 'black' END || '"];' FROM r
UNION ALL SELECT graph_id, 3, 0, '}' FROM g"""
SQL["decoded_relations"] = """
SELECT payload_id, CAST(i AS INTEGER) AS edge_idx, json_extract_string(x, '$.src') AS src, json_extract_string(x, '$.dst') AS dst, json_extract_string(x, '$.kind') AS kind, round(CAST(json_extract_string(x, '$.weight') AS DOUBLE), 6) AS weight, coalesce(json_extract_string(x, '$.gate_mode'), 'OR') AS gate_mode
FROM (SELECT payload_id, i, json_extract(j, '$.relations[' || i || ']') AS x FROM (SELECT payload_id, j, unnest(range(CAST(coalesce(json_array_length(j, '$.relations'), 0) AS BIGINT))) AS i FROM (SELECT payload_id, CAST(CASE WHEN json_valid(payload) THEN payload END AS JSON) AS j FROM graph_payloads) WHERE json_type(j) = 'OBJECT'))"""
SQL["claim_types_offline"] = _with(_U) + "SELECT graph_id, unit_id, 'fact' AS claim_type, CAST(1 AS DOUBLE) AS confidence, 'set' AS rationale FROM u"
SQL["missing_assumptions_offline"] = _with(_U, _R) + f"SELECT r.graph_id, edge_idx, src, dst, kind, 'x' AS assumption, CAST(1 AS DOUBLE) AS importance {_PAIR} WHERE kind IN ('support', 'attack', 'undercut', 'rebut')"
_VOID = " OR ".join("contains(x, '" + p.replace("'", "''") + "')" for p in model_hooks.VOID_PHRASES)
_SAID = "CASE WHEN e.source.span IS NOT NULL THEN e.source.span.text ELSE coalesce(json_extract_string(e.source.structured, '$.excerpt'), json_extract_string(e.source.structured, '$.text'), json_extract_string(e.source.structured, '$.content'), e.source.structured) END"
SQL["weighted_claim_credibility"] = _with(
    _U, _C,
    f"items AS (SELECT graph_id, unit_id, pos, e.id AS ev, TRUE AS inline, {_SAID} AS said FROM (SELECT graph_id, unit_id, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS pos FROM u) WHERE e IS NOT NULL AND e.id IS NOT NULL"
    " UNION ALL SELECT graph_id, unit_id, 1000000 + pos, ev, FALSE, NULL FROM (SELECT graph_id, unit_id, unnest(evidence_ids) AS ev, generate_subscripts(evidence_ids, 1) AS pos FROM u) WHERE ev IS NOT NULL)",
    "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, unit_id, ev ORDER BY pos) AS n FROM items) WHERE n = 1)",
    "inp AS (SELECT f.graph_id, f.unit_id, CASE WHEN c.card_id IS NOT NULL THEN c.excerpt ELSE said END AS excerpt, CASE WHEN c.card_id IS NULL THEN 1 WHEN confidence IS NULL THEN 0 ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), confidence)) END AS trust FROM firsts f LEFT JOIN c ON f.graph_id = c.graph_id AND f.ev = c.card_id WHERE inline OR c.card_id IS NOT NULL)",
    f"sc AS (SELECT graph_id, unit_id, trust, CASE WHEN {_VOID} THEN 0 ELSE (length(coalesce(excerpt, '')) % 21 - 10) / CAST(10 AS DOUBLE) END AS v FROM (SELECT *, lower(excerpt) AS x FROM inp))",
    "t AS (SELECT graph_id, unit_id, CASE WHEN sum(trust) > 0 THEN greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), sum(trust * v) / sum(trust))) ELSE CAST(0 AS DOUBLE) END AS w FROM sc GROUP BY ALL)",
    "y AS (SELECT t.*, CASE WHEN evidence_min IS NULL THEN NULL ELSE greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), evidence_min * 2 - 1)) END AS m FROM t JOIN u ON t.graph_id = u.graph_id AND t.unit_id = u.unit_id)",
) + "SELECT graph_id, unit_id, round(CASE WHEN m IS NULL OR (abs(m) > 0.2 AND abs(w) < 0.2) THEN w ELSE m END, 6) + 0.0 AS claim_score, round(w, 6) + 0.0 AS weighted_score, CASE WHEN m IS NULL THEN 'weighted' WHEN abs(m) > 0.2 AND abs(w) < 0.2 THEN 'weighted_consistency' ELSE 'llm' END AS score_source FROM y"
