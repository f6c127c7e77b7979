"""Flaw patterns of argument graphs and the gate actions that answer them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators import graphs
from claimloom.operators.corpus import edge_id
from claimloom.operators.grouped import ordered_rank

# The patterns (id, name, category, kind, action, description).
PATTERNS = (
    ("circular_reasoning", "Circular Reasoning", "Structural", "fallacious", "disable_edge", "A claim ultimately supports itself through a support cycle."),
    ("self_attack", "Self-Attack", "Structural", "fallacious", "disable_edge", "A node attacks itself, contradicting its own claim."),
    ("unsupported_conclusion", "Unsupported Conclusion", "Structural", "fallacious", "flag_node", "A claim has no incoming support edges."),
    ("redundancy", "Redundancy", "Structural", "fallacious", "flag_node", "Multiple equivalent supports to the same conclusion."),
    ("contradiction", "Contradiction", "Structural", "fallacious", "flag_edge", "Support and attack edges target the same claim from a source."),
    ("unstated_warrant", "Unstated Warrant", "Substructural", "fallacious", "disable_edge", "An edge has no explicit warrants gating its inference."),
)
_FIELDS = ("pattern_id", "name", "category", "kind", "action", "description")


def pattern_bank(path: str | None = None) -> list[tuple[str, ...]]:
    """The patterns of a YAML file (list ``patterns``), completed by the built-in ones; these alone if there is no readable file."""
    bank: dict[str, tuple[str, ...]] = {}
    try:
        import yaml

        data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) if path else None
    except Exception:  # noqa: BLE001 - any unreadable file means the built-in patterns
        data = None
    entries = data.get("patterns") if isinstance(data, dict) else None
    for e in entries if isinstance(entries, list) else []:
        if isinstance(e, dict) and e.get("id"):
            bank[e["id"]] = (e["id"], str(e.get("name") or e["id"]), str(e.get("category") or "Uncategorized"), str(e.get("kind") or "fallacious"), str(e.get("action") or "flag_edge"), str(e.get("description") or ""))
    for p in PATTERNS:
        bank.setdefault(p[0], p)
    return list(bank.values())


def normal_text(text: Column) -> Column:
    """Lower case, white space collapsed, ends stripped."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def _match(rank: int, pattern: str, order: Column, nodes: Column, edges: Column, message: Column) -> list[Column]:
    none = F.array().cast("array<string>")
    return ["graph_id", F.lit(rank).alias("rank"), order.cast("bigint").alias("order"), F.lit(pattern).alias("pattern_id"), nodes.alias("nodes"), F.coalesce(edges, none).alias("edges"), message.alias("message")]


def circular_reasoning(units: DataFrame, relations: DataFrame) -> DataFrame:
    """Cycles of support edges with two members or more; edges are all support relations along the cycle."""
    found = graphs.cycles(units, graphs.project_edges(relations, ["support"])).where("size(nodes) > 1")
    after = F.concat(F.slice("nodes", F.lit(2), F.size("nodes")), F.slice("nodes", 1, 1))
    steps = found.select("graph_id", "cycle_no", F.explode(F.arrays_zip(F.col("nodes").alias("src"), after.alias("dst"))).alias("x")).select("graph_id", "cycle_no", "x.src", "x.dst")
    support = relations.where("kind = 'support'").select("graph_id", "edge_idx", "src", "dst")
    used = steps.dropDuplicates().join(support, ["graph_id", "src", "dst"]).groupBy("graph_id", "cycle_no").agg(F.transform(F.array_sort(F.collect_set("edge_idx")), edge_id).alias("e"))
    said = F.format_string("Support cycle detected across %d claims.", F.size("nodes"))
    return found.join(used, ["graph_id", "cycle_no"], "left").select(*_match(0, "circular_reasoning", F.col("cycle_no"), F.col("nodes"), F.col("e"), said))


def self_attack(relations: DataFrame) -> DataFrame:
    rows = relations.where("kind = 'attack' and src = dst")
    return rows.select(*_match(1, "self_attack", F.col("edge_idx") * 2, F.array("src"), F.array(edge_id(F.col("edge_idx"))), F.lit("Attack edge targets the same claim.")))


def unstated_warrant(relations: DataFrame) -> DataFrame:
    rows = relations.where("warrant_ids is null or size(warrant_ids) = 0")
    return rows.select(*_match(1, "unstated_warrant", F.col("edge_idx") * 2 + 1, F.array("src", "dst"), F.array(edge_id(F.col("edge_idx"))), F.lit("Edge has no explicit warrants.")))


def unsupported_conclusion(units: DataFrame, relations: DataFrame) -> DataFrame:
    held = relations.where("kind = 'support'").select("graph_id", F.col("dst").alias("unit_id"))
    rows = units.join(held, ["graph_id", "unit_id"], "left_anti")
    return rows.select(*_match(2, "unsupported_conclusion", F.col("ord"), F.array("unit_id"), F.lit(None).cast("array<string>"), F.lit("Claim has no incoming support edges.")))


def redundancy(units: DataFrame, relations: DataFrame) -> DataFrame:
    """Two or more support edges into one target from sources with the same text; parallel edges of one source count."""
    texts = units.select("graph_id", F.col("unit_id").alias("src"), normal_text(F.coalesce("text", F.lit(""))).alias("t"))
    rows = relations.where("kind = 'support' and dst is not null").join(texts, ["graph_id", "src"])
    groups = rows.groupBy("graph_id", "dst", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_idx", "src"))), lambda x: x["src"]).alias("s"), F.min("edge_idx").alias("first")).where("size(s) > 1")
    nodes = F.array_sort(F.array_distinct(F.concat("s", F.array("dst"))))
    said = F.concat(F.lit("Redundant supports to "), F.col("dst"), F.lit(": "), F.array_join("s", ", "), F.lit("."))
    return groups.select(*_match(3, "redundancy", F.col("first"), nodes, F.lit(None).cast("array<string>"), said))


def contradiction(relations: DataFrame) -> DataFrame:
    """A source that both supports and attacks the same target; edges are the supports, then the attacks."""
    rows = relations.where("kind in ('support', 'attack') and src is not null and dst is not null")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("edge_idx"))))
    groups = rows.groupBy("graph_id", "src", "dst").agg(of("support").alias("s"), of("attack").alias("a"), F.min("edge_idx").alias("first")).where("size(s) > 0 and size(a) > 0")
    return groups.select(*_match(4, "contradiction", F.col("first"), F.array("src", "dst"), F.transform(F.concat("s", "a"), edge_id), F.lit("Same source both supports and attacks the target.")))


def detect_patterns(units: DataFrame, relations: DataFrame, bank: list[tuple[str, ...]] | None = None) -> DataFrame:
    """All matches in their order: (graph_id, match_ord, pattern_id, name, category, kind, action, description, nodes, edges, message)."""
    found = circular_reasoning(units, relations)
    for part in (self_attack(relations), unstated_warrant(relations), unsupported_conclusion(units, relations), redundancy(units, relations), contradiction(relations)):
        found = found.unionByName(part)
    # a handful of rows, whatever the corpus
    table = units.sparkSession.createDataFrame(bank or pattern_bank(), ", ".join(f"{f} string" for f in _FIELDS))
    # a graph's matches are numbered by their place; rank and order give it without a sort over all rows of a hot graph
    numbered = found.withColumn("match_ord", F.col("rank") * F.lit(10**12) + F.col("order"))
    return numbered.join(F.broadcast(table), "pattern_id").select("graph_id", "match_ord", *_FIELDS, "nodes", "edges", "message")


def apply_gate_actions(relations: DataFrame, matches: DataFrame) -> DataFrame:
    """Relations after the actions of the matches: disable_edge and restrict_edge set their flags, the last match names itself."""
    acts = matches.where("action in ('disable_edge', 'restrict_edge')").select("graph_id", "match_ord", "pattern_id", "action", F.explode("edges").alias("e"))
    idx = F.regexp_extract("e", "^e([0-9]+)$", 1).try_cast("int")
    per_edge = acts.withColumn("edge_idx", idx).where("edge_idx is not null").groupBy("graph_id", "edge_idx").agg(
        F.max_by("pattern_id", "match_ord").alias("_p"), F.bool_or(F.col("action") == "disable_edge").alias("_d"), F.bool_or(F.col("action") == "restrict_edge").alias("_r")
    )
    out = relations.join(per_edge, ["graph_id", "edge_idx"], "left")
    return out.select(*[
        {
            "gate_disabled": F.when(F.col("_d"), True).otherwise(F.col("gate_disabled")),
            "gate_restricted": F.when(F.col("_r"), True).otherwise(F.col("gate_restricted")),
            "gate_mode": F.when(F.col("_r"), "AND").otherwise(F.col("gate_mode")),
            "gate_action": F.coalesce("_p", "gate_action"),
        }.get(name, F.col(name)).alias(name)
        for name in relations.columns
    ])


def numbered(matches: DataFrame) -> DataFrame:
    """match_ord as consecutive numbers from 0 within each graph."""
    return ordered_rank(matches, ["graph_id"], ["match_ord"], "_n").withColumn("match_ord", F.col("_n")).drop("_n")
