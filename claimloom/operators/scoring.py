"""Warrant-gated credibility scores of claims and warrants, by fixpoint per graph.

All is relational, for graphs of any size: each round is one plan of joins and sums over the claims and warrants of the
graphs that have not come to rest, and writes their new scores as one table. Every graph stops by its own
convergence, so its number of rounds does not depend on the rest of the corpus. Both sides of each join on a claim or
warrant are tables, so Spark splits those that have many edges. For corpora whose graphs are all known to be small,
``score_small_graphs`` does the same with each graph in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.corpus import Corpus, edge_id
from claimloom.operators.grouped import per_group
from claimloom.session import cut, release


@dataclass(frozen=True)
class ScoringConfig:
    alpha: float = 1.0
    beta: float = 1.0
    max_iterations: int = 50
    epsilon: float = 1e-4
    gate_required: bool = True
    clamp_influence: float = 4.0


#: The preset of the credibility façade.
CREDIBILITY = ScoringConfig(alpha=0.5, beta=1.0, max_iterations=100, epsilon=1e-6)


@dataclass(frozen=True)
class Scores:
    """claims and warrants: (graph_id, id, evidence, initial, score, iterations); gates: (graph_id, edge_idx, gate)."""

    claims: DataFrame
    warrants: DataFrame
    gates: DataFrame


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def evidence_items(nodes: DataFrame, key: str) -> DataFrame:
    """(graph_id, key, pos, ev_id, stance, strength, inline) of the distinct evidence of each node, first of an id wins.

    Inline items come before evidence_ids. Null items and ids are left out. Nodes without evidence give no row.
    """
    entry = lambda i, stance, strength, inline: F.struct(i.alias("ev_id"), stance.alias("stance"), strength.alias("strength"), F.lit(inline).alias("inline"))
    own = F.transform(F.filter("evidence", lambda e: e.isNotNull() & e["id"].isNotNull()), lambda e: entry(e["id"], e["stance"], e["strength"], True))
    named = F.transform(F.filter("evidence_ids", lambda i: i.isNotNull()), lambda i: entry(i, F.lit("supports"), F.lit(None).cast("double"), False))
    none = F.array().cast("array<struct<ev_id: string, stance: string, strength: double, inline: boolean>>")
    rows = nodes.select("graph_id", key, F.concat(F.coalesce(own, none), F.coalesce(named, none)).alias("_all"))
    first = F.filter("_all", lambda x, i: ~F.exists(F.slice("_all", F.lit(1), i), lambda y: y["ev_id"] == x["ev_id"]))
    return rows.select("graph_id", key, F.posexplode(first).alias("pos", "x")).select("graph_id", key, "pos", "x.*")


def item_scores(items: DataFrame, cards: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``signed``, null for an evidence_id without a card. A null confidence counts as 0, a null trust as 1."""
    trust = documents.select("graph_id", F.col("doc_id").alias("supporting_doc_id"), clamp(F.col("trust"), 0.0, 1.0).alias("_trust"))
    known = cards.select("graph_id", F.col("card_id").alias("ev_id"), "supporting_doc_id", F.coalesce(clamp(F.col("confidence"), 0.0, 1.0), F.lit(0.0)).alias("_confidence"))
    known = known.join(trust, ["graph_id", "supporting_doc_id"], "left").select("graph_id", "ev_id", (F.coalesce("_trust", F.lit(1.0)) * F.col("_confidence")).alias("_card"))
    sign = F.when(F.col("stance") == "supports", 1.0).when(F.col("stance") == "attacks", -1.0).otherwise(0.0)
    own = F.coalesce(clamp(F.col("strength"), 0.0, 1.0), F.lit(1.0))
    score = F.when(F.col("_card").isNotNull(), sign * F.col("_card")).when(F.col("inline"), F.when(sign == 0.0, 0.0).otherwise(sign * own))
    return items.join(known, ["graph_id", "ev_id"], "left").withColumn("signed", score).drop("_card")


def axiom_support(score: Column, alpha: float) -> Column:
    p = clamp((clamp(F.coalesce(score, F.lit(0.0)), -1.0, 1.0) + 1.0) / 2.0, 1e-6, 1.0 - 1e-6)
    return F.log(p / (F.lit(1.0) - p)) / alpha if alpha > 0 else F.lit(0.0)


def evidence_support(nodes: DataFrame, key: str, c: Corpus, alpha: float) -> DataFrame:
    """(graph_id, id, evidence, ignore_influence): the mean of a node's evidence, or an axiom's own support; 0 without any."""
    scored = item_scores(evidence_items(nodes, key), c.evidence_cards, c.supporting_documents).where("signed is not null")
    mean = scored.groupBy("graph_id", key).agg(clamp(F.avg("signed"), -1.0, 1.0).alias("_mean"))
    base = nodes.select("graph_id", key, "score", F.coalesce("is_axiom", F.lit(False)).alias("_axiom"), F.coalesce("ignore_influence", F.lit(False)).alias("ignore_influence"))
    joined = base.join(mean, ["graph_id", key], "left")
    value = F.when(F.col("_axiom"), axiom_support(F.col("score"), alpha)).otherwise(F.coalesce("_mean", F.lit(0.0)))
    return joined.select("graph_id", F.col(key).alias("id"), value.alias("evidence"), "ignore_influence")


def _gates(relations: DataFrame, warrants: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """(graph_id, edge_idx, gate) from (graph_id, id, score) of warrants; an unknown warrant counts 0.5."""
    used = relations.where("not off and size(warrant_ids) > 0").select("graph_id", "edge_idx", "both", F.explode("warrant_ids").alias("id"))
    values = used.join(warrants.select("graph_id", "id", "score"), ["graph_id", "id"], "left").withColumn("_v", F.coalesce("score", F.lit(0.5)))
    found = values.groupBy("graph_id", "edge_idx", "both").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    found = found.select("graph_id", "edge_idx", F.when(F.col("both"), F.col("_lo")).otherwise(F.col("_hi")).alias("_g"))
    rest = F.when(F.col("off"), 0.0).when(F.size("warrant_ids") > 0, F.col("_g")).otherwise(0.0 if cfg.gate_required else 1.0)
    return relations.join(found, ["graph_id", "edge_idx"], "left").select("graph_id", "edge_idx", rest.alias("gate"))


def _edges(c: Corpus) -> DataFrame:
    return c.relations.select(
        "graph_id", "edge_idx", "src", "dst", F.when(F.col("kind") == "support", 1.0).otherwise(-1.0).alias("sign"),
        F.coalesce(F.filter("warrant_ids", lambda w: w.isNotNull()), F.array().cast("array<string>")).alias("warrant_ids"),
        (F.coalesce("gate_mode", F.lit("OR")) == "AND").alias("both"), F.coalesce("gate_disabled", F.lit(False)).alias("off"),
    )


def _round(state: DataFrame, used: DataFrame, edges: DataFrame, attacks: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """The state after one more round of the graphs that are still open: warrants, then gates, then claims.

    used: (g, edge_idx, both, id) of the warrants of edges that are on, edges: (g, edge_idx, src, dst, sign, gated),
    attacks: (g, src, id). A source that is missing has score 0 and moves nothing.
    """
    limit = cfg.clamp_influence
    still = state.groupBy("g").agg((F.max("change") >= F.lit(cfg.epsilon)).alias("going")).where("going").select("g")
    now = state.join(still.withColumn("_going", F.lit(True)), "g", "left").withColumn("_going", F.coalesce("_going", F.lit(False)))
    claims = now.where("_going and not warrant").select("g", F.col("id").alias("src"), "score")

    def updated(nodes: DataFrame, influence: DataFrame) -> DataFrame:
        pull = F.when(F.col("skip"), 0.0).otherwise(clamp(F.coalesce("_in", F.lit(0.0)), -limit, limit))
        new = F.when(F.col("_going"), sigmoid(F.lit(cfg.alpha) * F.col("evidence") + F.lit(cfg.beta) * pull)).otherwise(F.col("score"))
        return nodes.join(influence, ["g", "id"], "left").select(
            "g", "warrant", "id", "evidence", "skip", "initial", new.alias("score"), F.when(F.col("_going"), F.abs(new - F.col("score"))).otherwise(0.0).alias("change"),
            (F.col("iterations") + F.col("_going").cast("int")).alias("iterations"),
        )

    hits = attacks.join(claims, ["g", "src"]).groupBy("g", "id").agg(F.sum(-F.col("score")).alias("_in"))
    warrants = updated(now.where("warrant"), hits)
    values = used.join(warrants.select("g", "id", "score"), ["g", "id"], "left").withColumn("_v", F.coalesce("score", F.lit(0.5)))
    gates = values.groupBy("g", "edge_idx").agg(F.max("both").alias("both"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    gates = gates.select("g", "edge_idx", F.when(F.col("both"), F.col("_lo")).otherwise(F.col("_hi")).alias("gate"))
    moved = edges.join(claims, ["g", "src"]).join(gates, ["g", "edge_idx"], "left")
    gate = F.when(F.col("gated"), F.col("gate")).otherwise(1.0)
    pulls = moved.groupBy("g", F.col("dst").alias("id")).agg(F.sum(F.col("sign") * F.col("score") * gate).alias("_in"))
    return updated(now.where("not warrant"), pulls).unionByName(warrants)


def _group_key(df: DataFrame) -> DataFrame:
    """Adds ``g``, the graph as a join key that is never null."""
    return df.withColumn("g", F.coalesce(F.concat(F.lit("="), "graph_id"), F.lit("")))


def _fixpoint(claims: DataFrame, warrants: DataFrame, edges: DataFrame, attacks: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """(g, warrant, id, evidence, skip, initial, score, change, iterations) when every graph has come to rest."""
    one = lambda df, warrant: _group_key(df).select("g", F.lit(warrant).alias("warrant"), "id", "evidence", F.col("ignore_influence").alias("skip"), "initial", F.col("initial").alias("score"), F.lit(float("inf")).alias("change"), F.lit(0).alias("iterations"))
    state = cut(one(claims, False).unionByName(one(warrants, True)))
    keyed = _group_key(edges).where("not off")
    # an edge without warrants passes all or nothing
    passing = keyed.where("size(warrant_ids) > 0" if cfg.gate_required else "true")
    links = cut(passing.select("g", "edge_idx", "src", "dst", "sign", (F.size("warrant_ids") > 0).alias("gated")).where("src is not null and dst is not null"))
    used = cut(keyed.select("g", "edge_idx", "both", F.explode("warrant_ids").alias("id")))
    hits = cut(_group_key(attacks).select("g", "src", F.col("warrant_id").alias("id")).where("src is not null and id is not null"))
    for _ in range(cfg.max_iterations):
        before, state = state, cut(_round(state, used, links, hits, cfg))
        release(before)
        if state.where(F.col("change") >= F.lit(cfg.epsilon)).isEmpty():
            break
    release(links, used, hits)
    return state


def iterate_graph(rows: list[tuple], cfg: ScoringConfig) -> list[tuple]:
    """The fixpoint of one graph given in long form; (kind, id, score, iterations) of its claims and warrants.

    Rows are (graph, kind, place, id, src, value, flag, both, warrant ids), edges in the order of their place.
    """
    part: dict[str, list[tuple]] = {"claim": [], "warrant": [], "edge": [], "attack": []}
    for r in rows:
        part[r[1]].append(r)
    claims, warrants, edges, attacks = part["claim"], part["warrant"], part["edge"], part["attack"]
    c_at, w_at = ({r[3]: i for i, r in enumerate(x)} for x in (claims, warrants))
    c_ev, w_ev = (np.array([r[5] for r in x], dtype=float) for x in (claims, warrants))
    c_skip, w_skip = (np.array([r[6] for r in x], dtype=bool) for x in (claims, warrants))
    nc, nw = len(c_ev), len(w_ev)
    place = lambda at, ids, miss: np.array([at.get(i, miss) for i in ids], dtype=np.int64)
    # one slot more at the end: claims that are missing score 0 there, warrants 0.5
    a_src, a_dst = place(c_at, [r[4] for r in attacks], nc), place(w_at, [r[3] for r in attacks], -1)
    a_src, a_dst = a_src[a_dst >= 0], a_dst[a_dst >= 0]
    e_src, e_dst = place(c_at, [r[4] for r in edges], nc), place(c_at, [r[3] for r in edges], -1)
    sign, off, both = np.array([r[5] for r in edges], dtype=float), np.array([r[6] for r in edges], dtype=bool), np.array([r[7] for r in edges], dtype=bool)
    lists = [[] if r[8] is None else list(r[8]) for r in edges]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = place(w_at, [w for x in lists for w in x], nw)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    gated = sizes > 0
    sig = lambda z: 1.0 / (1.0 + np.exp(-z))
    limit = cfg.clamp_influence

    def gates(w: np.ndarray) -> np.ndarray:
        out = np.full(len(sizes), 0.0 if cfg.gate_required else 1.0)
        if len(flat):
            v = np.append(w, 0.5)[flat]
            out[gated] = np.where(both[gated], np.minimum.reduceat(v, starts[gated]), np.maximum.reduceat(v, starts[gated]))
        out[off] = 0.0
        return out

    def update(ev: np.ndarray, skip: np.ndarray, at: np.ndarray, pull: np.ndarray) -> np.ndarray:
        total = np.zeros(len(ev))
        ok = at >= 0
        np.add.at(total, at[ok], pull[ok])
        total[skip] = 0.0
        return sig(cfg.alpha * ev + cfg.beta * np.clip(total, -limit, limit))

    c, w, n = sig(cfg.alpha * c_ev), sig(cfg.alpha * w_ev), 0
    for n in range(1, cfg.max_iterations + 1):  # noqa: B007
        s = np.append(c, 0.0)
        w_new = update(w_ev, w_skip, a_dst, -s[a_src])
        c_new = update(c_ev, c_skip, e_dst, sign * s[e_src] * gates(w_new))
        change = max(np.abs(c_new - c).max(initial=0.0), np.abs(w_new - w).max(initial=0.0))
        c, w = c_new, w_new
        if change < cfg.epsilon:
            break
    return [("claim", r[3], float(x), n) for r, x in zip(claims, c, strict=True)] + [("warrant", r[3], float(x), n) for r, x in zip(warrants, w, strict=True)]


def _seeds(c: Corpus, cfg: ScoringConfig) -> tuple[DataFrame, DataFrame]:
    seed = lambda nodes, key: evidence_support(nodes, key, c, cfg.alpha).withColumn("initial", sigmoid(F.lit(cfg.alpha) * F.col("evidence")))
    return seed(c.units, "unit_id"), seed(c.warrants, "warrant_id")


def score_corpus(c: Corpus, cfg: ScoringConfig = CREDIBILITY) -> Scores:
    """Scores of all graphs of a corpus.

    Edges without warrants transmit nothing while ``gate_required``; relations' weights play no part. Rows
    with a null graph_id form a graph of their own. Empty tables give empty results.
    """
    claims, warrants = _seeds(c, cfg)
    edges = _edges(c)
    state = _fixpoint(claims, warrants, edges, c.warrant_attacks, cfg)
    graph = F.when(F.col("g") != "", F.substr("g", F.lit(2))).alias("graph_id")
    part = lambda warrant: state.where(F.col("warrant") == warrant).select(graph, "id", "evidence", "initial", "score", "iterations")
    return Scores(part(False), part(True), _gates(edges, part(True), cfg))


def score_small_graphs(c: Corpus, cfg: ScoringConfig = CREDIBILITY) -> Scores:
    """As :func:`score_corpus`, each graph in one task: one shuffle in all, for corpora whose graphs are all known to be small."""
    claims, warrants = (cut(x) for x in _seeds(c, cfg))
    edges, attacks = _edges(c), c.warrant_attacks.select("graph_id", "attack_idx", "src", "warrant_id")
    null = lambda t: F.lit(None).cast(t)
    node = lambda df, kind: df.select("graph_id", F.lit(kind).alias("kind"), F.lit(0).alias("ord"), "id", null("string").alias("src"), F.col("evidence").alias("value"), F.col("ignore_influence").alias("flag"), F.lit(False).alias("both"), null("array<string>").alias("ids"))
    long_form = (
        node(claims, "claim").unionByName(node(warrants, "warrant"))
        .unionByName(edges.select("graph_id", F.lit("edge").alias("kind"), F.col("edge_idx").alias("ord"), F.col("dst").alias("id"), "src", F.col("sign").alias("value"), F.col("off").alias("flag"), "both", F.col("warrant_ids").alias("ids")))
        .unionByName(attacks.select("graph_id", F.lit("attack").alias("kind"), F.col("attack_idx").alias("ord"), F.col("warrant_id").alias("id"), "src", F.lit(0.0).alias("value"), F.lit(False).alias("flag"), F.lit(False).alias("both"), null("array<string>").alias("ids")))
    )
    solved = cut(_group_key(per_group(long_form, "graph_id", ["kind", "ord"], "kind string, id string, score double, iterations int", lambda rows: iterate_graph(rows, cfg))).drop("graph_id"))
    known = lambda kind: solved.where(F.col("kind") == kind).drop("kind")
    out = [_group_key(nodes).join(known(kind), ["g", "id"]).select("graph_id", "id", "evidence", "initial", "score", "iterations") for nodes, kind in ((claims, "claim"), (warrants, "warrant"))]
    return Scores(*out, _gates(edges, out[1], cfg))


def iteration_history(c: Corpus, rounds: int, cfg: ScoringConfig = CREDIBILITY) -> DataFrame:
    """(graph_id, kind, id, iteration, score) of the seed and the first ``rounds`` rounds, without a stop rule."""
    parts = []
    for n in range(rounds + 1):
        if n == 0:
            for kind, nodes, key in (("claim", c.units, "unit_id"), ("warrant", c.warrants, "warrant_id")):
                e = evidence_support(nodes, key, c, cfg.alpha)
                parts.append(e.select("graph_id", F.lit(kind).alias("kind"), "id", F.lit(0).alias("iteration"), sigmoid(F.lit(cfg.alpha) * F.col("evidence")).alias("score")))
            continue
        s = score_corpus(c, replace(cfg, max_iterations=n, epsilon=0.0))
        for kind, nodes in (("claim", s.claims), ("warrant", s.warrants)):
            parts.append(nodes.select("graph_id", F.lit(kind).alias("kind"), "id", F.lit(n).alias("iteration"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explanations(c: Corpus, s: Scores) -> DataFrame:
    """(graph_id, edge_idx, edge_id, src, dst, kind, gate, src_score, influence, warrant_ids, gate_mode) of edges into known claims.

    Influence uses the final scores, without the clamp and without regard to ignore_influence.
    """
    of = s.claims.select("graph_id", F.col("id").alias("src"), F.col("score").alias("_s"))
    known = s.claims.select("graph_id", F.col("id").alias("dst"))
    rows = c.relations.join(known, ["graph_id", "dst"], "left_semi").join(of, ["graph_id", "src"], "left").join(s.gates, ["graph_id", "edge_idx"])
    sign = F.when(F.col("kind") == "support", 1.0).otherwise(-1.0)
    score = F.coalesce("_s", F.lit(0.0))
    return rows.select(
        "graph_id", "edge_idx", edge_id(F.col("edge_idx")).alias("edge_id"), "src", "dst", "kind", "gate", score.alias("src_score"),
        (sign * score * F.col("gate")).alias("influence"), "warrant_ids", "gate_mode",
    )


def explanation_totals(c: Corpus, s: Scores) -> DataFrame:
    """(graph_id, id, evidence_support, incoming, total_influence, final_score) of every claim."""
    total = explanations(c, s).groupBy("graph_id", F.col("dst").alias("id")).agg(F.count("*").alias("incoming"), F.sum("influence").alias("_t"))
    return s.claims.join(total, ["graph_id", "id"], "left").select(
        "graph_id", "id", F.col("evidence").alias("evidence_support"), F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("_t", F.lit(0.0)).alias("total_influence"), F.col("score").alias("final_score")
    )


def warrant_fragility(c: Corpus, s: Scores) -> DataFrame:
    """(graph_id, edge_idx, edge_id, dst, gate_mode, gate_score, critical_warrants) of edges with warrants.

    Critical are the warrants whose score is the least (AND) or greatest (OR) of the edge, in the order of its list.
    """
    e = c.relations.where("size(warrant_ids) > 0").select("graph_id", "edge_idx", "dst", "gate_mode", F.posexplode("warrant_ids").alias("pos", "id"))
    v = e.join(s.warrants.select("graph_id", "id", "score"), ["graph_id", "id"], "left").withColumn("v", F.coalesce("score", F.lit(0.5)))
    g = v.groupBy("graph_id", "edge_idx", "dst", "gate_mode").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.array_sort(F.collect_list(F.struct("pos", "id", "v"))).alias("all"))
    at = F.when(F.col("gate_mode") == "AND", F.col("lo")).otherwise(F.col("hi"))
    critical = F.transform(F.filter("all", lambda x: x["v"] == at), lambda x: x["id"])
    return g.join(s.gates, ["graph_id", "edge_idx"]).select(
        "graph_id", "edge_idx", edge_id(F.col("edge_idx")).alias("edge_id"), "dst", "gate_mode", F.col("gate").alias("gate_score"), critical.alias("critical_warrants")
    )


class Reasoner:
    """Runs named tasks over a corpus and keeps the last scores for the tasks after it."""

    def __init__(self, corpus: Corpus) -> None:
        self.corpus = corpus

    def run(self, tasks: list[str], explain: bool = False) -> dict:
        out: dict = {}
        last: Scores | None = None
        for task in tasks:
            name = task.lower()
            if name not in ("credibility", "credibility_propagation", "claim_scores", "warrant_scores", "gate_scores"):
                raise ValueError(f"unknown task: {task}")
            whole = name.startswith("credibility")
            if whole or last is None:
                last = score_corpus(self.corpus)
            out[task] = last if whole else {"claim_scores": last.claims, "warrant_scores": last.warrants, "gate_scores": last.gates}[name]
        if explain:
            out["explanations"] = explanations(self.corpus, last) if last else {}
        return out
