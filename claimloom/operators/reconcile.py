"""Merging the graphs of segments into one graph per document.

``doc_id`` names what is merged and ``seg_ord`` the order of its segments. Units with equal keys become one; with a
similarity, a new key joins a similar key that was kept before it. By token sets (the default) the pairs that are
similar enough come from a prefix join on pairs of rare tokens, which loses none, and what is kept is decided in rounds: a key
is kept once no earlier neighbour of it can be. Any other function of two keys is asked about all pairs of a document,
in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import ascii_tokens, strip
from claimloom.operators.corpus import _refuse
from claimloom.operators.grouped import ordered_rank, per_group
from claimloom.session import cut, release


@dataclass(frozen=True)
class MergePolicy:
    """unit_key: Column function of the text (default: stripped lower case). similarity: function of two keys."""

    unit_key: Callable[[Column], Column] | None = None
    relation_aggregation: str = "sum"
    similarity: Callable[[str, str], float] | None = None
    threshold: float = 0.9
    clamp_weights: bool = True
    weight_min: float = -1.0
    weight_max: float = 1.0


def jaccard(a: str, b: str) -> float:
    """Similarity of the token sets of two strings."""
    import re

    x, y = (set(re.findall("[a-zA-Z0-9]+", t.lower())) for t in (a, b))
    if not x or not y:
        return float(not x and not y)
    return len(x & y) / len(x | y)


def _keyed(units: DataFrame, p: MergePolicy) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return units.withColumn("_key", p.unit_key(text) if p.unit_key else F.lower(strip(text))).withColumn("_at", F.struct("seg_ord", "ord", "unit_id"))


def similar_pairs(keys: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, a, b, score) of the keys of a document, a before b in order, whose token sets have at least this similarity.

    keys: (doc_id, key, at, text), each key once; a and b are keys, compared by the tokens of their texts. Of sets that
    are that similar, any l tokens that both have and that come first in some order of all tokens stand among the first
    n - o + l of each, o being the least number of common tokens that a set of n tokens can have: with a set of its size or
    larger, 2 t / (1 + t) of n, with any other, t of n. So what both may share first, rare tokens before frequent ones, is
    joined by pairs of tokens (l = 2); the few sets that may be similar by less than two by single ones. Keys without tokens
    are alike. Texts move once, to be put in order; posts are numbers.
    """
    tokens = ascii_tokens(F.col("text"))
    own = cut(keys.select("doc_id", "key", "at", F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(""))).alias("t")))
    often = cut(own.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("c")))
    words = own.repartition("doc_id", "key").select("doc_id", "key", F.size("t").alias("n"), F.explode("t").alias("w"))
    # by their hashes, as far as tokens go into posts: what has one hash by chance is told apart when sets are compared
    token = F.struct("c", F.xxhash64("w").alias("w"))
    least = lambda share: F.ceil(F.col("n") * F.lit(share) - 1e-9).cast("int")
    front = lambda rows, share, more: F.slice(rows, F.lit(1), F.greatest(F.lit(1), F.least(F.col("n") - least(share) + more, F.col("n"))))
    ranked = words.join(often, "w").groupBy("doc_id", "key", "n").agg(F.array_sort(F.collect_list(token)).alias("r"))
    ranked = cut(ranked.select("doc_id", "key", "n", F.transform(front("r", threshold, 2), lambda x: x["w"]).alias("r")))
    after = lambda r, i: F.slice(r, i + 2, F.greatest(F.lit(0), F.size(r) - i - 1))
    two = lambda r: F.flatten(F.transform(r, lambda x, i: F.transform(after(r, i), lambda y: F.xxhash64(x, y))))
    short, none = least(threshold) < 2, F.array().cast("array<bigint>")
    one = F.when(short, front("r", threshold, 1)).otherwise(none)
    post = lambda i, p: ranked.select("doc_id", F.col("key").alias(f"k{i}"), F.col("n").alias(f"n{i}"), F.explode(F.array_distinct(p)).alias("p"))
    small = post(1, F.concat(two(front("r", 2 * threshold / (1 + threshold), 2)), one))
    large = post(2, F.concat(F.when(short, none).otherwise(two(F.col("r"))), one))
    met = small.join(large, ["doc_id", "p"]).where((F.col("k1") != F.col("k2")) & (F.col("n1") <= F.col("n2")) & (F.col("n1") >= F.col("n2") * F.lit(threshold) - 1e-9))
    met = met.select("doc_id", F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).dropDuplicates()
    side = lambda i: own.select("doc_id", F.col("key").alias(f"k{i}"), F.col("at").alias(f"at{i}"), F.col("t").alias(f"t{i}"))
    both = met.join(side(1), ["doc_id", "k1"]).join(side(2), ["doc_id", "k2"])
    shared = F.size(F.array_intersect("t1", "t2"))
    score = shared / (F.size("t1") + F.size("t2") - shared)
    early = F.col("at1") < F.col("at2")
    found = cut(both.where(score >= threshold).select("doc_id", F.when(early, F.col("k1")).otherwise(F.col("k2")).alias("a"), F.when(early, F.col("k2")).otherwise(F.col("k1")).alias("b"), score.alias("score")))
    release(own, often, ranked)
    return found


def kept_keys(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, key, at, kept): in order of ``at``, a key is kept if no kept key before it is a pair with it.

    Decided in rounds, each of which settles at least the first open key of every document.
    """
    later = pairs.select("doc_id", F.col("b").alias("key")).dropDuplicates().withColumn("_later", F.lit(True))
    state = cut(keys.join(later, ["doc_id", "key"], "left").select("doc_id", "key", "at", F.coalesce("_later", F.lit(False)).alias("open"), F.col("_later").isNull().alias("kept")))
    while not state.where("open").isEmpty():
        earlier = pairs.join(state.select("doc_id", F.col("key").alias("a"), F.col("open").alias("_o"), F.col("kept").alias("_k")), ["doc_id", "a"])
        seen = earlier.groupBy("doc_id", F.col("b").alias("key")).agg(F.bool_or("_k").alias("_any"), F.bool_or("_o").alias("_wait"))
        new = state.join(seen, ["doc_id", "key"], "left").select(
            "doc_id", "key", "at", (F.col("open") & ~F.col("_any") & F.col("_wait")).alias("open"), F.when(F.col("open"), ~F.col("_any") & ~F.col("_wait")).otherwise(F.col("kept")).alias("kept")
        )
        before, state = state, cut(new)
        release(before)
    return state.drop("open")


def greedy_keys(keys: list[str], similarity: Callable[[str, str], float], threshold: float, best: bool) -> list[tuple[str, float | None]]:
    """(root, score or None) of each key in order of arrival: the kept key that it joins, itself if it is kept, for any similarity."""
    kept: dict[str, None] = {}
    out: list[tuple[str, float | None]] = []
    for key in keys:
        scored = [] if key in kept else [(s, -i, other) for i, other in enumerate(kept) if (s := similarity(key, other)) >= threshold and s > 0]
        if scored:
            s, _, other = max(scored) if best else max(scored, key=lambda x: x[1])
            out.append((other, s))
        else:
            kept[key] = None
            out.append((key, None))
    return out


def joined_keys(rows: DataFrame, similarity: Callable[[str, str], float], threshold: float, best: bool) -> DataFrame:
    """(doc_id, at, key, root, score) of rows (doc_id, at, key): the kept key that each joins, itself if it is kept. By token sets, other columns stay.

    In order of ``at``, a key joins a kept key before it that is similar enough: the first, or with ``best`` the most similar
    and of these the first. A key that joined is no candidate for later ones, and is judged anew when it comes again.
    """
    if similarity is not jaccard:
        fields = [f"at.{f.name}" for f in rows.schema["at"].dataType]
        names = [f.rpartition(".")[2] for f in fields]
        flat = rows.select("doc_id", "key", *fields)
        kinds = ", ".join(f"{n} {flat.schema[n].dataType.simpleString()}" for n in names)

        def run(group: list[tuple]) -> list[tuple]:
            return [(*r[2:], r[1], *x) for r, x in zip(group, greedy_keys([r[1] for r in group], similarity, threshold, best), strict=True)]

        found = per_group(flat, "doc_id", names, f"{kinds}, key string, root string, score double", run)
        return found.select("doc_id", F.struct(*names).alias("at"), "key", "root", "score")
    # keys go by number; only those that are similar to another are asked about, all others are kept
    named = cut(rows.groupBy("doc_id", "key").agg(F.min("at").alias("at")).withColumn("id", F.monotonically_increasing_id()))
    pairs = similar_pairs(named.select("doc_id", F.col("id").alias("key"), "at", F.col("key").alias("text")), threshold)
    ends = pairs.select("doc_id", F.explode(F.array("a", "b")).alias("id")).dropDuplicates()
    met = cut(named.join(ends, ["doc_id", "id"]))
    state = kept_keys(met.select("doc_id", F.col("id").alias("key"), "at"), pairs).withColumnRenamed("key", "id")
    both = pairs.select("doc_id", F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(pairs.select("doc_id", F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    kept = met.join(state.where("kept").select("doc_id", "id"), ["doc_id", "id"]).select("doc_id", F.col("id").alias("other"), F.col("at").alias("oat"), F.col("key").alias("text"))
    order = F.struct((-F.col("score") if best else F.lit(0.0)).alias("s"), F.col("oat"), F.col("text").alias("other"), "score")
    options = both.join(state.where("not kept").select("doc_id", "id"), ["doc_id", "id"]).join(kept, ["doc_id", "other"]).groupBy("doc_id", "id").agg(F.array_sort(F.collect_list(order)).alias("options"))
    gone = cut(met.join(options, ["doc_id", "id"]).select("doc_id", "key", "options"))
    found = rows.join(gone, ["doc_id", "key"], "left")
    first = F.get(F.filter("options", lambda o: o["oat"] < F.col("at")), F.lit(0))
    return found.withColumns({"root": F.when(F.col("options").isNull(), F.col("key")).otherwise(first["other"]), "score": first["score"]}).drop("options")


def unit_map(units: DataFrame, p: MergePolicy = MergePolicy()) -> DataFrame:
    """(doc_id, seg_ord, segment_id, unit_id, new_id, _at, _root, match_score): where each unit goes.

    New ids are c1, c2, ... in the order in which the merged units were first seen.
    """
    rows = _keyed(units, p)
    if p.similarity is None:
        joined = rows.withColumn("_root", F.col("_key")).withColumn("match_score", F.lit(None).cast("double"))
    else:
        rows = cut(rows.select("doc_id", "seg_ord", "segment_id", "unit_id", "_key", "_at"))
        asked = rows.withColumnsRenamed({"_at": "at", "_key": "key"})
        found = joined_keys(asked, p.similarity, p.threshold, True).withColumnsRenamed({"at": "_at", "key": "_key", "root": "_root", "score": "match_score"})
        joined = found if p.similarity is jaccard else rows.join(found.select("doc_id", "_at", "_root", "match_score"), ["doc_id", "_at"])
    if p.similarity is not None:
        joined = cut(joined)
    # by token sets, a key that is kept is kept wherever it stands
    heads = (joined.where("_key = _root") if p.similarity is jaccard else rows).groupBy("doc_id", F.col("_key").alias("_root")).agg(F.min("_at").alias("_first"))
    if p.similarity not in (None, jaccard):
        heads = heads.join(joined.select("doc_id", "_root").dropDuplicates(), ["doc_id", "_root"], "left_semi")
    numbered = ordered_rank(heads.select("doc_id", "_root", "_first.*"), ["doc_id"], ["seg_ord", "ord", "unit_id"], "_n").select("doc_id", "_root", F.concat(F.lit("c"), (F.col("_n") + 1).cast("string")).alias("new_id"))
    return joined.select("doc_id", "seg_ord", "segment_id", "unit_id", "_key", "_at", "_root", "match_score").join(numbered, ["doc_id", "_root"])


def merge_units(units: DataFrame, mapping: DataFrame) -> DataFrame:
    """The merged units: text and type of the first, evidence and spans in order, evidence_ids once each, least and greatest bounds, sources."""
    rows = units.join(mapping.select("doc_id", "segment_id", "unit_id", "new_id", "_at"), ["doc_id", "segment_id", "unit_id"])
    listed = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce(F.to_json(c), F.lit("[]")).alias("v")))), lambda x: F.from_json(x["v"], units.schema[c].dataType)))
    first = lambda c: F.min_by(c, "_at").alias(c)
    out = rows.groupBy("doc_id", "new_id").agg(
        first("text"), first("type"),
        *[listed(c).alias(c) for c in ("spans", "evidence") if c in units.columns],
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))).alias("evidence_ids"),
        F.min("evidence_min").alias("evidence_min"), F.max("evidence_max").alias("evidence_max"),
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "unit_id"))), lambda x: x["unit_id"]).alias("source_unit_ids"),
    )
    return out


def merge_equal(units: DataFrame, p: MergePolicy = MergePolicy()) -> DataFrame:
    """As :func:`merge_units` by :func:`unit_map` without a similarity, with the number of segments: units that have only spans, moved once.

    A document's units are brought together by one shuffle, and merged, ordered and numbered where they are: for documents
    that were one text in one task before they were cut. Null documents are left out.
    """
    rows = _keyed(units, p).where("doc_id is not null").repartition("doc_id")
    at = lambda c: F.struct("_at", F.col(c).alias("v"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(at(c))), lambda x: x["v"])
    out = rows.groupBy("doc_id", "_key").agg(
        F.min("_at").alias("_first"), F.min_by("text", "_at").alias("text"), F.min_by("type", "_at").alias("type"), F.flatten(listed("spans")).alias("spans"),
        F.array_distinct(F.flatten(listed("evidence_ids"))).alias("evidence_ids"), F.min("evidence_min").alias("evidence_min"), F.max("evidence_max").alias("evidence_max"),
        listed("unit_id").alias("source_unit_ids"), F.size(F.collect_set("segment_id")).cast("bigint").alias("segments"),
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_first"))
    return out.withColumn("new_id", F.concat(F.lit("c"), number.cast("string"))).drop("_key", "_first")


def unit_segments(mapping: DataFrame) -> DataFrame:
    """(doc_id, new_id, segment_id, seg_ord): the segments that each merged unit was found in."""
    return mapping.groupBy("doc_id", "new_id", "segment_id").agg(F.min("seg_ord").alias("seg_ord"))


def _mapped(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select("doc_id", "segment_id", "unit_id", "new_id")
    rows = relations.join(m.select("doc_id", "segment_id", F.col("unit_id").alias("src"), F.col("new_id").alias("_s")), ["doc_id", "segment_id", "src"])
    rows = rows.join(m.select("doc_id", "segment_id", F.col("unit_id").alias("dst"), F.col("new_id").alias("_d")), ["doc_id", "segment_id", "dst"])
    return rows.withColumn("_at", F.struct("seg_ord", "edge_idx"))


def merge_relations(relations: DataFrame, mapping: DataFrame, p: MergePolicy = MergePolicy()) -> DataFrame:
    """(doc_id, src, dst, kind, weight, rationale, sources) of the merged relations; those with an unmapped end are dropped."""
    rows = _mapped(relations, mapping).withColumn("_w", F.coalesce("weight", F.lit(1.0)))
    how = p.relation_aggregation
    weight = {"sum": F.sum("_w"), "mean": F.avg("_w"), "max": F.min_by("_w", F.struct(-F.abs("_w"), F.col("_at")))}.get(how)
    if weight is None:
        raise ValueError(f"unknown aggregation: {how}")
    out = rows.groupBy("doc_id", F.col("_s").alias("src"), F.col("_d").alias("dst"), "kind").agg(weight.alias("weight"), F.min_by("rationale", "_at").alias("rationale"), F.count("*").alias("sources"))
    if p.clamp_weights:
        out = out.withColumn("weight", F.greatest(F.lit(p.weight_min), F.least(F.lit(p.weight_max), F.col("weight"))))
    return out


def relation_sources(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, src, dst, kind, segment_id, edge_idx): where each merged relation comes from."""
    return _mapped(relations, mapping).select("doc_id", F.col("_s").alias("src"), F.col("_d").alias("dst"), "kind", "segment_id", "edge_idx")


def merge_first(rows: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of cards or documents by ``key``: the first segment's row is kept, later rows that differ are conflicts.

    conflicts: (doc_id, seg_ord, kind, key). Columns that place a row (segment_id, seg_ord, graph_id, ord) do not count.
    """
    own = [c for c in rows.columns if c not in ("doc_id", "segment_id", "seg_ord", "graph_id", "ord", key)]
    body = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    seen = rows.withColumn("_b", body).withColumn("_at", F.struct("seg_ord", "ord"))
    first = seen.groupBy("doc_id", key).agg(F.min_by(F.struct(*own), "_at").alias("_v"), F.min_by("_b", "_at").alias("_fb"))
    conflicts = seen.join(first.select("doc_id", key, "_fb"), ["doc_id", key]).where("_b <> _fb").select("doc_id", "seg_ord", F.lit(label).alias("kind"), F.col(key).alias("key"))
    return first.select("doc_id", key, "_v.*"), conflicts


def merge_claims(claims: DataFrame, similarity: Callable[[str, str], float] = jaccard, threshold: float = 0.92) -> DataFrame:
    """Greedy merge of the claims of a document: (doc_id, segment_id, claim_id, new_id, merged).

    In order of (seg_ord, ord), a claim joins the first earlier kept claim that is similar enough, or becomes c1, c2, ....
    """
    rows = cut(claims.select("doc_id", "segment_id", F.struct("seg_ord", "ord", "claim_id", "segment_id").alias("at"), "claim_id", F.lower(strip(F.coalesce("text", F.lit("")))).alias("key")))
    joined = cut(joined_keys(rows.select("doc_id", "at", "key"), similarity, threshold, False))
    heads = joined.where("key = root").groupBy("doc_id", "root").agg(F.min("at").alias("head")).select("doc_id", "root", "head", "head.*")
    numbered = ordered_rank(heads, ["doc_id"], ["seg_ord", "ord", "claim_id", "segment_id"], "_n").select("doc_id", "root", "head", F.concat(F.lit("c"), (F.col("_n") + 1).cast("string")).alias("new_id"))
    out = joined.join(numbered, ["doc_id", "root"])
    return out.select("doc_id", F.col("at.segment_id").alias("segment_id"), F.col("at.claim_id").alias("claim_id"), "new_id", (F.col("at") != F.col("head")).alias("merged"))


@dataclass(frozen=True)
class Reconciled:
    """units, relations, unit_segments, relation_sources; documents: (doc_id, metadata) with the segments as JSON; the merged
    supporting_documents and evidence_cards, and merge_conflicts (doc_id, seg_ord, kind, key)."""

    units: DataFrame
    relations: DataFrame
    unit_segments: DataFrame
    relation_sources: DataFrame
    documents: DataFrame
    supporting_documents: DataFrame | None = None
    evidence_cards: DataFrame | None = None
    merge_conflicts: DataFrame | None = None


def reconcile(segments: DataFrame, graphs: DataFrame, units: DataFrame, relations: DataFrame, supporting_documents: DataFrame | None = None, evidence_cards: DataFrame | None = None, policy: MergePolicy = MergePolicy()) -> Reconciled:
    """Merges the graphs of segments into one graph per document.

    segments: (doc_id, segment_id, seg_ord, start, end); graphs: (doc_id, segment_id), the graphs that there are. Segments
    and graphs must match one to one, else they are refused. The other tables carry doc_id, segment_id and seg_ord.
    """
    by = ["doc_id", "segment_id"]
    ends = segments.select(*by, F.lit(1).alias("s"), F.lit(0).alias("g")).unionByName(graphs.select(*by, F.lit(0).alias("s"), F.lit(1).alias("g")))
    _refuse(ends.groupBy(*by).agg(F.sum("s").alias("s"), F.sum("g").alias("g")).where("s <> 1 or g <> 1").select(*by), "segments and graphs do not match")
    mapping = cut(unit_map(units, policy))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", F.struct(F.col("segment_id").alias("id"), "start", "end").alias("x")))), lambda x: x["x"])
    documents = segments.groupBy("doc_id").agg(F.to_json(F.struct(listed.alias("segments"))).alias("metadata"))
    docs, first = merge_first(supporting_documents, "document_id", "supporting_document") if supporting_documents is not None else (None, None)
    cards, more = merge_first(evidence_cards, "card_id", "evidence_card") if evidence_cards is not None else (None, None)
    conflicts = first.unionByName(more) if first is not None and more is not None else first if first is not None else more
    return Reconciled(merge_units(units, mapping), merge_relations(relations, mapping, policy), unit_segments(mapping), relation_sources(relations, mapping), documents, docs, cards, conflicts)
