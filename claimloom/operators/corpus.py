"""A corpus of argument graphs as DataFrames keyed by graph_id, and the operations that build one up."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.operators.grouped import ordered_rank
from claimloom.sources.tables import current

SPAN = "struct<doc_id: string, start: int, end: int, text: string, page: int, bbox: array<double>, modality: string>"
EVIDENCE = f"struct<id: string, source: struct<kind: string, span: {SPAN}, structured: string>, stance: string, strength: double, quality: string>"
SCHEMAS = {
    "units": f"graph_id string, unit_id string, ord int, text string, type string, spans array<{SPAN}>, evidence array<{EVIDENCE}>, evidence_ids array<string>, "
    "evidence_min double, evidence_max double, score double, is_axiom boolean, ignore_influence boolean, metadata string",
    "warrants": f"graph_id string, warrant_id string, ord int, text string, type string, spans array<{SPAN}>, evidence array<{EVIDENCE}>, evidence_ids array<string>, "
    "score double, is_axiom boolean, ignore_influence boolean, metadata string",
    "relations": "graph_id string, edge_idx int, src string, dst string, kind string, warrant_ids array<string>, gate_mode string, weight double, rationale string, "
    "gate_disabled boolean, gate_restricted boolean, gate_action string, confidence double, metadata string",
    "warrant_attacks": "graph_id string, attack_idx int, src string, warrant_id string, kind string, rationale string, metadata string",
    "evidence_cards": "graph_id string, card_id string, ord int, title string, supporting_doc_id string, excerpt string, confidence double, metadata string",
    "supporting_documents": "graph_id string, doc_id string, ord int, name string, type string, url string, trust double, size double, upload_date string, uploader string, metadata string",
    "bundles": "graph_id string, bundle_id string, ord int, units array<string>, relations string, metadata string",
    "graphs": "graph_id string, metadata string",
}
ID = {"units": "unit_id", "warrants": "warrant_id", "evidence_cards": "card_id", "supporting_documents": "doc_id", "bundles": "bundle_id"}


@dataclass(frozen=True)
class Corpus:
    """The tables of a corpus. ``ord``, ``edge_idx`` and ``attack_idx`` carry the order of insertion.

    ``graphs`` holds the metadata of graphs as such; a graph without any need not be there. ``relations`` of a bundle is
    the JSON list of its own relations.
    """

    units: DataFrame
    warrants: DataFrame
    relations: DataFrame
    warrant_attacks: DataFrame
    evidence_cards: DataFrame
    supporting_documents: DataFrame
    bundles: DataFrame
    graphs: DataFrame


def empty_corpus(spark: SparkSession) -> Corpus:
    return Corpus(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def load_corpus(spark: SparkSession, folder: str) -> Corpus:
    """The current rows (last delivery of each key, not deleted) of the tables in ``folder``; no bundles and no metadata of graphs."""
    names = [n for n in SCHEMAS if n not in ("bundles", "graphs")]
    return replace(empty_corpus(spark), **{n: current(spark, folder, n) for n in names})


def edge_id(edge_idx: Column) -> Column:
    return F.concat(F.lit("e"), edge_idx.cast("string"))


class Rejected(ValueError):
    """Rows that an operation refuses; ``rows`` holds some of them."""

    def __init__(self, message: str, rows: list) -> None:
        super().__init__(f"{message}: {rows}")
        self.rows = rows


def _refuse(bad: DataFrame, message: str) -> None:
    """Raise if ``bad`` has rows; shows the first ten."""
    rows = [tuple(r) for r in bad.limit(10).collect()]
    if rows:
        raise Rejected(message, rows)


def _conform(df: DataFrame, like: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Later rows replace earlier ones of the same key, at the place of the first; new keys follow by ``ord``.

    ``rows`` carries its own order in ``ord``. Of rows with one key the last wins, silently.
    """
    both = table.withColumn("_batch", F.lit(0)).unionByName(_conform(rows, table).withColumn("_batch", F.lit(1)))
    w = Window.partitionBy("graph_id", key)
    first = F.min(F.struct("_batch", "ord")).over(w)
    last = F.row_number().over(w.orderBy(F.col("_batch").desc(), F.col("ord").desc()))
    kept = both.withColumn("_first", first).withColumn("_last", last).where("_last = 1")
    placed = ordered_rank(kept.select("*", F.col("_first._batch").alias("_b"), F.col("_first.ord").alias("_o")), ["graph_id"], ["_b", "_o", key], "_place")
    return placed.withColumn("ord", F.col("_place").cast("int")).select(*table.columns)


def with_ids(rows: DataFrame, table: DataFrame, key: str, prefix: str) -> DataFrame:
    """Fills null keys with prefix + next number: one more than the largest all-digit suffix in the graph, then upwards by ord."""
    number = F.regexp_extract(F.col(key), f"^{prefix}([0-9]+)$", 1).try_cast("bigint")
    top = table.select("graph_id", number.alias("n")).unionByName(rows.select("graph_id", number.alias("n"))).groupBy("graph_id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("_top"))
    named = rows.where(F.col(key).isNotNull())
    numbered = ordered_rank(rows.where(F.col(key).isNull()), ["graph_id"], ["ord"], "_n").join(top, "graph_id", "left")
    made = F.concat(F.lit(prefix), (F.coalesce("_top", F.lit(0)) + F.col("_n") + 1).cast("string"))
    return named.unionByName(numbered.withColumn(key, made).select(*rows.columns))


def new_graphs(c: Corpus, rows: DataFrame) -> Corpus:
    """Adds graphs (graph_id, title and, if there, metadata as JSON); a title that is not empty goes into the metadata. The last row of a graph wins."""
    own = F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in rows.columns else F.lit("{}")
    title = F.to_json(F.struct("title"))
    merged = F.when(F.coalesce("title", F.lit("")) == "", own).when(own.rlike(r"^\s*\{\s*\}\s*$"), title).otherwise(F.concat(F.regexp_replace(own, r"\}\s*$", ","), F.substr(title, F.lit(2))))
    made = rows.select("graph_id", merged.alias("metadata"))
    return replace(c, graphs=c.graphs.join(made, "graph_id", "left_anti").unionByName(made.groupBy("graph_id").agg(F.max("metadata").alias("metadata"))))


def add_claims(c: Corpus, rows: DataFrame) -> Corpus:
    """Upsert of claims; null unit_ids are allocated from c1 on. ``rows`` needs graph_id, unit_id, ord, text."""
    filled = {"type": F.lit("other"), "is_axiom": F.lit(False), "ignore_influence": F.lit(False)}
    for name, value in filled.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return replace(c, units=upsert(c.units, with_ids(rows, c.units, "unit_id", "c"), "unit_id"))


def add_warrants(c: Corpus, rows: DataFrame) -> Corpus:
    """Upsert of warrants; null warrant_ids are allocated from the warrants' own numbers."""
    filled = {"type": F.lit("other"), "is_axiom": F.lit(False), "ignore_influence": F.lit(False)}
    for name, value in filled.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return replace(c, warrants=upsert(c.warrants, with_ids(rows, c.warrants, "warrant_id", "w"), "warrant_id"))


def _append(table: DataFrame, rows: DataFrame, idx: str) -> DataFrame:
    start = table.groupBy("graph_id").agg((F.max(idx) + 1).alias("_start"))
    numbered = ordered_rank(rows, ["graph_id"], ["ord"], "_n").join(start, "graph_id", "left")
    return table.unionByName(_conform(numbered.withColumn(idx, F.coalesce("_start", F.lit(0)) + F.col("_n")), table))


def add_relations(c: Corpus, rows: DataFrame) -> Corpus:
    """Appends relations in the order of ``ord``; ends are not checked. gate_mode defaults to OR."""
    rows = rows.withColumn("gate_mode", F.coalesce(F.col("gate_mode"), F.lit("OR")) if "gate_mode" in rows.columns else F.lit("OR"))
    return replace(c, relations=_append(c.relations, rows, "edge_idx"))


def add_warrant_attacks(c: Corpus, rows: DataFrame) -> Corpus:
    """Appends attacks on warrants; an unknown warrant is refused, the source is not checked."""
    _refuse(rows.join(c.warrants, ["graph_id", "warrant_id"], "left_anti").select("graph_id", "warrant_id"), "unknown warrant")
    rows = rows.withColumn("kind", F.coalesce(F.col("kind"), F.lit("attack")) if "kind" in rows.columns else F.lit("attack"))
    return replace(c, warrant_attacks=_append(c.warrant_attacks, rows, "attack_idx"))


def attach_evidence(c: Corpus, rows: DataFrame, to: str = "units") -> Corpus:
    """Appends evidence items (graph_id, the target's key, ord, item) to units or warrants; an unknown target is refused."""
    table, key = getattr(c, to), ID[to]
    _refuse(rows.join(table, ["graph_id", key], "left_anti").select("graph_id", key), "unknown target of evidence")
    placed = rows.withColumn("_m", F.row_number().over(Window.partitionBy("graph_id", key).orderBy("ord")))
    items = placed.groupBy("graph_id", key).agg(F.map_from_entries(F.collect_list(F.struct("_m", "item"))).alias("_map"), F.count("*").cast("int").alias("_n"))
    ordered = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.element_at("_map", i))
    old = F.coalesce("evidence", F.array().cast(table.schema["evidence"].dataType))
    joined = table.join(items, ["graph_id", key], "left")
    joined = joined.withColumn("evidence", F.when(F.col("_n").isNull(), F.col("evidence")).otherwise(F.concat(old, ordered.cast(table.schema["evidence"].dataType))))
    return replace(c, **{to: joined.select(*table.columns)})


def add_unique(c: Corpus, rows: DataFrame, to: str, overwrite: bool = False) -> Corpus:
    """Adds documents or cards; a key that is there already is refused unless ``overwrite``."""
    table, key = getattr(c, to), ID[to]
    if not overwrite:
        again = rows.groupBy("graph_id", key).count().where("count > 1").select("graph_id", key)
        _refuse(rows.join(table, ["graph_id", key], "left_semi").select("graph_id", key).unionByName(again), f"{key} exists already")
    return replace(c, **{to: upsert(table, rows, key)})


def attach_cards(c: Corpus, rows: DataFrame) -> Corpus:
    """Attaches evidence cards to units: (graph_id, unit_id, card_id, ord, evidence_id, stance).

    Unit and card must exist. The item names the card as its structured source and takes the card's
    confidence as strength; the card's id is added once to the unit's evidence_ids. Stance defaults to supports.
    """
    _refuse(rows.join(c.evidence_cards, ["graph_id", "card_id"], "left_anti").select("graph_id", "card_id"), "unknown evidence card")
    found = rows.join(c.evidence_cards.select("graph_id", "card_id", "confidence"), ["graph_id", "card_id"])
    source = F.struct(
        F.lit("structured").alias("kind"), F.lit(None).cast(SPAN).alias("span"), F.to_json(F.struct(F.col("card_id").alias("evidence_card_id"))).alias("structured")
    )
    stance = F.coalesce(F.col("stance"), F.lit("supports")) if "stance" in rows.columns else F.lit("supports")
    own = F.col("evidence_id") if "evidence_id" in rows.columns else F.lit(None)
    item = F.struct(
        F.coalesce(own, F.col("card_id")).alias("id"), source.alias("source"), stance.alias("stance"), F.col("confidence").alias("strength"), F.lit(None).cast("string").alias("quality")
    )
    out = attach_evidence(c, found.select("graph_id", "unit_id", "ord", item.alias("item")), "units")
    ids = rows.groupBy("graph_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("ord", "card_id"))).alias("_c"))
    units = out.units.join(ids, ["graph_id", "unit_id"], "left")
    have = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    merged = F.concat(have, F.array_except(F.col("_c.card_id"), have))
    return replace(out, units=units.withColumn("evidence_ids", F.when(F.col("_c").isNull(), F.col("evidence_ids")).otherwise(merged)).select(*out.units.columns))
