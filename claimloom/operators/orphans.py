"""References to records that do not exist, found in one pass over keys in long form.

Parent keys and child references of all tables are tagged and put in one table; one aggregation by target
table, graph and key leaves a row per key with the facts about its parent and its earliest reference. The
keys whose parent is absent, deleted, or later than a reference are written down and joined back to the references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut


@dataclass(frozen=True)
class Reference:
    """A field of a child table that names a key of a target table in the same graph."""

    table: str
    field: str
    record_key: str
    target: str
    target_key: str


REFERENCES = (
    Reference("relations", "src", "edge_idx", "units", "unit_id"),
    Reference("relations", "dst", "edge_idx", "units", "unit_id"),
    Reference("evidence_cards", "supporting_doc_id", "card_id", "supporting_documents", "doc_id"),
    Reference("warrant_attacks", "warrant_id", "attack_idx", "warrants", "warrant_id"),
)


def _children(tables: dict[str, DataFrame], refs: tuple[Reference, ...]) -> DataFrame:
    """One row per record and reference field, with the record's first delivery; null and empty values are left out."""
    parts = []
    for table in dict.fromkeys(r.table for r in refs):
        own = [r for r in refs if r.table == table]
        key = own[0].record_key
        first = tables[table].groupBy("graph_id", key).agg(
            F.min("loaded_at").alias("first_loaded"), *[F.min_by(r.field, "loaded_at").alias(f"_ref{i}") for i, r in enumerate(own)]
        )
        made = F.array(*[F.struct(F.lit(r.field).alias("field_name"), F.lit(r.target).alias("target"), F.col(f"_ref{i}").alias("ref_key")) for i, r in enumerate(own)])
        parts.append(first.select(F.lit(table).alias("table_name"), "graph_id", F.col(key).cast("string").alias("record_key"), "first_loaded", F.explode(made).alias("x")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "graph_id", "record_key", "first_loaded", "x.*").where("ref_key is not null and ref_key <> ''")


def _parents(tables: dict[str, DataFrame], refs: tuple[Reference, ...]) -> DataFrame:
    parts = []
    for target, key in dict.fromkeys((r.target, r.target_key) for r in refs):
        df = tables[target]
        gone = F.col("deleted_at").isNotNull() if "deleted_at" in df.columns else F.lit(False)
        parts.append(df.select(F.lit(target).alias("target"), "graph_id", F.col(key).alias("ref_key"), F.col("loaded_at").alias("parent_loaded"), gone.alias("gone")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_references(tables: dict[str, DataFrame], refs: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """Orphans, one row each: (table_name, field_name, period, graph_id, record_key, ref_key, reason).

    reason is missing, deleted (every row of the target key has a deleted_at) or late (the target's first
    delivery is after the record's). period is the month of the record's first delivery. A null graph_id
    matches no target. One key may have any share of the references: keys are aggregated before the shuffle, and in
    the join back to the references, whose two sides are shuffled for it, Spark splits what one key has. Empty tables give no rows (or, as targets, only orphans).
    """
    children, parents = _children(tables, refs), _parents(tables, refs)
    none = lambda t: F.lit(None).cast(t)
    loaded = children.schema["first_loaded"].dataType
    long_form = children.select("target", "graph_id", "ref_key", F.col("first_loaded").alias("child_loaded"), none(loaded).alias("parent_loaded"), none("boolean").alias("gone")).unionByName(
        parents.select("target", "graph_id", "ref_key", none(loaded).alias("child_loaded"), "parent_loaded", "gone")
    )
    keys = long_form.groupBy("target", "graph_id", "ref_key").agg(
        F.min("child_loaded").alias("child_first"),
        F.min("parent_loaded").alias("parent_first"),
        F.count("gone").alias("parents"),
        F.coalesce(F.bool_and("gone"), F.lit(False)).alias("all_gone"),
    )
    reason = F.when((F.col("parents") == 0) | F.col("graph_id").isNull(), "missing").when(F.col("all_gone"), "deleted")
    suspects = keys.withColumn("reason", reason).where("child_first is not null and (reason is not null or parent_first > child_first)")
    # graph_id may be null: join on a key that is not
    safe = lambda df: df.withColumn("_g", F.coalesce(F.concat(F.lit("="), "graph_id"), F.lit("")))
    few = cut(safe(suspects).select("target", "_g", "ref_key", "reason", "parent_first"))
    found = safe(children).join(few, ["target", "_g", "ref_key"])
    late = F.when(F.col("parent_first") > F.col("first_loaded"), "late")
    return (
        found.withColumn("reason", F.coalesce("reason", late))
        .where("reason is not null")
        .select("table_name", "field_name", F.substring(F.col("first_loaded").cast("string"), 1, 7).alias("period"), "graph_id", "record_key", "ref_key", "reason")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphans per table, field, period and reason, and of the distinct keys (of a graph) that they name."""
    by = ["table_name", "field_name", "period", "reason"]
    # counted per key first: a key with most of the references is combined before it is shuffled
    keys = orphans.groupBy(*by, "graph_id", "ref_key").agg(F.count("*").alias("n"))
    return keys.groupBy(*by).agg(F.sum("n").alias("orphans"), F.count("*").alias("ref_keys"))
