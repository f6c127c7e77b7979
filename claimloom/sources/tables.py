"""The Parquet table layout: one file or folder ``<name>.parquet`` per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "units", "warrants", "relations", "warrant_attacks", "evidence_cards", "supporting_documents",
    "extracted_claims", "merge_results", "claim_matches", "uploaders", "graph_payloads", "graph_exports",
    "documents",
)

KEYS = {
    "units": ["graph_id", "unit_id"],
    "warrants": ["graph_id", "warrant_id"],
    "relations": ["graph_id", "edge_idx"],
    "warrant_attacks": ["graph_id", "attack_idx"],
    "evidence_cards": ["graph_id", "card_id"],
    "supporting_documents": ["graph_id", "doc_id"],
    "extracted_claims": ["claim_id"],
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last delivery of each key (by loaded_at; of ties, the one not deleted and then any equal copy).

    Null keys are kept as one group, as in GROUP BY. An empty table gives an empty table.
    """
    order = [F.col("loaded_at").desc_nulls_last()]
    if "deleted_at" in df.columns:
        order.append(F.col("deleted_at").asc_nulls_first())
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Latest delivery per key without the deleted rows, for the tables in KEYS."""
    df = latest(read_table(spark, folder, name), KEYS[name])
    return df.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df
