"""Bundles of claims and the graph between bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.corpus import _refuse
from claimloom.sources.graph_json import relation_struct

AGGREGATIONS = ("sum", "mean", "max", "softmax")


def define_bundles(bundles: DataFrame, rows: DataFrame, units: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Adds bundles (graph_id, bundle_id, ord, units, relations, metadata); a null bundle_id becomes arg_{n+1}.

    Relations that are given (a JSON list) are kept; where they are null, those of ``relations`` with both ends inside are taken.

    Fewer than two units, a bundle_id that is there already, and unknown units are refused.
    """
    from pyspark.sql import Window

    have = bundles.groupBy("graph_id").agg(F.count("*").alias("_have"))
    n = F.row_number().over(Window.partitionBy("graph_id").orderBy("ord"))
    rows = rows.withColumn("_n", n).join(have, "graph_id", "left")
    place = F.coalesce("_have", F.lit(0)) + F.col("_n")
    rows = rows.withColumn("bundle_id", F.coalesce("bundle_id", F.concat(F.lit("arg_"), place.cast("string")))).withColumn("ord", (place - 1).cast("int"))
    given = F.col("relations") if "relations" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("relations", given).select(*bundles.columns)
    if relations is not None:
        inside = bundle_relations(bundle_members(rows), relations).join(relations, ["graph_id", "edge_idx"])
        lists = inside.select("graph_id", "bundle_id", F.struct("edge_idx", F.to_json(relation_struct(), {"ignoreNullFields": "false"}).alias("j")).alias("r")).groupBy("graph_id", "bundle_id")
        own = lists.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["j"]), ", "), F.lit("]")).alias("_own"))
        rows = rows.join(own, ["graph_id", "bundle_id"], "left").withColumn("relations", F.coalesce("relations", "_own", F.lit("[]"))).select(*bundles.columns)
    _refuse(rows.where("units is null or size(units) < 2").select("graph_id", "bundle_id"), "bundles need two units")
    both = bundles.unionByName(rows)
    _refuse(both.groupBy("graph_id", "bundle_id").count().where("count > 1").select("graph_id", "bundle_id"), "bundle exists already")
    _refuse(bundle_members(rows).join(units, ["graph_id", "unit_id"], "left_anti").select("graph_id", "unit_id"), "unknown unit")
    return both


def bundle_members(bundles: DataFrame) -> DataFrame:
    return bundles.select("graph_id", "bundle_id", F.posexplode("units").alias("pos", "unit_id"))


def bundle_relations(members: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with both ends inside one bundle: (graph_id, bundle_id, edge_idx)."""
    m = members.select("graph_id", "bundle_id", "unit_id").dropDuplicates()
    a = m.select("graph_id", "bundle_id", F.col("unit_id").alias("src"))
    b = m.select("graph_id", "bundle_id", F.col("unit_id").alias("dst"))
    return relations.join(a, ["graph_id", "src"]).join(b, ["graph_id", "bundle_id", "dst"]).select("graph_id", "bundle_id", "edge_idx")


def signed_weight(kind: Column, weight: Column) -> Column:
    """The weight (1 if null) of a support as it is, of any other kind minus its size."""
    base = F.coalesce(weight, F.lit(1.0))
    return F.when(kind == "support", base).otherwise(-F.abs(base))


def _total(x: Column) -> Column:
    """The sum by decimal digits, so that weights that cancel out give 0 in any order; of weights beyond 1e12 the plain sum."""
    return F.when(F.max(F.abs(x)) < 1e12, F.sum(x.try_cast("decimal(38,18)")).cast("double")).otherwise(F.sum(x))


def aggregate_weights(w: Column, at: Column, how: str) -> Column:
    """sum, mean, max (the largest size, of ties the first by ``at``) or softmax (weights e^|w|, with e = 2.718281828)."""
    if how == "sum":
        return _total(w)
    if how == "mean":
        return _total(w) / F.count(w)
    if how == "max":
        return F.max_by(w, F.struct(F.abs(w), -at))
    if how == "softmax":
        e = F.pow(F.lit(2.718281828), F.abs(w))
        return _total(w * e) / F.sum(e)
    raise ValueError(f"unknown aggregation: {how}")


def project_bundles(members: DataFrame, relations: DataFrame, how: str = "sum", clamp: bool = True, check: bool = True) -> DataFrame:
    """(graph_id, src, dst, kind, weight) between different bundles; support where the weight is at least 0.

    With ``check``, a unit in two bundles and a corpus without bundles are refused.
    """
    how = how.lower()
    if how not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {how}")
    if check:
        if members.isEmpty():
            raise ValueError("there are no bundles")
        _refuse(members.groupBy("graph_id", "unit_id").count().where("count > 1").select("graph_id", "unit_id"), "unit in several bundles")
    a = members.select("graph_id", F.col("unit_id").alias("src"), F.col("bundle_id").alias("a"))
    b = members.select("graph_id", F.col("unit_id").alias("dst"), F.col("bundle_id").alias("b"))
    rows = relations.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("a <> b").withColumn("w", signed_weight(F.col("kind"), F.col("weight")))
    out = rows.groupBy("graph_id", F.col("a").alias("src"), F.col("b").alias("dst")).agg(aggregate_weights(F.col("w"), F.col("edge_idx"), how).alias("weight"))
    if clamp:
        out = out.withColumn("weight", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("weight"))))
    return out.select("graph_id", "src", "dst", F.when(F.col("weight") >= 0, "support").otherwise("attack").alias("kind"), "weight")
