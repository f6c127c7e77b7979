"""Small corpora for tests."""

from claimloom.operators.corpus import SCHEMAS, empty_corpus


def table(spark, name, rows):
    """Rows given as dicts; fields left out are null."""
    from pyspark.sql.types import StructType

    schema = spark.createDataFrame([], SCHEMAS[name]).schema
    assert isinstance(schema, StructType)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def corpus(spark, **tables):
    from dataclasses import replace

    graph = {"graph_id": "g"}
    return replace(empty_corpus(spark), **{n: table(spark, n, [graph | r for r in rows]) for n, rows in tables.items()})


def units(*ids, **common):
    return [{"unit_id": i, "ord": n, "text": f"text {i}", "type": "other", "is_axiom": False, "ignore_influence": False} | common for n, i in enumerate(ids)]


def warrants(*ids, **common):
    return [{"warrant_id": i, "ord": n, "text": f"warrant {i}", "is_axiom": False, "ignore_influence": False} | common for n, i in enumerate(ids)]


def edges(*rows):
    """(src, dst, kind, warrant ids[, gate mode[, weight]])"""
    out = []
    for n, (src, dst, kind, ws, *more) in enumerate(rows):
        out.append({"edge_idx": n, "src": src, "dst": dst, "kind": kind, "warrant_ids": list(ws), "gate_mode": more[0] if more else "OR", "weight": more[1] if len(more) > 1 else None})
    return out
