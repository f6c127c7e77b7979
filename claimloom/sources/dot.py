"""Graphs as Graphviz DOT text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The colour of each kind of edge; others are black.
COLOURS = {"support": "green", "attack": "red", "undercut": "orange", "rebut": "blue"}


def escape_label(text: Column) -> Column:
    for plain, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(shown))
    return text


def dot_lines(units: DataFrame, relations: DataFrame) -> DataFrame:
    """(graph_id, part, at, line): the header, a line per unit and per relation, the end. Null texts and ends read as ''."""
    graphs = units.select("graph_id").unionByName(relations.select("graph_id")).dropDuplicates()
    line = lambda part, at, text: ["graph_id", F.lit(part).alias("part"), at.cast("int").alias("at"), text.alias("line")]
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = graphs.select("graph_id", F.posexplode(F.array(F.lit("digraph ArgumentGraph {"), F.lit("  node [shape=box];"))).alias("at", "line"))
    head = head.select(*line(0, F.col("at"), F.col("line")))
    label = escape_label(F.concat(F.col("unit_id"), F.lit(": "), empty("text")))
    nodes = units.select(*line(1, F.col("ord"), F.concat(F.lit('  "'), F.col("unit_id"), F.lit('" [label="'), label, F.lit('"];'))))
    colour = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), empty("kind")), F.lit("black"))
    said = F.concat(F.lit('  "'), empty("src"), F.lit('" -> "'), empty("dst"), F.lit('" [label="'), escape_label(empty("kind")), F.lit('", color="'), colour, F.lit('"];'))
    edges = relations.select(*line(2, F.col("edge_idx"), said))
    return head.unionByName(nodes).unionByName(edges).unionByName(graphs.select(*line(3, F.lit(0), F.lit("}"))))


def to_dot(units: DataFrame, relations: DataFrame) -> DataFrame:
    """(graph_id, dot): the whole text of each graph."""
    lines = dot_lines(units, relations)
    return lines.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"]), "\n").alias("dot"))


def render(units: DataFrame, relations: DataFrame, path: str, engine: str = "graphviz") -> None:
    """Writes the DOT text of all graphs below ``path``."""
    if engine != "graphviz":
        raise ValueError(f"unknown engine: {engine}")
    to_dot(units, relations).select(F.col("dot").alias("value")).write.mode("overwrite").text(path, lineSep="\n\n")
