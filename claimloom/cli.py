"""Command line: DOT, diagnostics and validation of one graph file."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from claimloom import __version__


def graph_diagnostics(path: str) -> dict:
    """All diagnostics of one graph file as a plain object."""
    from pyspark.sql import functions as F

    from claimloom.operators import graphs
    from claimloom.session import local_session
    from claimloom.sources.graph_json import read_graphs

    c = read_graphs(local_session(2), path)
    edges = graphs.project_edges(c.relations)
    row = graphs.diagnostics(c.units, c.warrants, c.relations).collect()
    counts = row[0].asDict() if row else {}
    groups = lambda df: sorted((sorted(r["m"]) for r in df.groupBy("component").agg(F.collect_list("node").alias("m")).collect()), key=lambda m: (len(m), m))
    degree = {r["node"]: {"in": r["in_degree"], "out": r["out_degree"]} for r in graphs.degrees(c.units, edges).collect()}
    support = graphs.degrees(c.units, graphs.project_edges(c.relations, ["support"])).where("in_degree = 0").collect()
    reach: dict[str, list[str]] = {n: [] for n in degree}
    for r in graphs.reachability(c.units, edges).collect():
        reach[r["src"]].append(r["dst"])
    named = lambda df, key: sorted(r[key] for r in df.where("is_axiom").select(key).collect())
    return {k: counts.get(k, 0) for k in ("node_count", "relation_count", "attack_edge_count", "support_edge_count", "cycle_count", "component_count", "scc_count", "max_reachability")} | {
        "cycles": [r["nodes"] for r in graphs.cycles(c.units, edges).orderBy("cycle_no").collect()],
        "components": sorted(groups(graphs.weakly_connected(c.units, edges)), key=lambda m: m[0]),
        "strongly_connected_components": groups(graphs.strongly_connected(c.units, edges)),
        "isolated_units": sorted(n for n, d in degree.items() if not d["in"] and not d["out"]),
        "unsupported_claims": sorted(r["node"] for r in support),
        "degrees": degree,
        "degree_summary": {k: counts.get(k, 0) for k in ("avg_in", "avg_out", "max_in", "max_out")},
        "reachability": {n: sorted(t) for n, t in reach.items()},
        "axioms": {"claims": named(c.units, "unit_id"), "warrants": named(c.warrants, "warrant_id")},
        "axiom_warnings": [r["warning"] for r in graphs.axiom_warnings(c.units, c.warrants).orderBy("kind", "id").collect()],
    }


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("dot", "diagnostics", "validate"):
        p = commands.add_parser(name)
        p.add_argument("path")
        if name != "validate":
            p.add_argument("--validate", action="store_true")
    commands.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    from claimloom.sources.graph_json import loads

    checked = args.command == "validate" or args.validate
    loads(Path(args.path).read_text(encoding="utf-8"), validate=checked)
    if args.command == "validate":
        print("OK")
    elif args.command == "dot":
        from claimloom.session import local_session
        from claimloom.sources.dot import to_dot
        from claimloom.sources.graph_json import read_graphs

        c = read_graphs(local_session(2), os.path.abspath(args.path))
        rows = to_dot(c.units, c.relations).collect()
        print(rows[0]["dot"] if rows else "digraph ArgumentGraph {\n  node [shape=box];\n}")
    else:
        print(json.dumps(graph_diagnostics(os.path.abspath(args.path)), indent=2, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
