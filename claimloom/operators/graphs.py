"""Structure of argument graphs: degrees, components, reachability, cycles, diagnostics.

Components and reachability are loops of joins and aggregations over all graphs at once, whose state is a table of the
shared folder in each round; a graph of any size goes the same way. Labels are handed on along edges and, in the same
round, taken over from the vertex that a label names (pointer jumping), so a chain takes rounds by its logarithm.
Reachability is worked out between strong components, not between vertices.

Cycles are by definition those that one depth-first walk in the order of insertion closes, and where a walk enters a
strong component depends on what it saw before. What cannot lead to a cycle is removed, each weak component is a
walk of its own, and that walk is one task; the figures of :func:`diagnostics` that need a walk come from the same one,
which lists neither cycles nor pairs. The kernels below also serve single graphs and corpora known to be small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.grouped import ordered_rank, per_group
from claimloom.session import cut, release


def project_edges(relations: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(graph_id, edge_idx, src, dst) of relations of the given kinds (all if None); duplicates stay. Edges with a null end are left out."""
    rows = relations.where("src is not null and dst is not null")
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(*kinds))
    return rows.select("graph_id", "edge_idx", "src", "dst")


def node_set(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node) of the units and of all ends of edges."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    return units.select("graph_id", F.col("unit_id").alias("node")).unionByName(ends).dropDuplicates()


def degrees(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, in_degree, out_degree); parallel edges count, ends that are no unit are nodes too."""
    marks = (
        edges.select("graph_id", F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
        .unionByName(edges.select("graph_id", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
        .unionByName(units.select("graph_id", F.col("unit_id").alias("node"), F.lit(0).alias("i"), F.lit(0).alias("o")))
    )
    return marks.groupBy("graph_id", "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


# ---- kernels on one graph


def _index(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> tuple[list[str], list[list[int]]]:
    at: dict[str, int] = {}
    for n in nodes:
        at.setdefault(n, len(at))
    out: list[list[int]] = [[] for _ in at]
    for s, d in edges:
        for x in (s, d):
            if x not in at:
                at[x] = len(at)
                out.append([])
        out[at[s]].append(at[d])
    return list(at), out


def back_edge_cycles(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Cycles closed by back edges of one depth-first walk in the order of nodes and edges, each from its smallest node, sorted."""
    names, out = _index(nodes, edges)
    depth = [-1] * len(names)  # place on the current path; -2 when left
    found: set[tuple[str, ...]] = set()
    for root in range(len(names)):
        if depth[root] != -1:
            continue
        path, todo = [root], [iter(out[root])]
        depth[root] = 0
        while path:
            nxt = next(todo[-1], None)
            if nxt is None:
                depth[path.pop()] = -2
                todo.pop()
            elif depth[nxt] == -1:
                depth[nxt] = len(path)
                path.append(nxt)
                todo.append(iter(out[nxt]))
            elif depth[nxt] >= 0:
                cycle = [names[i] for i in path[depth[nxt] :]]
                k = cycle.index(min(cycle))
                found.add(tuple(cycle[k:] + cycle[:k]))
    return [list(c) for c in sorted(found)]


def strong_components(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components by two passes (finishing order, then the reversed graph), sorted by size and members."""
    names, out = _index(nodes, edges)
    back: list[list[int]] = [[] for _ in names]
    for i, targets in enumerate(out):
        for t in targets:
            back[t].append(i)
    order, seen = [], [False] * len(names)
    for root in range(len(names)):
        if seen[root]:
            continue
        seen[root], stack = True, [(root, iter(out[root]))]
        while stack:
            node, todo = stack[-1]
            for t in todo:
                if not seen[t]:
                    seen[t] = True
                    stack.append((t, iter(out[t])))
                    break
            else:
                order.append(node)
                stack.pop()
    parts, owner = [], [False] * len(names)
    for root in reversed(order):
        if owner[root]:
            continue
        owner[root], part, stack = True, [], [root]
        while stack:
            node = stack.pop()
            part.append(names[node])
            for t in back[node]:
                if not owner[t]:
                    owner[t] = True
                    stack.append(t)
        parts.append(sorted(part))
    return sorted(parts, key=lambda p: (len(p), p))


def weak_components(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Weakly connected components, members sorted, ordered by their smallest member."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for n in nodes:
        find(n)
    for s, d in edges:
        a, b = find(s), find(d)
        if a != b:
            root[max(a, b)] = min(a, b)
    parts: dict[str, list[str]] = {}
    for n in list(root):
        parts.setdefault(find(n), []).append(n)
    return sorted(sorted(p) for p in parts.values())


def reachable(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    """Nodes that each node reaches by one edge or more; itself only if it is on a cycle."""
    names, out = _index(nodes, edges)
    result = {}
    for i, name in enumerate(names):
        seen, todo = set(), list(out[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        result[name] = sorted(names[x] for x in seen)
    return result


def back_edges(out: list[list[int]]) -> int:
    """How many cycles :func:`back_edge_cycles` finds, without listing them.

    A cycle is the walk's one path from a vertex to another and the edge back, so as many as there are such pairs of vertices.
    """
    state = [0] * len(out)  # 1 on the current path, 2 when left
    found: set[tuple[int, int]] = set()
    for root in range(len(out)):
        if state[root]:
            continue
        path, todo = [root], [iter(out[root])]
        state[root] = 1
        while path:
            nxt = next(todo[-1], None)
            if nxt is None:
                state[path.pop()] = 2
                todo.pop()
            elif not state[nxt]:
                state[nxt] = 1
                path.append(nxt)
                todo.append(iter(out[nxt]))
            elif state[nxt] == 1:
                found.add((path[-1], nxt))
    return len(found)


def _strong_order(out: list[list[int]]) -> list[list[int]]:
    """Strong components of a graph given as lists of targets, each after all those that it leads to (one depth-first walk)."""
    seen, low, on_stack = [0] * len(out), [0] * len(out), [False] * len(out)
    parts: list[list[int]] = []
    stack: list[int] = []
    count = 0
    for root in range(len(out)):
        if seen[root]:
            continue
        path, todo = [root], [iter(out[root])]
        count += 1
        seen[root] = low[root] = count
        stack.append(root)
        on_stack[root] = True
        while path:
            node, nxt = path[-1], next(todo[-1], None)
            if nxt is None:
                path.pop()
                todo.pop()
                if path and low[node] < low[path[-1]]:
                    low[path[-1]] = low[node]
                if low[node] == seen[node]:
                    part: list[int] = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        on_stack[part[-1]] = False
                    parts.append(part)
            elif not seen[nxt]:
                count += 1
                seen[nxt] = low[nxt] = count
                stack.append(nxt)
                on_stack[nxt] = True
                path.append(nxt)
                todo.append(iter(out[nxt]))
            elif on_stack[nxt] and seen[nxt] < low[node]:
                low[node] = seen[nxt]
    return parts


#: Vertices whose being reached is worked out at once, as bits of one number per strong component.
REACH_BITS = 8192


def reach_sizes(out: list[list[int]]) -> list[tuple[int, int]]:
    """(vertices, how many vertices each of them reaches by one edge or more) of each strong component, without listing pairs."""
    parts = _strong_order(out)
    own = [0] * len(out)
    for i, part in enumerate(parts):
        for x in part:
            own[x] = i
    leads = [sorted({own[y] for x in part for y in out[x]}) for part in parts]
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    counts = [0] * len(parts)
    for low in range(0, at, REACH_BITS):
        high = min(low + REACH_BITS, at)
        # of each component: what it reaches, and itself, among the vertices low to high
        masks: list[int] = []
        for i, part in enumerate(parts):
            a, b = max(starts[i], low) - low, min(starts[i] + len(part), high) - low
            me = ((1 << (b - a)) - 1) << a if b > a else 0
            far = 0
            for k in leads[i]:
                far |= me if k == i else masks[k]
            counts[i] += far.bit_count()
            masks.append(far | me)
    return [(len(part), n) for part, n in zip(parts, counts, strict=True)]


def _per_graph(units: DataFrame, edges: DataFrame, schema: str, kernel: Callable[[list[str], list[tuple[str, str]]], list[tuple]]) -> DataFrame:
    """Runs a kernel on each graph: its unit ids in ``ord`` order and its edges in ``edge_idx`` order."""
    ordinal = F.col("ord") if "ord" in units.columns else F.lit(0)
    long_form = units.select("graph_id", F.lit(False).alias("edge"), ordinal.cast("int").alias("at"), F.col("unit_id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(
        edges.select("graph_id", F.lit(True).alias("edge"), F.col("edge_idx").cast("int").alias("at"), F.col("src").alias("a"), F.col("dst").alias("b"))
    )

    def run(rows: list[tuple]) -> list[tuple]:
        return kernel([r[3] for r in rows if not r[1]], [(r[3], r[4]) for r in rows if r[1]])

    return per_group(long_form, "graph_id", ["edge", "at", "a"], schema, run)


def _walk_part(nodes: list[str], edges: list[tuple[str, str]]) -> list[tuple]:
    return [(c,) for c in back_edge_cycles(nodes, edges)]


def _per_part(units: DataFrame, edges: DataFrame, labels: DataFrame, schema: str, kernel: Callable[[list[str], list[tuple[str, str]]], list[tuple]]) -> DataFrame:
    """As :func:`_per_graph`, on each weak component of ``labels``; its graph_id is JSON of the graph and the component."""
    own = labels.select("graph_id", F.col("node").alias("unit_id"), F.to_json(F.struct("graph_id", "component")).alias("part"))
    inside = units.join(own, ["graph_id", "unit_id"]).withColumn("graph_id", F.col("part")).drop("part")
    within = edges.join(own.withColumnRenamed("unit_id", "src"), ["graph_id", "src"]).withColumn("graph_id", F.col("part")).drop("part")
    return _per_graph(inside, within, schema, kernel)


def _shape_of_part(nodes: list[str], edges: list[tuple[str, str]]) -> list[tuple]:
    out = _index(nodes, edges)[1]
    found = reach_sizes(out)
    return [(back_edges(out), len(found), max(n for _, n in found))]


def shapes(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, cycle_count, components, strong, reach) of graphs with edges: their cycles, their weak and strong components, and the most
    vertices that one reaches. Vertices without edges do not count.

    Cycles take one walk per weak component anyway, which is one task; the others are counted on the same walk.
    """
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).dropDuplicates()
    parts = _per_part(units, edges, _minimum_labels(ends, edges), "cycle_count bigint, strong bigint, reach bigint", _shape_of_part)
    return parts.groupBy(F.get_json_object("graph_id", "$.graph_id").alias("graph_id")).agg(
        F.sum("cycle_count").alias("cycle_count"), F.count("*").alias("components"), F.sum("strong").alias("strong"), F.max("reach").alias("max_reachability")
    )


def cycles(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, cycle_no, nodes) by :func:`back_edge_cycles`, numbered in their order within the graph.

    Self-loops are cycles whatever the walk. The others are searched per weak component, without the vertices that
    cannot reach a cycle because they have no way out (taken off three times, which decides nothing but the work).
    """
    links = cut(edges.where("src <> dst"))
    for _ in range(3):
        before, links = links, cut(links.join(links.select("graph_id", F.col("src").alias("dst")).dropDuplicates(), ["graph_id", "dst"], "left_semi").select(*links.columns))
        release(before)
    ends = links.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).dropDuplicates()
    walked = _per_part(units, links, _minimum_labels(ends, links), "nodes array<string>", _walk_part)
    found = walked.select(F.get_json_object("graph_id", "$.graph_id").alias("graph_id"), "nodes")
    loops = edges.where("src = dst").select("graph_id", F.array("src").alias("nodes")).dropDuplicates()
    return ordered_rank(found.unionByName(loops), ["graph_id"], ["nodes"], "cycle_no").select("graph_id", F.col("cycle_no").cast("int").alias("cycle_no"), "nodes")


def _minimum_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, node, component): smallest node reached over undirected links, by label propagation with pointer jumping."""
    both = cut(links.where("src <> dst").select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x")).select("graph_id", "x.*").dropDuplicates())
    state = cut(nodes.select("graph_id", "node", F.col("node").alias("label"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():
        told = both.join(state.select("graph_id", F.col("node").alias("b"), F.col("label").alias("l")), ["graph_id", "b"]).select("graph_id", F.col("a").alias("node"), "l")
        # a label is a node itself: take over its label too
        jump = state.where("label <> node").join(state.select("graph_id", F.col("node").alias("label"), F.col("label").alias("l")), ["graph_id", "label"]).select("graph_id", "node", "l")
        near = told.unionByName(jump).groupBy("graph_id", "node").agg(F.min("l").alias("l"))
        new = state.join(near, ["graph_id", "node"], "left").select("graph_id", "node", F.least("label", "l").alias("label"), F.coalesce(F.col("l") < F.col("label"), F.lit(False)).alias("moved"))
        before, state = state, cut(new)
        release(before)
    release(both)
    return state.select("graph_id", "node", F.col("label").alias("component"))


def weakly_connected(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, component); the component is named by its smallest member."""
    return _minimum_labels(node_set(units, edges), edges)


def weakly_connected_small(units: DataFrame, edges: DataFrame) -> DataFrame:
    """As :func:`weakly_connected`, each graph in one task: for corpora whose graphs are all known to be small."""
    return _per_graph(units, edges, "node string, component string", lambda n, e: [(x, p[0]) for p in weak_components(n, e) for x in p])


def strongly_connected(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, component); singletons are components too, named like the others by the smallest member.

    In each round, every vertex learns the least vertex that reaches it and the least that it reaches, in an order drawn
    anew for the round. Where the two are one, it is in that vertex's component. Other vertices of one component have both
    in common, so only links between vertices that have stay for the next round; without links, what is left is single.
    """
    nodes = cut(node_set(units, edges))
    links = cut(edges.select("graph_id", "src", "dst").where("src <> dst").dropDuplicates())
    settled: list[DataFrame] = []
    turn = 0
    while not links.isEmpty():
        turn += 1
        drawn = F.struct(F.xxhash64("graph_id", "node", F.lit(turn)).alias("h"), F.col("node").alias("n"))
        # only vertices with links both ways can be in a component of several
        live = links.select("graph_id", F.col("src").alias("node")).intersect(links.select("graph_id", F.col("dst").alias("node")))
        state = cut(live.select("graph_id", "node", drawn.alias("c"), drawn.alias("d"), F.lit(True).alias("moved")))
        while not state.where("moved").isEmpty():
            of = lambda name: state.select("graph_id", F.col("node").alias(name), "c", "d")  # noqa: B023, E731
            none = F.lit(None).cast(state.schema["c"].dataType)
            down = links.join(of("src"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node"), "c", none.alias("d"))
            up = links.join(of("dst"), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node"), none.alias("c"), "d")
            # what reaches the vertex that reaches this one reaches this one, and the other way round
            far = lambda x, y: state.where(F.col(x)["n"] != F.col("node")).select("graph_id", F.col(x)["n"].alias("_n"), "node").join(of("_n"), ["graph_id", "_n"]).select("graph_id", "node", F.col(x).alias(x), none.alias(y))  # noqa: B023, E731
            told = down.unionByName(up).unionByName(far("c", "d")).unionByName(far("d", "c")).groupBy("graph_id", "node").agg(F.min("c").alias("c2"), F.min("d").alias("d2"))
            less = lambda x: F.coalesce(F.col(f"{x}2") < F.col(x), F.lit(False))
            new = state.join(told, ["graph_id", "node"], "left").select(
                "graph_id", "node", *[F.when(less(x), F.col(f"{x}2")).otherwise(F.col(x)).alias(x) for x in "cd"], (less("c") | less("d")).alias("moved")
            )
            before, state = state, cut(new)
            release(before)
        settled.append(cut(state.where("c = d").select("graph_id", "node", F.col("c.n").alias("root"))))
        open_ = state.where("c <> d").select("graph_id", "node", F.col("c.n").alias("c"), F.col("d.n").alias("d"))
        end = lambda name: open_.select("graph_id", F.col("node").alias(name), F.col("c").alias(f"c_{name}"), F.col("d").alias(f"d_{name}"))  # noqa: B023, E731
        rest = links.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"]).where("c_src = c_dst and d_src = d_dst").select("graph_id", "src", "dst")
        before, links = links, cut(rest)
        release(before, state)
    release(links)
    if not settled:
        return nodes.select("graph_id", "node", F.col("node").alias("component"))
    known = settled[0]
    for part in settled[1:]:
        known = known.unionByName(part)
    names = known.groupBy("graph_id", "root").agg(F.min("node").alias("component"))
    named = known.join(names, ["graph_id", "root"]).select("graph_id", "node", "component")
    return nodes.join(named, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("component", "node").alias("component"))


def strongly_connected_small(units: DataFrame, edges: DataFrame) -> DataFrame:
    """As :func:`strongly_connected`, each graph in one task: for corpora whose graphs are all known to be small."""
    return _per_graph(units, edges, "node string, component string", lambda n, e: [(x, p[0]) for p in strong_components(n, e) for x in p])


def condensation(units: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, components, reached) of the graphs with each strong component as one vertex.

    members: (graph_id, node, component). components: (graph_id, component, size, cyclic), cyclic if a vertex of it reaches
    itself. reached: (graph_id, a, b) of different components, b being reached from a; made by squaring, so the longest
    path takes rounds by its logarithm. Strong components come from one walk per weak component, as cycles do; vertices
    without edges are left out.
    """
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).dropDuplicates()
    walked = _per_part(units, edges, _minimum_labels(ends, edges), "node string, component string", lambda n, e: [(x, p[0]) for p in strong_components(n, e) for x in p])
    members = cut(walked.select(F.get_json_object("graph_id", "$.graph_id").alias("graph_id"), "node", "component"))
    own = lambda name: members.select("graph_id", F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
    links = cut(edges.join(own("src"), ["graph_id", "src"]).join(own("dst"), ["graph_id", "dst"]).select("graph_id", F.col("c_src").alias("a"), F.col("c_dst").alias("b")).dropDuplicates())
    loops = links.where("a = b").select("graph_id", F.col("a").alias("component"), F.lit(True).alias("loop"))
    components = members.groupBy("graph_id", "component").agg(F.count("*").alias("size")).join(loops, ["graph_id", "component"], "left")
    components = cut(components.select("graph_id", "component", "size", F.coalesce("loop", F.lit(False)).alias("cyclic")))
    reached = cut(links.where("a <> b"))
    grown = not reached.isEmpty()
    while grown:
        step = reached.withColumnRenamed("b", "m").join(reached.withColumnRenamed("a", "m"), ["graph_id", "m"]).select("graph_id", "a", "b")
        new = cut(reached.unionByName(step).dropDuplicates())
        grown = new.count() > reached.count()
        release(reached)
        reached = new
    release(links)
    return members, components, reached


def reachability(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst): dst is reached from src by one edge or more. The result has as many rows as there are such pairs."""
    edges = cut(edges)
    members, components, reached = condensation(cut(units.select("graph_id", "unit_id", *(["ord"] if "ord" in units.columns else []))), edges)
    pairs = reached.unionByName(components.where("cyclic").select("graph_id", F.col("component").alias("a"), F.col("component").alias("b")))
    own = lambda name, at: members.select("graph_id", F.col("component").alias(at), F.col("node").alias(name))
    return cut(pairs).join(own("src", "a"), ["graph_id", "a"]).join(own("dst", "b"), ["graph_id", "b"]).select("graph_id", "src", "dst")


def diagnostics(units: DataFrame, warrants: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per graph: counts of nodes, edges by kind, cycles, components, isolated and unsupported nodes, degrees.

    Averages of degrees are over units, though ends of edges that are no unit add to the totals.
    """
    units = cut(units.select("graph_id", "unit_id", *(["ord"] if "ord" in units.columns else []), "is_axiom"))
    relations = cut(relations.select("graph_id", "edge_idx", "src", "dst", "kind"))
    edges, support = project_edges(relations), project_edges(relations, ["support"])
    counts = units.groupBy("graph_id").agg(F.count("*").alias("node_count"), F.count_if(F.coalesce("is_axiom", F.lit(False))).alias("axiom_claims"))
    kinds = relations.groupBy("graph_id").agg(
        F.count("*").alias("relation_count"), F.count_if(F.col("kind") == "support").alias("support_edge_count"), F.count_if(F.col("kind").isin("attack", "undercut", "rebut")).alias("attack_edge_count")
    )
    d = degrees(units, edges).groupBy("graph_id").agg(
        F.sum("in_degree").alias("_in"), F.sum("out_degree").alias("_out"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"),
        F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated_units"),
    )
    s = degrees(units, support).groupBy("graph_id").agg(F.count_if(F.col("in_degree") == 0).alias("unsupported_claims"))
    w = warrants.groupBy("graph_id").agg(F.count_if(F.coalesce("is_axiom", F.lit(False))).alias("axiom_warrants"))
    # a vertex without edges is a component of both kinds, and reaches nothing
    shape = shapes(units, edges)
    out = counts.select("graph_id").unionByName(kinds.select("graph_id")).dropDuplicates()
    for part in (counts, kinds, d, s, w, shape):
        out = out.join(part, "graph_id", "left")
    alone = F.coalesce("isolated_units", F.lit(0))
    out = out.withColumns({"component_count": F.coalesce("components", F.lit(0)) + alone, "scc_count": F.coalesce("strong", F.lit(0)) + alone})
    zero = lambda x: F.coalesce(F.col(x), F.lit(0).cast("bigint")).alias(x)
    mean = lambda x: F.when(F.coalesce("node_count", F.lit(0)) > 0, F.coalesce(F.col(x), F.lit(0)) / F.col("node_count")).otherwise(0.0)
    plain = ("node_count", "relation_count", "attack_edge_count", "support_edge_count", "cycle_count", "component_count", "scc_count", "isolated_units", "unsupported_claims", "max_in", "max_out", "max_reachability", "axiom_claims", "axiom_warrants")
    return out.select("graph_id", *[zero(x) for x in plain], mean("_in").alias("avg_in"), mean("_out").alias("avg_out"))


def axiom_warnings(units: DataFrame, warrants: DataFrame) -> DataFrame:
    """(graph_id, kind, id, warning) of claims and warrants that are axioms."""
    say = lambda kind, key: F.format_string(f"axiom {kind} '%s' bypasses evidence requirements.", F.col(key))
    one = lambda df, kind, key: df.where("is_axiom").select("graph_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), say(kind, key).alias("warning"))
    return one(units, "claim", "unit_id").unionByName(one(warrants, "warrant", "warrant_id"))
