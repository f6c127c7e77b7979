"""Deeply nested JSON records as flat tables, by columnar shredding.

Each leaf path of a record becomes a column of values with two small integers per entry: the repetition
level (at which repeated ancestor the entry continues) and the definition level (how many optional or
repeated steps of the path are there). From these sequences alone the rows of every repeated ancestor are
rebuilt, each with the ordinals and keys of its parents. Both steps are narrow: nothing is shuffled.

A path is a dotted string. ``name`` is a field, ``name[]`` a list, ``name{}`` an object keyed by ids whose
keys are data. ``units{}.evidence[].id`` is the id of each element of each unit's list. ``name#json`` is a
whole value as JSON text with sorted keys, ``name.#rest`` what an object holds beside its other paths.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS_SCHEMA = "columns array<struct<path: string, r: array<tinyint>, d: array<tinyint>, v: array<string>>>"
KEY, JSON, REST = "#key", "#json", "#rest"


def _steps(path: str) -> list[tuple[str, str]]:
    out = []
    for part in path.split("."):
        kind = {"[]": "list", "{}": "map"}.get(part[-2:], "field")
        out.append((part[:-2] if kind != "field" else part, kind))
    return out


def definition_levels(path: str) -> list[int]:
    """Definition level reached after each step: 1 for a field, 3 for a repeated one (there, not empty, not null)."""
    total, out = 0, []
    for _, kind in _steps(path):
        total += 1 if kind == "field" else 3
        out.append(total)
    return out


def _scalar(value: object) -> str | None:
    """Text of a leaf; objects and arrays are no leaf value and read as null."""
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, (dict, list)):
        return None
    return json.dumps(value)


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _rest(value: object, node: dict) -> str | None:
    """What of the value no path below the node takes, as JSON: unknown fields, and values of another shape than their paths'."""
    if not isinstance(value, dict):
        return None if node["own_leaf"] and _scalar(value) is not None else _json(value)

    def fits(k: str, x: object) -> bool:
        for (name, kind), child in node["children"].items():
            if name == k and (x is None or (isinstance(x, list if kind == "list" else dict) if kind != "field" else child["json_leaf"] or (child["own_leaf"] and _scalar(x) is not None) or (child["children"] and isinstance(x, dict)))):
                return True
        return False

    rest = {k: x for k, x in value.items() if not fits(k, x)}
    return _json(rest) if rest else None


def shred_record(record: dict, tree: dict) -> dict[str, tuple[list[int], list[int], list[str | None]]]:
    """Levels and values of all leaves of ``tree`` (see ``_tree``) in one record."""
    out: dict[str, tuple[list[int], list[int], list[str | None]]] = {p: ([], [], []) for p in tree["leaves"]}

    def put(path: str, r: int, d: int, v: str | None) -> None:
        column = out[path]
        column[0].append(r)
        column[1].append(d)
        column[2].append(v)

    def missing(node: dict, r: int, d: int) -> None:
        for path in node["leaves"]:
            put(path, r, d, None)

    def walk(value: object, node: dict, r: int, d: int, depth: int, key: str | None) -> None:
        """value: what stands at the node, not null, with definition level d."""
        if node["key_leaf"]:
            put(node["key_leaf"], r, d, key)
        if node["own_leaf"]:
            text = _scalar(value)
            put(node["own_leaf"], r, d if text is not None else d - 1, text)
        if node["json_leaf"]:
            put(node["json_leaf"], r, d, _json(value))
        if node["rest_leaf"]:
            put(node["rest_leaf"], r, d, _rest(value, node))
        for (name, kind), child in node["children"].items():
            below = value.get(name) if isinstance(value, dict) else None
            if kind == "field":
                if below is None:
                    missing(child, r, d)
                else:
                    walk(below, child, r, d + 1, depth, None)
                continue
            if not isinstance(below, list if kind == "list" else dict):
                missing(child, r, d)
                continue
            if not below:
                missing(child, r, d + 1)
                continue
            items = ((None, x) for x in below) if kind == "list" else below.items()
            again = r
            for k, x in items:
                if x is None:
                    # an element that is null: its key is there, nothing below it
                    for path in child["leaves"]:
                        put(path, again, d + 2, k if path == child["key_leaf"] else None)
                else:
                    walk(x, child, again, d + 3, depth + 1, k)
                again = depth + 1

    walk(record, tree, 0, 0, 0, None)
    return out


def _tree(paths: Sequence[str]) -> dict:
    def node() -> dict:
        return {"children": {}, "own_leaf": None, "key_leaf": None, "json_leaf": None, "rest_leaf": None, "leaves": []}

    root = node()
    for path in paths:
        bare, _, tag = path.partition("#")
        at = root
        at["leaves"].append(path)
        for step in _steps(bare.removesuffix(".")) if bare else ():
            at = at["children"].setdefault(step, node())
            at["leaves"].append(path)
        at[f"{tag or 'own'}_leaf"] = path
    return root


def _strict(token: str) -> float:
    raise ValueError(f"{token} is not JSON")


def parse_object(text: str | None) -> dict | None:
    """The record if ``text`` is one complete JSON object, else null (also for arrays, null, cut-off text)."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_strict)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def shred(df: DataFrame, record: str, keep: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """One row per record that is a complete JSON object: the columns ``keep`` and ``columns`` with the levels.

    Null, empty, cut-off and non-object records give no row. Fields outside ``paths`` are not read.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", " + LEVELS_SCHEMA
    keep, paths = list(keep), list(paths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = _tree(paths)
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch["_record"]):
                value = parse_object(text)
                if value is not None:
                    at.append(i)
                    rows.append([{"path": p, "r": r, "d": d, "v": v} for p, (r, d, v) in shred_record(value, tree).items()])
            out = batch.iloc[at][keep].reset_index(drop=True)
            out["columns"] = pd.Series(rows, dtype=object)
            yield out

    return df.where(F.col(record).isNotNull() & (F.col(record) != "")).select(*keep, F.col(record).alias("_record")).mapInPandas(run, schema)


def _entries(path: str, column: dict, ancestor_depth: int) -> Iterator[tuple[tuple[int, ...], int, str | None]]:
    """(ordinals of the repeated ancestors down to ancestor_depth, definition level, value) of each entry."""
    ordinals = [-1] * ancestor_depth
    for r, d, v in zip(column["r"], column["d"], column["v"], strict=True):
        if r <= ancestor_depth:
            if r == 0:
                ordinals = [0] * ancestor_depth
            else:
                ordinals[r - 1] += 1
                for k in range(r, ancestor_depth):
                    ordinals[k] = 0
        yield tuple(ordinals), int(d), v


def assemble_rows(columns: dict[str, dict], ancestor: str) -> list[tuple[tuple[int, ...], list[str | None], dict[str, str | None], bool]]:
    """Rows of a repeated ancestor from the level sequences of one record.

    Each row: ordinals (one per repeated step, from 0, null elements included), the keys of the steps (null
    for lists), its leaf values by path, and whether the element is not null.
    """
    steps = _steps(ancestor)
    repeated = [i for i, (_, kind) in enumerate(steps) if kind != "field"]
    depth = len(repeated)
    present = definition_levels(ancestor)[-1]
    prefix = lambda i: ".".join(ancestor.split(".")[: i + 1])
    rows: dict[tuple[int, ...], list] = {}
    parents: list[dict[tuple[int, ...], str | None]] = []
    for level, i in enumerate(repeated, 1):
        column = columns.get(prefix(i) + KEY)
        parents.append({o[:level]: v for o, _, v in _entries(prefix(i) + KEY, column, level)} if column else {})
    for path, column in columns.items():
        own = path == ancestor or path.startswith(ancestor + ".") or path == ancestor + KEY
        # leaves with a repetition of their own below the ancestor belong to that deeper table
        if not own or any(k != "field" for _, k in _steps(path.removesuffix(KEY))[len(steps) :]):
            continue
        for o, d, v in _entries(path, column, depth):
            if d < present - 1:
                continue  # the list is absent, null or empty
            row = rows.setdefault(o, [[p.get(o[: k + 1]) for k, p in enumerate(parents)], {}, False])
            row[1][path] = v
            row[2] = row[2] or d >= present
    return [(o, keys, fields, there) for o, (keys, fields, there) in rows.items()]


LONG_FORM = "ancestor string, ordinals array<int>, keys array<string>, present boolean, fields map<string, string>"


def _long_form(batch: pd.DataFrame, keep: list[str], records: Iterator[tuple[int, dict[str, dict]]], ancestors: list[str]) -> pd.DataFrame:
    at, rows = [], []
    for i, columns in records:
        for a in ancestors:
            for o, keys, fields, there in assemble_rows(columns, a):
                at.append(i)
                rows.append((a, list(o), keys, there, fields))
    out = batch.iloc[at][keep].reset_index(drop=True)
    for k, name in enumerate(("ancestor", "ordinals", "keys", "present", "fields")):
        out[name] = pd.Series([r[k] for r in rows], dtype=object)
    return out


def _kept(df: DataFrame, keep: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)


def assemble(levels: DataFrame, keep: Sequence[str], ancestors: Sequence[str]) -> DataFrame:
    """Flat tables of the repeated ``ancestors`` in one long form, from the output of :func:`shred`.

    Columns: ``keep``, ancestor, ordinals array<int>, keys array<string> (a key per repeated step, null for
    lists), present (false for a null element), fields map<string, string> (leaf path to value).
    Each child row names its parent: the parent's ordinals and keys are those without the last.
    """
    keep, ancestors = list(keep), list(ancestors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _long_form(batch, keep, ((i, {c["path"]: c for c in packed}) for i, packed in enumerate(batch["columns"])), ancestors)

    return levels.mapInPandas(run, f"{_kept(levels, keep)}, {LONG_FORM}")


def shred_and_assemble(df: DataFrame, record: str, keep: Sequence[str], paths: Sequence[str], ancestors: Sequence[str]) -> DataFrame:
    """:func:`shred` and :func:`assemble` in one pass: the levels of a record go from one to the other without leaving Python."""
    keep, paths, ancestors = list(keep), list(paths), list(ancestors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = _tree(paths)

        def columns(texts: pd.Series) -> Iterator[tuple[int, dict[str, dict]]]:
            for i, text in enumerate(texts):
                if (value := parse_object(text)) is not None:
                    yield i, {p: {"r": r, "d": d, "v": v} for p, (r, d, v) in shred_record(value, tree).items()}

        for batch in batches:
            yield _long_form(batch, keep, columns(batch["_record"]), ancestors)

    rows = df.where(F.col(record).isNotNull() & (F.col(record) != "")).select(*keep, F.col(record).alias("_record"))
    return rows.mapInPandas(run, f"{_kept(df, keep)}, {LONG_FORM}")


# ---- the graph payloads

_SOURCE_NAMES = ("doc_id", "evidence_card_id", "dataset.name")
UNIT, EVIDENCE, BUNDLE, BUNDLE_RELATION = "units{}", "units{}.evidence[]", "argument_bundles{}", "argument_bundles{}.relations[]"
PAYLOAD_PATHS = (
    *(UNIT + x for x in (KEY, ".text", ".type")),
    *(f"{EVIDENCE}.{x}" for x in ("id", "stance", "strength")),
    *(f"{EVIDENCE}.source.{x}" for x in ("start", "end", "text")),
    *(f"{EVIDENCE}.source{tag}.{x}" for tag in (".value", "") for x in _SOURCE_NAMES),
    BUNDLE + KEY,
    *(f"{BUNDLE_RELATION}.{x}" for x in ("src", "dst", "kind", "weight")),
)


def payload_tables(payloads: DataFrame) -> DataFrame:
    """The flat tables of graph payloads (units, their evidence, bundles, their relations) in long form."""
    return shred_and_assemble(payloads, "payload", ["payload_id"], PAYLOAD_PATHS, [UNIT, EVIDENCE, BUNDLE, BUNDLE_RELATION])


_SPAN = ("doc_id", "start:bigint", "end:bigint", "text", "page:bigint", "bbox#json", "modality")
_NODE = ("id", "text", "type", "score:double", "is_axiom:boolean", "ignore_influence:boolean", "metadata#json")
_RELATION = ("src", "dst", "kind", "gate_mode", "weight:double", "rationale", "metadata#json")
_SOURCE = (*_SPAN, "evidence_card_id", "dataset.name", "dataset.rows#json", "note")
#: Flat tables of a payload: the repeated steps whose elements are their rows, and the fields of these, with a type or as JSON.
TABLES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "units": (("units{}",), (*_NODE, "evidence_min:double", "evidence_max:double")),
    "warrants": (("warrants{}",), _NODE),
    "evidence": (("units{}.evidence[]", "warrants{}.evidence[]"), ("id", "stance", "strength:double", "quality#json", "source#json", "source.type", *(f"source.{v}{x}" for x in _SOURCE for v in ("value.", "")))),
    "spans": (("units{}.spans[]", "warrants{}.spans[]"), _SPAN),
    "relations": (("relations[]", "argument_bundles{}.relations[]"), _RELATION),
    "warrant_attacks": (("warrant_attacks[]",), ("src", "warrant_id", "kind", "rationale", "metadata#json")),
    "bundles": (("argument_bundles{}",), ("id", "metadata#json")),
    "cards": (("evidence_cards{}",), ("id", "title", "supporting_doc_id", "excerpt", "confidence:double", "metadata#json")),
    "documents": (("supporting_documents{}",), ("id", "name", "type", "url", "trust:double", "size:double", "upload_date", "uploader", "metadata#json")),
    "lists": (("units{}.evidence_ids[]", "warrants{}.evidence_ids[]", "argument_bundles{}.units[]", "relations[].warrant_ids[]", "argument_bundles{}.relations[].warrant_ids[]"), ("",)),
}


def _below(ancestor: str, field: str) -> str:
    return f"{ancestor}.{field}" if field else ancestor


def _table_paths(tables: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], name: str | None = None) -> list[str]:
    """Paths of all tables and of what the record holds beside them; with a name, of that table and of those inside its elements."""
    out = [] if name else ["#rest"]
    if name:
        inside = lambda a: a.startswith(tables[name][0])
        # the keys of the objects above, which name the parents
        out = [above + KEY for above in sorted({a.rpartition("{}.")[0] + "{}" for a in tables[name][0] if "{}." in a})]
        tables = {n: (tuple(filter(inside, ancestors)), fields) for n, (ancestors, fields) in tables.items()}
    for ancestors, fields in tables.values():
        for a in ancestors:
            out += [*([a + KEY] if a.endswith("{}") else []), *(_below(a, x.partition(":")[0]) for x in fields), f"{a}.{REST}"]
    return out


def flat_table(long_form: DataFrame, keep: Sequence[str], ancestors: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """From the long form, one row per element that is not null: ``keep``, place, key, parent_pos, pos, the fields, rest.

    place is the element's repeated path and key the key of the object above (or of the element itself, in an object by
    ids). pos is the position in its list, null elements included, and parent_pos that of the list's owner, if it stands in
    a list too. A source's fields are those of its ``value``, else its own. rest is JSON of what no other column holds.
    """
    t = long_form.where("present")
    own = lambda x: F.coalesce(*[F.try_element_at("fields", F.lit(_below(a, x))) for a in ancestors])
    columns: dict[str, list[Column]] = {}
    for x in fields:
        path, _, kind = x.partition(":")
        name = path.partition("#")[0].replace("source.value.", "source.").replace(".", "_") or "value"
        columns.setdefault(name, []).append(own(path).try_cast(kind) if kind else own(path))
    at_list = lambda k: F.when(F.get(F.split("ancestor", r"\."), F.size(F.split("ancestor", r"\.")) + k).endswith("[]"), F.try_element_at("ordinals", F.lit(k)))
    return t.select(
        *keep, F.col("ancestor").alias("place"), F.get("keys", F.lit(0)).alias("key"), at_list(-2).alias("parent_pos"), at_list(-1).alias("pos"),
        *[F.coalesce(*c).alias(n) for n, c in columns.items()], own(REST).alias("rest"),
    ).dropDuplicates()


def payload_table(payloads: DataFrame, name: str) -> DataFrame:
    """One of ``TABLES`` of the graph payloads. Repeated deliveries of a payload come out once."""
    return flat_table(shred_and_assemble(payloads, "payload", ["payload_id"], _table_paths(TABLES, name), TABLES[name][0]), ["payload_id"], *TABLES[name])


def payload_rest(payloads: DataFrame) -> DataFrame:
    """(payload_id, rest): JSON of what a payload holds beside its ``TABLES``, as its metadata; null if nothing."""
    levels = shred(payloads, "payload", ["payload_id"], _table_paths(TABLES))
    rest = F.get(F.filter("columns", lambda c: c["path"] == REST), F.lit(0))["v"]
    return levels.select("payload_id", F.get(rest, F.lit(0)).alias("rest")).dropDuplicates()


#: Flat tables of the array columns of units and warrants.
_TABLE_SOURCE = ("source.kind", *(f"source.span.{x}" for x in _SPAN), "source.structured")
ARRAYS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "evidence": (("evidence[]",), ("id", "stance", "strength:double", "quality", *_TABLE_SOURCE)),
    "spans": (("spans[]",), _SPAN),
    "evidence_ids": (("evidence_ids[]",), ("",)),
}


def array_table(nodes: dict[str, tuple[DataFrame, str]], name: str) -> DataFrame:
    """One of ``ARRAYS``: (table_name, graph_id, owner_key, pos, fields) of tables given with their key columns.

    The last delivery of each key counts, deleted or not.
    """
    keep = ["table_name", "graph_id", "owner_key"]
    parts = [df.select(F.lit(t).alias("table_name"), "graph_id", F.col(k).alias("owner_key"), F.struct("evidence", "spans", "evidence_ids").alias("x"), "loaded_at") for t, (df, k) in nodes.items()]
    rows = functools.reduce(DataFrame.unionByName, parts).withColumn("record", F.to_json("x", {"ignoreNullFields": "false"}))
    rows = rows.groupBy(*keep).agg(F.max_by("record", F.struct("loaded_at", "record")).alias("record"))
    return flat_table(shred_and_assemble(rows, "record", keep, _table_paths(ARRAYS, name), ARRAYS[name][0]), keep, *ARRAYS[name]).drop("place", "key", "parent_pos", "rest")


def payload_links(payloads: DataFrame) -> DataFrame:
    """Each parent-child link of a payload once: (payload_id, link, parent_key, child_key).

    Null elements, null sources, and evidence without an id give no row; a missing end of a bundle's
    relation reads as ''. Repeated deliveries of a payload come out once.
    """
    t = payload_tables(payloads).where("present")
    f = lambda path: F.try_element_at("fields", F.lit(path))
    pos = F.element_at("ordinals", -1).cast("string")
    first = F.get("keys", F.lit(0))
    target = F.coalesce(*[f(f"{EVIDENCE}.source{tag}.{x}") for x in _SOURCE_NAMES for tag in (".value", "")])
    link = lambda name, parent, child: F.struct(F.lit(name).alias("link"), parent.alias("parent_key"), child.alias("child_key"))
    is_a = lambda a: F.col("ancestor") == a
    links = F.array(
        F.when(is_a(UNIT), link("graph_unit", F.lit(""), first)),
        F.when(is_a(EVIDENCE), link("unit_evidence", first, F.concat(pos, F.lit(":"), f(EVIDENCE + ".id")))),
        F.when(is_a(EVIDENCE), link("evidence_source", F.concat(first, F.lit("#"), pos), target)),
        F.when(is_a(BUNDLE), link("graph_bundle", F.lit(""), first)),
        F.when(
            is_a(BUNDLE_RELATION),
            link("bundle_relation", first, F.concat(pos, F.lit(":"), F.coalesce(f(BUNDLE_RELATION + ".src"), F.lit("")), F.lit(">"), F.coalesce(f(BUNDLE_RELATION + ".dst"), F.lit("")))),
        ),
    )
    out = t.select("payload_id", F.explode(links).alias("x")).where("x is not null and x.child_key is not null and x.parent_key is not null")
    return out.select("payload_id", "x.link", "x.parent_key", "x.child_key").dropDuplicates()
