"""Schemas that drift between the files of a stream.

The schema of a file is the set of its paths with their JSON types, found by one pass over the records and written down
(paths are collected per batch, so what is shuffled grows with the number of files, not of records). A file's schema has
a fingerprint, and a stream's files a version that goes up where the fingerprint changes. Only where it does are schemas
compared; each difference is a migration step: rename, cast (a type that changes), drop or default (a field that is
added has none before). The steps are the reported changes, and records are routed through them: renames of their stream
are followed back to the first name of a path, values are cast to the type the path has in most files of all streams, and
fields that a record lacks get null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.session import cut

_ID_KEY = re.compile(r"[a-z][0-9]+")


def _join(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def json_type(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def _walk(path: str, value: object, out: set[tuple[str, str]]) -> None:
    if value is None:
        if path:
            out.add((path, "null"))
        return
    if path:
        out.add((path, json_type(value)))
    if isinstance(value, dict):
        for k, v in value.items():
            _walk(_join(path, "*" if _ID_KEY.fullmatch(k) else k), v, out)
    elif isinstance(value, list):
        for v in value:
            _walk(path + "[]", v, out)


def _renamed_back(path: str, file_no: int, steps: list[dict]) -> str:
    """As ``apply_step`` of migration_names; steps come newest first."""
    for x in steps:
        new = x["new_path"]
        if x["file_no"] <= file_no and (path == new or path.startswith((new + ".", new + "[]"))):
            path = x["old_path"] + path[len(new) :]
    return path


def _values(record: dict, canonical: Callable[[str], str], fields: dict[str, list[str]], expected: list[str]) -> list[tuple[str, str | None, str, str, str | None]]:
    """(place with ids and positions, path, canonical, type, text) of each scalar, null and empty container, and of what is missing.

    fields: names that objects of a canonical path have anywhere. An object without one of them gives a row of type
    missing at its place; an expected path that the whole record lacks gives one at the path itself.
    """
    out: list[tuple[str, str | None, str, str, str | None]] = []
    seen: set[str] = set()

    def walk(path: str, place: str, value: object) -> None:
        name = canonical(path) if path else ""
        seen.add(name)
        if value is None:
            out.append((place, path, name, "null", None))
        elif isinstance(value, dict):
            if path and not value:
                out.append((place, path, name, "object", "{}"))
            there = set()
            for k, v in value.items():
                below = _join(path, "*" if _ID_KEY.fullmatch(k) else k)
                there.add(canonical(below))
                walk(below, _join(place, k), v)
            for k in fields.get(name, ()):
                if (lost := _join(name, k)) not in there:
                    seen.add(lost)
                    out.append((_join(place, k), None, lost, "missing", None))
        elif isinstance(value, list):
            if not value:
                out.append((place, path, name, "array", "[]"))
            for i, v in enumerate(value):
                walk(path + "[]", f"{place}[{i}]", v)
        else:
            out.append((place, path, name, json_type(value), value if isinstance(value, str) else json.dumps(value)))

    walk("", "", record)
    return out + [(c, None, c, "missing", None) for c in expected if c not in seen]


def file_paths(exports: DataFrame, nulls: bool = False) -> DataFrame:
    """Paths of each file: (stream_name, file_no, path, types), types sorted and joined by '|'.

    With ``nulls``, paths of which all values are null are there too, with types ''. A file without a readable record has no row here. Repeated lines change nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple, set[tuple[str, str]]] = {}
            for stream, file_no, record in zip(batch["stream_name"], batch["file_no"], batch["record"], strict=True):
                try:
                    value = json.loads(record)
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, dict):
                    _walk("", value, seen.setdefault((stream, file_no), set()))
            yield pd.DataFrame([(s, int(n), p, t) for (s, n), found in seen.items() for p, t in found], columns=["stream_name", "file_no", "path", "type"])

    rows = exports.where("record is not null and stream_name is not null and file_no is not null").select("stream_name", F.col("file_no").cast("int").alias("file_no"), "record")
    found = rows.mapInPandas(run, "stream_name string, file_no int, path string, type string")
    # at most five types stand in one set
    found = found.withColumn("type", F.when(F.col("type") != "null", F.col("type")))
    found = found if nulls else found.where("type is not null")
    return found.groupBy("stream_name", "file_no", "path").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"))


def versions_of(paths: DataFrame) -> DataFrame:
    """(stream_name, file_no, fingerprint, paths, version) from :func:`file_paths`; see :func:`schema_versions`."""
    # a hash per path, summed without regard to order; the sum wraps at 2^61 so that it cannot overflow
    h = F.pmod(F.xxhash64("path", "types"), F.lit(2**61)).cast("decimal(38,0)")
    files = paths.where("types <> ''").groupBy("stream_name", "file_no").agg(F.pmod(F.sum(h), F.lit(2**61).cast("decimal(38,0)")).cast("long").alias("fingerprint"), F.count("*").alias("paths"))
    w = Window.partitionBy("stream_name").orderBy("file_no")
    changed = F.when(F.lag("fingerprint").over(w).eqNullSafe(F.col("fingerprint")), 0).otherwise(1)
    return files.withColumn("_c", changed).withColumn("version", F.sum("_c").over(w).cast("int")).drop("_c")


def schema_versions(exports: DataFrame) -> DataFrame:
    """Fingerprint of each file's schema and its version: (stream_name, file_no, fingerprint, paths, version).

    The version counts the changes of fingerprint along the files of a stream, from 1.
    """
    return versions_of(file_paths(exports))


def _parent(path: Column) -> Column:
    """The path without its last field name; '' at the top."""
    return F.regexp_replace(path, r"(^|\.)[^.]*$", "")


def migration_steps(paths: DataFrame) -> DataFrame:
    """Steps from each version of a stream's schema to the next: (stream_name, file_no, from_version, to_version, change_kind, old_path, new_path).

    file_no is the file that brings the step. A file whose fingerprint is that of the file before takes none and its paths
    are not looked at; one whose predecessor is not there (the first of a stream, or after a gap) has nothing to be held
    against. type_changed is a cast, renamed a rename, removed a drop, added a default for all before it.
    """
    paths = paths.where("types <> ''")
    versions = cut(versions_of(paths))
    last = versions.select("stream_name", (F.col("file_no") + 1).alias("file_no"), F.col("fingerprint").alias("_f"), F.col("version").alias("from_version"))
    moved = cut(versions.join(last, ["stream_name", "file_no"]).where("fingerprint <> _f").select("stream_name", "file_no", "from_version", F.col("version").alias("to_version")))
    both = moved.select("stream_name", "file_no")
    now = paths.join(both, ["stream_name", "file_no"], "left_semi").withColumn("new_types", F.col("types")).drop("types")
    before = paths.select("stream_name", (F.col("file_no") + 1).alias("file_no"), "path", F.col("types").alias("old_types")).join(both, ["stream_name", "file_no"], "left_semi")
    diff = now.join(before, ["stream_name", "file_no", "path"], "full").where("not (new_types <=> old_types)")
    # few paths of a file differ, so a file's differences fit in one array
    one = F.struct("path", "old_types", "new_types")
    per_file = diff.groupBy("stream_name", "file_no").agg(F.collect_list(one).alias("d"))
    inside = lambda p, q: p.startswith(F.concat(q, F.lit("."))) | p.startswith(F.concat(q, F.lit("[]")))
    top = F.filter("d", lambda x: ~F.exists("d", lambda y: inside(x["path"], y["path"])))
    named = F.filter("_top", lambda x: ~x["path"].rlike(r"(\[\]|(^|\.)\*)$"))
    out = per_file.withColumn("_top", top).withColumn("_n", named)
    out = out.select("stream_name", "file_no", F.explode("_n").alias("x")).select("stream_name", "file_no", "x.*").withColumn("parent", _parent(F.col("path")))
    gone, came = F.col("new_types").isNull(), F.col("old_types").isNull()
    groups = out.groupBy("stream_name", "file_no", "parent").agg(
        F.collect_list(F.when(gone, F.struct("path", F.col("old_types").alias("types")))).alias("gone"),
        F.collect_list(F.when(came, F.struct("path", F.col("new_types").alias("types")))).alias("came"),
        F.collect_list(F.when(~gone & ~came, F.col("path"))).alias("other"),
    )
    change = lambda kind, old, new: F.struct(F.lit(kind).alias("change_kind"), old.alias("old_path"), new.alias("new_path"))
    g0, c0 = F.get("gone", F.lit(0)), F.get("came", F.lit(0))
    renamed = (F.size("gone") == 1) & (F.size("came") == 1) & (g0["types"] == c0["types"])
    plain = F.concat(
        F.transform("gone", lambda x: change("removed", x["path"], F.lit(""))),
        F.transform("came", lambda x: change("added", F.lit(""), x["path"])),
    )
    changes = F.concat(
        F.transform("other", lambda p: change("type_changed", p, p)),
        F.when(renamed, F.array(change("renamed", g0["path"], c0["path"]))).otherwise(plain),
    )
    steps = groups.select("stream_name", "file_no", F.explode(changes).alias("c")).select("stream_name", "file_no", "c.*")
    return steps.join(moved, ["stream_name", "file_no"]).select("stream_name", "file_no", "from_version", "to_version", "change_kind", "old_path", "new_path")


def schema_changes(exports: DataFrame) -> DataFrame:
    """Changes of each file against the file before: (stream_name, file_no, change_kind, old_path, new_path), the steps of its migration.

    type_changed, renamed (under one parent exactly one path vanishes and exactly one appears, with equal
    types), removed or added. Paths below a changed path are not reported, nor paths ending in [] or *.
    """
    return migration_steps(cut(file_paths(exports))).select("stream_name", "file_no", "change_kind", "old_path", "new_path")


def _rename_steps(paths: DataFrame) -> DataFrame:
    """(stream_name, steps), the newest first."""
    renames = migration_steps(paths).where("change_kind = 'renamed'")
    return renames.groupBy("stream_name").agg(F.reverse(F.array_sort(F.collect_list(F.struct("file_no", "new_path", "old_path")))).alias("steps"))


def migration_names(paths: DataFrame, renames: DataFrame) -> DataFrame:
    """First name of every path of every file after its stream's renames: (stream_name, file_no, path, types, canonical).

    Renames are chained backwards from the newest file to the oldest inside one group per stream, whose size
    is that of its list of renames (not of its records).
    """
    named = paths.join(renames, "stream_name", "left")
    # a step renames the path itself and everything below it
    apply_step = lambda acc, s: F.when(
        (acc == s["new_path"]) | acc.startswith(F.concat(s["new_path"], F.lit("."))) | acc.startswith(F.concat(s["new_path"], F.lit("[]"))),
        F.concat(s["old_path"], F.substr(acc, F.length(s["new_path"]) + 1)),
    ).otherwise(acc)
    own = F.filter(F.coalesce("steps", F.array().cast("array<struct<file_no:int,new_path:string,old_path:string>>")), lambda s: s["file_no"] <= F.col("file_no"))
    return named.withColumn("canonical", F.aggregate(own, F.col("path"), apply_step)).select("stream_name", "file_no", "path", "types", "canonical")


@dataclass(frozen=True)
class Target:
    """What all records are brought to: the type of each canonical path, the names of the fields of each object, and the renames of each stream."""

    types: dict[str, str | None]
    fields: dict[str, list[str]]
    renames: DataFrame | None


def target_schema(exports: DataFrame) -> Target:
    """The type a canonical path has in most files of all streams (ties: scalars before containers, then the first by name; None if there are only nulls).

    What comes to the driver are the distinct canonical paths, not files or records.
    """
    paths = cut(file_paths(exports, nulls=True))
    renames = cut(_rename_steps(paths))
    typed = migration_names(paths, renames).select("stream_name", "file_no", "canonical", F.explode(F.split("types", r"\|")).alias("type"))
    votes = typed.groupBy("canonical", "type").agg(F.countDistinct("stream_name", "file_no").alias("n"))
    order = F.struct((F.col("type") == "").alias("none"), (-F.col("n")).alias("m"), F.col("type").isin("array", "object").alias("container"), "type")
    target = votes.groupBy("canonical").agg(F.nullif(F.min(order)["type"], F.lit("")).alias("target_type"))
    types = {r["canonical"]: r["target_type"] for r in target.orderBy("canonical").collect()}
    fields: dict[str, list[str]] = {}
    for c in types:
        above, _, name = c.rpartition(".")
        if name != "*" and not name.endswith("[]"):
            fields.setdefault(above, []).append(name)
    return Target(types, fields, renames)


def _lines(exports: DataFrame, renames: DataFrame) -> DataFrame:
    """Each line once, with its stream's renames."""
    lines = exports.where("record is not null and stream_name is not null and file_no is not null and line_no is not null")
    lines = lines.groupBy("stream_name", "file_no", "line_no").agg(F.min_by("record", "loaded_at").alias("record"))
    lines = lines.select("stream_name", F.col("file_no").cast("int").alias("file_no"), F.col("line_no").cast("int").alias("line_no"), "record")
    return lines.join(renames, "stream_name", "left")


def _names(known: dict[str, str], file_no: int, steps: list[dict] | None) -> Callable[[str], str]:
    def canonical(path: str) -> str:
        if path not in known:
            known[path] = _renamed_back(path, file_no, [] if steps is None else steps)
        return known[path]

    return canonical


def _object(record: str) -> dict | None:
    try:
        value = json.loads(record)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _cast(value: object, to: str | None) -> object:
    """A scalar as the target type; ValueError if it has no such form. One value of a list is that list."""
    if to is None or json_type(value) == to:
        return value
    if to == "string":
        return json.dumps(value)
    if to == "number" and not isinstance(value, bool):
        number = float(str(value))
        if number != number or number in (float("inf"), float("-inf")):
            raise ValueError(value)
        return int(number) if number.is_integer() and str(value).lstrip("+-").isdigit() else number
    if to == "boolean" and str(value).strip().lower() in ("true", "false"):
        return str(value).strip().lower() == "true"
    if to == "array":
        return [value]
    raise ValueError(value)


def _migrated(record: dict, canonical: Callable[[str], str], target: Target) -> tuple[dict, dict, dict[str, int]]:
    """(record in the target schema, what could not be cast by its place, numbers of renames, defaults and casts)."""
    lost: dict[str, object] = {}
    did = {"renamed": 0, "defaulted": 0, "cast": 0}

    def go(path: str, place: str, value: object) -> object:
        name = canonical(path) if path else ""
        to = target.types.get(name) if path else "object"
        if value is None:
            return None
        if isinstance(value, dict):
            if to not in (None, "object"):
                lost[place] = value
                return None
            out: dict[str, object] = {}
            for k, v in value.items():
                by_id = bool(_ID_KEY.fullmatch(k))
                below = _join(path, "*" if by_id else k)
                new = k if by_id else canonical(below).rpartition(".")[2]
                did["renamed"] += new != k
                out[new] = go(below, _join(place, k), v)
            for k in target.fields.get(name, ()):
                if k not in out:
                    out[k] = None
                    did["defaulted"] += 1
            return out
        if isinstance(value, list):
            if to not in (None, "array"):
                lost[place] = value
                return None
            return [go(path + "[]", f"{place}[{i}]", v) for i, v in enumerate(value)]
        try:
            new_value = _cast(value, to)
        except ValueError:
            lost[place] = value
            return None
        did["cast"] += json_type(new_value) != json_type(value)
        return new_value

    return go("", "", record), lost, did


def consistent_records(exports: DataFrame) -> DataFrame:
    """All records in one table of one schema: (stream_name, file_no, line_no, record, rejected, renamed, defaulted, casts).

    record is JSON with sorted keys: fields bear their first name in the stream, values have the target type, and every
    object has all fields that its canonical path has anywhere, null where it lacks them. A value without a form in the
    target type is null there and stands, by its place, in rejected (JSON, null if there is none). The numbers count what
    was renamed, defaulted and cast. Lines delivered twice come out once; lines that are no JSON object are left out.
    """
    target = target_schema(exports)
    bare = Target(target.types, target.fields, None)  # the table itself does not go to the workers
    columns = ["stream_name", "file_no", "line_no", "record", "rejected", "renamed", "defaulted", "casts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[tuple[str, int], dict[str, str]] = {}
        for batch in batches:
            rows = []
            for stream, file_no, line_no, text, steps in batch[["stream_name", "file_no", "line_no", "record", "steps"]].itertuples(index=False):
                if (value := _object(text)) is not None:
                    out, lost, did = _migrated(value, _names(names.setdefault((stream, file_no), {}), file_no, steps), bare)
                    rows.append((stream, file_no, line_no, json.dumps(out, ensure_ascii=False, sort_keys=True), json.dumps(lost, ensure_ascii=False, sort_keys=True) if lost else None, did["renamed"], did["defaulted"], did["cast"]))
            yield pd.DataFrame(rows, columns=columns)

    return _lines(exports, target.renames).mapInPandas(run, "stream_name string, file_no int, line_no int, record string, rejected string, renamed int, defaulted int, casts int")


def consistent_table(exports: DataFrame) -> DataFrame:
    """The same as a list of values under their canonical paths, with a row for every canonical path of every record.

    Columns: stream_name, file_no, line_no, place (path with ids and positions), path (as found; null if missing),
    canonical, found_type, target_type, value (text), number, flag, cast_ok. number and flag are set where the target is
    number or boolean. A value that cannot be cast keeps its text and has cast_ok false. Nulls, and fields that an object
    or record lacks (found_type missing), have a null value; empty containers are kept as [] and {}. Lines delivered twice
    come out once.
    """
    target = target_schema(exports)
    targets, fields = target.types, target.fields
    columns = ["stream_name", "file_no", "line_no", "place", "path", "canonical", "found_type", "value", "target_type"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths = list(targets)
        names: dict[tuple[str, int], dict[str, str]] = {}
        for batch in batches:
            rows = []
            for stream, file_no, line_no, record, steps in batch[["stream_name", "file_no", "line_no", "record", "steps"]].itertuples(index=False):
                if (value := _object(record)) is None:
                    continue
                canonical = _names(names.setdefault((stream, file_no), {}), file_no, steps)
                rows += [(stream, file_no, line_no, *x, targets.get(x[2])) for x in _values(value, canonical, fields, paths)]
                # a record gives many rows
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    lines = _lines(exports, target.renames)
    out = lines.mapInPandas(run, "stream_name string, file_no int, line_no int, place string, path string, canonical string, found_type string, value string, target_type string")
    number = F.when(F.col("target_type") == "number", F.col("value").try_cast("double"))
    flag = F.when(F.col("target_type") == "boolean", F.col("value").try_cast("boolean"))
    out = out.withColumn("number", number).withColumn("flag", flag)
    kind, to = F.col("found_type"), F.col("target_type")
    ok = (
        F.when(kind.isin("null", "missing"), True).when(kind.isin("array", "object") | to.isin("array", "object"), kind.eqNullSafe(to))
        .when(to == "number", F.col("number").isNotNull()).when(to == "boolean", F.col("flag").isNotNull()).otherwise(True)
    )
    return out.withColumn("cast_ok", ok).select("stream_name", "file_no", "line_no", "place", "path", "canonical", "found_type", "target_type", "value", "number", "flag", "cast_ok")


def consistent_values(exports: DataFrame) -> DataFrame:
    """The scalars of :func:`consistent_table` alone."""
    return consistent_table(exports).where("found_type in ('string', 'number', 'boolean')")
