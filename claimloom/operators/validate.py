"""Checks of raw graph payloads against the rules of the data model.

Rules are kept as tables: what each collection must be, and per kind of entry its required fields, the
types of its fields and the keys it refers to. One narrow pass applies them to every payload.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_list = lambda v: isinstance(v, list)
_object = lambda v: isinstance(v, dict)
_number = lambda v: v is None or isinstance(v, (int, float))
_boolean = lambda v: isinstance(v, bool)
_TYPE = {"a list": _list, "an object": _object, "a number": _number, "a boolean": _boolean}


@dataclass(frozen=True)
class Entry:
    """Rules for the entries of a keyed collection."""

    collection: str
    label: str
    required: tuple[str, ...]
    types: tuple[tuple[str, str], ...]
    #: (field, collection it names, message after the label, only where that collection is not empty)
    names: tuple[tuple[str, str, str], ...] = ()


# The collections with their types, and the rules in the order in which they report.
_COLLECTIONS = (
    ("units", dict, True, "units must be a dictionary of id -> unit."),
    ("relations", list, True, "relations must be a list."),
    ("metadata", dict, False, "metadata must be an object when provided."),
    ("evidence_cards", dict, False, "evidence_cards must be an object when provided."),
    ("supporting_documents", dict, False, "supporting_documents must be an object when provided."),
    ("argument_bundles", dict, False, "argument_bundles must be an object when provided."),
    ("warrants", dict, False, "warrants must be an object when provided."),
    ("warrant_attacks", list, False, "warrant_attacks must be a list when provided."),
)
_ENTRIES = (
    Entry(
        "units", "unit", ("id", "text"),
        (("spans", "a list"), ("evidence", "a list"), ("evidence_ids", "a list"), ("evidence_min", "a number"), ("evidence_max", "a number"), ("score", "a number"),
         ("is_axiom", "a boolean"), ("ignore_influence", "a boolean"), ("metadata", "an object")),
        (("evidence_ids", "evidence_cards", "evidence_id '{}' is not a known evidence card."),),
    ),
    Entry("evidence_cards", "evidence_card", ("id", "title"), ()),
    Entry("supporting_documents", "supporting_document", ("id", "name"), (("trust", "a number"),)),
    Entry(
        "warrants", "warrant", ("id", "text"), (("evidence_ids", "a list"), ("score", "a number"), ("is_axiom", "a boolean"), ("ignore_influence", "a boolean")),
        (("evidence_ids", "evidence_cards", "evidence_id '{}' is not a known evidence card."),),
    ),
    Entry("argument_bundles", "argument_bundle", (), (("units", "a list"),), (("units", "units", "references unknown unit '{}'."),)),
)


def _known(value: object, table: dict) -> bool:
    try:
        return value in table
    except TypeError:  # a list or an object is no key
        return False


def _members(value: object) -> list:
    return value if isinstance(value, list) else []


def _check_entry(rule: Entry, key: str, entry: object, tables: dict, say: Callable[[str], None]) -> None:
    head = f"{rule.label} '{key}'"
    if not isinstance(entry, dict):
        say(f"{head} must be an object.")
        return
    if any(f not in entry for f in rule.required):
        say(f"{head} must include {' and '.join(repr(f) for f in rule.required)}.")
    if entry.get("id") != key:
        say(f"{head} id field does not match its key.")
    for field, kind in rule.types:
        if field in entry and not _TYPE[kind](entry[field]):
            say(f"{head} {field} must be {kind}.")
    for field, target, message in rule.names:
        for name in _members(entry.get(field)):
            if tables[target] and not _known(name, tables[target]):
                say(f"{head} {message.format(name)}")
    if rule.collection == "evidence_cards" and (ref := entry.get("supporting_doc_id")) and not _known(ref, tables["supporting_documents"]):
        say(f"{head} references unknown supporting_doc_id.")


def _check_relation(i: int, entry: object, tables: dict, say: Callable[[str], None]) -> None:
    head = f"relation[{i}]"
    if not isinstance(entry, dict):
        say(f"{head} must be an object.")
        return
    for field in ("src", "dst", "kind"):
        if field not in entry:
            say(f"{head} missing '{field}'.")
    for end in ("src", "dst"):
        name = entry.get(end)
        if isinstance(name, str) and name not in tables["units"]:
            say(f"{head} {end} '{name}' is not a known unit id.")
    if "warrant_ids" in entry and not isinstance(entry["warrant_ids"], list):
        say(f"{head} warrant_ids must be a list.")
    for name in _members(entry.get("warrant_ids")):
        if tables["warrants"] and not _known(name, tables["warrants"]):
            say(f"{head} warrant_id '{name}' is not a known warrant.")
    if entry.get("gate_mode") is not None and entry["gate_mode"] not in ("AND", "OR"):
        say(f"{head} gate_mode must be AND or OR.")


def _check_attack(i: int, entry: object, tables: dict, say: Callable[[str], None]) -> None:
    head = f"warrant_attacks[{i}]"
    if not isinstance(entry, dict):
        say(f"{head} must be an object.")
    elif "src" not in entry or "warrant_id" not in entry:
        say(f"{head} missing 'src' or 'warrant_id'.")
    else:
        for field, target, what in (("src", "units", "unit id"), ("warrant_id", "warrants", "warrant")):
            if isinstance(entry[field], str) and entry[field] not in tables[target]:
                say(f"{head} {field} '{entry[field]}' is not a known {what}.")


def graph_errors(data: object) -> list[str]:
    """Messages for one decoded payload, in rule order; [] if it is valid.

    A null where a collection stands is reported like any other wrong type, as is a field of the wrong type
    that other rules would look into.
    """
    if not isinstance(data, dict):
        return ["Graph payload must be a dictionary."]
    errors: list[str] = []
    tables: dict = {}
    for name, kind, required, message in _COLLECTIONS:
        value = data.get(name)
        given = name in data and (value is not None or name not in ("metadata", "warrant_attacks"))
        if (required or given) and not isinstance(value, kind):
            errors.append(message)
        tables[name] = value if isinstance(value, kind) else kind()
    for rule in _ENTRIES:
        for key, entry in tables[rule.collection].items():
            _check_entry(rule, key, entry, tables, errors.append)
    for i, entry in enumerate(tables["relations"]):
        _check_relation(i, entry, tables, errors.append)
    for i, entry in enumerate(tables["warrant_attacks"]):
        _check_attack(i, entry, tables, errors.append)
    return errors


def text_errors(text: str | None) -> list[str]:
    try:
        return graph_errors(json.loads(text))
    except (TypeError, ValueError, RecursionError):
        return ["Graph payload is not JSON."]


def require_valid(data: object) -> None:
    """Raises ValueError with all messages if the payload is not valid."""
    if errors := graph_errors(data):
        raise ValueError("\n".join(["Invalid graph payload:", *(f"- {e}" for e in errors)]))


def payload_violations(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, error_ord, message) of each violated rule; valid payloads give no row, null and broken JSON one each."""
    kind = payloads.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, m) for k, t in zip(batch["k"], batch["t"], strict=True) for i, m in enumerate(text_errors(t))]
            yield pd.DataFrame(rows, columns=["k", "error_ord", "message"])

    out = payloads.select(F.col(key).alias("k"), F.col(payload).alias("t")).mapInPandas(run, f"k {kind}, error_ord int, message string")
    return out.withColumnRenamed("k", key)
