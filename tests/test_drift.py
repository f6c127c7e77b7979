import datetime as dt
import json

from claimloom.operators import drift

T = dt.datetime(2024, 1, 1)
SCHEMA = "stream_name string, file_no int, line_no int, written_at timestamp_ntz, loaded_at timestamp_ntz, record string, path string"


def exports(spark, files):
    rows = [(s, n, i, T, T, r if isinstance(r, (str, type(None))) else json.dumps(r), "x") for (s, n), lines in files.items() for i, r in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted(tuple(r) for r in drift.schema_changes(exports(spark, files)).collect())


def unit(**fields):
    return {"units": {"c1": fields}}


def test_kinds_of_change(spark):
    files = {
        ("s", 1): [unit(a=1, b="x"), None, "", "{cut", "[1]"],
        ("s", 2): [unit(a=1, c="x"), unit(a=2, c="x"), unit(a=2, c="x")],  # renamed
        ("s", 3): [unit(a="1", c="x")],  # type changed
        ("s", 4): [unit(a="1", c="x", d=True, e=None)],  # added; null is nothing
        ("s", 5): [unit(a="1")],  # two removed
        ("s", 7): [unit(z=1)],  # a gap before it
        ("t", 2): [unit(q=1)],
    }
    assert changes(spark, files) == [
        ("s", 2, "renamed", "units.*.b", "units.*.c"),
        ("s", 3, "type_changed", "units.*.a", "units.*.a"),
        ("s", 4, "added", "", "units.*.d"),
        ("s", 5, "removed", "units.*.c", ""),
        ("s", 5, "removed", "units.*.d", ""),
    ]


def test_below_a_changed_path(spark):
    files = {
        ("s", 1): [{"src": {"p": 1, "q": [{"r": 1}]}, "n": 1, "l": [{"k": 1}]}],
        ("s", 2): [{"dst": {"p": 1, "q": [{"r": 1}]}, "n": {"v": 1}, "l": [1]}],
        ("s", 3): [{"dst": {"p": 1, "w": "t"}, "n": {"v": 1}, "l": [1]}],
    }
    assert changes(spark, files) == [
        ("s", 2, "renamed", "src", "dst"),
        ("s", 2, "type_changed", "n", "n"),
        ("s", 3, "added", "", "dst.w"),
        ("s", 3, "removed", "dst.q", ""),
    ]


def test_versions(spark):
    files = {("s", 1): [unit(a=1)], ("s", 2): [unit(a=2)], ("s", 3): [unit(b=2)], ("s", 4): [unit(a=2)]}
    got = {r["file_no"]: (r["version"], r["fingerprint"]) for r in drift.schema_versions(exports(spark, files)).collect()}
    assert [got[n][0] for n in (1, 2, 3, 4)] == [1, 1, 2, 3] and got[1][1] == got[4][1] != got[3][1]


def test_consistent_table_follows_renames(spark):
    files = {("s", 1): [{"a": {"x": 1}}], ("s", 2): [{"b": {"x": 2}}], ("s", 3): [{"b": {"y": "3"}}], ("s", 4): [{"c": {"y": 4}}]}
    rows = {r["file_no"]: r for r in drift.consistent_values(exports(spark, files)).collect()}
    assert {n: r["canonical"] for n, r in rows.items()} == {1: "a.x", 2: "a.x", 3: "a.y", 4: "a.y"}
    assert rows[2]["number"] == 2.0 and all(r["cast_ok"] for r in rows.values())


def test_empty(spark):
    none = exports(spark, {("s", 1): [None]}).where("false")
    assert drift.schema_changes(none).collect() == [] and drift.consistent_values(none).collect() == [] and drift.schema_versions(none).collect() == []


def test_consistent_table_has_every_path_and_one_type(spark):
    files = {
        ("s", 1): [unit(t="x", n=None), {"units": {"c1": {"t": "y"}, "c2": {"t": "z", "n": 1, "l": []}}}],
        ("s", 2): [unit(t="v")], ("t", 1): [unit(t=5)], ("t", 2): [{"title": "no units"}],
    }
    got = {(r["stream_name"], r["file_no"], r["line_no"], r["place"]): r for r in drift.consistent_table(exports(spark, files)).collect()}
    assert {r["target_type"] for r in got.values() if r["canonical"] == "units.*.t"} == {"string"}
    assert got["t", 1, 0, "units.c1.t"]["value"] == "5" and all(r["cast_ok"] for r in got.values())
    kinds = {k: r["found_type"] for k, r in got.items()}
    assert kinds["s", 1, 0, "units.c1.n"] == "null" and kinds["s", 1, 1, "units.c1.n"] == "missing" and kinds["s", 1, 1, "units.c2.l"] == "array"
    assert got["s", 1, 1, "units.c2.n"]["number"] == 1.0 and kinds["t", 2, 0, "units"] == kinds["t", 2, 0, "units.*.t"] == "missing"
    assert len({r["canonical"] for k, r in got.items() if k[:3] == ("t", 2, 0)}) == 6 and all(r["value"] is None for r in got.values() if r["found_type"] == "missing")


def test_records_are_brought_to_one_schema(spark):
    files = {
        ("s", 1): [unit(a="1", b="x", l=[1])], ("s", 2): [unit(a=2, c="y", l=["2"]), unit(a=None, c="z", l=3)],
        ("t", 1): [unit(a="many", b=True, l=[1], o={"k": 1})], ("t", 2): [unit(a=5, b="q", l=[2], o=None)], ("u", 1): [unit(a=1, b="w", l=[1])],
    }
    rows = {(r["stream_name"], r["file_no"], r["line_no"]): r for r in drift.consistent_records(exports(spark, files)).collect()}
    at = lambda *k: json.loads(rows[k]["record"])["units"]["c1"]
    assert at("s", 1, 0) == {"a": 1, "b": "x", "l": [1], "o": None} and at("s", 2, 0) == {"a": 2, "b": "y", "l": [2], "o": None}
    assert (rows["s", 2, 0]["renamed"], rows["s", 2, 0]["defaulted"], rows["s", 2, 0]["casts"]) == (1, 1, 1)
    assert at("t", 1, 0)["a"] is None and json.loads(rows["t", 1, 0]["rejected"]) == {"units.c1.a": "many"} and at("t", 1, 0)["b"] == "true"
    assert at("t", 2, 0)["o"] is None and rows["t", 2, 0]["defaulted"] == 0 and rows["t", 2, 0]["rejected"] is None


def test_steps_only_where_the_fingerprint_changes(spark):
    files = {("s", 1): [unit(a=1)], ("s", 2): [unit(a=2)], ("s", 3): [unit(b=3)], ("s", 4): [unit(b=3)], ("s", 5): [unit(b=3, c=1)]}
    steps = sorted(tuple(r) for r in drift.migration_steps(drift.file_paths(exports(spark, files))).collect())
    assert steps == [("s", 3, 1, 2, "renamed", "units.*.a", "units.*.b"), ("s", 5, 2, 3, "added", "", "units.*.c")]
