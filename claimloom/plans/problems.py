"""Queries of the general data problems (pN_...) over the tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import drift, nested, orphans, timestamps
from claimloom.session import cut
from claimloom.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.document_instants(read_table(spark, d, "supporting_documents"), read_table(spark, d, "uploaders"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.payload_links(read_table(spark, d, "graph_payloads"))


def p2_evidence_table(spark: SparkSession, d: str) -> DataFrame:
    """The flat evidence table of the payloads, each row with its unit, its position and what its source names."""
    t = nested.payload_tables(read_table(spark, d, "graph_payloads")).where(F.col("present") & (F.col("ancestor") == nested.EVIDENCE))
    f = lambda x: F.try_element_at("fields", F.lit(f"{nested.EVIDENCE}.{x}"))
    named = lambda x: F.coalesce(f(f"source.value.{x}"), f(f"source.{x}"))
    return t.select(
        "payload_id", F.get("keys", F.lit(0)).alias("unit_key"), F.element_at("ordinals", -1).alias("pos"), f("id").alias("evidence_id"),
        f("stance").alias("stance"), f("strength").try_cast("double").alias("strength"), named("doc_id").alias("source_doc_id"),
        named("evidence_card_id").alias("source_card_id"), named("dataset.name").alias("source_dataset"),
    ).dropDuplicates()


def _columns(name: str, source: Callable[[SparkSession, str], DataFrame], *columns: str, where: str = "true") -> None:
    QUERIES[name] = lambda spark, d: source(spark, d).where(where).select(*columns).dropDuplicates()


def _array_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return nested.array_table({"units": (read_table(spark, d, "units"), "unit_id"), "warrants": (read_table(spark, d, "warrants"), "warrant_id")}, name)


def p2_rest(spark: SparkSession, d: str) -> DataFrame:
    """What each payload holds outside of its flat tables."""
    return nested.payload_rest(read_table(spark, d, "graph_payloads"))


def _reference_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    names = {r.table for r in orphans.REFERENCES} | {r.target for r in orphans.REFERENCES}
    return {n: read_table(spark, d, n) for n in sorted(names)}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(_reference_tables(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p4_found(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(read_table(spark, d, "graph_exports"))


def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    """The version of each file's schema and its number of paths."""
    return drift.schema_versions(read_table(spark, d, "graph_exports")).drop("fingerprint")


def p6_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps from version to version."""
    return drift.migration_steps(cut(drift.file_paths(read_table(spark, d, "graph_exports"))))


def p6_consistent(spark: SparkSession, d: str) -> DataFrame:
    """All records in one schema."""
    return drift.consistent_records(read_table(spark, d, "graph_exports"))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """All values under their canonical paths."""
    return drift.consistent_table(read_table(spark, d, "graph_exports"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_evidence_table": p2_evidence_table, "p4_found": p4_found,
    "p4_report": p4_report, "p6_found": p6_found, "p6_versions": p6_versions, "p6_steps": p6_steps, "p6_consistent": p6_consistent, "p6_values": p6_values, "p2_rest": p2_rest,
    **{f"p2_{n}": lambda spark, d, n=n: nested.payload_table(read_table(spark, d, "graph_payloads"), n) for n in nested.TABLES},
    **{f"p2_array_{n}": lambda spark, d, n=n: _array_table(spark, d, n) for n in nested.ARRAYS},
}

# the flat tables by the columns that SQL can say, too
_payload = lambda n: lambda spark, d: nested.payload_table(read_table(spark, d, "graph_payloads"), n)
_array = lambda n: lambda spark, d: _array_table(spark, d, n)
_columns("p2_unit_rows", _payload("units"), "payload_id", "key", "id", "text", "type", "score", "evidence_min", "evidence_max")
_columns("p2_span_rows", _payload("spans"), "payload_id", "place", "key", "pos", "doc_id", "start", "end", "text", "page", "modality")
_columns("p2_relation_rows", _payload("relations"), "payload_id", "place", "key", "pos", "src", "dst", "kind", "gate_mode", "weight", "rationale")
_columns("p2_array_evidence_rows", _array("evidence"), "table_name", "graph_id", "owner_key", "pos", "id", "stance", "strength", "source_kind", "source_span_doc_id", "source_structured")

_P4 = """
WITH c AS (
  SELECT 'relations' AS table_name, 'src' AS field_name, 'units' AS target, graph_id, CAST(edge_idx AS VARCHAR) AS record_key, min(loaded_at) AS l, arg_min(src, loaded_at) AS ref_key FROM relations GROUP BY graph_id, edge_idx
  UNION ALL SELECT 'relations', 'dst', 'units', graph_id, CAST(edge_idx AS VARCHAR), min(loaded_at), arg_min(dst, loaded_at) FROM relations GROUP BY graph_id, edge_idx
  UNION ALL SELECT 'evidence_cards', 'supporting_doc_id', 'supporting_documents', graph_id, card_id, min(loaded_at), arg_min(supporting_doc_id, loaded_at) FROM evidence_cards GROUP BY graph_id, card_id
  UNION ALL SELECT 'warrant_attacks', 'warrant_id', 'warrants', graph_id, CAST(attack_idx AS VARCHAR), min(loaded_at), arg_min(warrant_id, loaded_at) FROM warrant_attacks GROUP BY graph_id, attack_idx
), p AS (
  SELECT target, graph_id, ref_key, min(loaded_at) AS pl, bool_and(deleted_at IS NOT NULL) AS gone FROM (
    SELECT 'units' AS target, graph_id, unit_id AS ref_key, loaded_at, deleted_at FROM units
    UNION ALL SELECT 'supporting_documents', graph_id, doc_id, loaded_at, deleted_at FROM supporting_documents
    UNION ALL SELECT 'warrants', graph_id, warrant_id, loaded_at, deleted_at FROM warrants
  ) GROUP BY target, graph_id, ref_key
), o AS (
  SELECT table_name, field_name, strftime(l, '%Y-%m') AS period, c.graph_id AS graph_id, record_key, c.ref_key AS ref_key,
    CASE WHEN p.pl IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.pl > c.l THEN 'late' END AS reason
  FROM c LEFT JOIN p ON c.target = p.target AND c.graph_id = p.graph_id AND c.ref_key = p.ref_key
  WHERE c.ref_key IS NOT NULL AND c.ref_key <> ''
)
"""

SQL: dict[str, str] = {
    "p4_found": _P4 + "SELECT * FROM o WHERE reason IS NOT NULL",
    "p4_report": _P4 + "SELECT table_name, field_name, period, reason, count(*) AS orphans, count(DISTINCT (graph_id, ref_key)) AS ref_keys FROM o WHERE reason IS NOT NULL GROUP BY ALL",
}
_OK = "FROM (SELECT payload_id, CAST(CASE WHEN json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT' THEN payload END AS JSON) AS j FROM graph_payloads) WHERE j IS NOT NULL"
_UNITS = f"u AS (SELECT payload_id, k, json_extract(j, '$.units.\"' || k || '\"') AS x FROM (SELECT payload_id, j, unnest(json_keys(j, '$.units')) AS k {_OK}) WHERE json_type(json_extract(j, '$.units.\"' || k || '\"')) <> 'NULL')"
_EV = "e AS (SELECT payload_id, k, i, json_extract(x, '$.evidence[' || i || ']') AS y FROM (SELECT payload_id, k, x, unnest(range(CAST(json_array_length(x, '$.evidence') AS BIGINT))) AS i FROM u WHERE json_type(x, '$.evidence') = 'ARRAY') WHERE json_type(x, '$.evidence[' || i || ']') <> 'NULL')"
_BU = f"b AS (SELECT payload_id, k, json_extract(j, '$.argument_bundles.\"' || k || '\"') AS x FROM (SELECT payload_id, j, unnest(json_keys(j, '$.argument_bundles')) AS k {_OK} AND json_type(j, '$.argument_bundles') = 'OBJECT'))"
_RE = "r AS (SELECT payload_id, k, i, json_extract(x, '$.relations[' || i || ']') AS y FROM (SELECT payload_id, k, x, unnest(range(CAST(json_array_length(x, '$.relations') AS BIGINT))) AS i FROM b WHERE json_type(x, '$.relations') = 'ARRAY') WHERE json_type(x, '$.relations[' || i || ']') <> 'NULL')"
_NAME = ", ".join(f"json_extract_string(y, '$.source.{t}{n}')" for n in ("doc_id", "evidence_card_id", "dataset.name") for t in ("value.", ""))
SQL["p2_found"] = f"""
WITH {_UNITS}, {_EV}, {_BU}, {_RE}
SELECT DISTINCT * FROM (
  SELECT payload_id, 'graph_unit' AS link, '' AS parent_key, k AS child_key FROM u
  UNION ALL SELECT payload_id, 'unit_evidence', k, i || ':' || json_extract_string(y, '$.id') FROM e
  UNION ALL SELECT payload_id, 'evidence_source', k || '#' || i, coalesce({_NAME}) FROM e
  UNION ALL SELECT payload_id, 'graph_bundle', '', k FROM b
  UNION ALL SELECT payload_id, 'bundle_relation', k, i || ':' || coalesce(json_extract_string(y, '$.src'), '') || '>' || coalesce(json_extract_string(y, '$.dst'), '') FROM r
) WHERE child_key IS NOT NULL
"""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\b\.?)?"
_AREA = r"([+-]\d{2}(?::?\d{2})?|[A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)*)"
_END = rf"(?:\s*{_AREA})?(?:\s*[\[(]\s*{_AREA}\s*[\])])?"
_DAY = r"(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*\.?,?\s+)?"
_SHAPES = {
    "i": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:[Tt]\s*|,?\s+){_CLOCK}{_END})?$", "a b c h mi s f ap z1 z2"),
    "k": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_END})?$", "a b c h mi s f z1 z2"),
    "l": (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:(?:[Tt]\s*|,?\s+){_CLOCK}{_END})?$", "a b c h mi s f ap z1 z2"),
    "d": (rf"^{_DAY}(\d{{1,2}})(?:st|nd|rd|th)?[-\s]\s*([A-Za-z]{{3,9}})\.?,?[-\s]\s*(\d{{4}})(?:,?\s+{_CLOCK}{_END})?$", "a b c h mi s f ap z1 z2"),
    "n": (rf"^{_DAY}([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_END})?$", "a b c h mi s f ap z1 z2"),
}
_HIT = ", ".join(f"regexp_extract(t, '{p}', [{', '.join(repr(n) for n in names.split())}]) AS {k}" for k, (p, names) in _SHAPES.items())
_TAKE = lambda x: f"CASE WHEN bare AND length(t) NOT IN (8, 12, 14) THEN '' WHEN i.a <> '' THEN i.{x} WHEN k.a <> '' THEN {'chr(0)' if x == 'ap' else 'k.' + x} WHEN l.a <> '' THEN l.{x} WHEN d.a <> '' THEN d.{x} ELSE n.{x} END AS {x}"
_MONTH = "CASE WHEN lower({x}) = 'sept' THEN 9 ELSE list_position([" + ", ".join(f"'{m[:3]}'" for m in timestamps.MONTHS) + "], CASE WHEN length({x}) = 3 OR lower({x}) IN (" + ", ".join(f"'{m}'" for m in timestamps.MONTHS) + ") THEN lower({x}[:3]) END) END"
_DATE = lambda y, m, d: f"TRY_CAST(lpad({y}, 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
_OFF = "CAST(epoch_us(timezone(zone, timezone('UTC', make_timestamp(CAST(x AS BIGINT)))) - make_timestamp(CAST(x AS BIGINT))) AS BIGINT)"
SQL["p1_found"] = f"""
WITH q AS (
  SELECT DISTINCT doc_id, trim(upload_date, {_WS}) AS t, zone_id, date_order FROM supporting_documents s
  LEFT JOIN (SELECT uploader, max(zone_id) AS zone_id, max(date_order) AS date_order FROM uploaders GROUP BY uploader) p ON s.uploader = p.uploader
  WHERE upload_date IS NOT NULL AND doc_id IS NOT NULL
), hit AS (SELECT *, regexp_full_match(t, '[0-9]+') AS bare, {_HIT} FROM q)
, f AS (SELECT doc_id, t, bare, zone_id, date_order, CASE WHEN i.a <> '' OR k.a <> '' THEN 'ymd' WHEN l.a <> '' THEN 'local' WHEN d.a <> '' THEN 'dny' ELSE 'ndy' END AS kind, {', '.join(map(_TAKE, 'a b c h mi s f ap z1 z2'.split()))} FROM hit)
, g AS (
  SELECT *, CASE WHEN z1 <> '' THEN z1 ELSE z2 END AS z, {_DATE('c', 'b', 'a')} AS dm, {_DATE('c', 'a', 'b')} AS md,
    CASE kind WHEN 'ymd' THEN {_DATE('a', 'b', 'c')} WHEN 'dny' THEN {_DATE('c', _MONTH.format(x='b'), 'a')} WHEN 'ndy' THEN {_DATE('c', _MONTH.format(x='a'), 'b')} END AS sure,
    TRY_CAST(h AS INTEGER) AS hour, coalesce(TRY_CAST(mi AS INTEGER), 0) AS minute, coalesce(TRY_CAST(s AS INTEGER), 0) AS second, CASE WHEN f = '' THEN 0 ELSE CAST(rpad(f[:6], 6, '0') AS BIGINT) END AS micro
  FROM f WHERE a <> '' OR bare OR regexp_full_match(t, '[0-9]{{10}}\\.[0-9]+')
), w AS (
  SELECT *, CASE WHEN kind <> 'local' THEN sure WHEN date_order = 'DMY' THEN dm WHEN date_order = 'MDY' THEN md WHEN dm IS NULL THEN md WHEN md IS NULL OR md = dm THEN dm END AS day,
    CASE WHEN h = '' THEN 0 WHEN minute > 59 OR second > 59 THEN NULL
      WHEN lower(ap) IN ('a', 'p') THEN CASE WHEN hour BETWEEN 1 AND 12 THEN hour % 12 + CASE WHEN lower(ap) = 'p' THEN 12 ELSE 0 END END WHEN hour <= 23 THEN hour END AS clock,
    CASE WHEN z[1] IN ('+', '-') THEN CASE WHEN CAST(z[2:3] AS INTEGER) <= 18 AND coalesce(TRY_CAST(replace(z[4:], ':', '') AS INTEGER), 0) <= 59
      THEN CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (CAST(z[2:3] AS INTEGER) * 60 + coalesce(TRY_CAST(replace(z[4:], ':', '') AS INTEGER), 0)) END
      ELSE CASE upper(z) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in timestamps.ABBREVIATION_MINUTES.items())} END END AS off
  FROM g
), l AS (
  SELECT doc_id, CASE WHEN regexp_full_match(t, '[0-9]{{10}}\\.[0-9]+') THEN CAST(t[:10] AS BIGINT) * 1000000 + CAST(rpad(t[12:17], 6, '0') AS BIGINT)
      WHEN bare THEN CASE length(t) WHEN 10 THEN CAST(t AS BIGINT) * 1000000 WHEN 13 THEN CAST(t AS BIGINT) * 1000 WHEN 16 THEN CAST(t AS BIGINT) WHEN 19 THEN TRY_CAST(t AS BIGINT) // 1000 END END AS counted,
    epoch_us(CAST(day AS TIMESTAMP)) + CAST(clock * 3600 + minute * 60 + second AS BIGINT) * 1000000 + micro AS local_us, off, z[1] IN ('+', '-') AS signed, CASE WHEN z = '' THEN zone_id ELSE z END AS zone FROM w
), o AS (
  SELECT doc_id, counted, local_us, off, CASE WHEN counted IS NULL AND off IS NULL AND NOT signed AND zone IN (SELECT name FROM pg_timezone_names()) THEN zone END AS zone FROM l
), u AS (
  SELECT doc_id, count(DISTINCT inst) AS n, min(inst) AS inst FROM (
    SELECT doc_id, local_us, zone, local_us - unnest([{_OFF.replace('x', 'local_us - 93600000000')}, {_OFF.replace('x', 'local_us + 93600000000')}]) AS inst FROM o WHERE zone IS NOT NULL AND local_us IS NOT NULL)
  WHERE inst + {_OFF.replace('CAST(x AS', 'CAST(inst AS')} = local_us GROUP BY doc_id, local_us, zone
)
SELECT DISTINCT doc_id, upload_us FROM (
  SELECT doc_id, coalesce(counted, local_us - CAST(off AS BIGINT) * 60000000) AS upload_us FROM o UNION ALL SELECT doc_id, inst FROM u WHERE n = 1) WHERE upload_us IS NOT NULL
"""

_KIND = "CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END"
_KEYS = r"regexp_replace({}, '\.[a-z][0-9]+(\.|\[|$)', '.*\1', 'g')"
_PATH = r"regexp_replace(" + _KEYS.format(_KEYS.format("substr(fullkey, 2)")) + r", '\[[0-9]+\]', '[]', 'g')"
_SCHEMAS = f"""
WITH x AS (SELECT stream_name, file_no, CAST(CASE WHEN json_valid(record) THEN record END AS JSON) AS j FROM graph_exports),
t AS (SELECT stream_name, file_no, substr({_PATH}, 2) AS path, {_KIND} AS kind FROM (SELECT stream_name, file_no, j FROM x WHERE json_type(j) = 'OBJECT') s, json_tree(s.j) WHERE type <> 'NULL' AND fullkey <> '$'),
p AS (SELECT stream_name, file_no, path, string_agg(DISTINCT kind, '|' ORDER BY kind) AS types FROM t GROUP BY ALL),
f AS (SELECT stream_name, file_no, count(*) AS paths, list((path, types) ORDER BY path) AS schema FROM p GROUP BY ALL),
v AS (SELECT *, sum(c) OVER (PARTITION BY stream_name ORDER BY file_no) AS version FROM (SELECT *, CASE WHEN schema IS NOT DISTINCT FROM lag(schema) OVER (PARTITION BY stream_name ORDER BY file_no) THEN 0 ELSE 1 END AS c FROM f)),
b AS (SELECT n.stream_name, n.file_no, o.version AS from_version, n.version AS to_version FROM v n JOIN v o ON n.stream_name = o.stream_name AND n.file_no = o.file_no + 1),
d AS (SELECT b.stream_name, b.file_no, k.path AS path, o.types AS was, n.types AS now FROM b JOIN (SELECT DISTINCT stream_name, file_no, path FROM (SELECT stream_name, file_no, path FROM p UNION ALL SELECT stream_name, file_no + 1, path FROM p)) k ON b.stream_name = k.stream_name AND b.file_no = k.file_no
  LEFT JOIN p n ON n.stream_name = k.stream_name AND n.file_no = k.file_no AND n.path = k.path LEFT JOIN p o ON o.stream_name = k.stream_name AND o.file_no = k.file_no - 1 AND o.path = k.path WHERE o.types IS DISTINCT FROM n.types),
e AS (SELECT *, regexp_replace(path, '(^|\\.)[^.]*$', '') AS parent FROM d WHERE NOT regexp_matches(path, '(\\[\\]|(^|\\.)\\*)$') AND NOT EXISTS (SELECT 1 FROM d y WHERE y.stream_name = d.stream_name AND y.file_no = d.file_no AND (starts_with(d.path, y.path || '.') OR starts_with(d.path, y.path || '[]')))),
g AS (SELECT *, count(*) FILTER (now IS NULL) OVER w AS gone, count(*) FILTER (was IS NULL) OVER w AS came, min(was) FILTER (now IS NULL) OVER w AS gt, min(now) FILTER (was IS NULL) OVER w AS ct, min(path) FILTER (was IS NULL) OVER w AS cp FROM e WINDOW w AS (PARTITION BY stream_name, file_no, parent)),
h AS (SELECT stream_name, file_no, CASE WHEN now IS NOT NULL AND was IS NOT NULL THEN 'type_changed' WHEN gone = 1 AND came = 1 AND gt = ct THEN 'renamed' WHEN now IS NULL THEN 'removed' ELSE 'added' END AS change_kind,
  CASE WHEN was IS NULL THEN '' ELSE path END AS old_path, CASE WHEN now IS NOT NULL THEN path WHEN gone = 1 AND came = 1 AND gt = ct THEN cp ELSE '' END AS new_path FROM g WHERE NOT (gone = 1 AND came = 1 AND gt = ct AND was IS NULL))
"""
SQL["p6_found"] = _SCHEMAS + "SELECT * FROM h"
SQL["p6_steps"] = _SCHEMAS + "SELECT h.stream_name, h.file_no, CAST(from_version AS INTEGER) AS from_version, CAST(to_version AS INTEGER) AS to_version, change_kind, old_path, new_path FROM h JOIN b ON h.stream_name = b.stream_name AND h.file_no = b.file_no"
SQL["p6_versions"] = _SCHEMAS + "SELECT stream_name, file_no, paths, CAST(version AS INTEGER) AS version FROM v"

_X = lambda f: f"json_extract_string(y, '$.{f}')"
_Y = lambda f: f"json_extract_string(x, '$.{f}')"
_SRC = lambda f: f"coalesce(json_extract_string(y, '$.source.value.{f}'), json_extract_string(y, '$.source.{f}'))"
_NUM = lambda x: f"TRY_CAST({x} AS DOUBLE)"
SQL["p2_evidence_table"] = f"WITH {_UNITS}, {_EV} SELECT DISTINCT payload_id, k AS unit_key, CAST(i AS INTEGER) AS pos, {_X('id')} AS evidence_id, {_X('stance')} AS stance, {_NUM(_X('strength'))} AS strength, {_SRC('doc_id')} AS source_doc_id, {_SRC('evidence_card_id')} AS source_card_id, {_SRC('dataset.name')} AS source_dataset FROM e"


def _elements(link: str, above: str = "units") -> str:
    return f"(SELECT payload_id, k, i, json_extract(x, '$.{link}[' || i || ']') AS y FROM (SELECT payload_id, k, x, unnest(range(CAST(json_array_length(x, '$.{link}') AS BIGINT))) AS i FROM {above} WHERE json_type(x, '$.{link}') = 'ARRAY') WHERE json_type(x, '$.{link}[' || i || ']') <> 'NULL')"


_WA = _UNITS.replace("u AS (", "wa AS (", 1).replace("$.units", "$.warrants")
_SPAN_COLUMNS = f"{_X('doc_id')} AS doc_id, TRY_CAST({_X('start')} AS BIGINT) AS \"start\", TRY_CAST({_X('end')} AS BIGINT) AS \"end\", {_X('text')} AS text, TRY_CAST({_X('page')} AS BIGINT) AS page, {_X('modality')} AS modality"
SQL["p2_span_rows"] = f"WITH {_UNITS}, {_WA} SELECT DISTINCT * FROM (SELECT payload_id, 'units{{}}.spans[]' AS place, k AS key, CAST(i AS INTEGER) AS pos, {_SPAN_COLUMNS} FROM {_elements('spans', 'u')} UNION ALL SELECT payload_id, 'warrants{{}}.spans[]', k, CAST(i AS INTEGER), {_SPAN_COLUMNS} FROM {_elements('spans', 'wa')})"
SQL["p2_unit_rows"] = f"WITH {_UNITS} SELECT DISTINCT payload_id, k AS key, json_extract_string(x, '$.id') AS id, json_extract_string(x, '$.text') AS text, json_extract_string(x, '$.type') AS type, {_NUM(_Y('score'))} AS score, {_NUM(_Y('evidence_min'))} AS evidence_min, {_NUM(_Y('evidence_max'))} AS evidence_max FROM u"
_REL = f"{_X('src')} AS src, {_X('dst')} AS dst, {_X('kind')} AS kind, {_X('gate_mode')} AS gate_mode, {_NUM(_X('weight'))} AS weight, {_X('rationale')} AS rationale"
SQL["p2_relation_rows"] = f"WITH o AS (SELECT payload_id, '' AS k, j AS x {_OK}), {_BU} SELECT DISTINCT * FROM (SELECT payload_id, 'relations[]' AS place, CAST(NULL AS VARCHAR) AS key, CAST(i AS INTEGER) AS pos, {_REL} FROM {_elements('relations', 'o')} UNION ALL SELECT payload_id, 'argument_bundles{{}}.relations[]', k, CAST(i AS INTEGER), {_REL} FROM {_elements('relations', 'b')})"
_LISTED = lambda place, rows, parent="NULL": f"SELECT payload_id, '{place}' AS place, k AS key, CAST({parent} AS INTEGER) AS parent_pos, CAST(i AS INTEGER) AS pos, json_extract_string(y, '$') AS value, CAST(NULL AS VARCHAR) AS rest FROM {rows}"
_INNER = lambda rows: f"(SELECT payload_id, k, n, i, json_extract(y, '$.warrant_ids[' || i || ']') AS y FROM (SELECT payload_id, k, i AS n, y, unnest(range(CAST(json_array_length(y, '$.warrant_ids') AS BIGINT))) AS i FROM {rows} WHERE json_type(y, '$.warrant_ids') = 'ARRAY'))"
SQL["p2_lists"] = f"WITH o AS (SELECT payload_id, CAST(NULL AS VARCHAR) AS k, j AS x {_OK}), {_UNITS}, {_WA}, {_BU} SELECT DISTINCT * FROM (" + " UNION ALL ".join([
    _LISTED("units{}.evidence_ids[]", _elements("evidence_ids", "u")), _LISTED("warrants{}.evidence_ids[]", _elements("evidence_ids", "wa")), _LISTED("argument_bundles{}.units[]", _elements("units", "b")),
    _LISTED("relations[].warrant_ids[]", _INNER(_elements("relations", "o")), "n"), _LISTED("argument_bundles{}.relations[].warrant_ids[]", _INNER(_elements("relations", "b")), "n"),
]) + ")"
_LAST = lambda t, k: f"(SELECT '{t}' AS table_name, graph_id, {k} AS owner_key, arg_max(struct_pack(e := evidence, s := spans, i := evidence_ids), loaded_at) AS x FROM {t} GROUP BY ALL)"
_OWNERS = f"WITH n AS (SELECT * FROM {_LAST('units', 'unit_id')} UNION ALL SELECT * FROM {_LAST('warrants', 'warrant_id')})"
SQL["p2_array_evidence_ids"] = _OWNERS + " SELECT DISTINCT table_name, graph_id, owner_key, CAST(pos - 1 AS INTEGER) AS pos, value FROM (SELECT table_name, graph_id, owner_key, unnest(x.i) AS value, generate_subscripts(x.i, 1) AS pos FROM n) WHERE value IS NOT NULL"
SQL["p2_array_evidence_rows"] = _OWNERS + " SELECT DISTINCT table_name, graph_id, owner_key, CAST(pos - 1 AS INTEGER) AS pos, v.id AS id, v.stance AS stance, v.strength AS strength, v.source.kind AS source_kind, v.source.span.doc_id AS source_span_doc_id, v.source.structured AS source_structured FROM (SELECT table_name, graph_id, owner_key, unnest(x.e) AS v, generate_subscripts(x.e, 1) AS pos FROM n) WHERE v IS NOT NULL"
SQL["p2_array_spans"] = _OWNERS + """ SELECT DISTINCT table_name, graph_id, owner_key, CAST(pos - 1 AS INTEGER) AS pos, v.doc_id AS doc_id, CAST(v.start AS BIGINT) AS "start", CAST(v.end AS BIGINT) AS "end", v.text AS text, CAST(v.page AS BIGINT) AS page,
  CASE WHEN v.bbox IS NOT NULL THEN '[' || array_to_string(v.bbox, ', ') || ']' END AS bbox, v.modality AS modality FROM (SELECT table_name, graph_id, owner_key, unnest(x.s) AS v, generate_subscripts(x.s, 1) AS pos FROM n) WHERE v IS NOT NULL"""
