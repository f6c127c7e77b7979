"""Queries of the text-corpus problems (pN_...), and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import copies, linked_groups, lookalikes, near_duplicates, packing, tokens
from claimloom.session import cut
from claimloom.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
CAPACITY = 2048


def _texts(spark: SparkSession, d: str, second: tuple[str, str]) -> DataFrame:
    """The texts of units and of a second table in one form: (table_name, key, text)."""
    units = read_table(spark, d, "units").select(F.lit("units").alias("table_name"), F.col("unit_id").alias("key"), "text")
    table, key = second
    return units.unionByName(read_table(spark, d, table).select(F.lit(table).alias("table_name"), F.col(key).alias("key"), "text"))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(_texts(spark, d, ("extracted_claims", "claim_id")), "table_name", "key", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.expand_pairs(*_near(spark, d)).withColumnRenamed("tbl", "table_name")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its class (the smallest key of equal token sets), the class's records and its links to other classes."""
    members, found, links = _near(spark, d)
    ends = links.select(F.explode(F.array("id_a", "id_b")).alias("id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("links"))
    members = cut(members)
    heads = members.groupBy("id").agg(F.min("key").alias("class_key"), F.count("*").alias("records"))
    heads = cut(heads.join(degree, "id", "left").withColumn("links", F.coalesce("links", F.lit(0))))
    return members.join(heads, "id").select(F.col("tbl").alias("table_name"), "key", "class_key", "records", "links")


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_groups(_texts(spark, d, ("warrants", "warrant_id")), ["table_name"], "key", {"text": copies.words(F.col("text"))})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).where("key <> first_key").select("table_name", "first_key", F.col("key").alias("copy_key"))


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    """One row per text that occurs more than once, with its number of records."""
    return copies.copy_counts(_copies(spark, d), ["table_name"], "key")


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """One row per text, those that occur once too: its words, the smallest key and the number of records."""
    texts = _texts(spark, d, ("warrants", "warrant_id")).select("table_name", "key", copies.words(F.col("text")).alias("words"))
    return texts.where("words is not null and key is not null").groupBy("table_name", "words").agg(F.min("key").alias("first_key"), F.countDistinct("key").alias("copies"))


def p5_same_records(spark: SparkSession, d: str) -> DataFrame:
    """Units, and warrants, that are equal in text, type and all metadata fields, whatever the order of these, with their group's number of records."""
    one = lambda table, key: read_table(spark, d, table).select(F.lit(table).alias("table_name"), F.col(key).alias("key"), "text", "type", "metadata")
    records = one("units", "unit_id").unionByName(one("warrants", "warrant_id"))
    fields = {"text": copies.words(F.col("text")), "type": copies.words(F.col("type"))}
    found = copies.copy_groups(records, ["table_name"], "key", fields, ("metadata",))
    counts = copies.copy_counts(found, ["table_name"], "key")
    return found.where("key <> first_key").join(counts, ["table_name", "first_key"]).select("table_name", "first_key", F.col("key").alias("copy_key"), "copies")


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Links of both kinds of nodes; a node is its kind's first letter, a colon and its key."""
    matches = read_table(spark, d, "claim_matches").where("verdict = 'same'")
    claims = matches.select(F.concat(F.lit("c:"), "left_claim").alias("u"), F.concat(F.lit("c:"), "right_claim").alias("v"))
    lists = read_table(spark, d, "merge_results").select(F.explode(F.map_values("unit_segments")).alias("x"))
    lists = lists.select(F.filter("x", lambda s: s.isNotNull()).alias("x")).where("size(x) > 1")
    # the first of a list stands for all of it
    segments = lists.select(F.array_min("x").alias("head"), F.explode("x").alias("s"))
    return claims.unionByName(segments.select(F.concat(F.lit("s:"), "head").alias("u"), F.concat(F.lit("s:"), "s").alias("v")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    groups = linked_groups.linked_groups(_links(spark, d))
    kind = F.when(F.col("node").startswith("c:"), "claim").otherwise("segment")
    return groups.select(kind.alias("node_kind"), F.substr("node", F.lit(3)).alias("node_key"), F.substr("group_key", F.lit(3)).alias("group_key"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every claim and every segment; one that is tied to no other is a group of its own."""
    claims = read_table(spark, d, "extracted_claims")
    lists = read_table(spark, d, "merge_results").select(F.explode(F.map_values("unit_segments")).alias("x"))
    one = lambda df, kind, key: df.select(F.lit(kind).alias("node_kind"), F.col(key).alias("node_key"))
    nodes = one(claims, "claim", "claim_id").unionByName(one(claims, "segment", "segment_id")).unionByName(one(lists.select(F.explode("x").alias("s")), "segment", "s"))
    nodes = nodes.where("node_key is not null").dropDuplicates()
    return nodes.join(p7_found(spark, d), ["node_kind", "node_key"], "full").withColumn("group_key", F.coalesce("group_key", "node_key"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(read_table(spark, d, "documents"), "doc_id", "text", tokens.encoder(VOCABULARY))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts after encoding and decoding: (doc_id, text), '' for null."""
    enc = tokens.encoder(VOCABULARY)
    return tokens.decode_ids(tokens.encode_texts(read_table(spark, d, "documents"), "doc_id", "text", enc), "doc_id", "ids", enc)


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_tokens(read_table(spark, d, "documents"), "doc_id", "text", tokens.encoder(VOCABULARY))
    return packing.pack(spark, sizes, "doc_id", "n_tokens", CAPACITY)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_pairs(read_table(spark, d, "documents"), "doc_id", "text", "doc_a", "doc_b")


def p10_normal(spark: SparkSession, d: str) -> DataFrame:
    """The one consistent form of every text: (doc_id, normal)."""
    return lookalikes.normalised_texts(read_table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {
    "p3_found": p3_found, "p3_classes": p3_classes, "p5_found": p5_found, "p5_copies": p5_copies, "p5_texts": p5_texts, "p5_same_records": p5_same_records,
    "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_packing": p9_packing, "p10_found": p10_found, "p10_normal": p10_normal,
}

_P5 = r"""
WITH r AS (
  SELECT DISTINCT table_name, key, w FROM (
    SELECT 'units' AS table_name, unit_id AS key, array_to_string(regexp_extract_all(lower(text), '[\pL\pN]+'), ' ') AS w FROM units
    UNION ALL SELECT 'warrants', warrant_id, array_to_string(regexp_extract_all(lower(text), '[\pL\pN]+'), ' ') FROM warrants
  ) WHERE w <> ''
), g AS (SELECT table_name, w, min(key) AS first_key, count(DISTINCT key) AS copies FROM r GROUP BY table_name, w HAVING count(DISTINCT key) > 1)
"""
SQL: dict[str, str] = {
    "p5_found": _P5 + "SELECT DISTINCT r.table_name, first_key, key AS copy_key FROM r JOIN g ON r.table_name = g.table_name AND r.w = g.w WHERE key <> first_key",
    "p5_copies": _P5 + "SELECT table_name, first_key, copies FROM g",
    "p7_found": """
WITH RECURSIVE l AS (
  SELECT 'claim' AS kind, left_claim AS u, right_claim AS v FROM claim_matches WHERE verdict = 'same' AND left_claim <> right_claim
  UNION SELECT 'segment', list_min(x), s FROM (SELECT x, unnest(x) AS s FROM (SELECT list_filter(x, lambda y: y IS NOT NULL) AS x FROM (SELECT unnest(map_values(unit_segments)) AS x FROM merge_results))) WHERE list_min(x) <> s
), e AS (SELECT kind, u, v FROM l UNION SELECT kind, v, u FROM l),
reach AS (SELECT kind, u AS a, u AS b FROM e UNION SELECT r.kind, r.a, e.v FROM reach r JOIN e ON r.kind = e.kind AND r.b = e.u)
SELECT kind AS node_kind, a AS node_key, min(b) AS group_key FROM reach GROUP BY kind, a
""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}

# ---- the same in SQL where it is quick enough on the tables of the smaller scales
_P3 = r"""
WITH r AS (
  SELECT table_name, key, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM (
    SELECT 'units' AS table_name, unit_id AS key, text FROM units WHERE unit_id IS NOT NULL UNION ALL SELECT 'extracted_claims', claim_id, text FROM extracted_claims WHERE claim_id IS NOT NULL)
), k AS (SELECT DISTINCT table_name, key, t FROM r WHERE len(t) > 0),
c AS (SELECT *, row_number() OVER () AS id FROM (SELECT table_name, t, min(key) AS class_key, count(DISTINCT key) AS records FROM k GROUP BY ALL)),
l AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.table_name = b.table_name AND a.id < b.id AND 5 * least(len(a.t), len(b.t)) >= 4 * greatest(len(a.t), len(b.t))
  WHERE 9 * len(list_intersect(a.t, b.t)) >= 4 * (len(a.t) + len(b.t))),
m AS (SELECT k.*, c.id, class_key, records FROM k JOIN c ON k.table_name = c.table_name AND k.t = c.t)
"""
SQL["p3_found"] = _P3 + """SELECT DISTINCT x.table_name, least(x.key, y.key) AS key_a, greatest(x.key, y.key) AS key_b FROM (SELECT a, b FROM l UNION ALL SELECT id, id FROM c WHERE records > 1) p
JOIN m x ON x.id = p.a JOIN m y ON y.id = p.b WHERE x.key <> y.key"""
SQL["p3_classes"] = _P3 + "SELECT table_name, key, class_key, records, coalesce(n, 0) AS links FROM m LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT a AS id FROM l UNION ALL SELECT b FROM l) GROUP BY id) q ON m.id = q.id"
SQL["p5_texts"] = _P5.replace("HAVING count(DISTINCT key) > 1", "") + "SELECT table_name, w AS words, first_key, copies FROM g"
_LOW = r"nullif(array_to_string(regexp_extract_all(lower({}), '[\pL\pN]+'), ' '), '')"
SQL["p5_same_records"] = f"""
WITH r AS (SELECT DISTINCT table_name, key, w, y, f FROM (SELECT table_name, key, {_LOW.format('text')} AS w, {_LOW.format('type')} AS y,
    coalesce(list_sort(list_filter(list_transform(json_keys(m), lambda k: k || '=' || {_LOW.format("json_extract_string(m, '$.' || chr(34) || k || chr(34))")}), lambda x: x IS NOT NULL)), []) AS f
  FROM (SELECT table_name, key, text, type, CASE WHEN json_valid(metadata) THEN CASE WHEN json_type(metadata) = 'OBJECT' THEN CAST(metadata AS JSON) END END AS m FROM (
    SELECT 'units' AS table_name, unit_id AS key, text, type, metadata FROM units UNION ALL SELECT 'warrants', warrant_id, text, type, metadata FROM warrants))) WHERE w IS NOT NULL OR y IS NOT NULL OR len(f) > 0),
g AS (SELECT table_name, w, y, f, min(key) AS first_key, count(DISTINCT key) AS copies FROM r GROUP BY ALL HAVING count(DISTINCT key) > 1)
SELECT DISTINCT r.table_name, first_key, key AS copy_key, copies FROM r JOIN g ON r.table_name = g.table_name AND r.w IS NOT DISTINCT FROM g.w AND r.y IS NOT DISTINCT FROM g.y AND r.f = g.f WHERE key <> first_key"""
_ALONE = """SELECT 'claim' AS node_kind, claim_id AS node_key FROM extracted_claims UNION SELECT 'segment', segment_id FROM extracted_claims
  UNION SELECT 'segment', unnest(x) FROM (SELECT unnest(map_values(unit_segments)) AS x FROM merge_results)"""
SQL["p7_groups"] = f"SELECT coalesce(a.node_kind, g.node_kind) AS node_kind, coalesce(a.node_key, g.node_key) AS node_key, coalesce(g.group_key, a.node_key) AS group_key FROM (SELECT * FROM ({_ALONE}) WHERE node_key IS NOT NULL) a FULL JOIN ({SQL['p7_found']}) g ON a.node_kind = g.node_kind AND a.node_key = g.node_key"


def _looks_sql() -> str:
    """CTE z (doc_id, text, look): the appearance of each text, letter by letter.

    SQL has no table of what characters look like, so it takes one from Unicode's data, made here from the rules' own parts:
    what is shown as nothing, blanks, widths and joined letters, and letters of one shape. How they combine is SQL's.
    """
    import unicodedata

    pairs: list[tuple[str, str]] = []
    for code in (*range(0x80, 0x20000), *range(0xE0000, 0xE1000)):
        ch = chr(code)
        category = unicodedata.category(ch)
        if category in ("Cs", "Cn", "Co"):
            continue
        kind, _, parts = unicodedata.decomposition(ch).partition(" ")
        if any(low <= code <= high for low, high in lookalikes.IGNORABLE):
            pairs.append((ch, ""))
        elif category == "Zs":
            pairs.append((ch, " "))
        elif ch in lookalikes.LOOKALIKES:
            pairs.append((ch, lookalikes.LOOKALIKES[ch]))
        elif kind in ("<wide>", "<narrow>") or (kind == "<compat>" and category[0] == "L" and all(unicodedata.category(chr(int(x, 16)))[0] in "LM" for x in parts.split())):
            plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch))
            pairs.append((ch, "".join(lookalikes.LOOKALIKES.get(c, c) for c in plain)))
        elif set(apart := unicodedata.normalize("NFD", ch)) & lookalikes.LOOKALIKES.keys():
            pairs.append((ch, "".join(lookalikes.LOOKALIKES.get(c, c) for c in apart)))
    values = ", ".join(f"({ord(a)}, [{', '.join(str(ord(c)) for c in b)}])" for a, b in pairs)
    return f"""
WITH t AS (SELECT a, CAST(b AS INTEGER[]) AS b FROM (VALUES {values}) v(a, b)),
h AS (SELECT doc_id, text, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\\x00-\\x7f]')),
z AS (SELECT doc_id, text, nfc_normalize(string_agg(CASE WHEN t.a IS NULL THEN ch ELSE array_to_string(list_transform(t.b, lambda c: chr(c)), '') END, '' ORDER BY i)) AS look FROM h LEFT JOIN t ON unicode(ch) = t.a GROUP BY doc_id, text
  UNION ALL SELECT doc_id, text, text FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7f]'))
"""


SQL["p10_found"] = _looks_sql() + "SELECT DISTINCT least(x.doc_id, y.doc_id) AS doc_a, greatest(x.doc_id, y.doc_id) AS doc_b FROM z x JOIN z y ON x.look = y.look AND x.text <> y.text AND x.doc_id <> y.doc_id"
