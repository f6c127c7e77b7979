"""Records that are equal but for spacing, case, marks or the order of their fields.

Each field is normalised to its words; every (field name, value) pair is hashed, and the hashes are added up
without regard to order, so that the order of fields does not matter. Records are grouped by the resulting
fingerprint of 122 bits; only hashes and keys are shuffled for that. Records of groups of two or more are
then compared, field by field, with the group's first record; any that differ (a collision) are grouped
again by their values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut

WORD = r"[\p{L}\p{N}]+"
_MASK = (1 << 61) - 1


def words(text: Column) -> Column:
    """The runs of Unicode letters and digits in lower case, one space between; null if there are none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))
    return F.when(F.size(found) > 0, F.concat_ws(" ", found))


def json_fields(text: Column) -> Column:
    """map of the top-level fields of a JSON object and their values as text; null where it is none."""
    return F.from_json(text, "map<string, string>")


def _multiset_hash(pairs: Column, seed: int) -> Column:
    one = lambda p: F.xxhash64(F.lit(seed), p["name"], p["value"]).bitwiseAND(F.lit(_MASK))
    return F.aggregate(F.transform(pairs, one), F.lit(0).cast("bigint"), lambda acc, x: (acc + x).bitwiseAND(F.lit(_MASK)))


def _named_in(column: str) -> Callable[[Column], Column]:
    return lambda e: F.struct(F.concat(F.lit(column), F.lit("."), e["key"]).alias("name"), words(e["value"]).alias("value"))


def fingerprinted(records: DataFrame, keys: list[str], fields: dict[str, Column], json_columns: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``f1``, ``f2`` and ``pairs`` (the normalised fields, null ones left out) of each record.

    Each field of an object in ``json_columns`` counts as a field of its own. Records with no field that has
    a word are left out.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in fields.items()])
    for c in json_columns:
        entries = F.coalesce(F.map_entries(json_fields(F.col(c))), F.array().cast("array<struct<key:string,value:string>>"))
        pairs = F.concat(pairs, F.transform(entries, _named_in(c)))
    out = records.select(*keys, F.filter(pairs, lambda p: p["value"].isNotNull()).alias("pairs")).where(F.size("pairs") > 0)
    return out.select(*keys, "pairs", _multiset_hash(F.col("pairs"), 1).alias("f1"), _multiset_hash(F.col("pairs"), 2).alias("f2"))


def _covers(a: str, b: str) -> Column:
    """All pairs of one record are among the other's; with equal numbers of distinct names that is equality."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def copy_groups(records: DataFrame, group: list[str], key: str, fields: dict[str, Column], json_columns: tuple[str, ...] = ()) -> DataFrame:
    """(group..., key, first_key) of each record that is equal to another one of its ``group`` columns' value.

    first_key is the smallest key of the equal records, which is in the result too. Deliveries of one key
    count once. Null keys are left out. Records are read and hashed once; heads of groups and their members are tables
    of their own, so that Spark can split a group with most of the records where they are joined.
    """
    rows = cut(fingerprinted(records.where(F.col(key).isNotNull()), [*group, key], fields, json_columns))
    fp = [*group, "f1", "f2"]
    heads = rows.groupBy(*fp).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key")).where("first_key <> last_key")
    copies = cut(rows.join(cut(heads.drop("last_key")), fp))
    first = cut(copies.where(F.col(key) == F.col("first_key")).groupBy(*fp).agg(F.min("pairs").alias("first_pairs")))
    checked = copies.join(first, fp).withColumn("same", _covers("pairs", "first_pairs"))
    good = checked.where("same").select(*group, key, "first_key").dropDuplicates()
    # only for what collides in all 122 bits are fields put in order, to group it by its values
    bad = checked.where("not same").select(*fp, key, F.array_sort("pairs").alias("pairs"))
    again = bad.groupBy(*fp, "pairs").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key")).where("first_key <> last_key")
    rescued = bad.join(again.drop("last_key"), [*fp, "pairs"]).select(*group, key, "first_key").dropDuplicates()
    return good.unionByName(rescued)


def copy_counts(groups: DataFrame, group: list[str], key: str) -> DataFrame:
    """One row per group of copies: first_key and the number of records."""
    return groups.groupBy(*group, "first_key").agg(F.count(key).alias("copies"))
