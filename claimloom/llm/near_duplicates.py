"""Pairs of texts whose token sets are similar, by a signature-coordinate inverted join.

Records with the same token set form one class, and only classes are compared. The tokens of a class are
hashed into m buckets; the signature has one coordinate per bucket, whose value is a hash of the tokens in
it. Two sets that differ in D tokens differ in at most D coordinates, so a pair above the similarity agrees
on at least m - D of them: a match threshold that no pair can miss, other than with sampled signatures.

Classes are posted under their (coordinate, value) elements, and collisions are counted, in two steps. First the
prefix: if two sets of m elements share T of them, their m - T + l rarest elements (in one order for all) share l; the
long lists of frequent elements, made of words that every text has, are skipped. Posted are the l-combinations of these
elements, so that a list holds only classes that collide at least l times. Then, for each pair that met, the collisions
of all coordinates are counted, those of the skipped lists too, on the signatures (four bytes a coordinate); pairs with
at least m - D are checked on their token hashes.

Sizes: a pair (a <= b) needs a >= t * b, so sizes are cut into intervals [x, x / t] and a class has a signature in
its own interval and, if a partner can be there, in the next. m, D and l are functions of the interval, so both sides
of a pair use the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut

TOKEN = "[a-zA-Z0-9]+"


@dataclass(frozen=True)
class SimilarityJoin:
    """Parameters of the join.

    threshold: least Jaccard similarity, as an exact fraction.
    buckets_per_token: coordinates per token of the largest set of an interval, where more than needed.
    pair_limit: where prefixes of an interval are longer than this, l is 1, else 2: the number of l-combinations of a
        prefix stays below a few hundred or its length, and nothing is lost either way.
    """

    threshold: Fraction = Fraction(4, 5)
    buckets_per_token: float = 0.3
    pair_limit: int = 24

    def intervals(self) -> list[tuple[int, int]]:
        """[first, last] set size of each interval, up to sizes beyond any text."""
        out, low = [], 1
        while low < 2**30:
            high = int(low / self.threshold)
            out.append((low, high))
            low = high + 1
        return out

    def max_difference(self, total: int) -> int:
        """Largest symmetric difference of two sets of ``total`` tokens together at the threshold."""
        return int(total * (1 - self.threshold) / (1 + self.threshold))

    def collisions(self, high: int) -> int:
        """l of an interval that ends at ``high``."""
        return 1 if self.max_difference(2 * high) + 2 > self.pair_limit else 2

    def coordinates(self, high: int) -> int:
        """m of an interval that ends at ``high``."""
        wanted = -int(-high * self.buckets_per_token // 1)
        difference = self.max_difference(2 * high)
        if self.collisions(high) == 1:
            return difference + max(1, difference // 4)
        return max(difference + 2, wanted)


def token_set(text: Column) -> Column:
    """Sorted distinct runs of [a-zA-Z0-9] of the lower-cased text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))))


def classes(records: DataFrame, table: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of records with equal token sets.

    members: (id, tbl, key), each record once. classes: (id, tbl, n, tokens), n counting rows (deliveries of
    one record too) and tokens as hashes that differ between tables; they are written down, so that the numbers
    in ``id`` stay. Null texts and texts without tokens are left out.
    """
    rows = records.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(table).alias("tbl"), F.col(key).alias("key"), token_set(F.col(text)).alias("t")).where(F.size("t") > 0)
    tokens = F.transform("t", lambda x: F.xxhash64("tbl", x))
    rows = cut(rows.select("tbl", "key", F.unhex(F.md5(F.concat_ws(" ", "t"))).alias("cls"), tokens.alias("tokens")))
    # the tokens follow from the class; as a grouping key they keep the aggregation a hash aggregation
    found = rows.groupBy("tbl", "cls", "tokens").agg(F.count("*").alias("n"))
    found = cut(found.select(F.monotonically_increasing_id().alias("id"), "tbl", "cls", "n", "tokens"))
    members = rows.select("tbl", "cls", "key").join(found.select("tbl", "cls", "id"), ["tbl", "cls"]).select("id", "tbl", "key").dropDuplicates()
    return members, found.drop("cls")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit values in which every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(found: DataFrame, p: SimilarityJoin) -> DataFrame:
    """(cid, size, e) of each class in each of its intervals: the m elements e of its signature, in the order of buckets.

    cid is 128 times the class's id plus the interval's number. A bucket without tokens has an element too, the same for all. Rows are worked on in
    slices of about a million tokens.
    """
    cuts = p.intervals()
    whole = 2**31 - 1
    lows = np.array([low for low, _ in cuts] + [2**62], dtype=np.int64)
    counts = np.array([min(p.coordinates(high), whole) for _, high in cuts] + [whole], dtype=np.int64)
    num, den = p.threshold.numerator, p.threshold.denominator

    def part(ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> list[pa.Array]:
        k = np.searchsorted(lows, sizes, side="right") - 1
        also = np.flatnonzero(sizes * den // num >= lows[k + 1])
        row = np.concatenate([np.arange(len(ids)), also])
        j = np.concatenate([k, k[also] + 1])
        m, n = counts[j], sizes[row]
        place = np.cumsum(m) - m
        begin = np.cumsum(sizes) - sizes
        # the tokens of each signature, one signature after the other
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[row], n)
        with np.errstate(over="ignore"):
            of = np.repeat(np.arange(len(row)), n)
            h = _mixed(tokens.view(np.uint64)[at] + (j[of].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            slot = place[of] + (h % m[of].astype(np.uint64)).astype(np.int64)
            value = np.zeros(int(m.sum()), dtype=np.uint64)
            np.add.at(value, slot, _mixed(h))
            bucket = np.arange(len(value)) - np.repeat(place, m)
            e = _mixed(value + (np.repeat(j, m).astype(np.uint64) << np.uint64(40)) + bucket.astype(np.uint64)).view(np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32))
        return [pa.array(ids[row] * 128 + j), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            tokens = lists.values.to_numpy()
            step = np.searchsorted(ends, np.arange(ends[0], ends[-1], 1_000_000), side="left").tolist() + [len(ids)]
            for a, b in zip(step, step[1:], strict=False):
                if a < b:
                    yield pa.RecordBatch.from_arrays(part(ids[a:b], np.diff(ends[a : b + 1]), tokens[ends[a] : ends[b]]), ("cid", "size", "e"))

    return found.select("id", "tokens").mapInArrow(run, "cid bigint, size int, e array<bigint>")


def _postings(signed: DataFrame, p: SimilarityJoin) -> DataFrame:
    """(g, cid, size) lists of classes under combinations of their rarest elements."""
    cuts = p.intervals()
    num, den = p.threshold.numerator, p.threshold.denominator
    whole = 2**31 - 1
    highs = F.array(*[F.lit(min(high, whole)) for _, high in cuts])
    taken = F.array(*[F.lit(p.collisions(high)) for _, high in cuts])
    counts = F.array(*[F.lit(min(p.coordinates(high), whole)) for _, high in cuts])
    elements = signed.select("cid", "size", F.explode("e").alias("e"))
    often = cut(elements.groupBy("e").agg(F.count("*").alias("c")).where("c > 1"))
    ranked = elements.join(often, "e").groupBy("cid", "size").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("own"))
    # a class of this size differs from any partner in at most d tokens
    j = F.pmod("cid", F.lit(128)).cast("int")
    largest = F.floor(F.col("size").cast("long") * den / num)
    total = F.col("size").cast("long") + F.least(F.get(highs, j).cast("long"), largest)
    # what one class alone has comes first in the order and collides with nothing
    alone = F.get(counts, j) - F.size("own")
    head = F.floor(total * (den - num) / (den + num)).cast("int") + F.get(taken, j) - alone
    l = F.get(taken, j)  # noqa: E741
    shared = ranked.withColumn("l", l).withColumn("x", F.slice("own.e", F.lit(1), F.greatest(F.lit(0), head))).where(F.size("x") >= F.col("l"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.xxhash64(a, b))))
    groups = F.when(F.col("l") == 1, F.col("x")).otherwise(pairs)
    return shared.select("cid", "size", F.explode(groups).alias("g"))


def similar_classes(found: DataFrame, p: SimilarityJoin = SimilarityJoin()) -> DataFrame:
    """(id_a, id_b) of different classes with similarity of at least the threshold, each pair once, id_a < id_b.

    No pair is lost: a hot list of postings is joined in parts by Spark's skew handling, and there is no cap.
    """
    num, den = p.threshold.numerator, p.threshold.denominator
    lows = F.array(*[F.lit(low) for low, _ in p.intervals()])
    signed = cut(signatures(found, p))
    posts = _postings(signed, p)
    a = posts.select("g", F.col("cid").alias("cid_a"), F.col("size").alias("size_a"))
    b = posts.select("g", F.col("cid").alias("cid_b"), F.col("size").alias("size_b"))
    larger = F.greatest("size_a", "size_b")
    j = F.pmod("cid_a", F.lit(128)).cast("int")
    # each pair counts in the interval of its larger class only
    fits = (F.least("size_a", "size_b") * den >= larger * num) & (larger >= F.get(lows, j))
    met = a.join(b, "g").where((F.col("cid_a") < F.col("cid_b")) & fits).select("cid_a", "cid_b").dropDuplicates()
    # the match threshold, over all coordinates
    own = lambda x: signed.select(F.col("cid").alias(f"cid_{x}"), F.col("size").alias(f"size_{x}"), F.transform("e", lambda v: F.shiftright(v, 32).cast("int")).alias(f"s_{x}"))
    met = met.join(own("a"), "cid_a").join(own("b"), "cid_b")
    agree = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    most = F.floor((F.col("size_a") + F.col("size_b")).cast("long") * (den - num) / (den + num))
    met = met.where(agree >= F.size("s_a") - most).select(F.shiftright("cid_a", 7).alias("id_a"), F.shiftright("cid_b", 7).alias("id_b"))
    sets = found.select("id", "tokens")
    met = met.join(sets.select(F.col("id").alias("id_a"), F.col("tokens").alias("t_a")), "id_a")
    met = met.join(sets.select(F.col("id").alias("id_b"), F.col("tokens").alias("t_b")), "id_b")
    both = F.size(F.array_intersect("t_a", "t_b"))
    return met.where(both * den >= (F.size("t_a") + F.size("t_b") - both) * num).select("id_a", "id_b")


def near_duplicates(records: DataFrame, table: str = "tbl", key: str = "key", text: str = "text", p: SimilarityJoin = SimilarityJoin()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): records by class, classes with their number of records, and similar pairs of classes."""
    members, found = classes(records, table, key, text)
    return members, found, similar_classes(found, p)


def expand_pairs(members: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """(tbl, key_a, key_b) of all records that are alike, within a class and across linked classes, key_a < key_b."""
    many = found.where("n > 1").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    ends = links.unionByName(many).join(members.select(F.col("id").alias("id_a"), "tbl", F.col("key").alias("x")), "id_a")
    ends = ends.join(members.select(F.col("id").alias("id_b"), F.col("key").alias("y")), "id_b")
    ends = ends.where("(id_a <> id_b or x < y) and x <> y")
    return ends.select("tbl", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
