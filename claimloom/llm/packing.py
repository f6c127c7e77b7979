"""Filling containers of fixed capacity with items, planned over the histogram of lengths.

Best fit by decreasing length places counts, not items: all items of one length go at once into the fullest
containers they fit in. Containers are kept as runs with equal free space, so the plan's work and size depend
on the number of different lengths (at most the capacity), never on the number of items. Items then take
their planned slots by their rank among the items of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.session import cut

PLAN_SCHEMA = "length int, first_rank bigint, last_rank bigint, per_container int, first_container bigint, first_offset int"


def plan(histogram: dict[int, int], capacity: int, first_container: int = 0) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(slots, number of containers) for ``histogram`` of lengths from 1 to ``capacity``.

    A slot run (length, first_rank, last_rank, per_container, first_container, first_offset): the items of
    that length with these ranks stand ``per_container`` to a container, in consecutive containers, from
    ``first_offset`` on.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first container, number)
    free: list[int] = []  # the keys of runs, ascending
    opened = first_container

    def put_back(space: int, first: int, number: int) -> None:
        if number and space:
            if space not in runs:
                runs[space] = []
                insort(free, space)
            runs[space].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, number = runs[space].pop()
                if not runs[space]:
                    del runs[space]
                    free.pop(at)
            else:
                per = capacity // length
                space, first, number = capacity, opened, -(-left // per)
                opened += number
            per = space // length
            full = min(number, left // per)
            if full:
                slots.append((length, rank, rank + full * per - 1, per, first, capacity - space))
                put_back(space - per * length, first, full)
                rank, left, first, number = rank + full * per, left - full * per, first + full, number - full
            if number and left and left < per:
                slots.append((length, rank, rank + left - 1, left, first, capacity - space))
                put_back(space - left * length, first, 1)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            put_back(space, first, number)
    return slots, opened - first_container


#: Plans and part sizes of up to so many rows are broadcast; longer ones are joined as they are.
SMALL = 200_000


def _ranks(items: DataFrame, by: str) -> DataFrame:
    """Adds ``rank`` from 0 within ``by``, also where one value of ``by`` has most rows.

    Rows are spread by ranges of (by, a hash) and sorted in their part, so the place within the part, less that of the
    value's first row, is the rank within value and part; the ranks of a part follow those of the parts before it. Ranges
    share a value only at their borders: there are no more (value, part) pairs than values and parts together.
    """
    place = F.monotonically_increasing_id()
    spread = items.repartitionByRange(F.col(by), F.xxhash64(*items.columns)).sortWithinPartitions(by)
    placed = cut(spread.withColumn("_at", place).withColumn("_part", F.shiftright("_at", 33)))
    sizes = placed.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select(by, "_part", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    starts = F.broadcast(starts) if starts.count() <= SMALL else starts
    return placed.join(starts, [by, "_part"]).withColumn("rank", F.col("_start") + F.col("_at") - F.col("_from")).drop("_part", "_start", "_from", "_at")


def pack(spark: SparkSession, items: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """Assigns every item to a container: (key, piece, container_id, start, length, item_start).

    An item longer than the capacity is cut into full pieces, each a container of its own, and a rest that is
    packed like an item; all others are one piece 0. ``start`` is the place in the container, ``item_start``
    that in the item. Items of size 0 or null take no space and are spread over the containers (container 0
    if there is none). Repeated keys are separate items. An empty table gives no rows. Only the histogram,
    of at most ``capacity`` lengths, comes to the driver; what is made from it is broadcast if it has no more than SMALL rows.
    """
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    items = items.select(F.col(key), n.alias("_n"))
    full = F.floor(F.col("_n") / F.lit(capacity)).cast("int")
    rest = F.col("_n") - full * F.lit(capacity)
    # a multiple of the capacity has no rest; an empty item is one piece of nothing
    last = F.when((rest > 0) | (full == 0), F.array(full)).otherwise(F.array().cast("array<int>"))
    pieces = F.concat(F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>")), last)
    cutting = items.select(key, "_n", F.explode(pieces).alias("piece"))
    length = F.least(F.lit(capacity), F.col("_n") - F.col("piece") * F.lit(capacity)).cast("int")
    made = cut(cutting.select(key, "piece", length.alias("length")))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, number = plan({k: v for k, v in histogram.items() if k > 0}, capacity)
    table = spark.createDataFrame(slots, PLAN_SCHEMA)
    table = F.broadcast(table) if len(slots) <= SMALL else table
    ranked = _ranks(made, "length")
    within = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") <= F.col("last_rank"))
    placed = ranked.alias("x").join(table.alias("t"), (F.col("x.length") == F.col("t.length")) & within, "left")
    step = F.col("rank") - F.col("first_rank")
    container = F.when(F.col("x.length") == 0, F.pmod(F.col("rank"), F.lit(max(1, number)))).otherwise(F.col("first_container") + F.floor(step / F.col("per_container")))
    start = F.when(F.col("x.length") == 0, F.lit(0)).otherwise(F.col("first_offset") + F.pmod(step, F.col("per_container")) * F.col("x.length"))
    return placed.select(
        key, "piece", container.cast("bigint").alias("container_id"), start.cast("int").alias("start"),
        F.col("x.length").alias("length"), (F.col("piece").cast("bigint") * capacity).alias("item_start"),
    )
