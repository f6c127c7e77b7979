"""Ranks within groups of any size, and plain functions over whole groups, many small ones at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.session import cut

#: Rows of results that are handed over at once.
OUT_ROWS = 20_000


def ordered_rank(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the rank from 0 within ``by`` along ``order``, also where one group has most rows.

    Rows are range-partitioned and ranked in their part; a part's ranks follow those of the parts before it. Null is a
    value of ``by`` like any other.
    """
    parts = cut(df.repartitionByRange(*by, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = parts.groupBy(*by, "_pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_pid").orderBy(*order)) - 1)
    starts = starts.withColumnsRenamed({c: f"_{c}" for c in by})
    met = F.lit(True)
    for c in by:
        met = met & ranked[c].eqNullSafe(starts[f"_{c}"])
    joined = ranked.join(starts.withColumnRenamed("_pid", "_part"), met & (F.col("_pid") == F.col("_part"))).drop("_part", *[f"_{c}" for c in by])
    return joined.withColumn(name, F.col("_start") + F.col("_r")).drop("_pid", "_start", "_r")


def per_group(df: DataFrame, by: str, order: list[str], schema: str, kernel: Callable[[list[tuple]], Iterable[tuple]]) -> DataFrame:
    """(by, schema) rows that ``kernel`` gives for the rows of each value of ``by``, sorted by ``order``.

    One shuffle brings a group together and a sort within partitions lines groups up, so a task walks through
    its groups batch by batch; what a group costs is the kernel, not a data frame of its own. A group is held
    in memory of one task: callers send only groups here whose result is one task's work by definition. Small partitions
    are merged by adaptive execution. Column ``by`` comes first in each tuple, the others in the order of ``df``.
    """
    columns = [by, *[c for c in df.columns if c != by]]
    # by a hash of the key, not the key: after a union of inputs that each are partitioned by it already, Spark would
    # leave a shuffle by the key itself out, and adaptive execution may then merge the inputs' partitions unlike
    rows = df.select(*columns).repartition(F.xxhash64(by)).sortWithinPartitions(by, *order)
    kind = df.schema[by].dataType.simpleString()
    names = [by, *[x.strip().split(" ")[0] for x in schema.split(", ")]]

    def tuples(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        return chain.from_iterable(zip(*[b[c].tolist() for c in columns], strict=True) for b in batches)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for key, group in groupby(tuples(batches), key=itemgetter(0)):
            out += [(key, *x) for x in kernel(list(group))]
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, f"{by} {kind}, {schema}")
