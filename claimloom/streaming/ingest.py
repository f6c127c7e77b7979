"""Streams of graph payloads: exactly-once ingest into the corpus tables, and counts of what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.operators.corpus import SCHEMAS
from claimloom.session import cut, release
from claimloom.sources.graph_json import decoded_parts, table_of


def ingest_payloads(stream: DataFrame, key: str, payload: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Decodes each micro-batch once and appends it to ``folder/<table>/batch=N``.

    A batch that is run again overwrites its own folders, so the tables hold every payload once.
    """

    def write(batch: DataFrame, number: int) -> None:
        parts = cut(decoded_parts(batch, key, payload))
        for name in SCHEMAS:
            table_of(parts, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        release(parts)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def payload_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def arrivals(stream: DataFrame, at: str = "loaded_at", every: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per window of arrival time, with rows later than the watermark left out of closed windows."""
    when = F.col(at).cast("timestamp")
    return stream.withColumn("_at", when).withWatermark("_at", late).groupBy(F.window("_at", every).alias("w")).agg(F.count("*").alias("rows")).select("w.start", "w.end", "rows")
