"""Streams of entities: files that keep arriving in a folder.

An extension beside the batch engine: counts by type over windows of time with
late rows up to a watermark, and the latest record of each handle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """Rows of parquet files as they come to lie in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(rows: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by, n) of tumbling windows; state goes once the watermark has passed a window."""
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks take no timestamps without zone
    w = F.window(ts, size)
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; on a stream the result is updated in place."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
