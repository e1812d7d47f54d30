"""Deduplication by computed keys, with explicit tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_key(text: str = "text", x: str = "x", y: str = "y", size: str = "size") -> list[Column]:
    """The key of a recovered text: stripped, and its place and height in thousandths, rounded half to even."""
    return [F.trim(text).alias("k_text"), *[F.bround(F.col(c) * 1000).cast("long").alias(f"k_{c}") for c in (x, y, size)]]


def by_source(rows: DataFrame, keys: list[str], rank: str, order: list[str]) -> DataFrame:
    """All rows of source rank 0, and of the others the first of each key that no better source has."""
    w = Window.partitionBy(*keys)
    df = rows.withColumn("__best", F.min(rank).over(w)).withColumn("__n", F.row_number().over(w.orderBy(rank, *order)))
    return df.where((F.col(rank) == 0) | ((F.col("__best") == F.col(rank)) & (F.col("__n") == 1))).drop("__best", "__n")


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def exact(rows: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """Rows that differ in nothing but beyond ``digits`` decimals count once."""
    kinds = dict(rows.dtypes)
    canon = F.to_json(F.struct(*[(F.bround(c, digits) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in sorted(rows.columns) if c not in keys]))
    return rows.withColumn("__json", canon).dropDuplicates([*keys, "__json"]).drop("__json")


def line_signature(x1: str, y1: str, x2: str, y2: str, digits: int = 3) -> Column:
    """A line's rounded ends in an order that doesn't depend on its direction."""
    p = lambda x, y: F.struct(F.bround(x, digits).alias("x"), F.bround(y, digits).alias("y"))
    return F.sort_array(F.array(p(x1, y1), p(x2, y2)))


def merged_dimensions(rows: DataFrame) -> DataFrame:
    """One row for each handle: any other subtype beats DIM_LINEAR, then the earlier offset counts."""
    return first_of(rows, ["handle"], [F.col("dxftype") == "DIM_LINEAR", "off"])
