"""Colour resolution: entity style, then layer, with the override rule for layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Indexes that defer to the layer or block.
DEFERRED = (0, 256, 257)


def deferred(index: Column) -> Column:
    return index.isNull() | index.isin(*DEFERRED)


def normal(index: Column, true_color: Column) -> tuple[Column, Column]:
    """A true colour of 1..257 beside a deferring index is really an index."""
    is_index = deferred(index) & true_color.between(1, 257)
    return F.when(is_index, true_color.cast("int")).otherwise(index), F.when(~F.coalesce(is_index, F.lit(False)), true_color)


def resolved(entities: DataFrame, layers: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``entities`` with ``resolved_index`` and ``resolved_true_color``.

    An entity whose index defers and that has no true colour takes its
    layer's colour, an overridden layer's first; unknown layers change
    nothing. ``overrides`` (handle, color_index) has at most two rows.
    """
    own = layers.groupBy(F.col("handle").alias("layer_handle")).agg(F.min(F.struct("color_index", "true_color")).alias("__layer"))
    df = entities.join(own, "layer_handle", "left")
    index, true = F.col("__layer.color_index"), F.col("__layer.true_color")
    if overrides is not None:
        df = df.join(F.broadcast(overrides.select(F.col("handle").alias("layer_handle"), F.col("color_index").alias("__over")).limit(2)), "layer_handle", "left")
        index, true = F.coalesce("__over", index), F.when(F.col("__over").isNull(), true)
    by_layer = deferred(F.col("color_index")) & F.col("true_color").isNull() & F.col("__layer").isNotNull()
    index, true = normal(F.when(by_layer, index).otherwise(F.col("color_index")), F.when(by_layer, true).otherwise(F.col("true_color")))
    df = df.withColumn("__index", index).withColumn("__true", true)
    return df.select(*entities.columns, F.col("__index").alias("resolved_index"), F.col("__true").alias("resolved_true_color"))


def layer_overrides(entities: DataFrame, layers: DataFrame, version: str) -> DataFrame:
    """(handle, color_index): none or two layers whose colours are to be swapped.

    From AC1024 on: if the busiest grey (9) layer holds at least 16 and a third of at
    least 40 entities, the idlest blue (5) layer none, and the first white (7)
    layer any, then the grey one turns blue and the white one grey.
    """
    usage = entities.groupBy(F.col("layer_handle").alias("handle")).agg(F.count("*").alias("n"))
    total = usage.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    index, _ = normal(F.col("color_index"), F.col("true_color"))
    used = layers.select("handle", index.alias("color_index")).join(usage, "handle", "left").fillna(0, ["n"])
    pick = used.agg(
        F.max_by(F.struct("handle", "n"), F.when(F.col("color_index") == 9, F.struct(F.col("n"), -F.col("handle")))).alias("grey"),
        F.min(F.when(F.col("color_index") == 5, F.col("n"))).alias("blue"),
        F.min(F.when(F.col("color_index") == 7, F.struct("handle", "n"))).alias("white"),
    ).join(F.broadcast(total))  # one row each
    fits = (F.col("total") >= 40) & (F.col("grey.n") >= F.greatest(F.lit(16), F.floor(F.col("total") / 3))) & (F.col("blue") == 0) & (F.col("white.n") > 0) & F.lit(version in ("AC1024", "AC1027", "AC1032"))
    rows = F.array(F.struct(F.col("grey.handle").alias("handle"), F.lit(5).alias("color_index")), F.struct(F.col("white.handle").alias("handle"), F.lit(9).alias("color_index")))
    return pick.where(fits).select(F.explode(rows).alias("r")).select("r.*")
