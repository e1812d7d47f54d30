"""Which entities a query returns: types, layouts, lookups in request order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans import catalogue


def canonical(raw: Column) -> Column:
    """The catalogue name of a raw type name; null for unknown types."""
    name = F.upper(F.trim(raw))
    name = F.when(name.startswith("DIM_"), F.lit("DIMENSION")).otherwise(name)
    return F.when(name.isin(*catalogue.TYPES), name)


def rank(name: Column) -> Column:
    """The place of a type in the catalogue, from 1."""
    return F.array_position(F.array(*[F.lit(t) for t in catalogue.TYPES]), name)


def of_types(entities: DataFrame, wanted: list[str]) -> DataFrame:
    """Entities of the wanted types, with ``type_rank`` by the order of the request; an empty plan gives no rows.

    Raw names are tested as they are stored, so that the scan can filter.
    """
    raw = [t for t in (*catalogue.TYPES, "DIM_LINEAR", "DIM_RADIUS", "DIM_DIAMETER", "DIM_ORDINATE", "DIM_ALIGNED", "DIM_ANG3PT", "DIM_ANG2LN") if catalogue.canonical(t) in wanted]
    df = entities.where(F.col("dxftype").isin(*raw)).withColumn("dxftype", canonical(F.col("dxftype")))
    return df.withColumn("type_rank", F.array_position(F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>"), F.col("dxftype")))


def present(entities: DataFrame, explicit_only: bool = False) -> DataFrame:
    """(dxftype, rank) of the canonical types that occur."""
    df = entities.select(canonical(F.col("dxftype")).alias("dxftype")).where("dxftype is not null").distinct()
    df = df if explicit_only else df.where(~F.col("dxftype").isin(*sorted(catalogue.EXPLICIT_ONLY)))
    return df.withColumn("rank", rank(F.col("dxftype")))


def spaced(entities: DataFrame, blocks: DataFrame, space: str = "space") -> DataFrame:
    """``entities`` with the column ``space``: MODELSPACE, PAPERSPACE or BLOCK.

    Entity mode 2 is model, 1 is paper. Mode 0 goes by the owner's name: a
    model or paper space block, any other block record (then it belongs to
    neither), or an owner that is no block (then model). What has no placement
    is kept in model space.
    """
    names = blocks.select(F.col("handle").alias("owner_handle"), F.upper(F.trim("name")).alias("__name")).dropDuplicates(["owner_handle"])
    df = entities.join(names, "owner_handle", "left")
    owner = F.col("__name")
    space_of = F.when(F.col("entmode") == 2, F.lit("MODELSPACE")).when(F.col("entmode") == 1, F.lit("PAPERSPACE"))
    space_of = space_of.when((F.col("entmode") == 0) & owner.isNotNull() & (F.col("owner_handle") != 0), F.when(owner == "*MODEL_SPACE", F.lit("MODELSPACE")).when(owner.startswith("*PAPER_SPACE"), F.lit("PAPERSPACE")).otherwise(F.lit("BLOCK")))
    return df.select(*entities.columns, F.coalesce(space_of, F.lit("MODELSPACE")).alias(space))


def layout(entities: DataFrame, blocks: DataFrame, space: str) -> DataFrame:
    """Entities of MODELSPACE or PAPERSPACE."""
    return spaced(entities, blocks, "__space").where(F.col("__space") == space).drop("__space")


def by_request(rows: DataFrame, requested: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Rows of the requested keys with the place of the first request; keys requested again count once."""
    first = requested.groupBy(key).agg(F.min(pos).alias(pos))
    return rows.join(first, key)


def skipped(entities: DataFrame, writable: tuple[str, ...] = catalogue.WRITABLE) -> DataFrame:
    """(dxftype, written, skipped): how many entities of each type a sink takes and leaves."""
    name = F.coalesce(canonical(F.col("dxftype")), F.upper(F.trim("dxftype")))
    fits = F.col("dxftype").isin(*writable)
    return entities.select(name.alias("dxftype")).groupBy("dxftype").agg(F.count_if(fits).alias("written"), F.count_if(~fits).alias("skipped"))


def finite(*columns: str, most: float = 1e12) -> Column:
    """All columns are finite and at most ``most`` in size."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) <= most) for c in columns])


def block_references(entities: DataFrame, inside: str, least: int = 32, reduction: float = 0.5) -> DataFrame:
    """``entities`` without the inserts that aren't ``inside``, if there are ``least`` inserts, some of them inside, and at least the share ``reduction`` isn't; else all."""
    ref, within = F.coalesce(F.col("dxftype").isin("INSERT", "MINSERT"), F.lit(False)), F.coalesce(F.col(inside), F.lit(False))
    rule = entities.agg(F.count_if(ref).alias("__n"), F.count_if(ref & within).alias("__in"))
    use = (F.col("__n") >= least) & (F.col("__in") > 0) & (F.col("__in") <= F.col("__n") * (1 - reduction))
    return entities.crossJoin(F.broadcast(rule.select(use.alias("__use")))).where(~ref | within | ~F.col("__use")).drop("__use")
