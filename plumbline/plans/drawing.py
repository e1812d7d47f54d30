"""A drawing as a set of DataFrames, and a projection of the star schema onto one."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import colours, graph, select
from plumbline.plans import catalogue
from plumbline.session import table

#: Types that the projection deals to line items by part.
DEALT = ("LINE", "ARC", "CIRCLE", "POINT", "LWPOLYLINE", "TEXT", "MTEXT", "INSERT", "DIM_LINEAR", "DIM_RADIUS", "HATCH", "VERTEX_2D")


@dataclass(frozen=True)
class Drawing:
    """Tables of one or many drawings.

    entities(handle, off, dxftype, layer_handle, owner_handle, entmode,
    color_index, true_color, x, y, ...), layers(handle, name, color_index,
    true_color), blocks(handle, name, off), header(name, value).
    """

    entities: DataFrame
    layers: DataFrame
    blocks: DataFrame
    space: str = "ENTITIES"

    def layout(self, name: str) -> Drawing:
        """A view on MODELSPACE, PAPERSPACE or all ENTITIES."""
        return replace(self, space=name.upper())

    def modelspace(self) -> Drawing:
        return self.layout("MODELSPACE")

    def query(self, types=None, styles: bool = True) -> DataFrame:
        """Entities of the requested types in this layout, with their type's canonical name, rank and resolved colours.

        With ``styles=False`` the join with the layers is left out. A plan
        needs the present types only for wildcards and for "all"; rows then
        are matched by the catalogue, so no job runs to find them.
        """
        wanted = catalogue.planned(types)
        df = select.of_types(self.entities, wanted)
        if self.space != "ENTITIES":
            df = select.layout(df, self.blocks, self.space)
        return colours.resolved(df, self.layers) if styles else df

    def present_types(self, explicit_only: bool = False) -> DataFrame:
        """(dxftype, rank) of the types that occur, in catalogue order."""
        return select.present(self.entities, explicit_only)

    def edges(self) -> DataFrame:
        """The reference graph: (src, kind, dst)."""
        return graph.edges(self.entities, self.blocks)

    def views(self, prefix: str = "") -> None:
        """Registers the tables for SQL."""
        for name in ("entities", "layers", "blocks"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def _dealt() -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in DEALT]), (F.col("l_partkey") % len(DEALT) + 1).cast("int"))


def projection(spark: SparkSession, sf_dir: str) -> Drawing:
    """The drawing that line items, orders and suppliers stand for.

    A line item is an entity on its supplier's layer, owned by its order;
    handles repeat where order and line number do.
    """
    items, orders, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    part, key, no = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    entities = items.select(
        (key * 8 + no).alias("handle"),
        (part * 1000000 + F.col("l_suppkey")).alias("off"),
        _dealt().alias("dxftype"),
        F.col("l_suppkey").alias("layer_handle"),
        key.alias("owner_handle"),
        (no % 4).alias("entmode"),
        (part % 258).cast("int").alias("color_index"),
        F.when(part % 7 == 0, part * 65793 % 16777216).alias("true_color"),
        F.col("l_extendedprice").alias("x"),
        F.col("l_quantity").alias("y"),
        (F.col("l_discount") * 100).alias("size"),
        (F.col("l_tax") * 1000).alias("angle"),
        part.alias("part"),
        no.alias("number"),
    )
    layers = suppliers.select(F.col("s_suppkey").alias("handle"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 10).alias("color_index"), F.when(F.col("s_suppkey") % 11 == 0, F.col("s_suppkey") * 7919 % 16777216).alias("true_color"))
    o = F.col("o_orderkey")
    name = F.when(o % 5 == 0, F.lit("*Model_Space")).when(o % 5 == 1, F.concat(F.lit("*Paper_Space"), (o % 3).cast("string"))).when(o % 5 == 2, F.lit("*U")).when(o % 5 == 3, F.concat(F.lit("BLOCK"), F.col("o_custkey").cast("string"))).otherwise(F.lit("*D"))
    blocks = orders.where(o % 7 != 6).select(o.alias("handle"), name.alias("name"), (F.col("o_custkey") * 100000 + o).alias("off"))
    return Drawing(entities, layers, blocks)


#: The same projection for DuckDB: CTEs ent, lay and blk.
SQL = f"""
ent AS (SELECT l_orderkey * 8 + l_linenumber AS handle, l_partkey * 1000000 + l_suppkey AS off, {list(DEALT)!r}[l_partkey % {len(DEALT)} + 1] AS dxftype, l_suppkey AS layer_handle,
  l_orderkey AS owner_handle, l_linenumber % 4 AS entmode, CAST(l_partkey % 258 AS INTEGER) AS color_index, CASE WHEN l_partkey % 7 = 0 THEN l_partkey * 65793 % 16777216 END AS true_color,
  l_extendedprice AS x, l_quantity AS y, l_discount * 100 AS size, l_tax * 1000 AS angle, l_partkey AS part, l_linenumber AS number FROM lineitem),
lay AS (SELECT s_suppkey AS handle, s_name AS name, s_nationkey % 10 AS color_index, CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey * 7919 % 16777216 END AS true_color FROM supplier),
blk AS (SELECT o_orderkey AS handle, CASE o_orderkey % 5 WHEN 0 THEN '*Model_Space' WHEN 1 THEN concat('*Paper_Space', o_orderkey % 3) WHEN 2 THEN '*U' WHEN 3 THEN concat('BLOCK', o_custkey) ELSE '*D' END AS name,
  o_custkey * 100000 + o_orderkey AS off FROM orders WHERE o_orderkey % 7 <> 6)
"""
