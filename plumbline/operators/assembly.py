"""Putting parts to their parents: vertices to polylines, attributes to inserts, records to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_owner(children: DataFrame, owner: str, order: list[str], fields: list[str], name: str = "children") -> DataFrame:
    """(owner, n, <name>): each owner's children as an array in order."""
    own = F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return children.groupBy(owner).agg(F.count("*").alias("n"), own.alias(name))


def attached(parents: DataFrame, children: DataFrame, owner: str, order: list[str], fields: list[str], name: str = "children") -> DataFrame:
    """``parents`` (handle) with their children; an empty array where there are none."""
    own = by_owner(children, owner, order, fields, name).withColumnRenamed(owner, "handle").drop("n")
    kind = own.schema[name].dataType.simpleString()
    return parents.join(own, "handle", "left").withColumn(name, F.coalesce(F.col(name), F.expr(f"cast(array() as {kind})")))


def adjacent(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(handle, child): children whose handles follow a parent's without a gap.

    Handles less their rank are equal along a run, so a run is one group; a
    parent owns what is left of the run that the handle after its own is in.
    """
    c = children.select(F.col("handle").alias("child")).distinct()
    # ranks within blocks of handles, so that no window spans all rows; runs are put together across blocks
    block = F.floor(F.col("child") / 4096)
    c = c.withColumn("__b", block).withColumn("__g", F.col("child") - F.row_number().over(Window.partitionBy("__b").orderBy("child")))
    c = c.withColumn("hi", F.max("child").over(Window.partitionBy("__b", "__g"))).select("child", "hi")
    out = parents.select("handle").distinct().join(c, F.col("handle") + 1 == F.col("child")).select("handle", F.col("child").alias("lo"), "hi")
    done = out
    while True:
        # a run that reaches its block's end may go on in the next
        ends = out.where(F.col("hi") % 4096 == 4095)
        out = ends.alias("o").join(c.alias("r"), F.col("r.child") == F.col("o.hi") + 1).select("o.handle", F.col("r.child").alias("lo"), F.col("r.hi").alias("hi"))
        if not out.limit(1).count():
            break
        done = done.union(out)
    return done.select("handle", F.explode(F.sequence("lo", "hi")).alias("child"))


def until_end(rows: DataFrame, part: str, order: list[str], parent: str, child: str, handle: str = "handle") -> DataFrame:
    """(part, parent_handle, ...) of child rows that follow a parent with nothing but children between."""
    w = Window.partitionBy(part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    is_parent, is_child = F.expr(parent), F.expr(child)
    df = rows.withColumn("__i", F.row_number().over(w))
    df = df.withColumn("__p", F.last(F.when(is_parent, F.struct("__i", handle)), ignorenulls=True).over(upto))
    df = df.withColumn("__stop", F.max(F.when(~is_parent & ~is_child, F.col("__i"))).over(upto))
    keep = is_child & F.col("__p").isNotNull() & (F.coalesce(F.col("__stop"), F.lit(0)) < F.col("__p.__i"))
    return df.where(keep).select(*rows.columns, F.col(f"__p.{handle}").alias("parent_handle"))


def carried(rows: DataFrame, part: str, order: list[str], when: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the value of the last row up to here that satisfies ``when``."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(F.expr(when), F.expr(value)), ignorenulls=True).over(w))


def without_repeats(rows: DataFrame, part: str, order: list[str], x: str, y: str, eps: float = 1e-9) -> DataFrame:
    """``rows`` without those that lie within ``eps`` of the row before."""
    w = Window.partitionBy(part).orderBy(*order)
    same = (F.abs(F.col(x) - F.lag(x).over(w)) <= eps) & (F.abs(F.col(y) - F.lag(y).over(w)) <= eps)
    return rows.withColumn("__same", F.coalesce(same, F.lit(False))).where("not __same").drop("__same")


def jumps(rows: DataFrame, part: str, order: list[str], x: str, y: str) -> DataFrame:
    """``rows`` with ``jump``: the larger distance to the row before and the row after."""
    w = Window.partitionBy(part).orderBy(*order)
    far = lambda f: F.hypot(F.col(x) - f(x).over(w), F.col(y) - f(y).over(w))
    return rows.withColumn("jump", F.coalesce(F.greatest(far(F.lag), far(F.lead)), F.lit(0.0)))


def references(rows: DataFrame, known: DataFrame, refs: str, key: str) -> DataFrame:
    """(key, pos, handle, ...known): an array's handles that are known, in order, without the row's own and without repeats."""
    each = rows.select(key, F.posexplode(refs).alias("pos", "handle")).where(F.col("handle") != F.col(key))
    each = each.groupBy(key, "handle").agg(F.min("pos").alias("pos"))
    return each.join(known, "handle")


def reference_strategy(stream, scanned, confidence):
    """(refs, rule) as a struct: which of the decoded and scanned references to trust at a confidence of 0 to 100."""
    both = F.filter(stream, lambda r: F.array_contains(scanned, r))
    pick = lambda refs, rule: F.struct(refs.alias("refs"), F.lit(rule).alias("rule"))
    return (
        F.when(F.size(stream) == 0, pick(scanned, "scan-only"))
        .when(confidence >= 60, pick(stream, "stream"))
        .when((F.size(both) > 0) & (confidence >= 40), pick(both, "stream-overlap"))
        .when(F.size(both) > 0, pick(both, "stream-scan-overlap"))
        .when(confidence >= 40, pick(stream, "stream-mid"))
        .otherwise(pick(F.array().cast("array<bigint>"), "lowconf-drop"))
    )
