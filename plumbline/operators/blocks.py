"""Blocks: flattening nested inserts, and names that go together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut


def flattened(roots: DataFrame, inserts: DataFrame, members: DataFrame, depth: int = 8) -> DataFrame:
    """(root, depth, id, px, py): the members of each root's block and of the blocks inserted in it, where the inserts put them.

    roots (root, block); inserts (block, child, x, y, sx, sy, rotation);
    members (block, id, x, y). Each level joins once with the inserts and
    composes their affine maps; levels beyond ``depth`` are left out, which also
    ends cycles.
    """
    cos, sin = F.cos(F.radians("rotation")), F.sin(F.radians("rotation"))
    steps = inserts.select("block", "child", F.col("x").alias("ix"), F.col("y").alias("iy"), (F.col("sx") * cos).alias("p"), (-F.col("sy") * sin).alias("q"), (F.col("sx") * sin).alias("r"), (F.col("sy") * cos).alias("s"))
    front = cut(roots.select("root", "block", *[F.lit(v).alias(n) for n, v in (("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 1.0), ("tx", 0.0), ("ty", 0.0))]))
    levels = []
    for n in range(depth + 1):
        levels.append(front.withColumn("depth", F.lit(n)))
        if n == depth:
            break
        c = F.col
        front = cut(front.join(steps, "block").select(
            "root", c("child").alias("block"),
            (c("a") * c("p") + c("b") * c("r")).alias("a"), (c("a") * c("q") + c("b") * c("s")).alias("b"), (c("c") * c("p") + c("d") * c("r")).alias("c"), (c("c") * c("q") + c("d") * c("s")).alias("d"),
            (c("a") * c("ix") + c("b") * c("iy") + c("tx")).alias("tx"), (c("c") * c("ix") + c("d") * c("iy") + c("ty")).alias("ty"),
        ))
        if not front.limit(1).count():
            break
    placed = reduce(DataFrame.union, levels)
    x, y = F.col("x"), F.col("y")
    return placed.join(members, "block").select("root", "depth", "id", (F.col("a") * x + F.col("b") * y + F.col("tx")).alias("px"), (F.col("c") * x + F.col("d") * y + F.col("ty")).alias("py"))


def flattened_totals(roots: DataFrame, inserts: DataFrame, members: DataFrame, depth: int = 8) -> DataFrame:
    """(root, depth, n, sum_x, sum_y): how many members ``flattened`` places for each root at each depth, and the sums of their places.

    Sums of composed maps are the composed sums of maps, so all ways from a
    root to a block go on as one row, and there are never more rows than
    roots times blocks, however many ways there are.
    """
    cos, sin = F.cos(F.radians("rotation")), F.sin(F.radians("rotation"))
    total = lambda v, n: F.sum(v).alias(n)
    steps = cut(inserts.groupBy("block", "child").agg(F.count("*").alias("m"), total("x", "ix"), total("y", "iy"), total(F.col("sx") * cos, "p"), total(-F.col("sy") * sin, "q"), total(F.col("sx") * sin, "r"), total(F.col("sy") * cos, "s")))
    own = cut(members.groupBy("block").agg(F.count("*").alias("m"), total("x", "mx"), total("y", "my")))
    front = roots.groupBy("root", "block").agg(F.count("*").alias("k"))
    front = cut(front.select("root", "block", "k", *[(F.col("k") * F.lit(v)).alias(n) for n, v in (("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 1.0), ("tx", 0.0), ("ty", 0.0))]))
    levels, c = [], F.col
    for n in range(depth + 1):
        levels.append(front.withColumn("depth", F.lit(n)))
        if n == depth:
            break
        front = cut(front.join(steps, "block").groupBy("root", F.col("child").alias("block")).agg(
            total(c("k") * c("m"), "k"),
            total(c("a") * c("p") + c("b") * c("r"), "a"), total(c("a") * c("q") + c("b") * c("s"), "b"), total(c("c") * c("p") + c("d") * c("r"), "c"), total(c("c") * c("q") + c("d") * c("s"), "d"),
            total(c("a") * c("ix") + c("b") * c("iy") + c("tx") * c("m"), "tx"), total(c("c") * c("ix") + c("d") * c("iy") + c("ty") * c("m"), "ty"),
        ))
        if not front.limit(1).count():
            break
    placed = reduce(DataFrame.union, levels).join(own, "block")
    sums = [total(c(u) * c("mx") + c(v) * c("my") + c(t) * c("m"), "sum_" + n) for u, v, t, n in (("a", "b", "tx", "x"), ("c", "d", "ty", "y"))]
    return placed.groupBy("root", "depth").agg(total(c("k") * c("m"), "n"), *sums)


def text_layers(layers: DataFrame, span: int = 8, suffix: str = "_TEXT") -> DataFrame:
    """(handle, text_handle): layers with a layer of their name and the suffix within ``span`` handles; the nearest, then the smaller handle."""
    base = layers.select("handle", F.upper("name").alias("key"))
    text = base.where(F.col("key").endswith(suffix)).select(F.col("handle").alias("text_handle"), F.expr(f"left(key, length(key) - {len(suffix)})").alias("key"))
    near = base.join(text, "key").withColumn("gap", F.abs(F.col("handle") - F.col("text_handle"))).where(F.col("gap").between(1, span))
    return near.groupBy("handle").agg(F.min(F.struct("gap", "text_handle")).alias("m")).select("handle", "m.text_handle")
