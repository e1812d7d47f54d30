"""Proximity joins and clusters by grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import merged
from plumbline.session import cut


def _cells(df: DataFrame, lo: str, hi: str, size: float, margin: float, name: str) -> DataFrame:
    cell = lambda c, d: F.floor((F.col(c) + d) / size)
    return df.withColumn(name, F.explode(F.sequence(cell(lo, -margin), cell(hi, margin))))


def nearby_layer(points: DataFrame, boxes: DataFrame, dx: float = 1600.0, dy: float = 900.0) -> DataFrame:
    """(id, layer_handle, score): the layer that scores most around each point; of equal ones the smaller handle.

    Each box (layer_handle, min_x, max_x, min_y, max_y, weight) within dx and dy
    adds its weight and up to 6 for its nearness along either axis. A box
    meets a point in the one cell of the grid that the point is in, so the join
    is an equi-join and no pair is met twice.

    A layer's boxes of a cell come as one row, so a pair of point and layer has
    its whole score where it is met: maxima leave the join, not pairs. Only
    pairs of ids that name several points are summed up by a shuffle.
    """
    b = _cells(_cells(boxes, "min_x", "max_x", dx, dx, "__cx"), "min_y", "max_y", dy, dy, "__cy")
    box = F.struct("min_x", "max_x", "min_y", "max_y", "weight")
    # sorted, so that a layer's sum is the same whenever it is worked out
    b = b.groupBy("__cx", "__cy", "layer_handle").agg(F.min(box).alias("__box"), F.sort_array(F.collect_list(box)).alias("__boxes"), F.count("*").alias("__n"))
    b = b.select("__cx", "__cy", "layer_handle", "__box.*", F.when(F.col("__n") > 1, F.col("__boxes")).alias("__boxes"))
    gap = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
    near = lambda c, a, m, z: F.when(c <= a, 6).when(c <= m, 3).when(c <= z, 1).otherwise(0)

    def one(get):
        x, y = gap(F.col("x"), get("min_x"), get("max_x")), gap(F.col("y"), get("min_y"), get("max_y"))
        return F.when((x <= dx) & (y <= dy), get("weight") + near(x, 100, 400, 900) + near(y, 80, 250, 600))

    each = F.filter(F.transform("__boxes", lambda v: one(lambda c: v[c])), lambda s: s.isNotNull())
    several = F.when(F.size(each) > 0, F.aggregate(F.slice(each, 2, F.size("__boxes")), F.element_at(each, 1), lambda t, s: t + s))

    def met(p: DataFrame) -> DataFrame:
        p = p.withColumn("__cx", F.floor(F.col("x") / dx)).withColumn("__cy", F.floor(F.col("y") / dy))
        return p.join(b, ["__cx", "__cy"]).withColumn("__s", F.when(F.col("__boxes").isNull(), one(F.col)).otherwise(several)).where("__s is not null")

    ids = points.groupBy("id").agg(F.count("*").alias("__k"), F.min("x").alias("x"), F.min("y").alias("y"))
    top = met(ids.where("__k = 1").select("id", "x", "y")).groupBy("id", "x", "y").agg(F.max("__s").alias("score"))
    alone = met(top).where("__s = score").groupBy("id", "x", "y").agg(F.min("layer_handle").alias("layer_handle"), F.max("score").alias("score")).select("id", "layer_handle", "score")
    some = ids.where("__k > 1").select(F.col("id").alias("__i"))
    by = met(points.join(some, F.col("id").eqNullSafe(F.col("__i")), "left_semi")).groupBy("id", "layer_handle").agg(F.sum("__s").alias("score"))
    best = by.groupBy("id").agg(F.max("score").alias("__m")).withColumnRenamed("id", "__i")
    tied = by.join(best, F.col("id").eqNullSafe(F.col("__i")) & (F.col("score") == F.col("__m")))
    return alone.union(tied.groupBy("id").agg(F.min("layer_handle").alias("layer_handle"), F.max("score").alias("score")))


#: Pairs of points that are compared one by one, for each point, before pairs of boxes are split further.
COMPARED = 16
#: Splits of a cell before what is still open is compared point by point.
SPLITS = 20


def _boxes(points: DataFrame, level: int) -> DataFrame:
    """The cells' parts of 1 / 2 ** level of their side, with their bounds, size and one of their points."""
    part = lambda c: F.floor(F.col(c) * float(2**level)).alias("i" + c)
    bounds = [f(c).alias(n) for c in "xy" for f, n in ((F.min, "lo" + c), (F.max, "hi" + c))]
    return points.groupBy("cell", part("u"), part("v")).agg(*bounds, F.min(F.struct("x", "y")).alias("one"), F.count("*").alias("n"))


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + side) for c in df.columns])


def clusters(points: DataFrame, radius: float) -> DataFrame:
    """(id, cluster): points linked within ``radius``; a cluster is named by its smallest id.

    Points of one cell of side radius / sqrt 2 are always linked, so they meet
    as one node. Pairs of cells are told by their bounds and by one point of
    each; those that are neither linked so, nor by way of others, nor too far
    are split into parts, and points are compared where few pairs are left.
    """
    size = radius / 2**0.5
    p = points.select("id", "x", "y", (F.col("x") / size).alias("u"), (F.col("y") / size).alias("v")).withColumns({"cx": F.floor("u"), "cy": F.floor("v")})
    cells = p.groupBy("cx", "cy").agg(F.min("id").alias("cell"))
    p = cut(p.join(cells, ["cx", "cy"]).select("id", "x", "y", "u", "v", "cell"))
    rows, square = p.count(), radius * radius
    labels = cut(p.select(F.col("cell").alias("node")).distinct().withColumn("label", F.col("node")))
    boxes = cut(_boxes(p, 0))
    step = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    to = boxes.select("cell", "iu", "iv").withColumn("du", step).withColumn("dv", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    to = to.select(F.col("cell").alias("cell2"), F.col("iu").alias("iu2"), F.col("iv").alias("iv2"), (F.col("iu") + F.col("du")).alias("iu"), (F.col("iv") + F.col("dv")).alias("iv"))
    pair = boxes.select("cell", "iu", "iv").join(to, ["iu", "iv"]).where("cell < cell2").select("cell", "iu", "iv", "cell2", "iu2", "iv2")
    for level in range(SPLITS + 1):
        told = pair.join(boxes, ["cell", "iu", "iv"]).join(_sided(boxes, "2"), ["cell2", "iu2", "iv2"])
        c = F.col
        gap = lambda v: F.greatest(c(f"lo{v}2") - c(f"hi{v}"), c(f"lo{v}") - c(f"hi{v}2"), F.lit(0.0))
        span = lambda v: F.greatest(c(f"hi{v}2") - c(f"lo{v}"), c(f"hi{v}") - c(f"lo{v}2"))
        dx, dy = c("one.x") - c("one2.x"), c("one.y") - c("one2.y")
        near = (span("x") * span("x") + span("y") * span("y") <= square) | (dx * dx + dy * dy <= square)
        told = cut(told.where(gap("x") * gap("x") + gap("y") * gap("y") <= square).select("cell", "iu", "iv", "cell2", "iu2", "iv2", (c("n") * c("n2")).alias("work"), near.alias("near")))
        labels = merged(labels, told.where("near").select("cell", "cell2").distinct(), "cell", "cell2")
        own = labels.select(F.col("node").alias("cell"), F.col("label").alias("l1"))
        own2 = labels.select(F.col("node").alias("cell2"), F.col("label").alias("l2"))
        pair = cut(told.where("not near").join(own, "cell").join(own2, "cell2").where("l1 <> l2").select("cell", "iu", "iv", "cell2", "iu2", "iv2", "work"))
        work = pair.agg(F.sum("work")).first()[0] or 0
        if not work:
            break
        few = pair.select("cell").union(pair.select("cell2")).distinct()
        rest = p.join(few, "cell", "left_semi")
        if work <= COMPARED * rows or level == SPLITS:
            part = rest.select("cell", F.floor(c("u") * float(2**level)).alias("iu"), F.floor(c("v") * float(2**level)).alias("iv"), "x", "y")
            both = pair.join(part, ["cell", "iu", "iv"]).join(_sided(part, "2"), ["cell2", "iu2", "iv2"])
            dx, dy = c("x") - c("x2"), c("y") - c("y2")
            labels = merged(labels, cut(both.where(dx * dx + dy * dy <= square).select("cell", "cell2").distinct()), "cell", "cell2")
            break
        boxes = cut(_boxes(rest, level + 1))
        half = boxes.select("cell", F.shiftright("iu", 1).alias("pu"), F.shiftright("iv", 1).alias("pv"), "iu", "iv")
        up = pair.select("cell", c("iu").alias("pu"), c("iv").alias("pv"), "cell2", c("iu2").alias("pu2"), c("iv2").alias("pv2"))
        pair = up.join(half, ["cell", "pu", "pv"]).join(_sided(half, "2"), ["cell2", "pu2", "pv2"]).select("cell", "iu", "iv", "cell2", "iu2", "iv2")
    return p.join(labels.withColumnRenamed("node", "cell"), "cell").select("id", F.col("label").alias("cluster"))
