"""Object records: duplicate handles, delta coding, names by position, handle allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_max_offset(objects: DataFrame) -> DataFrame:
    """(handle, off): of records that repeat a handle the one with the highest offset."""
    return objects.groupBy("handle").agg(F.max("off").alias("off"))


#: What a repeated record scores: for a type, a size, its class, its own or another decoded handle, and for one or two neighbouring layer records.
TYPED, SIZED, CLASSED, OWN, FOREIGN, LAYERS = 32, 8, {"ENTITY": 16, "OBJECT": -8}, 10000, -5000, {1: 6000, 2: 12000}
#: The type code of a layer record, how near in offset a neighbour must be, and the score of a record that can't be parsed.
LAYER_CODE, NEARBY, UNPARSED = 0x33, 256, -536870912


def by_score(objects: DataFrame) -> DataFrame:
    """(handle, off, score): of records that repeat a handle the best one, and of equal ones the later; ``score`` is null where a handle has one record.

    objects (handle, off, type_code, data_size, class, decoded_handle,
    parsed_ok). A layer record gains by layer records of the handle before and
    the one after, if these repeat too and lie within ``NEARBY`` of its offset.
    Neighbours meet by handle and stretch of offsets, so no handle's records
    are compared pair by pair.
    """
    many = objects.groupBy("handle").agg(F.count("*").alias("__n"))
    df = objects.join(many, "handle")
    layer = df.where((F.col("__n") > 1) & F.col("parsed_ok") & (F.col("type_code") == LAYER_CODE)).select("handle", "off").distinct()
    stretch = F.floor(F.col("off") / NEARBY)
    near = layer.withColumn("__side", F.explode(F.array(F.lit(-1), F.lit(1))))
    near = near.select((F.col("handle") + F.col("__side")).alias("handle"), "__side", F.col("off").alias("__o"), F.explode(F.sequence(stretch - 1, stretch + 1)).alias("__s"))
    met = layer.withColumn("__s", stretch).join(near, ["handle", "__s"]).where(F.abs(F.col("off") - F.col("__o")) <= NEARBY)
    bonus = met.groupBy("handle", "off").agg(F.countDistinct("__side").alias("__m"))
    df = df.join(bonus, ["handle", "off"], "left")
    score = F.when(F.col("type_code") != 0, TYPED).otherwise(0) + F.when(F.col("data_size") > 0, SIZED).otherwise(0)
    for name, n in CLASSED.items():
        score = score + F.when(F.col("class") == name, n).otherwise(0)
    decoded = F.col("decoded_handle")
    score = score + F.when(decoded == F.col("handle"), OWN).when(decoded != 0, FOREIGN).otherwise(0)
    layers = F.when(F.col("type_code") == LAYER_CODE, F.when(F.col("__m") == 2, LAYERS[2]).when(F.col("__m") == 1, LAYERS[1]).otherwise(0)).otherwise(0)
    score = F.when(F.col("__n") > 1, F.when(F.col("parsed_ok"), score + layers).otherwise(UNPARSED))
    return df.withColumn("score", score).groupBy("handle").agg(F.max(F.struct("score", "off")).alias("best")).select("handle", "best.off", "best.score")


def deltas(rows: DataFrame, part: str | None, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``d_<column>``: the step from the row before, the first from 0."""
    w = Window.partitionBy(*([part] if part else [])).orderBy(*order)
    return rows.select("*", *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(f"d_{c}") for c in columns])


def undelta(rows: DataFrame, part: str | None, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with each ``d_<column>`` summed up to ``<column>``."""
    w = Window.partitionBy(*([part] if part else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.sum(f"d_{c}").over(w).alias(c) for c in columns])


def zipped(names: DataFrame, handles: DataFrame, part: str, by: str) -> DataFrame:
    """Names and handles of a group put together by their places; what one side lacks stays away."""
    n = names.withColumn("__i", F.row_number().over(Window.partitionBy(part).orderBy("off")))
    h = handles.withColumn("__i", F.row_number().over(Window.partitionBy(part).orderBy(by)))
    return h.join(n.select(part, "__i", "name"), [part, "__i"]).drop("__i")


def numbered(blocks: DataFrame, part: str, prefixes: tuple[str, ...] = ("*D", "*U", "*T")) -> DataFrame:
    """Bare anonymous names get numbers in handle order, one count for all prefixes, passing over numbers in use."""
    bare = blocks.where(F.col("name").isin(*prefixes))
    used = blocks.select(part, F.expr("try_cast(regexp_extract(name, '^[*][A-Z]([0-9]+)$', 1) as int)").alias("n")).where("n is not null").distinct()
    ranked = bare.withColumn("i", F.row_number().over(Window.partitionBy(part).orderBy("handle")))
    # the i-th free number: i plus the used numbers u with u - rank(u) < i
    gaps = used.withColumn("gap", F.col("n") - F.row_number().over(Window.partitionBy(part).orderBy("n")))
    gaps = gaps.groupBy(part, "gap").count().select(F.col(part).alias("__p"), "gap", "count")
    skip = ranked.join(gaps, (ranked[part] == gaps["__p"]) & (F.col("gap") < F.col("i")), "left").groupBy(ranked[part], "handle", "name", "i").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("skip"))
    return skip.select(part, "handle", F.concat("name", (F.col("i") + F.col("skip")).cast("string")).alias("name"))


def sequential_names(blocks: DataFrame, part: str, least: int = 4) -> DataFrame:
    """(part, handle, name): BLOCK names renumbered by offset in parts that hold at least ``least`` of them with a repeated number; all other names stay."""
    number = F.expr("try_cast(regexp_extract(name, '^BLOCK([0-9]+)$', 1) as int)")
    df = blocks.withColumn("__n", number)
    guard = df.where("__n is not null").groupBy(part).agg(F.count("*").alias("__c"), F.countDistinct("__n").alias("__d")).where((F.col("__c") >= least) & (F.col("__d") < F.col("__c"))).select(part, F.lit(True).alias("__fix"))
    place = F.row_number().over(Window.partitionBy(part, F.col("__n").isNull()).orderBy("off", "handle"))
    df = df.join(guard, part, "left").withColumn("__i", place)
    return df.select(part, "handle", F.when(F.col("__fix") & F.col("__n").isNotNull(), F.concat(F.lit("BLOCK"), F.col("__i").cast("string"))).otherwise(F.col("name")).alias("name"))


def allocated(rows: DataFrame, part: str, used: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``new_handle``: the free handles of a part in ascending order, passing over ``used`` (part, handle)."""
    ranked = rows.withColumn("__i", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    taken = used.select(part, F.col("handle").alias("__u")).distinct()
    gaps = taken.withColumn("__gap", F.col("__u") - F.row_number().over(Window.partitionBy(part).orderBy("__u")))
    w = Window.partitionBy(part).orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, 0)
    # the i-th free handle is i plus the used ones with gap < i: merge both sides in order and count
    left = ranked.select(part, F.col("__i").alias("__at"), F.lit(1).alias("__row"), *[F.col(c) for c in rows.columns if c != part])
    right = gaps.select(part, (F.col("__gap") + 1).alias("__at"), F.lit(0).alias("__row"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__skip", F.sum(1 - F.col("__row")).over(w))
    return both.where("__row = 1").select(*rows.columns, (F.col("__at") + F.col("__skip")).alias("new_handle"))


def layer_table(colours: DataFrame, names: DataFrame) -> DataFrame:
    """(handle, name, color_index, true_color): the full union of colour and name rows, the first of each handle."""
    c = colours.groupBy("handle").agg(F.min(F.struct("color_index", "true_color")).alias("__c"))
    n = names.groupBy("handle").agg(F.min("name").alias("name"))
    bad = F.col("name").isNull() | (F.col("name") == "") | F.col("name").rlike(r'[\x00-\x1F<>/\\":;?*=|]')
    df = c.join(n, "handle", "full_outer")
    return df.select("handle", F.when(bad, F.concat(F.lit("LAYER_"), F.hex("handle"))).otherwise(F.col("name")).alias("name"), "__c.color_index", "__c.true_color")
