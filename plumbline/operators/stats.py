"""Aggregates over entities: counts, modes, bounds, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def top(rows: DataFrame, by: str, value: str, order: str, n: int) -> DataFrame:
    """(by, value, n, place): the ``n`` most common values of each group; of equal ones the first seen."""
    c = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "__first")
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("__first")


def mode(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, value): the most common value of each group; of equal ones the first seen."""
    c = rows.groupBy(by, value).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    return c.groupBy(by).agg(F.max_by(value, F.struct("__n", -F.col("__first"))).alias(value))


def gaps(declared: DataFrame, decoded: DataFrame, by: str) -> DataFrame:
    """(by, declared, decoded, gap): two counts side by side, with what one side lacks as 0."""
    a, b = declared.groupBy(by).agg(F.count("*").alias("declared")), decoded.groupBy(by).agg(F.count("*").alias("decoded"))
    return a.join(b, by, "full_outer").fillna(0, ["declared", "decoded"]).withColumn("gap", F.col("declared") - F.col("decoded"))


def bounds(rows: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return rows.groupBy(*by).agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.count("*").alias("n"))


def robust_bounds(rows: DataFrame, by: list[str], x: str = "x", y: str = "y", least: int = 16, ratio: float = 1.6) -> DataFrame:
    """Bounds of each group; those between the 2nd and 98th percentile where at least ``least`` points reach ``ratio`` times as far in either direction."""
    df = rows.groupBy(*by).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{n}") for n, c in (("x", x), ("y", y)) for k, f in (("min", F.min), ("max", F.max), ("lo", lambda v: F.percentile(v, 0.02)), ("hi", lambda v: F.percentile(v, 0.98)))])
    wide = [(F.col(f"max_{n}") - F.col(f"min_{n}")) >= ratio * (F.col(f"hi_{n}") - F.col(f"lo_{n}")) for n in "xy"]
    use = (F.col("n") >= least) & (wide[0] | wide[1])
    return df.select(*by, use.alias("robust"), *[F.when(use, F.col(f"{q}_{n}")).otherwise(F.col(f"{k}_{n}")).alias(f"{k}_{n}") for n in "xy" for k, q in (("min", "lo"), ("max", "hi"))])


def lone_long_lines(lines: DataFrame, by: str, p: float = 0.75) -> DataFrame:
    """Lines (handle, x1, y1, x2, y2) whose ends no other line of the group shares, that run along an axis and are at least as long as the ``p`` percentile of such lines."""
    key = lambda x, y: F.struct(F.bround(x, 6).alias("x"), F.bround(y, 6).alias("y"))
    df = lines.withColumn("__a", key("x1", "y1")).withColumn("__b", key("x2", "y2")).withColumn("length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    ends = df.select(by, F.explode(F.array("__a", "__b")).alias("__e")).groupBy(by, "__e").count().where("count = 1").drop("count")
    one = lambda e: ends.withColumnRenamed("__e", e)
    lone = df.where((F.abs(F.col("x2") - F.col("x1")) <= 1e-9) | (F.abs(F.col("y2") - F.col("y1")) <= 1e-9)).join(one("__a"), [by, "__a"], "left_semi").join(one("__b"), [by, "__b"], "left_semi")
    limit = lone.groupBy(by).agg(F.percentile("length", p).alias("limit"))
    return lone.join(limit, by).where(F.col("length") + 1e-9 >= F.col("limit")).select("handle", by, "length")


def concentric(circles: DataFrame, by: list[str], radius: str = "r") -> DataFrame:
    """(…, handle, ratio): the largest circle of each centre if it is 2 to 4 times the second; ties go to the smaller handle."""
    w = Window.partitionBy(*by).orderBy(F.desc(radius), "handle")
    df = circles.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead(radius).over(w))
    return df.where((F.col("__n") == 1) & (F.col("__next") > 0)).withColumn("ratio", F.col(radius) / F.col("__next")).where("ratio between 2 and 4").select(*by, "handle", "ratio")


def best_definition(members: DataFrame, name: str, definition: str, order: str) -> DataFrame:
    """(name, definition): of several definitions of a name the one with most members, then most that aren't points, then the first."""
    c = members.groupBy(name, definition).agg(F.count("*").alias("n"), F.count_if(F.col("dxftype") != "POINT").alias("__np"), F.min(order).alias("__first"))
    return c.groupBy(name).agg(F.max_by(F.struct(definition, "n"), F.struct("n", "__np", -F.col("__first"))).alias("d")).select(name, f"d.{definition}", "d.n")


def endpoint_degree(lines: DataFrame, by: str) -> DataFrame:
    """(by, x, y, degree): how many ends of lines (x1, y1, x2, y2) lie at each place, to six digits."""
    end = lambda k: F.struct(F.bround(f"x{k}", 6).alias("x"), F.bround(f"y{k}", 6).alias("y"))
    return lines.select(by, F.inline(F.array(end(1), end(2)))).groupBy(by, "x", "y").agg(F.count("*").alias("degree"))
