"""Running totals within keys of which one may hold a third of all rows.

Rows are dealt into ranges of (key, order), so that a large key spans many
partitions; each partition takes its own running totals, and the totals of a
key's earlier partitions are added. No task ever holds a whole key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut


def deal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` in ranges of keys and order, written once, with the range in ``__part``."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))


def totals(dealt: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[Callable, Callable, Column]]) -> DataFrame:
    """``dealt`` with a running total for each name in ``values``: (aggregate, how two of its results add up, input).

    The aggregate must also take its own results, as a sum or a XOR does.
    """
    part = ["__part", *keys]
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.select("*", *[agg(value).over(local).alias(f"__own_{n}") for n, (agg, _, value) in values.items()])
    whole = dealt.groupBy(*part).agg(*[agg(value).alias(f"__all_{n}") for n, (agg, _, value) in values.items()])
    # one row for each key and range: a key's earlier ranges
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = whole.select(*[F.col(c).alias(f"__k_{c}") for c in part], *[agg(f"__all_{n}").over(before).alias(f"__before_{n}") for n, (agg, _, _) in values.items()])
    on = own["__part"] == earlier["__k___part"]
    for k in keys:
        on = on & own[k].eqNullSafe(earlier[f"__k_{k}"])
    sums = [F.coalesce(add(F.col(f"__before_{n}"), F.col(f"__own_{n}")), F.col(f"__own_{n}")).alias(n) for n, (_, add, _) in values.items()]
    return own.join(earlier, on).select(*dealt.columns, *sums)
