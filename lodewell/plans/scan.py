"""Folds along an order within keys, where one key may hold most of the rows.

Rows are dealt into ranges of (key, order) once and written, so that a range and its number stay what they are. Each range is
folded alone; what passes from one to the next is one row for each key and range, met by a window over these; a second look
at the ranges adds what came before. No task holds more than a range, whatever the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.plans.storage import materialize

PART = "_part"


def dealt(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows with the number of their range; ranges follow each other in the order of (keys, order).

    Rows that are equal in keys and order lie in one range. `parts` of them; by default as many as a shuffle has.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right for its key and range; null keys meet null keys."""
    names = {k: f"_key_{i}" for i, k in enumerate([*keys, PART])}
    other = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in names])
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    met = left.join(other, on, "left")
    return met.drop(*names.values())


def before(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column]) -> DataFrame:
    """dealt rows with, for each name, the column's value in the row before of the same key, null for the first; _first tells which that is."""
    w = Window.partitionBy(*keys, PART).orderBy(*order)
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    marked = rows.withColumn("_own", values).withColumn("_lag", F.lag("_own").over(w)).withColumn("_nth", F.row_number().over(w))
    last = rows.withColumn("_own", values).groupBy(*keys, PART).agg(F.max_by("_own", F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy(PART))).drop("_last")
    met = _same(marked, carried, keys)
    value = F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_lag"))
    return met.select(*rows.columns, *[value[n].alias(n) for n in columns], value.isNull().alias("_first"))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """dealt rows with the sum of value over the rows of the same key up to and with this one, in order."""
    w = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_sum", F.sum(value).over(w))
    per = rows.groupBy(*keys, PART).agg(F.sum(value).alias("_all"))
    upto = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.withColumn("_carried", F.coalesce(F.sum("_all").over(upto), F.lit(0))).drop("_all")
    met = _same(own, carried, keys)
    return met.select(*rows.columns, (F.col("_sum") + F.coalesce("_carried", F.lit(0))).alias(name))
