"""Joins in which a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of ids and numbers are broadcast up to this many rows (a few MB).
BROADCAST_ROWS = 200_000
#: Keys with fewer rows than this are never taken apart.
HOT_ROWS = 1000


def hot_limit(total: int) -> int:
    """Rows from which a key counts as hot: of `total` rows no more than BROADCAST_ROWS / 2 keys can have that many."""
    return max(HOT_ROWS, -(-2 * total // BROADCAST_ROWS))


def hot_join(rows: DataFrame, table: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """rows with the columns of table, which has one row for each key and in column n the number of rows with that key.

    Both hold every key. Hot keys, few by `hot_limit` whatever the data, are broadcast and their rows stay where
    they are; the others meet by a shuffle. total is the number of rows, counted.
    """
    limit = hot_limit(total)
    hot = F.broadcast(table.where(F.col(n) > limit).drop(n))
    cold = table.where(F.col(n) <= limit).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(cold, key))
