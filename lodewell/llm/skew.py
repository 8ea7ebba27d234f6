"""Tables addressed by document id: whole texts are moved once, and only where a row asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.plans import skew


def fetch(docs: DataFrame, wanted: DataFrame, key: str, rows: int) -> DataFrame:
    """docs joined to wanted on key; wanted has `rows` rows, a counted number.

    Where few rows are wanted, their ids are broadcast to pick the documents before these are shuffled.
    """
    if rows <= skew.BROADCAST_ROWS:
        docs = docs.join(F.broadcast(wanted.select(key).distinct()), key, "left_semi")
    return docs.join(wanted, key)
