"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.plans.skew import hot_limit
from lodewell.plans.storage import discard, materialize


def _state(edges: DataFrame) -> tuple:
    """(edges, digest, most edges of an upper end, most edges of a lower end), in one job."""
    digest = F.xxhash64("a", "b").cast("decimal(20,0)")
    ends = edges.select(F.col("a").alias("x"), F.lit(0).alias("side"), digest.alias("d")).union(edges.select("b", F.lit(1), F.lit(0).cast("decimal(20,0)")))
    per = ends.groupBy("x", "side").agg(F.count("*").alias("n"), F.sum("d").alias("d"))
    most = [F.max(F.when(F.col("side") == k, F.col("n"))) for k in (0, 1)]
    return tuple(per.agg(F.sum(F.when(F.col("side") == 0, F.col("n"))), F.sum("d"), *most).first())


def _with_low(edges: DataFrame, low: DataFrame, end: str, n: int, most: int) -> DataFrame:
    """edges with the column m of low (node, m), null where low has no such node, met on this end.

    The nodes with very many edges, if there are any, are so few that their rows of low are broadcast, and
    their edges are not moved.
    """
    low = low.withColumnRenamed("node", end)
    if most <= hot_limit(n):
        return edges.join(low, end, "left")
    hubs = edges.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") > hot_limit(n)).select(end)
    known = F.broadcast(hubs.join(low, end, "left").withColumn("hub", F.lit(True)))
    marked = edges.join(known, end, "left")
    rest = marked.where("hub is null").select("a", "b").join(low, end, "left")
    return marked.where("hub").select("a", "b", "m").unionByName(rest.select("a", "b", "m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another node; component is the smallest node reachable.

    Edges point from the larger node a to the smaller b. Each round is two aggregations and two joins, never a
    neighbour list: first every a moves to the smallest neighbour of its b, then all b of an a to the smallest of
    them. Hubs are met by broadcasts of a bounded size. Rounds end when the edge set no longer changes; a set
    of stars ends after one. Self-loops and nulls are ignored, repeated edges count once; without edges the
    result is empty.
    """
    a, b = F.col(src), F.col(dst)
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = materialize(now, "edges")
    seen = _state(now)
    for _ in range(max_rounds if seen[0] else 0):
        n, _, most_a, most_b = seen
        low = now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        large = _with_low(now, low, "b", n, most_b).select("a", F.coalesce("m", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        met = _with_low(large, low, "a", n, most_a)
        small = met.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        old, now = now, materialize(small, "edges")
        discard(old)
        if (then := _state(now))[:2] == seen[:2]:
            break
        seen = then
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
