"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> node, component (the smallest node reachable).  Each round every node points to the neighbour,
    itself included, that comes first; nodes become what they point to and edges within a point vanish.  Rounds go by the
    nodes' own order (which settles stars around a smallest node at once) and by an order drawn anew in turn, so that
    long chains take about the logarithm of their length; hubs are aggregated map side, never gathered.  The rounds'
    points are followed in one job at the end."""
    kind = edges.schema["a"].dataType
    live = save(edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).where("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        turn = len(rounds)
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.xxhash64(c, F.lit(turn)) if turn % 2 else F.lit(0).cast("long")  # noqa: B023, E731
        first = lambda c: F.struct(order(c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        points = save(both.groupBy("a").agg(F.least(F.min(first("b")), F.first(first("a")))["n"].alias("p")).select(F.col("a").alias("node"), "p"), "points")
        rounds.append(points)
        pa, pb = points.select(F.col("node").alias("a"), F.col("p").alias("pa")), points.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        live = save(live.join(pa, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    at = rounds[0]
    for k, points in enumerate(rounds[1:], 1):
        moved = at.select("node", F.col("p").alias("old")).join(points.withColumnRenamed("node", "old"), "old", "left")
        at = moved.select("node", F.coalesce("p", "old").alias("p"))
        if k % 8 == 0:
            at = save(at, "at")
    least = at.groupBy("p").agg(F.least(F.min("node"), F.col("p")).alias("component"))
    return save(at.join(least, "p").select("node", "component"), "components")
