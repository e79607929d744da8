"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged

BY_ID = 2  # rounds in which a vertex moves to its least neighbour; stars, the usual case, need no more


def components(edges: DataFrame) -> DataFrame:
    """Columns a, b of any one orderable type -> vertex, component (the least vertex of its component).

    Every round maps each vertex to the first vertex of its closed neighbourhood and contracts the edges. "First"
    is by value at the start and by a hash that changes per round later, so that long chains halve each round
    whatever their ids. All steps are aggregates with partial results and joins with a table of one row per
    vertex, both written before they meet, so hubs are split by the join. Edges with a null end are ignored;
    loops make their vertex a component; no edges give no rows.
    """
    edges = edges.select("a", "b").dropna()
    cur = staged(edges.distinct())
    steps, k = [], 0
    while not cur.isEmpty():
        ends = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(k)) if k >= BY_ID else F.lit(0).cast("long")).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        first = ends.groupBy("a").agg(F.min(rank("b")).alias("m"))
        first = staged(first.select("a", F.least(F.col("m"), rank("a")).getField("v").alias("p")))
        steps.append(first)
        other = first.select(F.col("a").alias("b"), F.col("p").alias("q"))
        cur = staged(cur.join(first, "a").join(other, "b").filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
        k += 1
    if not steps:
        return edges.select(F.col("a").alias("vertex"), F.col("a").alias("component")).limit(0)
    labels = steps[0].select(F.col("a").alias("vertex"), F.col("p").alias("at"))
    for step in steps[1:]:
        labels = labels.join(step, labels["at"] == step["a"], "left").select("vertex", F.coalesce("p", "at").alias("at"))
    labels = staged(labels)
    least = staged(labels.groupBy("at").agg(F.min("vertex").alias("component")))
    return labels.join(least, "at").select("vertex", "component")
