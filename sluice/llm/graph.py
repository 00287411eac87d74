"""Connected components of an edge table by contraction; nothing comes to the driver but whether a round left edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Steps along pointers in a round, all in one job: chains of JUMPS + 1 nodes collapse at once, longer ones over more rounds.
JUMPS = 3


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """id, root (the least id reachable) of all ends of edges (a, b).

    In each round every node points to its least neighbour, or itself; pointers are followed; nodes become what they
    point to, and edges within one node go. Each round at least halves the nodes that still have edges, and edges shrink
    faster, so later rounds cost little. Labels are pre-aggregated before each shuffle; joins have tables on both sides,
    so hot nodes are split over tasks.
    """
    todo = ws.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-edges-0")
    labels, at, i, read = None, "", 0, [f"{name}-edges-0"]
    while labels is None or not todo.isEmpty():
        i += 1
        down = todo.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "id")
        ends = todo.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id"))
        steps = ws.save(down.unionByName(ends).groupBy("id").agg(F.min("root").alias("root")), f"{name}-{i}-steps")
        points = steps
        for j in range(JUMPS):
            far = steps.select(F.col("id").alias(f"_{j}"), F.col("root").alias("far"))
            points = points.join(far, F.col("root") == F.col(f"_{j}")).select("id", F.col("far").alias("root"))
        points = ws.save(points, f"{name}-{i}-points")
        to = lambda c: points.select(F.col("id").alias(f"_{c}"), F.col("root").alias(f"new_{c}"))  # noqa: B023,E731
        moved = todo.join(to("a"), F.col("a") == F.col("_a")).join(to("b"), F.col("b") == F.col("_b")).select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
        todo = ws.save(moved.filter("a <> b").distinct(), f"{name}-edges-{i}")
        read += [f"{name}-{i}-steps", f"{name}-edges-{i}"]
        if labels is None:
            labels, at = points, f"{name}-{i}-points"
        else:
            new = points.select(F.col("id").alias("_r"), F.col("root").alias("far"))
            read += [at, f"{name}-{i}-points"]
            at = f"{name}-labels-{i}"
            labels = ws.save(labels.join(new, F.col("root") == F.col("_r"), "left").select("id", F.coalesce("far", "root").alias("root")), at)
    for table in read:
        ws.drop(table)
    return labels
