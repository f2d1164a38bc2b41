"""Connected components of an edge table, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._common import discard, saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return ``(node, component)`` for every end of an edge; component is the least node reachable.

    Each round hooks every node to its least neighbour, follows the hooks four steps,
    renames the edge ends and drops what became a loop. All state is in tables; aggregates are
    partial, so a hub costs one row for each task, and hub joins can be split by AQE.
    """
    left = saved(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        "edges",
    )
    names = None
    while True:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        hook = saved(hook, "hook")
        for _ in range(2):
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            hook = saved(hook.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "hook")
        if names is None:
            names = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            older = names
            names = saved(names.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "names")
            discard(older)
        hu = hook.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        hv = hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        right = (
            left.join(hu, "u").join(hv, "v").filter("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        )
        right = saved(right, "edges")
        discard(left)
        left = right
        if left.isEmpty():
            return names.select("node", F.col("root").alias("component"))
