"""Connected components by alternating large and small stars."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder of spark.checkpoint.dir.

    Where no folder is set (tests), one of our own is."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


#: Edges to a partition between rounds: a small graph isn't dealt over files by the hundred each time.
PART_EDGES = 100_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges point to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.coalesce(parts).distinct().coalesce(parts)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of an undirected edge list; component is its least id.

    Loops and repeated edges do no harm; nulls are left out; no edges give no rows. Each round
    at least halves the distance to the least node, so rounds go with the logarithm of the
    longest path. Only counts come to the driver.
    """
    work = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    work = checkpointed(work)
    parts = max(1, -(-work.count() // PART_EDGES))
    work = work.coalesce(parts)
    mark = None
    for _ in range(max_rounds):
        work = checkpointed(_small_star(_large_star(work, parts), parts))
        now = work.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    nodes = edges.select(F.explode(F.array(a, b)).alias("id")).where("id is not null").distinct()
    return nodes.join(work.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
