"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.session import reliable_checkpoint

#: Links a task holds, about; a link table is small beside the corpus and would else be spread over as many
#: tasks, each with files of its own in every round.
LINKS_PER_TASK = 200_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Each node hands its larger (or its smaller) neighbours to the least node it knows."""
    if large:
        seen = edges.union(edges.select("parent", "child")).toDF("node", "other")
    else:
        seen = edges.toDF("node", "other")
    least = seen.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    joined = seen.join(least, "node")
    if large:
        moved = joined.where(F.col("other") > F.col("node")).select(F.col("other").alias("child"), F.col("least").alias("parent"))
    else:
        moved = joined.select(F.col("other").alias("child"), F.col("least").alias("parent")).union(least.toDF("child", "parent"))
    return moved.where("child != parent").coalesce(tasks).distinct().coalesce(tasks)


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either a parent or the child of one parent."""
    ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("parent", F.lit(0), F.lit(1)))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (columns a, b; any order, repeats allowed): root is the
    least node reachable. Nodes without links do not appear; NULL ends are ignored.

    A hub's rows are split by adaptive skew handling, since every step is an aggregate with
    map-side minima or a join. Each round is checkpointed.
    """
    edges = links.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    edges = reliable_checkpoint(edges.dropna().where("child != parent").distinct())
    tasks = max(1, edges.count() // LINKS_PER_TASK)
    edges = edges.coalesce(tasks)
    while not _is_stars(edges):
        edges = reliable_checkpoint(_star(_star(edges, True, tasks), False, tasks))
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("root")).union(
        edges.select("parent", "parent").distinct()
    )
