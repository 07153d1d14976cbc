"""Roots of a forest given by parent links, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.session import materialise


def roots_of(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, root) for every id of ``nodes``; ``parents`` has (id, parent), at most one row an id, without cycles.

    Each round doubles the distance jumped, so a chain of d links takes log2(d) rounds;
    every round is one join of the links with themselves, written to the shared folder.
    """
    links = parents.select("id", F.col("parent").alias("root"))
    while True:
        step = links.alias("x").join(links.alias("y"), F.col("x.root") == F.col("y.id"), "left")
        jumped = materialise(step.select(F.col("x.id").alias("id"), F.coalesce(F.col("y.root"), F.col("x.root")).alias("root"), F.col("y.root").isNotNull().alias("moved")), "forest")
        moved = jumped.where("moved").limit(1).count()
        links = jumped.select("id", "root")
        if not moved:
            break
    return nodes.join(links, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
