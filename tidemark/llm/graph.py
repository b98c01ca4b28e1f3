"""Connected components of an edge table, by DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage_table


def connected(edges: DataFrame) -> DataFrame:
    """``v``, ``root`` (smallest vertex of its component) for the vertices of ``edges`` (columns a, b).

    Each round every vertex takes the smallest root among its neighbours, then its root's
    root; rounds end when nothing changes, after about the logarithm of the longest path.
    Each round's table is written to the shared folder, so no round recomputes another."""
    both = stage_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = stage_table(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots, both.b == roots.v).groupBy(F.col("a").alias("v")).agg(F.min("root").alias("low"))
        step = roots.join(near, "v").select("v", F.least("root", "low").alias("next"), "root")
        jump = step.select(F.col("v").alias("u"), F.col("next").alias("up"))
        new = stage_table(step.join(jump, step.next == jump.u).select(
            "v", F.least("next", "up").alias("root"), (F.least("next", "up") != F.col("root")).alias("changed")), "roots")
        roots = new.select("v", "root")
        if new.where("changed").isEmpty():
            return roots
