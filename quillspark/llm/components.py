"""Connected components of a graph given as edges, by alternating large and small stars.

Every round is joins and aggregations with map-side partials; no group is collected. Rounds are written to the
shared folder, so lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import compact, discard, stored

LINKS_PER_TASK = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of a node's neighbours to the least of them and itself: of the larger neighbours, or of the others."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.join(least, "u")
    if large:
        new = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return new.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges``: columns u, v (long, no nulls). One row (node, root) per node that has an edge; root: the least node.

    The result is stored; ``discard`` it when it isn't needed any more.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark, left = None, now.count()
    while True:
        # few links need few tasks and files, whatever the shuffle was set up for
        after = stored(compact(_star(_star(now, True), False), left, LINKS_PER_TASK), name)
        discard(now)
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (seen.n, seen.s) == mark:
            out = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.scratch_path = after.scratch_path
            return out
        mark, left, now = (seen.n, seen.s), seen.n, after
